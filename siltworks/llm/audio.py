"""Audio features of media columns.

A clip (RIFF/WAVE bytes: PCM of 8, 16, 24 or 32 bits, or 32-bit floats; channels are averaged) is resampled to ``RATE`` by a
polyphase windowed-sinc filter, cut into overlapping frames (``WINDOW`` samples every ``HOP``), and turned into log-mel energies.
Segments with sound come from frame energies by hysteresis: a run above the lower threshold counts if it reaches the upper
one; both lie above the clip's noise floor, its tenth percentile. The result has one row for every ``FRAMES`` frames of the
whole clip: a tensor of fixed shape (FRAMES, MELS), its time span, and the segments within the span.

Spark has no tensor type: the column is array<float> in row-major order whose field metadata names the Arrow extension
type and shape, and ``as_tensors`` gives collected or read tables the true ``arrow.fixed_shape_tensor`` column.

Defined cases: null bytes, bytes that aren't such a clip, and clips without a sample or with a rate outside 100 to
768,000 Hz give one row with null features and ``ok`` false; a clip shorter than a frame is padded with silence to one;
frames past the end hold the floor value; repeated rows give equal rows; long clips are taken whole, and give as many
chunks as they need; an empty table gives no rows; extra columns don't matter; ids may be of any type.
"""

from __future__ import annotations

import functools
import json
import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

RATE, WINDOW, HOP, FFT, MELS, FRAMES = 16_000, 400, 160, 512, 40, 48
FLOOR = 1e-10
ON_DB, OFF_DB, QUIET_DB = 12.0, 6.0, -60.0
ZEROS = 8
SHAPE = (FRAMES, MELS)


def wav(samples: np.ndarray, rate: int) -> bytes:
    """One channel of 16-bit PCM."""
    data = samples.astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(data)) + data


def decode(raw: bytes | None) -> tuple[np.ndarray, int] | None:
    """Samples in -1..1 and rate, or None."""
    if not raw or len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None
    at, form, data = 12, None, None
    while at + 8 <= len(raw):
        kind, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if kind == b"fmt " and size >= 16 and at + 24 <= len(raw):
            form = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif kind == b"data":
            data = raw[at + 8 : at + 8 + size]
            break
        at += 8 + size + size % 2
    if form is None or data is None or not form[1] or not 100 <= form[2] <= 768_000:
        return None
    tag, channels, rate, _, _, bits = form
    if tag not in (1, 3, 0xFFFE) or bits not in (8, 16, 24, 32) or (tag == 3 and bits != 32):
        return None
    step = channels * bits // 8
    data = data[: len(data) // step * step]
    if not data:
        return None
    if tag == 3:
        x = np.nan_to_num(np.frombuffer(data, "<f4").astype(np.float64), posinf=0.0, neginf=0.0)
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
    else:
        x = np.frombuffer(data, f"<i{bits // 8}").astype(np.float64) / 2.0 ** (bits - 1)
    return x.reshape(-1, channels).mean(axis=1), rate


@functools.lru_cache(64)
def phases(up: int, down: int) -> tuple[np.ndarray, int]:
    """(up, taps) filters, one for each phase, and the samples before the centre. Each phase's weights add up to 1."""
    cutoff = min(1.0, up / down)
    half = math.ceil(ZEROS / cutoff)
    k = np.arange(-half + 1, half + 1)
    t = k[None, :] - np.arange(up)[:, None] / up
    w = np.where(np.abs(t) < half, np.cos(np.pi * t / (2 * half)) ** 2, 0)
    f = np.sinc(t * cutoff) * w
    return f / f.sum(axis=1, keepdims=True), half - 1


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Polyphase resampling by up / down; output m lies at input time m * down / up, silence around the clip."""
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    if up == down:
        return x
    filters, before = phases(up, down)
    taps = filters.shape[1]
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(before), x, np.zeros(taps)])
    out = np.empty(n)
    view = np.lib.stride_tricks.sliding_window_view(padded, taps)
    for p in range(min(up, n)):  # outputs p, p + up, ... share a phase, and lie ``down`` inputs apart
        first, phase = divmod(p * down, up)
        own = view[first::down][: len(range(p, n, up))]
        out[p::up] = own @ filters[phase]
    return out


@functools.lru_cache(4)
def mel_weights(mels: int = MELS, size: int = FFT, rate: int = RATE) -> np.ndarray:
    """(bins, mels) triangles, equally spaced on the mel scale from 0 to half the rate."""
    mel = lambda f: 2595 * np.log10(1 + np.asarray(f) / 700)
    hz = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.arange(size // 2 + 1) * rate / size
    up = (f[:, None] - hz[:-2]) / (hz[1:-1] - hz[:-2])
    down = (hz[2:] - f[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(up, down))


_HANN = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log energies and each frame's level in decibels."""
    if len(x) < WINDOW:
        x = np.concatenate([x, np.zeros(WINDOW - len(x))])
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    mel, level = np.empty((len(frames), MELS), np.float32), np.empty(len(frames))
    for lo in range(0, len(frames), 4096):
        f = frames[lo : lo + 4096]
        power = np.abs(np.fft.rfft(f * _HANN, FFT)) ** 2
        mel[lo : lo + 4096] = np.log(np.maximum(power @ mel_weights(), FLOOR))
        level[lo : lo + 4096] = 10 * np.log10(np.maximum((f * f).mean(axis=1), FLOOR))
    return mel, level


def hysteresis(level: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frame behind the last) of each segment with sound."""
    floor = max(float(np.sort(level)[(len(level) - 1) // 10]), QUIET_DB)
    # a clip with sound from end to end has no quiet tenth: thresholds are at most 6 and 12 dB under its peak
    low = min(floor + OFF_DB, max(float(level.max()) - ON_DB, QUIET_DB))
    high = min(floor + ON_DB, max(float(level.max()) - OFF_DB, QUIET_DB + OFF_DB))
    on = np.concatenate([[False], level >= low, [False]])
    starts, ends = np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(~on[1:] & on[:-1])
    return [(int(s), int(e)) for s, e in zip(starts, ends) if (level[s:e] >= high).any()]


def features(raw: bytes | None) -> list[tuple[int, float, float, int, np.ndarray, list[tuple[float, float]]]]:
    """(chunk, start, end, valid frames, tensor, segments) of a clip; none where it isn't one. Times are seconds."""
    clip = decode(raw)
    if clip is None:
        return []
    x = resample(*clip)
    mel, level = log_mel(x)
    runs = [(s * HOP / RATE, ((e - 1) * HOP + WINDOW) / RATE) for s, e in hysteresis(level)]
    total, out = len(x) / RATE, []
    for c in range(-(-len(mel) // FRAMES)):
        part = mel[c * FRAMES : (c + 1) * FRAMES]
        tensor = np.full(SHAPE, np.float32(math.log(FLOOR)), np.float32)
        tensor[: len(part)] = part
        start = c * FRAMES * HOP / RATE
        end = max(total, start) if (c + 1) * FRAMES >= len(mel) else (c + 1) * FRAMES * HOP / RATE
        spans = [(max(a, start), min(b, end)) for a, b in runs if a < end and b > start]
        out.append((c, start, end, len(part), tensor, spans))
    return out


def _chunks(column: pa.Array, most: int = 512):
    """(clip numbers, chunks) of at most ``most`` chunks each."""
    at, rows = [], []
    for i, raw in enumerate(column):
        for r in features(raw.as_py()) or [(None,) * 6]:
            at.append(i)
            rows.append(r)
            if len(rows) == most:
                yield at, rows
                at, rows = [], []
    if rows:
        yield at, rows


_SEGMENT = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
METADATA = {"ARROW:extension:name": "arrow.fixed_shape_tensor", "ARROW:extension:metadata": json.dumps({"shape": list(SHAPE)})}


def extract(media: DataFrame, id_column: str = "media_id", audio_column: str = "audio") -> DataFrame:
    """(id, ok, chunk, start_s, end_s, frames, mel, segments): the features of every clip, in chunks."""
    light = pick(media, id_column, audio_column).toDF("id", "audio").withColumn("audio", F.col("audio").cast("binary"))

    def run(batches):
        for batch in batches:
            # a clip's chunks may go out in several batches, so that offsets and memory stay bounded however long it is
            for at, rows in _chunks(batch.column("audio")):
                part = batch
                chunk, start, end, frames, tensor, spans = zip(*rows) if rows else ((),) * 6
                flat = [t for t in tensor if t is not None]
                sizes = np.cumsum([0, *[0 if t is None else t.size for t in tensor]]).astype(np.int32)
                none = np.array([t is None for t in tensor], bool)
                mel = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([t.ravel() for t in flat]) if flat else np.zeros(0, np.float32)), mask=pa.array(none))
                segments = pa.array([None if s is None else [{"start": a, "end": b} for a, b in s] for s in spans], _SEGMENT)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at, pa.int64())), pa.array(~none), pa.array(chunk, pa.int32()), pa.array(start, pa.float64()), pa.array(end, pa.float64()), pa.array(frames, pa.int32()), mel, segments], ["id", "ok", "chunk", "start_s", "end_s", "frames", "mel", "segments"])

    kind = light.schema["id"].dataType.simpleString()
    out = light.mapInArrow(run, f"id {kind}, ok boolean, chunk int, start_s double, end_s double, frames int, mel array<float>, segments array<struct<start:double,end:double>>")
    return out.withMetadata("mel", METADATA).withColumnRenamed("id", id_column)


def as_tensors(table: pa.Table, column: str = "mel") -> pa.Table:
    """An Arrow table whose ``column`` has the fixed-shape tensor type; null lists stay null."""
    kind, size = pa.fixed_shape_tensor(pa.float32(), SHAPE), FRAMES * MELS

    def convert(lists: pa.Array) -> pa.Array:
        none = lists.is_null().to_numpy(zero_copy_only=False)
        values = np.zeros((len(lists), size), np.float32)
        values[~none] = lists.drop_null().flatten().to_numpy().reshape(-1, size)
        return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), size, mask=pa.array(none)))

    chunks = [convert(c) for c in table.column(column).cast(pa.list_(pa.float32())).chunks]
    return table.set_column(table.schema.get_field_index(column), pa.field(column, kind), pa.chunked_array(chunks, kind))


TONE_RATES = (8_000, 16_000, 22_050, 44_100)


def render(vectors: DataFrame, seconds: float = 0.5) -> DataFrame:
    """(media_id, audio): a clip for each row of (vec_id, embedding), as there is no table of recordings.

    The vector's values are the amplitudes of a row of partials; the middle fifth is silent; the rate follows from the id.
    """
    def run(batches):
        bases: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                audio = []
                for i, v in zip(part.column("vec_id").to_pylist(), part.column("embedding").to_pylist()):
                    if v is None or not v or None in v:
                        audio.append(None)
                        continue
                    rate = TONE_RATES[(i or 0) % len(TONE_RATES)]
                    if (rate, len(v)) not in bases:
                        t = np.arange(int(seconds * rate)) / rate
                        quiet = (t > 0.4 * seconds) & (t < 0.6 * seconds)
                        bases[rate, len(v)] = np.sin(2 * np.pi * (110 + 45 * np.arange(len(v)))[:, None] * t) * ~quiet
                    audio.append(wav(np.clip(np.round(np.array(v) @ bases[rate, len(v)] * 8000), -32768, 32767), rate))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(audio, pa.binary())], ["media_id", "audio"])

    light = pick(vectors, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    return light.mapInArrow(run, "media_id long, audio binary")
