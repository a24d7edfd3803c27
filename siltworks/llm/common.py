"""Shared plumbing: tables in the shared folder, row identity, size-checked joins, Arrow text access."""

from __future__ import annotations

import ctypes
import tempfile
import unicodedata
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has at most this many rows (of a few dozen bytes each).
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made, and only under a local master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siltworks-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/siltworks-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that nothing will read any more."""
    _delete(df.sparkSession, df.stored_at)


def release(spark: SparkSession) -> None:
    """Delete this application's tables in the shared folder, once no result that reads them is needed."""
    _delete(spark, shared_dir(spark))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, each once (the first, where a name occurs twice); absent ones become null strings.

    Columns are taken by position, so that extra or clashing names in the input can't make a reference ambiguous.
    """
    have = [c.lower() for c in df.columns]
    plain = df.toDF(*[f"c{i}" for i in range(len(have))])
    return plain.select(*[(F.col(f"c{have.index(n.lower())}") if n.lower() in have else F.lit(None).cast("string")).alias(n) for n in names])


def positional(df: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """``df`` with its columns renamed ``c0, c1, ...``, and the columns of the given names in it (null strings where absent).

    What is added to it under other names can't clash with the input's; ``toDF(*df.columns)`` gives the names back.
    """
    have = [c.lower() for c in df.columns]
    plain = df.toDF(*[f"c{i}" for i in range(len(have))])
    return plain, [F.col(f"c{have.index(n.lower())}") if n.lower() in have else F.lit(None).cast("string") for n in names]


def kind_of(df: DataFrame, name: str) -> str:
    """A column's type as DDL, for a schema that carries it on (a column of nulls alone counts as strings)."""
    kind = df.schema[name].dataType.simpleString()
    return "string" if kind == "void" else kind


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was found small; else as it is, for a shuffled join. ``df`` should be stored."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def row_hash(*names: str):
    """64-bit content hash of the named columns; with the id it identifies a row."""
    return F.xxhash64(*[F.col(n) for n in names])


def less_rows(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """``keyed`` (see ``positional``; with key columns k0, k1, ...) less the rows whose key is in ``keys``, compared null-safely."""
    on = keys.columns
    k = small(keys.toDF(*[f"other{i}" for i in range(len(on))]))
    cond = F.lit(True)
    for i in range(len(on)):
        cond = cond & F.col(f"k{i}").eqNullSafe(F.col(f"other{i}"))
    return keyed.join(k, cond, "left_anti")


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def trimmed(run):
    """``run`` over a task's batches; then freed memory goes back to the system, since the Python worker lives on."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        _trim()

    return whole


def _trim() -> None:
    _TRIM(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a string array, and the n + 1 offsets into them; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def portions(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 19, rows: int = 4096):
    """Slices of a batch with about ``most`` bytes of text and at most ``rows`` rows each (a longer single text comes alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, base + most, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, vectorised."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_CODE_VALUE = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(_BASE))
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, 1 << 19)
        inv = pow(_BASE, -1, 1 << 64)
        grow = lambda b: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]))
        _POWERS, _INVERSE = grow(np.uint64(_BASE)), grow(np.uint64(inv))
    return _POWERS[:n], _INVERSE[:n]


def slice_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each slice of bytes or code points, independent of where the slice lies."""
    p, inv = powers(len(codes) + 1)
    far = codes.dtype != np.uint8 and len(codes) and codes.max() >= 1 << 16
    value = mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)) if far else _CODE_VALUE[codes]
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(value * p[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


# kinds of signs
OTHER, LETTER, ALONE, BLANK, LINE, STOP, FULL_STOP, CLOSING = range(8)
#: Scripts written without spaces: each sign counts as a word.
_UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)]


def _sign_tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of each code point of the basic plane."""
    kind, low = np.zeros(1 << 16, np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        x = chr(c)
        cat = unicodedata.category(x)
        if cat[0] in "LNM":
            kind[c] = LETTER
            y = x.lower()
            if len(y) == 1:
                low[c] = ord(y)
        elif x.isspace():
            kind[c] = BLANK
        elif cat in ("Pe", "Pf") or x in "\"'":
            kind[c] = CLOSING
    for a, b in _UNSPACED:
        part = kind[a : b + 1]
        part[part == LETTER] = ALONE
    kind[[10, 11, 12, 13, 0x85, 0x2028, 0x2029]] = LINE
    kind[[ord(x) for x in ".!?…؟۔।॥։።"]] = STOP
    kind[[ord(x) for x in "。！？｡．"]] = FULL_STOP
    return kind, low


_KIND, _LOW = _sign_tables()


class Words(NamedTuple):
    """The words of some texts. ``codes`` holds all code points in one, ``at`` the texts' n + 1 offsets into them."""

    codes: np.ndarray
    kind: np.ndarray
    at: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all values of a string array, and the n + 1 offsets into them; nulls count as empty."""
    data, at = utf8(column)
    if not len(data) or data.max() < 128:
        return data, at
    try:
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le", "surrogatepass"), np.uint32)
    except UnicodeDecodeError:  # a value that isn't UTF-8: replacement signs stand for what can't be read
        texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(at[:-1], at[1:])]
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, texts)])
    before = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return codes, before[at].astype(np.int64)


def words(column: pa.Array) -> Words:
    """Words are runs of letters, digits and marks, hashed in lower case; signs of unspaced scripts are words by themselves."""
    codes, at = code_points(column)
    none = np.zeros(0, np.int64)
    if not len(codes):
        return Words(codes, np.zeros(0, np.uint8), at, none, none, none, np.zeros(0, np.uint64))
    far = None
    low = codes
    if codes.dtype != np.uint8 and codes.max() >= 1 << 16:
        far = codes >= 1 << 16
        low = np.where(far, 0, codes)
    kind = _KIND[low]
    folded = _LOW[low]
    if far is not None:
        kind[far] = np.where(codes[far] >= 0x20000, ALONE, LETTER)
        folded[far] = codes[far]
    inside = (kind == LETTER) | (kind == ALONE)
    first = inside.copy()
    first[1:] &= ~((kind[1:] == LETTER) & (kind[:-1] == LETTER))
    cut = at[:-1][at[:-1] < len(codes)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(at, starts, side="right") - 1
    return Words(codes, kind, at, row, starts, ends, slice_hashes(folded, starts, ends))
