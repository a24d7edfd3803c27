"""Byte-level BPE: encoding with vectorised pre-tokenisation, and decoding.

Pre-tokens are those of the usual byte-level pattern (contractions; letters, numbers or other signs, each with one space before;
white space, of which the last sign is left to what follows). Their starts are found without a regular expression:
every code point gets a class from an array, refined by its neighbours (which apostrophes could begin a contraction, which
white space ends its run); each class is a function on the eight states of a small automaton; those functions compose
associatively, so a blocked scan over a table of all their products gives the state at the head of every block at once, and
a second sweep the state before every code point. State and class tell whether a token starts there.

Slices between starts go through a cache to pair merging, so each distinct slice is merged once in a worker (the cache
is emptied when full, which changes no result). Byte offsets of all tokens are kept: they give any token range's bytes.

Defined cases: null text gives null ids and offsets, empty text empty ones; repeated rows and extra columns don't matter; a piece
with several merges of one rank joins the leftmost; very long texts are never cut, and a batch's texts never touch each other;
an empty table gives no rows; ids may be of any type, and their column of any name.
"""

from __future__ import annotations

import array
import base64
import heapq
import os
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kind_of, pick, portions, utf8

#: Where the vocabulary file lies, unless a path is passed on.
VOCABULARY = os.environ.get("SILTWORKS_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
CACHE = 400_000
BLOCK = 64

# symbols
L, N, O, A2, A3, P, W, V = range(8)
RESET = 8
# states
CLOSED, IN_L, IN_N, IN_O, SPACE, IN_V, LEFT1, LEFT2 = range(8)
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, sym: int) -> tuple[int, bool]:
    """(next state, whether a token starts here)."""
    if sym >= RESET:
        state, sym = CLOSED, sym - RESET
    if sym == L and state in (LEFT1, LEFT2):
        return (CLOSED if state == LEFT1 else LEFT1), False
    joined = state == SPACE
    if sym == L:
        return IN_L, not (joined or state == IN_L)
    if sym == N:
        return IN_N, not (joined or state == IN_N)
    if sym in (O, A2, A3):
        if joined or state == IN_O:
            return IN_O, False
        return {O: IN_O, A2: LEFT1, A3: LEFT2}[sym], True
    if sym == P:
        return SPACE, True
    if sym == W:
        return CLOSED, True
    return IN_V, state != IN_V


def _tables():
    step = np.array([[_step(s, a)[0] for a in range(16)] for s in range(8)], np.uint8)
    start = np.array([[_step(s, a)[1] for a in range(16)] for s in range(8)], bool)
    maps: dict[tuple, int] = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    letters = [tuple(int(step[s, a]) for s in range(8)) for a in range(16)]
    while todo:  # all products of the symbols' functions
        f = todo.pop()
        for g in letters:
            fg = tuple(g[x] for x in f)
            if fg not in maps:
                maps[fg] = len(maps)
                todo.append(fg)
    function = np.array(list(maps), np.uint8)
    m = len(maps)
    compose = np.array([[maps[tuple(int(g[x]) for x in f)] for g in function] for f in function], np.uint16)
    return step, start, function, compose, np.array([maps[g] for g in letters], np.uint16), m


_STEP, _START, _FUNCTION, _COMPOSE, _LETTER_OF, _M = _tables()
_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    global _CLASS
    if _CLASS is None:
        kind = {"L": L, "N": N}
        _CLASS = np.array([kind.get(unicodedata.category(chr(c))[0], O) for c in range(sys.maxunicode + 1)], np.uint8)
        _CLASS[_WHITE] = V
    return _CLASS


def _scan(sym: np.ndarray) -> np.ndarray:
    """State before every symbol."""
    n = len(sym)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = sym
    upright = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    whole = _LETTER_OF[upright[0]]
    flat = _COMPOSE.ravel()
    for row in upright[1:]:
        whole = flat[whole * np.uint16(_M) + _LETTER_OF[row]]
    # inclusive scan of the blocks' functions by doubling
    span = 1
    while span < blocks:
        tail = flat[whole[:-span] * np.uint16(_M) + whole[span:]]
        whole = np.concatenate([whole[:span], tail])
        span *= 2
    state = np.empty(blocks, np.uint8)
    state[0] = CLOSED
    state[1:] = _FUNCTION[whole[:-1], CLOSED]
    out = np.empty((BLOCK, blocks), np.uint8)
    step = _STEP.ravel()
    for j in range(BLOCK):
        out[j] = state
        state = step[(state << np.uint8(4)) | upright[j]]
    return out.T.reshape(-1)[:n]


def token_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte offsets where pre-tokens start, in the concatenated UTF-8 of texts with offsets ``at``."""
    if not len(data):
        return np.zeros(0, np.int64)
    char = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    sym = _classes()[code]
    n = len(code)
    head = np.searchsorted(char, at[:-1][at[1:] > at[:-1]])
    first = np.zeros(n + 1, bool)
    first[head] = True
    first[n] = True
    white = sym == V
    # white space before something else in its text
    ends = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:-1])
    sym[ends] = np.where(code[ends] == 32, P, W)
    for a in np.flatnonzero(code == 39):
        if a + 1 < n and not first[a + 1]:
            x = code[a + 1]
            if x in (115, 116, 109, 100):
                sym[a] = A2
            elif a + 2 < n and not first[a + 2]:
                y = code[a + 2]
                if (x == 114 and y == 101) or (x == 118 and y == 101) or (x == 108 and y == 108):
                    sym[a] = A3
    sym[head] += RESET
    state = _scan(sym)
    return char[_START.ravel()[(state << np.uint8(4)) | sym]]


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    """Tokens and ranks of a vocabulary file with lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one slice: again and again the pair of least rank, leftmost first, is joined."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= 40:
        parts = [piece[i : i + 1] for i in range(n)]
        rank = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(n - 1)]
        while rank:
            best = min(rank)
            if best == 1 << 60:
                break
            i = rank.index(best)
            parts[i] += parts.pop(i + 1)
            del rank[i]
            if i < len(rank):
                rank[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                rank[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    live = bytearray(b"\1") * n
    while heap:
        _, i, e = heapq.heappop(heap)
        j = after[i] if live[i] else n
        if not live[i] or j >= n or end[j] != e:
            continue
        live[j], end[i], after[i] = 0, e, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : e])) is not None:
            heapq.heappush(heap, (r, before[i], e))
    return [ranks[piece[i : end[i]]] for i in range(n) if live[i]]


class Encoder(dict):
    """Slice -> number in tables of token ids; a missing slice is merged and added."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.by_rank = {r: len(t) for t, r in ranks.items()}
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.ids = array.array("i")
        self.first = array.array("q", [0])

    def __missing__(self, piece: bytes) -> int:
        self.ids.extend(merge(piece, self.ranks))
        self.first.append(len(self.ids))
        k = self[piece] = len(self.first) - 2
        return k

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, byte offset of each within its text, and the texts' offsets into the ids."""
        starts = token_starts(data, at)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        if len(self) > CACHE:
            self._reset()
        pieces = np.insert(data, starts, 255).tobytes().split(b"\xff")[1:]
        which = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        ids, first = np.frombuffer(self.ids, np.int32).copy(), np.frombuffer(self.first, np.int64).copy()
        count = first[which + 1] - first[which]
        cum = np.cumsum(count)
        flat = np.repeat(first[which] - (cum - count), count) + np.arange(cum[-1])
        out = ids[flat]
        sizes = self.sizes()[out]
        offset = np.cumsum(sizes) - sizes
        head = np.concatenate([[0], cum])[np.searchsorted(starts, at)]
        return out, (offset - np.repeat(at[:-1], np.diff(head))).astype(np.int32), head

    def sizes(self) -> np.ndarray:
        if not hasattr(self, "_sizes"):
            self._sizes = np.zeros(max(self.by_rank) + 1, np.int64)
            self._sizes[list(self.by_rank)] = list(self.by_rank.values())
        return self._sizes


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        tokens = [b""] * len(self.size)
        for t, r in ranks.items():
            tokens[r] = t
            self.size[r] = len(t)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.first = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """UTF-8 bytes of the ids, all in one."""
        size = self.size[ids]
        cum = np.cumsum(size)
        if not len(ids):
            return np.zeros(0, np.uint8)
        return self.bytes[np.repeat(self.first[ids] - (cum - size), size) + np.arange(cum[-1])]


_WORKER: dict[str, tuple[Encoder, Decoder]] = {}


def _worker(key: str, shared) -> tuple[Encoder, Decoder]:
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = (Encoder(shared.value), Decoder(shared.value))
    return _WORKER[key]


def _lists(values: np.ndarray, head: np.ndarray, nulls: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(head.astype(np.int32)), pa.array(values), mask=pa.array(nulls))


def encode(docs: DataFrame, path: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids, offsets, exact): token ids, their byte offsets, and whether decoding them gives the text again."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(path))

    def run(batches):
        encoder, decoder = _worker(path, shared)
        for batch in batches:
            for part in portions(batch, "text", 1 << 20):
                text = part.column("text")
                nulls = text.is_null().to_numpy(zero_copy_only=False)
                data, at = utf8(text)
                ids, offsets, head = encoder.encode(data, at)
                back = decoder.decode(ids)
                size = np.concatenate([[0], np.cumsum(decoder.size[ids])])[head]
                same = np.array_equal(size, at) and np.array_equal(back, data)
                if same:
                    exact = np.ones(len(text), bool)
                else:
                    exact = np.array([back[size[i] : size[i + 1]].tobytes() == data[at[i] : at[i + 1]].tobytes() for i in range(len(text))])
                yield pa.RecordBatch.from_arrays([part.column("id"), _lists(ids, head, nulls), _lists(offsets, head, nulls), pa.array(exact, mask=nulls)], ["id", "ids", "offsets", "exact"])

    light = pick(docs, id_column, text_column).toDF("id", "text")
    return light.mapInArrow(run, f"id {kind_of(light, 'id')}, ids array<int>, offsets array<int>, exact boolean").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str = VOCABULARY, id_column: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids). Ids that don't form UTF-8 are decoded with replacement signs."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        _, decoder = _worker(path, shared)
        for batch in batches:
            lists = batch.column("ids")
            texts = []
            for x in lists:
                texts.append(None if not x.is_valid else decoder.decode(x.values.to_numpy(zero_copy_only=False)).tobytes().decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    light = pick(encoded, id_column, "ids").toDF("id", "ids")
    return light.mapInArrow(run, f"id {kind_of(light, 'id')}, text string").withColumnRenamed("id", id_column)
