"""SimHash near-duplicate removal with bit-sliced Hamming comparison.

Fingerprint: 256 signs of a weighted sum over a text's distinct words (weight 2) and distinct pairs of neighbouring words
(weight 1), in lower case; so every word counts, and so does their order. Signs of scripts without spaces are words. A text of
fewer than two words gets bits of its whole content instead, and so equals exact copies alone.

Search: every distinct fingerprint is put in ``tables`` buckets, each keyed by ``bits`` sampled bit positions. ``bits`` grows with
the logarithm of the number of fingerprints, so that buckets keep their size, and there are as many tables as give two
fingerprints that differ in ``RADIUS`` bits a common bucket with probability ``RECALL``, at any size of the input. Within
a bucket all members are compared, without a cap, by bit planes: 64 fingerprints lie side by side in the 256 words of a
block; a query's bit flips a plane, and carry-save adders sum the planes into bit-sliced counters, so that one operation
advances 64 distances. After each portion of planes, the (query, block) pairs in which every lane has exceeded the
radius are abandoned. Connected components of the found pairs are the groups; a fingerprint is its own node.

Hot buckets (a family of like texts) aren't compared in one task: see ``hot_edges``.

Defined cases: null text is never compared and always stays; equal texts, empty ones too, are copies of each other;
rows with one doc_id and text are one document, of which the row that sorts first by a hash of all its columns stays; the
kept document of a group is that with the least doc_id (null last), then the least content hash; very long texts are
taken whole; an empty table gives no rows; extra columns pass through, whatever their names; ids may be of any type.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kind_of, less_rows, mix, pick, portions, positional, row_hash, slice_hashes, small, stored, trimmed, utf8, words
from .components import connected_components

BITS = 256
RADIUS = 44
#: Share of the pairs at the radius that meet in some bucket, however many fingerprints there are; closer pairs meet more surely.
RECALL = 0.97
#: Unrelated fingerprints that a bucket holds on average.
PER_BUCKET = 128
#: Buckets expected to hold more are split over tasks. The results are the same.
HOT = 50_000
#: A hot bucket's members in one block.
BLOCK = 16_384
WORD_WEIGHT, PAIR_WEIGHT = 2, 1
_SALTS = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_TIE = np.unpackbits(mix(_SALTS).view(np.uint8)) == 1
#: Spreads the bits of a byte over the bytes of a word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def _add(total: np.ndarray, weight: np.ndarray, row: np.ndarray, h: np.ndarray, times: int) -> None:
    """Add ``times`` the bits of each row's distinct hashes to ``total`` (rows, BITS), and their number to ``weight``."""
    if not len(row):
        return
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    row = (key >> np.uint64(40)).astype(np.int64)
    bounds = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    ends = np.append(bounds[1:], len(row))
    weight[row[bounds]] += times * (ends - bounds)
    lo = 0
    while lo < len(bounds):  # some thousand words at once, to stay in cache
        hi = max(lo + 1, int(np.searchsorted(ends, bounds[lo] + 16384, side="right")))
        for a in range(bounds[lo], ends[hi - 1], 1 << 16):
            b = min(a + (1 << 16), ends[hi - 1])
            lanes = _LANES[mix((key[a:b, None] & np.uint64((1 << 40) - 1)) ^ _SALTS).view(np.uint8)]
            for k in range(lo, hi):
                for s in range(max(bounds[k], a), min(ends[k], b), 255):  # a lane of 8 bits holds 255 ones
                    total[row[bounds[k]]] += times * np.add.reduce(lanes[s - a : min(s + 255, ends[k], b) - a], axis=0).view(np.uint8).astype(np.int32)
        lo = hi


def fingerprints(column: pa.Array) -> np.ndarray:
    """(n, 32) bytes, one fingerprint for each text."""
    n = len(column)
    w = words(column)
    total, weight = np.zeros((n, BITS), np.int32), np.zeros(n, np.int64)
    bare = np.bincount(w.row, minlength=n) < 2
    _add(total, weight, w.row, w.hash, WORD_WEIGHT)
    joined = w.row[1:] == w.row[:-1]
    _add(total, weight, w.row[1:][joined], mix(w.hash[:-1][joined] * np.uint64(3) + w.hash[1:][joined]), PAIR_WEIGHT)
    half = weight[:, None]
    out = np.packbits((2 * total > half) | ((2 * total == half) & _TIE), axis=1)
    if bare.any():
        data, at = utf8(column)
        k = np.flatnonzero(bare)
        whole = slice_hashes(data, at[k], at[k + 1])
        out[k] = mix(whole[:, None] ^ _SALTS[::-1]).view(np.uint8).reshape(len(k), -1)
    return out


def plan(n: int, recall: float = RECALL, radius: int = RADIUS, per_bucket: int = PER_BUCKET) -> tuple[int, int]:
    """(bits, tables) for n fingerprints: about ``per_bucket`` unrelated ones in a bucket, and as many tables as the recall needs."""
    bits = min(BITS, max(8, round(math.log2(max(n, 2) / per_bucket))))
    # a table's bit positions are drawn without repetition
    hit = math.prod((BITS - radius - i) / (BITS - i) for i in range(bits))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def _positions(bits: int, tables: int) -> np.ndarray:
    """Bit positions of each table; whole permutations are used up in turn, so that all bits serve alike."""
    rng = np.random.default_rng(20_261)
    need = bits * tables
    flat = np.concatenate([rng.permutation(BITS) for _ in range(need // BITS + 2)])
    out, at = [], 0
    while len(out) < tables:
        take = flat[at : at + bits]
        at += bits
        if at + bits > len(flat):
            flat, at = np.concatenate([flat[at:], rng.permutation(BITS), rng.permutation(BITS)]), 0
        if len(set(take.tolist())) == bits:
            out.append(take)
    return np.array(out)


def bucket_keys(fp: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """(n, tables) keys of fingerprints."""
    bit = np.unpackbits(fp, axis=1)
    out = np.empty((len(fp), len(positions)), np.uint64)
    for t, p in enumerate(positions):
        sub = np.packbits(bit[:, p], axis=1)
        wide = np.zeros((len(fp), max(8, (sub.shape[1] + 7) // 8 * 8)), np.uint8)
        wide[:, : sub.shape[1]] = sub
        h = np.full(len(fp), (t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for w in wide.view(np.uint64).T:
            h = mix(h ^ w)
        out[:, t] = h
    return out


def planes_of(fp: np.ndarray, block: np.ndarray, lane: np.ndarray, blocks: int) -> np.ndarray:
    """(BITS, blocks) bit planes: bit ``lane`` of word [p, block] is bit p of the fingerprint put there."""
    slots = np.zeros((blocks * 64, BITS // 8), np.uint8)
    slots[block * 64 + lane] = fp
    bit = np.unpackbits(slots, axis=1).reshape(blocks, 64, BITS)
    upright = np.packbits(np.ascontiguousarray(bit.transpose(2, 0, 1)), axis=2, bitorder="little")
    return np.ascontiguousarray(upright).view(np.uint64).reshape(BITS, blocks)


def sliced_compare(query_bits: np.ndarray, planes: np.ndarray, q: np.ndarray, k: np.ndarray, live: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Lanes (as bits) of block k[i] within ``radius`` of query q[i], for all i at once.

    query_bits: (BITS, queries) words, all ones where the bit is set. live: the lanes of each pair to look at. Eight planes
    go through a carry-save adder tree into vertical counters; a pair is given up when all its live lanes exceed the radius.
    """
    width = BITS.bit_length()
    out = np.zeros(len(q), np.uint64)
    at = np.flatnonzero(live)
    q, k, live = q[at], k[at], live[at]
    count = [np.zeros(len(q), np.uint64) for _ in range(width)]
    ones = ~np.uint64(0)

    def csa(a, b, c):
        x = a ^ b
        return x ^ c, (a & b) | (x & c)

    def over() -> np.ndarray:
        """Lanes whose counter exceeds the radius, compared from the top bit down."""
        more, same = np.zeros(len(q), np.uint64), np.full(len(q), ones)
        for b in range(width - 1, -1, -1):
            if radius >> b & 1:
                same = same & count[b]
            else:
                more = more | (same & count[b])
                same = same & ~count[b]
        return more

    for p in range(0, BITS, 8):
        d = [planes[p + i][k] ^ query_bits[p + i][q] for i in range(8)]
        s1, c1 = csa(d[0], d[1], d[2])
        s2, c2 = csa(d[3], d[4], d[5])
        s3, c3 = csa(s1, s2, d[6])
        low, c4 = csa(s3, d[7], count[0])
        t1, e1 = csa(c1, c2, c3)
        two, e2 = csa(t1, c4, count[1])
        four, e3 = csa(e1, e2, count[2])
        count[0], count[1], count[2] = low, two, four
        carry = e3
        for b in range(3, width):
            count[b], carry = count[b] ^ carry, count[b] & carry
        if p >= 56 and p % 16 == 8:
            gone = (over() & live) == live
            if gone.mean() > 0.1:
                stay = ~gone
                at, q, k, live = at[stay], q[stay], k[stay], live[stay]
                count = [c[stay] for c in count]
                if not len(at):
                    return out
    out[at] = ~over() & live
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component, for edges within one batch."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        left = label[a] != label[b]
        a, b = a[left], b[left]
    while (label[label] != label).any():
        label = label[label]
    return label


def bucket_edges(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS, most: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least member) that connect what lies within ``radius`` inside the buckets; rows are sorted by key."""
    n = len(key)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, n))
    start, size = start[size > 1], size[size > 1]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    member = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    fp, inner = fp[member], np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    per = -(-size // 64)
    base = np.repeat(np.cumsum(per) - per, size)
    block, lane = base + inner // 64, inner % 64
    found_a, found_b = [], []
    # rows in their own block: the lanes after themselves; rows against later blocks of the bucket: all lanes
    last = np.repeat(np.cumsum(per), size)
    todo = last - block
    ends = np.cumsum(todo)
    filled = np.bincount(block, minlength=int(per.sum()))
    full = np.where(filled >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(filled, 63).astype(np.uint64)) - np.uint64(1))
    lo = 0
    while lo < len(member):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        b0, b1 = int(block[lo]), int(last[hi - 1])
        part = np.flatnonzero((block >= b0) & (block < b1))
        planes = planes_of(fp[part], block[part] - b0, lane[part], b1 - b0)
        bits = np.unpackbits(fp[lo:hi], axis=1).T
        query = np.ascontiguousarray((np.uint64(0) - bits.astype(np.uint64)))
        reps = todo[lo:hi]
        for s in range(0, int(reps.sum()), most):  # a single row of a huge bucket may have more pairs than one portion
            e = min(s + most, int(reps.sum()))
            i = np.arange(s, e)
            cum = np.cumsum(reps)
            q = np.searchsorted(cum, i, side="right")
            k = block[lo + q] - b0 + (i - (cum[q] - reps[q]))
            own = k + b0 == block[lo + q]
            after = np.where(lane[lo + q] == 63, np.uint64(0), ~np.uint64(0) << np.minimum(lane[lo + q] + 1, 63).astype(np.uint64))
            live = full[k + b0] & np.where(own, after, ~np.uint64(0))
            hit = sliced_compare(query, planes, q, k, live, radius)
            w = np.flatnonzero(hit)
            if len(w):
                x, y = np.nonzero(np.unpackbits(hit[w, None].view(np.uint8), axis=1, bitorder="little"))
                first = np.searchsorted(block, k[w[x]] + b0)
                found_a.append(lo + q[w[x]])
                found_b.append(first + y)
        lo = hi
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    root = _roots(len(member), a, b)
    linked = np.flatnonzero(root != np.arange(len(member)))
    return member[linked], member[root[linked]]


def _sketch(batches):
    for batch in batches:
        for part in portions(batch):
            fp = fingerprints(part.column("text"))
            flat = pa.Array.from_buffers(pa.binary(BITS // 8), len(fp), [None, pa.py_buffer(np.ascontiguousarray(fp))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), flat], ["doc_id", "h", "fp"])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp) of every row with text; h is the hash of the text."""
    light = pick(docs, "doc_id", "text").where("text is not null").withColumn("h", row_hash("text"))
    return light.mapInArrow(trimmed(_sketch), f"doc_id {kind_of(light, 'doc_id')}, h long, fp binary")


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)


_WORDS = [f"w{i}" for i in range(BITS // 64)]
_WIDE = ", ".join(f"{w} long" for w in _WORDS)


def _wide(fp: np.ndarray) -> list[pa.Array]:
    return [pa.array(x) for x in np.ascontiguousarray(fp.view(np.int64).T)]


def _narrow(table) -> np.ndarray:
    return np.ascontiguousarray(np.stack([table.column(w).to_numpy() for w in _WORDS], axis=1)).view(np.uint8).reshape(-1, BITS // 8)


def _blobs(fp: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in fp], pa.binary())


def _scatter(positions: np.ndarray, skip: frozenset[int], only: bool):
    """Rows (bucket, fingerprint) of all tables; those of the buckets in ``skip`` are left out, or nothing else is sent."""
    skipped = np.array(sorted(skip), np.int64).view(np.uint64)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = _prints(batch.column("fp"))
            for t in range(0, len(positions), 8):
                keys = bucket_keys(fp, positions[t : t + 8])
                which = np.arange(t, min(t + 8, len(positions)), dtype=np.uint64)
                keys = mix(keys ^ mix(which + np.uint64(1))).T.ravel()
                rows = np.tile(np.arange(len(fp)), len(which))
                if len(skipped) or only:
                    use = np.isin(keys, skipped) == only
                    keys, rows = keys[use], rows[use]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *_wide(fp[rows])], ["bucket", *_WORDS])

    return run


def _whole_groups(keys: list[str], work, most: int = 40_000):
    """Over rows sorted by ``keys``: ``work`` on tables that hold whole groups, some of them at a time."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            same = np.ones(n, bool)
            for k in keys:
                column = batch.column(k).to_numpy()
                same &= column == column[-1]
            cut = int(np.argmax(same))  # where the batch's last group starts
            if held and not cut:
                last = held[-1]
                if any(last.column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys) and size >= most:
                    yield work(pa.Table.from_batches(held))
                    held, size = [], 0
            if cut and size + cut >= most:
                yield work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, size = [batch.slice(cut)], n - cut
            else:
                held.append(batch)
                size += n
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _pairs_of(radius: int):
    def work(t: pa.Table) -> pa.RecordBatch:
        fp = _narrow(t)
        a, b = bucket_edges(t.column("bucket").to_numpy(), fp, radius)
        return pa.RecordBatch.from_arrays([_blobs(fp[a]), _blobs(fp[b])], ["u", "v"])

    return work


def _asking(radius: int):
    """Edges between a block's residents and the members of the same bucket that ask (they may be residents too)."""

    def work(t: pa.Table) -> pa.RecordBatch:
        fp, asks = _narrow(t), t.column("asks").to_numpy()
        key = np.stack([t.column("bucket").to_numpy(), t.column("block").to_numpy()])
        edge = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True]]))
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(edge[:-1], edge[1:]):
            home, query = s + np.flatnonzero(~asks[s:e]), s + np.flatnonzero(asks[s:e])
            if not len(home) or not len(query):
                continue
            inner = np.arange(len(home))
            blocks = -(-len(home) // 64)
            planes = planes_of(fp[home], inner // 64, inner % 64, blocks)
            full = np.full(blocks, ~np.uint64(0))
            if len(home) % 64:
                full[-1] = (np.uint64(1) << np.uint64(len(home) % 64)) - np.uint64(1)
            step = max(1, 4096 // blocks)
            for lo in range(0, len(query), step):
                part = query[lo : lo + step]
                bits = np.ascontiguousarray(np.uint64(0) - np.unpackbits(fp[part], axis=1).T.astype(np.uint64))
                q, k = np.repeat(np.arange(len(part)), blocks), np.tile(np.arange(blocks), len(part))
                hit = sliced_compare(bits, planes, q, k, full[k], radius)
                w = np.flatnonzero(hit)
                if len(w):
                    x, y = np.nonzero(np.unpackbits(hit[w, None].view(np.uint8), axis=1, bitorder="little"))
                    us.append(part[q[w[x]]])
                    vs.append(home[k[w[x]] * 64 + y])
        u, v = np.concatenate(us), np.concatenate(vs)
        differ = (fp[u] != fp[v]).any(axis=1)
        root = _roots(len(fp), u[differ], v[differ])
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([_blobs(fp[moved]), _blobs(fp[root[moved]])], ["u", "v"])

    return work


def _distance(a: str, b: str):
    return sum((F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in _WORDS), F.lit(0))


def _blob(prefix: str = ""):
    """The fingerprint as the binary value it was: the words' bytes lie in little-endian order."""
    digits = [F.lpad(F.hex(F.col(prefix + w)), 16, "0") for w in _WORDS]
    return F.unhex(F.concat(*[F.substring(d, i, 2) for d in digits for i in range(15, 0, -2)]))


def hot_edges(members: DataFrame, radius: int = RADIUS, hot: int = HOT, block: int = BLOCK, rounds: int = 6) -> DataFrame:
    """Edges (u, v) that connect what lies within ``radius`` in large buckets; members: (bucket, w0 ... w3), each once.

    A bucket is large because many like texts are in it. So each round takes one member of every bucket as a pivot and links it with
    all within the radius, one comparison each. Of the others, only those within twice the radius can lie within it of
    one of these; they ask all of these, block by block. Then the rest goes on without what the pivot has linked. Buckets
    that are still large in the end compare their blocks with each other. No link is lost, and no task holds a bucket.
    """
    left, found = stored(members, "simhash-hot"), []
    for turn in range(rounds + 1):
        sizes = left.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(*_WORDS)).alias("p"))
        sizes = stored(sizes.select("bucket", "n", *[F.col(f"p.{w}").alias(f"p{w}") for w in _WORDS]), "simhash-pivots")
        if sizes.where(F.col("n") > hot).isEmpty() or turn == rounds:
            break
        both = left.join(small(sizes), "bucket").withColumn("d", _distance("", "p"))
        both = stored(both, "simhash-near")
        star = both.where((F.col("d") <= radius) & (F.col("d") > 0))
        found.append(star.select(_blob().alias("u"), _blob("p").alias("v")))
        blocks = (F.col("n") / block + 1).cast("int")
        homes = star.select("bucket", F.pmod(F.xxhash64(*_WORDS), blocks).cast("int").alias("block"), F.lit(False).alias("asks"), *_WORDS)
        ring = both.where((F.col("d") > radius) & (F.col("d") <= 2 * radius))
        ring = ring.select("bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("asks"), *_WORDS)
        met = homes.unionByName(ring).repartition("bucket", "block").sortWithinPartitions("bucket", "block")
        found.append(met.mapInArrow(trimmed(_whole_groups(["bucket", "block"], _asking(radius))), "u binary, v binary"))
        left = stored(both.where(F.col("d") > radius).select("bucket", *_WORDS), "simhash-hot")
    near = left.join(small(sizes.select("bucket", "n")), "bucket")
    cold = near.where(F.col("n") <= hot).select("bucket", *_WORDS)
    found.append(cold.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_whole_groups(["bucket"], _pairs_of(radius))), "u binary, v binary"))
    blocks = (F.col("n") / block + 1).cast("int")
    own = F.pmod(F.xxhash64(*_WORDS), blocks).cast("int")
    rest = near.where(F.col("n") > hot).withColumn("own", own)
    homes = rest.select("bucket", F.col("own").alias("block"), F.lit(False).alias("asks"), *_WORDS)
    asks = rest.select("bucket", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("block"), F.lit(True).alias("asks"), *_WORDS)
    met = homes.unionByName(asks).repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    found.append(met.mapInArrow(trimmed(_whole_groups(["bucket", "block"], _asking(radius))), "u binary, v binary"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def hot_buckets(prints: DataFrame, n: int, positions: np.ndarray, hot: int = HOT) -> frozenset[int]:
    """Buckets that a sample shows to be large. Which ones are named changes the plan, never the result."""
    share = 16 / hot
    if n <= hot:
        return frozenset()

    def count(batches):
        for batch in _scatter(positions, frozenset(), False)(batches):
            yield pa.RecordBatch.from_arrays([batch.column("bucket")], ["bucket"])

    sample = prints.where(F.pmod(F.xxhash64("fp", F.lit("hot")), F.lit(1_000_000)) < max(1, round(1_000_000 * share))).select("fp")
    seen = sample.mapInArrow(count, "bucket long").groupBy("bucket").count().where("count >= 8")
    return frozenset(r["bucket"] for r in seen.collect())  # at most two for each HOT rows of a table


def links(prints: DataFrame, n: int, radius: int = RADIUS, recall: float = RECALL, hot: int = HOT) -> DataFrame:
    """Edges (u, v) that connect the fingerprints (fp, each once) within ``radius`` of each other that meet in a bucket."""
    positions = _positions(*plan(n, recall, radius))
    large = hot_buckets(prints, n, positions, hot)
    wide = f"bucket long, {_WIDE}"
    spread = prints.select("fp").mapInArrow(trimmed(_scatter(positions, large, False)), wide)
    edges = spread.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_whole_groups(["bucket"], _pairs_of(radius))), "u binary, v binary")
    if large:
        edges = edges.unionByName(hot_edges(prints.select("fp").mapInArrow(trimmed(_scatter(positions, large, True)), wide), radius, hot))
    return edges


def duplicate_groups(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, hot: int = HOT) -> DataFrame:
    """(doc_id, h, keep_id, keep_h) for every document that has a kept one other than itself."""
    rows = stored(sketches(docs), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")
    prints = stored(rows.groupBy("fp").agg(F.min(order).alias("first")), "simhash-prints")
    roots = connected_components(links(prints, prints.count(), radius, recall, hot))
    group = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    keepers = group.groupBy("root").agg(F.min("first").alias("keep"))
    member = group.join(keepers, "root").select("fp", "keep")
    out = rows.join(member, "fp").select("doc_id", "h", F.col("keep.doc_id").alias("keep_id"), F.col("keep.h").alias("keep_h")).distinct()
    return out.where(~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h"))))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, dup_of): every document that a kept one stands for, with that one's id. Ids keep their own rows' values."""
    return duplicate_groups(docs, radius).select("doc_id", F.col("keep_id").alias("dup_of"))


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group; of rows with one doc_id and text, one row."""
    dup = stored(duplicate_groups(docs, radius).select("doc_id", "h"), "simhash-dups")
    plain, (doc_id, text) = positional(docs, "doc_id", "text")
    keyed = plain.withColumns({"k0": doc_id, "k1": F.xxhash64(text.cast("string")), "some": text.isNotNull()})
    again = stored(keyed.where("some").groupBy("k0", "k1").count().where("count > 1").select("k0", "k1"), "simhash-repeats")
    left = less_rows(keyed, dup)
    names = plain.columns
    if not again.isEmpty():
        r = small(again.toDF("r0", "r1"))
        same = F.col("some") & F.col("k0").eqNullSafe(F.col("r0")) & (F.col("k1") == F.col("r1"))
        plainly = [f.name for f in plain.schema.fields if "map<" not in f.dataType.simpleString()]
        first = Window.partitionBy("k0", "k1").orderBy(F.xxhash64(*plainly))
        once = left.join(r, same, "left_semi").withColumn("n", F.row_number().over(first)).where("n = 1").select(*names)
        left = left.join(r, same, "left_anti").select(*names).unionByName(once)
    return left.select(*names).toDF(*docs.columns)
