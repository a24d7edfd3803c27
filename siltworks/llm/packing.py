"""Best-fit packing of documents into fixed-length sequences by the linear grouping scheme.

Lengths are characters of the text. A text longer than ``CAPACITY`` is cut into full pieces, a sequence each, and a rest.
The rests are planned from the number of pieces of each length alone, a table of at most CAPACITY rows whatever the corpus, and
one length class is never split by anything but the plan:

1. lengths above ``LARGE`` of the capacity go, longest first, into ``GROUPS`` groups of equal cardinality; each is rounded up
   to its group's longest;
2. the cutting-stock problem of those few sizes is solved over bin configurations: a linear programme by column generation
   (revised simplex; knapsack pricing), rounded down to whole bins;
3. actual pieces are put in place of the rounded sizes, which always fit;
4. what the rounding left over and all small pieces, longest first, go where they fit best, bins of equal room taken together.

Pieces are then ranked within their length (by doc_id, null last, and content hash) and looked up in the plan.

Defined cases: null and empty texts have no piece; null ids are packed like others; repeated rows are packed once each;
an empty table gives no rows; extra columns don't matter; a length that equals the capacity is one full sequence.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, row_hash, stored

CAPACITY = 8192
LARGE = 0.125
GROUPS = 24
#: Room is counted in so many units when configurations are sought; sizes are rounded up to them.
UNITS = 1024
BUCKETS = 4096


def configurations(sizes: list[int], need: list[int], room: int) -> list[tuple[list[int], int]]:
    """(copies of each size, bins) from the rounded-down linear programme that covers ``need`` with the fewest bins."""
    k = len(sizes)
    s, d = np.array(sizes), np.array(need, float)
    columns = [np.eye(k, dtype=int)[i] * (room // sizes[i]) for i in range(k)]
    basis = np.array(columns, float).T
    for _ in range(50 * k):
        x = np.linalg.solve(basis, d)
        dual = np.linalg.solve(basis.T, np.ones(k))
        best, choice = np.zeros(room + 1), np.full(room + 1, -1)
        for c in range(1, room + 1):  # unbounded knapsack
            best[c] = best[c - 1]
            fit = s <= c
            if fit.any():
                v = np.where(fit, best[np.maximum(c - s, 0)] + dual, -1)
                i = int(v.argmax())
                if v[i] > best[c] + 1e-12:
                    best[c], choice[c] = v[i], i
        if best[room] <= 1 + 1e-7:
            break
        column, c = np.zeros(k, int), room
        while c > 0:
            if choice[c] < 0:
                c -= 1
                continue
            column[choice[c]] += 1
            c -= sizes[choice[c]]
        w = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(w > 1e-9, np.maximum(x, 0) / np.where(w > 1e-9, w, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out], columns[out] = column, column
    x = np.linalg.solve(basis, d)
    return [(c.tolist(), int(np.floor(v + 1e-6))) for c, v in zip(columns, x) if v >= 1 - 1e-6]


class Plan:
    """Where the pieces of each length go: rows (length, first rank, bin, offset, per bin), sorted."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS):
        self.capacity, self.bins = capacity, 0
        self.entries: list[tuple[int, int, int, int, int]] = []
        self.used: dict[int, int] = dict.fromkeys(counts, 0)
        self.rooms: dict[int, list[tuple[int, int]]] = {}
        self.order: list[int] = []
        counts = {n: c for n, c in counts.items() if c > 0}
        left = self._large({n: c for n, c in counts.items() if n > capacity * large}, groups)
        rest = {n: c for n, c in counts.items() if n <= capacity * large}
        for n in sorted({*left, *rest}, reverse=True):
            self._best_fit(n, left.get(n, 0) + rest.get(n, 0))
        self.entries.sort()

    def _place(self, length: int, count: int, bin_: int, offset: int, per: int) -> None:
        self.entries.append((length, self.used[length], bin_, offset, per))
        self.used[length] += count

    def _add_room(self, room: int, bin_: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in self.rooms:
                self.rooms[room] = []
                bisect.insort(self.order, room)
            self.rooms[room].append((bin_, count))

    def _large(self, counts: dict[int, int], groups: int) -> dict[int, int]:
        total = sum(counts.values())
        if not total:
            return {}
        per = -(-total // groups)
        queues: list[list[list[int]]] = [[]]
        room = per
        for n in sorted(counts, reverse=True):
            c = counts[n]
            while c:
                if not room:
                    queues.append([])
                    room = per
                take = min(c, room)
                queues[-1].append([n, take])
                c, room = c - take, room - take
        unit = -(-self.capacity // UNITS)
        units = self.capacity // unit
        sizes = [-(-q[0][0] // unit) for q in queues]
        merged: dict[int, list[int]] = {}
        for i, s in enumerate(sizes):  # equal rounded sizes are one size
            merged.setdefault(min(s, units), []).append(i)
        # a size of the whole room has bins of its own, even where rounding to units would cut it off
        keys = sorted(merged, reverse=True)
        stock = [[seg for i in merged[s] for seg in queues[i]] for s in keys]
        need = [sum(c for _, c in q) for q in stock]
        for config, bins in configurations(keys, need, units):
            slots = [g for g, a in enumerate(config) for _ in range(a)]
            todo = bins
            while todo > 0:
                # a run of bins in which each slot holds one length
                runs = []
                for g in dict.fromkeys(slots):
                    want, q = config[g], stock[g]
                    if sum(c for _, c in q) < want:
                        todo = 0
                        break
                    n, c = q[0]
                    if c >= want:
                        runs.append((g, [(n, want)], c // want))
                    else:  # this bin's slots of one group span several lengths
                        mix, w = [], want
                        for n, c in q:
                            take = min(c, w)
                            mix.append((n, take))
                            w -= take
                            if not w:
                                break
                        runs.append((g, mix, 1))
                if not todo:
                    break
                m = min([todo, *[r[2] for r in runs]])
                offset = 0
                for g, parts, _ in runs:
                    for n, w in parts:
                        self._place(n, w * m, self.bins, offset, w)
                        offset += n * w
                        q = stock[g]
                        q[0][1] -= w * m
                        if not q[0][1]:
                            q.pop(0)
                self._add_room(self.capacity - offset, self.bins, m)
                self.bins += m
                todo -= m
        left: dict[int, int] = {}
        for q in stock:
            for n, c in q:
                left[n] = left.get(n, 0) + c
        return left

    def _best_fit(self, length: int, count: int) -> None:
        while count > 0:
            i = bisect.bisect_left(self.order, length)
            if i == len(self.order):
                fresh = -(-count // (self.capacity // length))
                self._add_room(self.capacity, self.bins, fresh)
                self.bins += fresh
                continue
            room = self.order[i]
            bin_, m = self.rooms[room].pop()
            per = room // length
            if count >= per:
                take = min(m, count // per)
            else:
                per, take = count, 1
            self._place(length, take * per, bin_, self.capacity - room, per)
            count -= take * per
            if not self.rooms[room]:
                del self.rooms[room]
                self.order.pop(i)
            self._add_room(room - per * length, bin_, take)
            self._add_room(room, bin_ + take, m - take)

    def arrays(self) -> tuple[np.ndarray, ...]:
        e = np.array(self.entries, np.int64).reshape(-1, 5)
        return (e[:, 0] << 44) | e[:, 1], e[:, 2], e[:, 3], e[:, 4]

    def lookup(self, length: np.ndarray, rank: np.ndarray, arrays) -> tuple[np.ndarray, np.ndarray]:
        return place(length, rank, arrays)


def place(length: np.ndarray, rank: np.ndarray, arrays) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of the pieces of given lengths and ranks."""
    key, bin_, offset, per = arrays
    i = np.searchsorted(key, (length << 44) | rank, side="right") - 1
    k = rank - (key[i] & ((1 << 44) - 1))
    return bin_[i] + k // per[i], offset[i] + k % per[i] * length


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, bin, at): each piece of each document, its sequence, and its place in the sequence."""
    spark = docs.sparkSession
    light = pick(docs, "doc_id", "text").select("doc_id", F.char_length("text").cast("long").alias("n"), row_hash("text").alias("h")).where("n > 0")
    rows = stored(light.select("doc_id", "h", F.expr(f"n div {capacity}").alias("whole"), (F.col("n") % capacity).alias("rest")), "pack")
    counts = {r["rest"]: r["c"] for r in rows.where("rest > 0").groupBy("rest").agg(F.count("*").alias("c")).toLocalIterator()}
    plan = Plan(counts, capacity)
    shared = spark.sparkContext.broadcast(plan.arrays())

    def assign(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            bin_, at = place(length, rank, shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), b.column("start"), b.column("length"), pa.array(bin_), pa.array(at)], ["doc_id", "piece", "start", "length", "bin", "at"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    by_length = Window.partitionBy("rest").orderBy(F.col("doc_id").asc_nulls_last(), "h")
    rests = rows.where("rest > 0").select("doc_id", F.col("whole").alias("piece"), (F.col("whole") * capacity).alias("start"), F.col("rest").alias("length"), (F.row_number().over(by_length) - 1).cast("long").alias("rank"))
    packed = rests.mapInArrow(assign, f"doc_id {kind}, piece long, start long, length long, bin long, at long")
    # full pieces: numbered bucket by bucket, so that no task sees them all
    long = rows.where("whole > 0").withColumn("b", F.pmod(F.xxhash64("doc_id", "h"), F.lit(BUCKETS)))
    sums = long.groupBy("b").agg(F.sum("whole").alias("w")).orderBy("b").collect()  # at most BUCKETS rows
    base, start = {}, plan.bins
    for r in sums:
        base[r["b"]] = start
        start += r["w"]
    bases = F.broadcast(spark.createDataFrame(list(base.items()) or [(-1, 0)], "b long, base long"))
    before = Window.partitionBy("b").orderBy(F.col("doc_id").asc_nulls_last(), "h").rowsBetween(Window.unboundedPreceding, -1)
    full = long.withColumn("before", F.coalesce(F.sum("whole").over(before), F.lit(0))).join(bases, "b")
    full = full.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("piece"), (F.col("base") + F.col("before")).alias("first"))
    full = full.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), (F.col("first") + F.col("piece")).alias("bin"), F.lit(0).cast("long").alias("at"))
    return packed.unionByName(full)
