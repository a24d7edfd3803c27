"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to unit length and cut into halves. Each half has a codebook of its own, trained by Lloyd passes over all
rows (sums by grouped aggregation, in whole numbers, so that they don't depend on their order); the two codes form a product grid of
cells, of which each holds ``PER_CELL`` vectors on average. Every vector is a query: it visits cells in the order in which the
multi-sequence algorithm meets them, by the squared distances from the vector's halves to the cells' bisectors. The chance that a
partner ``1 - cosine`` away in a random direction lies beyond a bisector falls off like a normal density; since a cell's weight
is the product of its halves' weights, the sum over all cells is known beforehand, and the visit ends once the wanted share
``VISITED`` of it was seen. Either of two partners finds the other, so that more than this share of the pairs is found.

What visits a cell is a vector's node and its values in a byte each, with the length of the rounding error. Within each cell all
visitors are compared with all residents, without a cap: the errors bound how far the product of the bytes is from the
true one, so that most pairs are settled; those that aren't are verified by exact dot products of the vectors themselves.
Connected components of the pairs are the groups. Vectors of each dimension are searched by themselves.

Defined cases: null and empty vectors, and those with nulls, infinities or zero length in them, are never compared; vectors of
different dimensions aren't compared with each other; equal vectors, and repeated rows with an id of their own, are
copies of each other; of rows repeated with their id one row stands for all; the kept row of a group has the least id (null
last); an empty table gives no rows; extra columns don't matter; ids may be of any type.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, pick, stored
from .components import connected_components

THRESHOLD = 0.9
#: Share of the weight of its cells that each vector visits.
VISITED = 0.85
PER_CELL = 256
PASSES = 4
_SCALE = 1 << 20


def codes(n: int) -> int:
    """Size of each codebook for n vectors."""
    return max(1, round(math.sqrt(n / PER_CELL)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _unit(dim: int):
    """Unit vectors of at least two values (a single one gets a zero beside it)."""

    def run(batches):
        for b in batches:
            column = b.column("embedding").cast(pa.list_(pa.float64()))
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            if dim == 1:
                x = np.hstack([x, np.zeros_like(x)])
            with np.errstate(all="ignore"):
                norm = np.sqrt((x * x).sum(axis=1))
                ok = np.isfinite(norm) & (norm > 0)
                y = (x[ok] / norm[ok, None]).astype(np.float32) + np.float32(0)  # no negative zeros
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(ok)), pa.array([r.tobytes() for r in y], pa.binary())], ["vec_id", "v"])

    return run


def _square(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def _sums(shared, dim: int):
    def run(batches):
        books, total, count = shared.value, None, None
        for b in batches:
            x = _matrix(b.column("v"), dim)
            for half, part in enumerate((x[:, : dim // 2], x[:, dim // 2 :])):
                if total is None:
                    total = [np.zeros(c.shape, np.int64) for c in books]
                    count = [np.zeros(len(c), np.int64) for c in books]
                for lo in range(0, len(x), 4096):
                    p = part[lo : lo + 4096]
                    code = _square(p, books[half]).argmin(axis=1)
                    np.add.at(total[half], code, np.round(p.astype(np.float64) * _SCALE).astype(np.int64))
                    count[half] += np.bincount(code, minlength=len(count[half]))
        if total is not None:
            for half in (0, 1):
                k = np.flatnonzero(count[half])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), half, np.int32)), pa.array(k.astype(np.int32)), pa.array(count[half][k]), pa.array(list(total[half][k]), pa.list_(pa.int64()))], ["half", "code", "n", "s"])

    return run


def train(vectors: DataFrame, dim: int, size: int, passes: int = PASSES) -> list[np.ndarray]:
    """The two codebooks. vectors: distinct rows (node, v). The seeds are the ``size`` rows of least hash."""
    spark = vectors.sparkSession
    seeds = np.frombuffer(b"".join(bytes(r["v"]) for r in vectors.orderBy("node").limit(size).select("v").collect()), np.float32).reshape(-1, dim)
    books = [seeds[:, : dim // 2].astype(np.float64), seeds[:, dim // 2 :].astype(np.float64)]
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(books)
        parts = vectors.select("v").mapInArrow(_sums(shared, dim), "half int, code int, n long, s array<long>")
        width = max(b.shape[1] for b in books)
        sums = parts.groupBy("half", "code").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).alias("s"))
        books = [b.copy() for b in books]
        for r in sums.toLocalIterator():  # two rows a code
            books[r["half"]][r["code"]] = np.array(r["s"][: books[r["half"]].shape[1]], float) / _SCALE / r["n"]
        shared.unpersist()
    return books


def gaps(centres: np.ndarray) -> np.ndarray:
    """Distances of all centres from each other."""
    return np.maximum(np.sqrt(_square(centres, centres)), 1e-12)


def bisector_distances(x: np.ndarray, centres: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre, and the squared distance from x to each other centre's side of the bisector with it."""
    d = _square(x, centres)
    best = d.argmin(axis=1)
    h = np.maximum(d - d[np.arange(len(x)), best][:, None], 0) / (2 * gap[best])
    return best, h * h


def in_bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in a byte each, the scale they are counted in, and the length of each row's rounding error."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    q = np.round(x / scale[:, None]).astype(np.int8)
    # a little more than the error, for the arithmetic in single precision
    return q, scale, np.sqrt(((q * scale[:, None] - x) ** 2).sum(axis=1)) + 1e-5


def multi_sequence(a: np.ndarray, b: np.ndarray, sigma2: float, recall: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code of the first half, of the second) of all cells visited; a, b: squared distances (queries, codes).

    All queries advance together: each has sorted halves, and in every row of its grid a pointer to the next column; a row is
    open once the one before is further. The least open sum is visited, until ``recall`` of the weights' product is seen.
    """
    n = len(a)
    order_a, order_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
    a, b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
    wa, wb = np.exp(-a / (2 * sigma2)), np.exp(-b / (2 * sigma2))
    goal = recall * wa.sum(axis=1) * wb.sum(axis=1)
    seen = np.zeros(n)
    at = np.zeros((n, a.shape[1]), np.int32)
    live, out, opened, visited = np.arange(n), [], 1, np.zeros(n, np.int64)
    cells = a.shape[1] * b.shape[1]
    while len(live):
        p = at[live, :opened]
        inside = p < b.shape[1]
        cost = np.where(inside, a[live, :opened] + np.take_along_axis(b[live], np.minimum(p, b.shape[1] - 1), 1), np.inf)
        cost[:, 1:][p[:, :-1] <= p[:, 1:]] = np.inf
        row = cost.argmin(axis=1)
        col = at[live, row]
        out.append((live, order_a[live, row], order_b[live, col]))
        seen[live] += wa[live, row] * wb[live, col]
        visited[live] += 1
        at[live, row] += 1
        if opened < a.shape[1] and (at[live, opened - 1] > 0).any():
            opened += 1
        live = live[(seen[live] < goal[live]) & (visited[live] < cells)]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 3


class Groups:
    """Components of nodes 0..n-1 under edges that come in portions."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            low = np.minimum(x, y)
            np.minimum.at(self.label, x, low)
            np.minimum.at(self.label, y, low)
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def cell_pairs(x: np.ndarray, error: np.ndarray, home: np.ndarray, threshold: float, side: int = 2048) -> tuple[np.ndarray, ...]:
    """Edges (member, least member) of the components that sure pairs (any row, resident row) of one cell form, and the unsure pairs."""
    own = np.flatnonzero(home)
    groups = Groups(len(x))
    worst = float(error.max(initial=0))
    least = threshold - 1e-6 - worst * (2 + worst)
    unsure_a, unsure_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(x), side):
        for j in range(0, len(own), side):
            r = own[j : j + side]
            dot = x[i : i + side] @ x[r].T
            q, k = np.nonzero(dot >= least)
            if not len(q):
                continue
            e, f, d = error[i + q], error[r[k]], dot[q, k]
            bound = e + f + e * f
            sure = d - bound >= threshold
            groups.join(i + q[sure], r[k[sure]])
            maybe = ~sure & (d + bound >= threshold - 1e-6)
            unsure_a.append(i + q[maybe])
            unsure_b.append(r[k[maybe]])
    a, b = np.concatenate(unsure_a), np.concatenate(unsure_b)
    open_ = groups.label[a] != groups.label[b]
    moved = np.flatnonzero(groups.label != np.arange(len(x)))
    return moved, groups.label[moved], a[open_], b[open_]


def _exactly(threshold: float):
    """Of rows (u, v, x, y), nodes and their vectors, those whose product reaches the threshold."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                dim = len(b.column("x")[0].as_py()) // 4
                x, y = _matrix(b.column("x"), dim).astype(np.float64), _matrix(b.column("y"), dim).astype(np.float64)
                ok = pa.array((x * y).sum(axis=1) >= threshold - 1e-6)
                yield pa.RecordBatch.from_arrays([b.column("u").filter(ok), b.column("v").filter(ok)], ["u", "v"])

    return run


def duplicates(rows: DataFrame, threshold: float = THRESHOLD, visited: float = VISITED, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, dup_of): every row whose group is kept in another row."""
    light = pick(rows, id_column, vector_column).toDF("vec_id", "embedding")
    kind = kind_of(light, "vec_id")
    light = light.where("embedding is not null").where(~F.exists("embedding", lambda v: v.isNull())) if "array" in kind_of(light, "embedding") else light.limit(0)
    dims = [r["d"] for r in light.groupBy(F.size("embedding").alias("d")).count().where("d > 0").orderBy("d").collect()] if "array" in kind_of(light, "embedding") else []
    out = rows.sparkSession.createDataFrame([], f"vec_id {kind}, dup_of {kind}")
    for dim in dims:
        units = light.where(F.size("embedding") == dim).mapInArrow(_unit(dim), f"vec_id {kind}, v binary")
        out = out.unionByName(_search(stored(units, "vectors"), max(dim, 2), threshold, visited))
    return out.toDF(id_column, "dup_of")


def _search(units: DataFrame, dim: int, threshold: float, visited: float) -> DataFrame:
    """(vec_id, dup_of) of unit vectors (vec_id, v) of one dimension."""
    spark = units.sparkSession
    order = F.struct(F.col("vec_id").isNull().alias("z"), "vec_id")
    vectors = stored(units.groupBy("v").agg(F.min(order).alias("first")).select(F.unhex(F.md5("v")).alias("node"), "v", "first"), "vector-nodes")
    n = vectors.count()
    books = train(vectors, dim, codes(n)) if n else []
    shared = spark.sparkContext.broadcast([(c, gaps(c)) for c in books])
    sigma2 = (2 - 2 * threshold) / dim

    def visit(batches):
        (a, gap_a), (b, gap_b) = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = _matrix(part.column("v"), dim)
                home1, h1 = bisector_distances(x[:, : dim // 2], a, gap_a)
                home2, h2 = bisector_distances(x[:, dim // 2 :], b, gap_b)
                q, i, j = multi_sequence(h1, h2, sigma2, visited)
                take = pa.array(q)
                value, scale, error = in_bytes(x)
                own = (home1[q] == i) & (home2[q] == j)
                raw = pa.array([r.tobytes() for r in value], pa.binary()).take(take)
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64) * len(b) + j), part.column("node").take(take), raw, pa.array(scale[q].astype(np.float32)), pa.array(error[q].astype(np.float32)), pa.array(own)], ["cell", "node", "q", "scale", "error", "home"])

    def verify(batches):
        def flush(parts):
            t = pa.Table.from_batches(parts).combine_chunks()
            cell, home, node = t.column("cell").to_numpy(), t.column("home").to_numpy(zero_copy_only=False), t.column("node")
            x = np.frombuffer(b"".join(t.column("q").to_pylist()), np.int8).reshape(-1, dim).astype(np.float32) * t.column("scale").to_numpy()[:, None]
            error = t.column("error").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
            us, vs, sure = [], [], []
            for s, e in zip(edge[:-1], edge[1:]):
                u, v, a, b = cell_pairs(x[s:e], error[s:e], home[s:e], threshold)
                us += [s + u, s + a]
                vs += [s + v, s + b]
                sure += [np.ones(len(u), bool), np.zeros(len(a), bool)]
            node = node.combine_chunks() if isinstance(node, pa.ChunkedArray) else node
            return pa.RecordBatch.from_arrays([node.take(pa.array(np.concatenate(us))), node.take(pa.array(np.concatenate(vs))), pa.array(np.concatenate(sure))], ["u", "v", "sure"])

        held, size = [], 0
        for batch in batches:  # sorted by cell: all but the last cell seen so far are whole
            key = batch.column("cell").to_numpy()
            if not len(key):
                continue
            if held and key[0] != held[-1].column("cell")[-1].as_py() and size >= 20_000:
                yield flush(held)
                held, size = [], 0
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut and size + cut >= 20_000:
                yield flush([*held, batch.slice(0, cut)])
                held, size = [batch.slice(cut)], len(key) - cut
            else:
                held.append(batch)
                size += len(key)
        if held:
            yield flush(held)

    visits = vectors.select("node", "v").mapInArrow(visit, "cell long, node binary, q binary, scale float, error float, home boolean")
    pairs = stored(visits.repartition("cell").sortWithinPartitions("cell").mapInArrow(verify, "u binary, v binary, sure boolean"), "vector-pairs")
    edges = pairs.where("sure").select("u", "v")
    unsure = pairs.where("not sure").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    if not unsure.isEmpty():
        x, y = vectors.select(F.col("node").alias("u"), F.col("v").alias("x")), vectors.select(F.col("node").alias("v"), F.col("v").alias("y"))
        edges = edges.unionByName(unsure.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(_exactly(threshold), "u binary, v binary"))
    roots = connected_components(edges)
    group = vectors.select("v", "node", "first").join(roots, "node", "left").select("v", "first", F.coalesce("root", "node").alias("root"))
    keepers = group.groupBy("root").agg(F.min("first").alias("keep"))
    member = group.join(keepers, "root").select("v", "keep")
    return units.join(member, "v").select("vec_id", F.col("keep.vec_id").alias("dup_of")).where("not (vec_id <=> dup_of)").distinct()
