"""Substring deduplication by sliding spans of consecutive sentences.

A text is cut into sentences: behind a full stop, exclamation or question mark (or a like sign of other scripts) that white space
follows, closing quotes and brackets apart; behind the full-width marks of unspaced scripts; and at line ends. Only a
sentence of more than ``LONG`` words is cut further, so that a long unpunctuated stretch is cut alike wherever it
occurs: behind its words whose hash is a multiple of ``CUT``. From each sentence starts one span: ``SENTENCES`` sentences, or as many
more as reach ``WORDS`` words; so a lone line, however often it repeats, is no span. Spans are hashed over their words in lower case,
without punctuation, joined globally on the hash, and the sentences covered by any span that isn't the first of its
kind, by (doc_id, content hash, place), are removed.

Each portion of rows first settles repeats within itself. A span found in very many documents would still send one row a portion
to one task; ``hot_spans`` finds such spans by a sample, their first places by an aggregate combined before the shuffle,
and the scan then settles them on the spot. Spans are told apart by 96 bits of hash (64 to join on, 32 to confirm).

Defined cases: null and empty texts, and texts without a span, are left alone; repeated rows (one doc_id and text)
are the same document and don't repeat each other; a span repeated within one document counts as repeated; null ids order
last; very long texts are taken whole; a document of which nothing is left is dropped by the filter; an empty table
gives no rows; extra columns pass through, whatever their names; ids may be of any type.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, CLOSING, FULL_STOP, LINE, STOP, kind_of, mix, pick, portions, positional, powers, stored, trimmed, words

SENTENCES = 3
WORDS = 12
LONG = 24
CUT = 8
#: Lists of places are broadcast up to this many bytes, as measured.
BROADCAST_BYTES = 48 << 20
#: Spans expected in more documents are settled while the texts are scanned. The results are the same.
HOT = 20_000
#: Bytes of text that are cut into sentences at once (a longer single text comes alone).
PORTION = 1 << 19


def spans(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Of a string array's sentences: row, number within the row, first sign and the one behind the last; of the span from each: two
    hashes, and the number of the sentence behind its last (0 where no span starts)."""
    w = words(column)
    none = np.zeros(0, np.int64)
    if not len(w.row):
        return none, none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), none
    row, word, kind = w.row, w.hash, w.kind
    # a stop counts if the next sign, closing ones apart, is blank
    after = np.empty(len(kind), np.uint8)
    after[:-1], after[-1] = kind[1:], BLANK
    quoted = np.flatnonzero((kind == STOP) & (after == CLOSING))
    look = quoted + 2
    while len(quoted):
        after[quoted] = np.where(look < len(kind), kind[np.minimum(look, len(kind) - 1)], BLANK)
        more = after[quoted] == CLOSING
        quoted, look = quoted[more], look[more] + 1
    ends_here = ((kind == STOP) & ((after == BLANK) | (after == LINE))) | (kind == FULL_STOP) | (kind == LINE)
    ended = np.concatenate([[0], np.cumsum(ends_here, dtype=np.int32)])
    close = np.ones(len(row), bool)
    close[:-1] = (ended[w.start[1:]] > ended[w.end[:-1]]) | (row[1:] != row[:-1])
    # long sentences are cut by their words
    end = np.flatnonzero(close) + 1
    size = np.diff(np.concatenate([[0], end]))
    close |= np.repeat(size > LONG, size) & (word % np.uint64(CUT) == 0)
    end = np.flatnonzero(close) + 1  # words behind each sentence
    begin = np.concatenate([[0], end[:-1]])
    urow = row[begin]
    new = np.concatenate([[True], urow[1:] != urow[:-1]])
    head = np.flatnonzero(new)  # the first sentence of each row
    which = np.cumsum(new) - 1
    stop_at = np.append(head[1:], len(begin))[which]
    first = np.where(new, w.at[urow], w.start[begin])
    behind = np.append(first[1:], 0)
    final = np.append(new[1:], True)
    behind[final] = w.at[urow[final] + 1]
    n = np.arange(len(begin))
    need = np.searchsorted(end, begin + WORDS, side="left") + 1  # the sentence behind the one that reaches WORDS
    to = np.maximum(n + SENTENCES, need)
    to = np.where(to <= stop_at, to, 0)
    p, inv = powers(len(word) + 1)
    last = end[np.maximum(to, 1) - 1]
    hashes = []
    for salt in (0, 0x6A09E667F3BCC909):
        total = np.zeros(len(word) + 1, np.uint64)
        np.cumsum((mix(word ^ np.uint64(salt)) if salt else word) * p[:-1], out=total[1:])
        hashes.append(mix((total[last] - total[begin]) * inv[begin] + (last - begin).astype(np.uint64)))
    return urow, n - head[which], first - w.at[urow], behind - w.at[urow], *hashes, np.where(to > 0, to - head[which], 0)


def _found(batches):
    """For each portion: its rows, and of each span in them the row, both hashes (the second's upper half and the place in one)."""
    for batch in batches:
        for part in portions(batch, most=PORTION):
            row, place, _, _, s, check, to = spans(part.column("text"))
            k = np.flatnonzero(to)
            if len(k):
                yield part, row[k], s[k].view(np.int64), ((check[k] >> np.uint64(32) << np.uint64(32)) | place[k].astype(np.uint64)).view(np.int64)


def _dense(ids: pa.Array) -> np.ndarray:
    """Where each id comes in ascending order, nulls last; equal ids equal."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)


def _scan(hot: dict | None):
    """Rows (s, t, doc_id, h, more) of the spans of each portion: the first place of each span, and the others it has. With ``hot``,
    a table {(s, upper half of t): (doc_id, h, place)} of the first places of hot spans, these are settled: their other places
    come with a null s."""
    settled = np.array(sorted({s for s, _ in hot}), np.int64) if hot else np.zeros(0, np.int64)

    def run(batches):
        for part, row, s, t in _found(batches):
            h = part.column("h").to_numpy()
            ids = part.column("doc_id")
            if len(settled):
                is_hot = np.flatnonzero(np.isin(s, settled))
                out = []
                for i in is_hot:
                    first = hot.get((int(s[i]), int(t[i]) >> 32))
                    if first is None or first != (ids[int(row[i])].as_py(), int(h[row[i]]), int(t[i]) & 0xFFFFFFFF):
                        out.append(i)
                if out:
                    o = np.array(out)
                    yield _rows(np.zeros(len(o), np.int64), t[o], ids.take(pa.array(row[o])), h[row[o]], None, np.ones(len(o), bool))
                keep = np.ones(len(s), bool)
                keep[is_hot] = False
                row, s, t = row[keep], s[keep], t[keep]
                if not len(s):
                    continue
            place, check = t & 0xFFFFFFFF, t >> 32
            order = np.lexsort((place, h[row], _dense(ids)[row], check, s))
            row, s, t, place, check = row[order], s[order], t[order], place[order], check[order]
            lead = np.concatenate([[True], (s[1:] != s[:-1]) | (check[1:] != check[:-1])])
            group, tail = np.flatnonzero(lead), np.flatnonzero(~lead)
            owner = np.searchsorted(group, tail, side="right") - 1
            # the same place of a repeated row isn't a repeat
            rank, g = _dense(ids), group[owner]
            real = (place[tail] != place[g]) | (h[row[tail]] != h[row[g]]) | (rank[row[tail]] != rank[row[g]])
            tail, owner = tail[real], owner[real]
            sizes = np.bincount(owner, minlength=len(group))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            more = pa.StructArray.from_arrays([ids.take(pa.array(row[tail])), pa.array(h[row[tail]]), pa.array(place[tail].astype(np.int32))], ["doc_id", "h", "place"])
            lists = pa.ListArray.from_arrays(offsets, more, mask=pa.array(sizes == 0))
            yield _rows(s[group], t[group], ids.take(pa.array(row[group])), h[row[group]], lists, None)

    def _rows(s, t, ids, h, more, null):
        more = pa.nulls(len(s), pa.list_(pa.struct([("doc_id", ids.type), ("h", pa.int64()), ("place", pa.int32())]))) if more is None else more
        return pa.RecordBatch.from_arrays([pa.array(s, mask=null), pa.array(t), ids, pa.array(h), more], ["s", "t", "doc_id", "h", "more"])

    return run


def hot_spans(light: DataFrame, hot: int = HOT) -> dict | None:
    """The first places of the spans that a sample shows to be in very many documents. light: (doc_id, h, text)."""
    n = light.count()
    if n <= hot:
        return None
    share, kind = 16 / hot, kind_of(light, "doc_id")

    def sampled(batches):
        for _, row, s, t in _found(batches):
            once = np.unique(np.stack([row, s]), axis=1)[1]
            yield pa.RecordBatch.from_arrays([pa.array(once)], ["s"])

    some = light.where(F.pmod(F.xxhash64("h", "doc_id", F.lit("hot")), F.lit(1_000_000)) < max(1, round(1_000_000 * share)))
    names = [r["s"] for r in some.mapInArrow(sampled, "s long").groupBy("s").count().where("count >= 8").select("s").collect()]
    if not names:
        return None
    wanted = np.array(sorted(names), np.int64)

    def places(batches):
        for part, row, s, t in _found(batches):
            k = np.flatnonzero(np.isin(s, wanted))
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(s[k]), pa.array(t[k]), part.column("doc_id").take(pa.array(row[k])), part.column("h").take(pa.array(row[k]))], ["s", "t", "doc_id", "h"])

    seen = light.mapInArrow(trimmed(places), f"s long, t long, doc_id {kind}, h long")
    check, place = F.shiftright("t", 32), F.col("t").bitwiseAND(0xFFFFFFFF)
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h", place.alias("place"))
    firsts = seen.groupBy("s", check.alias("check")).agg(F.min(order).alias("x"))
    return {(r["s"], r["check"]): (r["x"]["doc_id"], r["x"]["h"], r["x"]["place"]) for r in firsts.toLocalIterator()}


def repeated_places(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, h, places): for each document with repeats, the numbers of the sentences where a non-first span starts."""
    light = pick(docs, "doc_id", "text").where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")
    kind = kind_of(light, "doc_id")
    settled = hot_spans(light, hot)
    found = light.mapInArrow(trimmed(_scan(settled)), f"s long, t long, doc_id {kind}, h long, more array<struct<doc_id:{kind},h:long,place:int>>")
    if settled:  # read twice below
        found = stored(found, "spans")
    place = F.col("t").bitwiseAND(0xFFFFFFFF).cast("int")
    order = Window.partitionBy("s", F.shiftright("t", 32)).orderBy(F.col("doc_id").asc_nulls_last(), "h", place)
    ranked = found.where("s is not null").withColumn("r", F.rank().over(order)).where("r > 1 or more is not null")
    own = F.when(F.col("r") > 1, F.array(F.struct("doc_id", "h", place.alias("place"))))
    none = F.expr(f"cast(array() as array<struct<doc_id:{kind},h:long,place:int>>)")
    each = ranked.select(F.explode(F.concat(F.coalesce(own, none), F.coalesce("more", none))).alias("x")).select("x.doc_id", "x.h", "x.place")
    if settled:
        each = each.unionByName(found.where("s is null").select("doc_id", "h", place.alias("place")))
    return each.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("place")).alias("places"))


def cut(text: pa.Array, places: pa.Array) -> tuple[list, list]:
    """Texts without the sentences that the spans from ``places`` cover, and what was removed; null places leave a text."""
    row, _, first, behind, _, _, to = spans(text)
    kept, gone = [], []
    bounds = np.searchsorted(row, np.arange(len(text) + 1))
    for i, (value, at) in enumerate(zip(text, places)):
        if not at.is_valid or not value.is_valid:
            kept.append(value.as_py())
            gone.append(None)
            continue
        raw = value.as_py()
        a, b = bounds[i], bounds[i + 1]
        p = np.array(at.as_py(), np.int64)
        p = p[p < b - a]
        depth = np.zeros(b - a + 1, np.int64)
        np.add.at(depth, p, 1)
        np.add.at(depth, to[a:b][p], -1)
        covered = np.cumsum(depth[:-1]) > 0
        parts = [raw[s:e] for s, e in zip(first[a:b], behind[a:b])]
        kept.append("".join(x for x, c in zip(parts, covered) if not c).strip())
        gone.append("".join(x for x, c in zip(parts, covered) if c).strip())
    return kept, gone


def _joined(docs: DataFrame, how: str, hot: int) -> DataFrame:
    """``docs`` by position (see ``positional``) with ``text`` and ``places``."""
    found = stored(repeated_places(docs, hot), "repeats")
    size = found.agg(F.sum(F.size("places") * 4 + 64)).first()[0] or 0
    found = found.toDF("at_id", "at_h", "places")
    plain, (doc_id, text) = positional(docs, "doc_id", "text")
    plain = plain.withColumns({"id": doc_id, "text": text.cast("string"), "h": F.xxhash64(text.cast("string"))})
    return plain.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, F.col("id").eqNullSafe(F.col("at_id")) & (F.col("h") == F.col("at_h")), how)


def _cut_struct():
    @F.pandas_udf("text string, removed string")
    def run(text, places):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string(), from_pandas=True), pa.array(places, pa.list_(pa.int32()), from_pandas=True)], ["text", "places"])
        kept, gone = [], []
        for part in portions(batch, most=PORTION):
            k, g = cut(part.column("text"), part.column("places"))
            kept += k
            gone += g
        return pd.DataFrame({"text": pd.Series(kept, dtype=object), "removed": pd.Series(gone, dtype=object)})

    return run


def removals(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, text, removed) of every document that loses sentences: what is left of it, and what was taken."""
    hit = _joined(pick(docs, "doc_id", "text"), "inner", hot)
    return hit.withColumn("x", _cut_struct()("text", "places")).select(F.col("id").alias("doc_id"), "x.text", "x.removed")


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs`` with repeated spans cut out of ``text`` and ``n_chars`` set anew where they were; emptied documents go."""
    low = [c.lower() for c in docs.columns]
    hit = F.col("places").isNotNull()
    x = _joined(docs, "left", hot).withColumn("x", _cut_struct()(F.when(hit, F.col("text")), "places"))
    new = {}
    if "text" in low:
        new[low.index("text")] = F.when(hit, F.col("x.text")).otherwise(F.col("text"))
    if "n_chars" in low:
        k = low.index("n_chars")
        new[k] = F.when(hit, F.char_length("x.text").cast(docs.schema.fields[k].dataType)).otherwise(F.col(f"c{k}"))
    return x.where(~hit | (F.char_length("x.text") > 0)).select(*[new.get(k, F.col(f"c{k}")).alias(f"c{k}") for k in range(len(low))]).toDF(*docs.columns)
