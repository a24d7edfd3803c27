"""The pipeline's stages by themselves and together."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from siltworks.llm import language_id, packing, simhash, vector_dedup

from .test_operators import brute_dedup, brute_fingerprint, brute_languages

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash", "substring_dedup", "best_fit_packing"]
    x = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        y = stage(spark, x, DATA)
        assert y.columns == docs.columns
        assert {r["doc_id"] for r in y.collect()} <= {r["doc_id"] for r in x.collect()}
        x = y
    assert x.count() > 0.7 * docs.select("text").distinct().count()


def test_run_against_brute_force(spark):
    """All four stages by plain loops, from which only the bins' numbers may differ: they have to be sound and as few."""
    rows = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]
    languages = brute_languages([(r["doc_id"], r["text"], None, None, r["source"] and r["source"].lower(), "*", "*") for r in rows], [(r["text"], r["lang"]) for r in rows if r["text"] and r["lang"]])
    rows = [r for r in rows if languages.get(r["doc_id"], ("und", 0))[0] != "und" and languages[r["doc_id"]][1] >= language_id.MIN_POSTERIOR]
    prints = [brute_fingerprint(r["text"]) or r["text"].encode() for r in rows]
    bit = np.array([np.unpackbits(np.frombuffer(p, np.uint8)) if len(p) == 32 else np.random.default_rng(abs(hash(p))).integers(0, 2, 256) for p in prints], np.float32) * 2 - 1
    groups = vector_dedup.Groups(len(rows))
    groups.join(*np.nonzero(np.triu((simhash.BITS - bit @ bit.T) / 2 <= simhash.RADIUS, 1)))
    rows = [r for i, r in enumerate(rows) if groups.label[i] == i]
    texts = brute_dedup([r["text"] for r in rows])
    capacity, want = packing.CAPACITY, []
    for r, t in zip(rows, texts):
        want += [(r["doc_id"], at // capacity, at, min(capacity, len(t) - at)) for at in range(0, len(t), capacity)]
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got) == sorted(want) and len(want) > 100
    bins = {}
    for r in got:
        bins.setdefault(r["bin"], []).append((r["at"], r["at"] + r["length"]))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] >= 0 and spans[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    rooms = []
    for n in sorted((w[3] for w in want), reverse=True):
        fit = [x for x in rooms if x >= n]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - n)
    assert len(bins) <= 1.03 * len(rooms) + 1


def test_messy_and_empty(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    empty = spark.createDataFrame([], schema)
    text = "One of the men said that the other should have been there before the day was over, and then they all went home to eat. "
    docs = spark.createDataFrame([(1, text * 5, "en", "a", 1, 1), (1, text * 5, "en", "a", 1, 1), (None, text * 5 + "More.", "en", None, None, None), (2, None, None, None, None, None), (3, "", "en", "a", 0, 1)], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
        out = stage(spark, docs, DATA)
        ids = [r["doc_id"] for r in out.collect()]
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns and set(ids) == {"language_id": {1, None}, "simhash": {1, 2, 3}, "substring_dedup": {1, 2, 3, None}}[name]
    huge = docs.limit(1).withColumn("text", F.repeat(F.lit(text), 4000)).withColumn("doc_id", F.lit(9).cast("long"))
    x = docs.unionByName(huge)
    for _, stage in corpus_pipeline.STAGES:
        x = stage(spark, x, DATA)
    lengths = {r["doc_id"]: r["n"] for r in x.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert set(lengths) <= {1, None, 9} and lengths[1] > 0
    assert simhash.deduplicate(docs).where(F.col("doc_id") == 1).count() == 1
