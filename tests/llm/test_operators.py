"""Edge cases that every operator has to stand, and comparisons with brute force where SQL can't express an operator."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltworks.llm import audio, bpe, common, language_id, license_scan, packing, sharding, simhash, span_dedup, url_filter, vector_dedup

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH = "The quick brown fox jumps over the lazy dog while the old farmer watches them from his porch. "
#: Names that the operators use themselves.
CLASHING = ["h", "rank", "node", "bin", "host", "places", "cell", "shard", "fp", "keep", "k0", "k1", "c0", "c1", "c3", "id", "at_id", "at_h", "x", "some", "other0", "other1", "r0", "r1", "n", "__h", "__id", "__url", "__places", "__k_h", "position", "s", "t", "w0", "bucket"]
GERMAN = "Der schnelle braune Fuchs springt über den faulen Hund, während der alte Bauer von der Veranda zusieht. "


@pytest.fixture(scope="module")
def messy(spark):
    long = " ".join(f"word{i % 977} other{i % 311}" for i in range(30_000))
    rows = [(i, ENGLISH * 3 + f"Number {i} comes along here now.", "en", f"a{i}.example.com", 300) for i in range(1, 6)]
    rows += [(i, GERMAN * 3 + f"Nummer {i} kommt jetzt hier entlang.", "de", "b.example.de", 300) for i in range(6, 10)]
    rows += [(10, None, "en", "a.example.com", 0), (11, "", "en", None, 0), (12, long, "en", "a.example.com", len(long)), (13, "!!! ...", None, None, 7), (None, ENGLISH, None, None, 90), (None, None, None, None, None)]
    rows += [rows[0], rows[0], (14, "x", "en", "s", 1), (15, "x", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(c) for c in CLASHING})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_language_edges(spark, messy):
    got = language_id.identify_documents(messy).collect()
    assert len(got) == messy.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["lang"] == "en" and by[6]["lang"] == "de" and by[1]["accepted"] and by[6]["accepted"]
    for k in (10, 11, 13):
        assert by[k]["lang"] is None and by[k]["posterior"] is None and not by[k]["accepted"]
    kept = language_id.keep_identified(messy)
    assert kept.columns == messy.columns
    assert [tuple(r)[5:] for r in kept.limit(1).collect()] == [tuple(CLASHING)]
    assert {10, 11, 13}.isdisjoint({r["doc_id"] for r in kept.collect()}) and {1, 6, 12} <= {r["doc_id"] for r in kept.collect()}
    assert language_id.identify_documents(empty(spark)).count() == 0
    assert language_id.keep_identified(messy.select("doc_id", "text", "lang")).count() == kept.count()
    named = messy.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert {r["doc_id"] for r in language_id.keep_identified(named).collect()} == {r["doc_id"] and f"d{r['doc_id']}" for r in kept.collect()}
    unlabelled = spark.createDataFrame([(1, ENGLISH, None, None, 1)], DOCS)
    assert not language_id.identify_documents(unlabelled).first()["accepted"]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    half = docs.where("doc_id % 2 = 0")
    langs, table = language_id.train(half)
    rest = docs.where("doc_id % 2 = 1 and length(text) > 30")
    rows = rest.select("doc_id", F.lit(0).alias("h"), "text", *[F.lit(None).cast("string").alias(c) for c in ("declared", "suffix", "host", "domain")])
    got = language_id.identify(rows, langs, table).join(rest.select("doc_id", F.col("lang").alias("want")), "doc_id")
    right, n = got.where("lang = want").count(), got.count()
    assert right / n > 0.97


def slots_of(text):
    """Trigram slots of a text, sign by sign."""
    raw = text.lower().encode()
    letter = lambda b: 97 <= b <= 122 or b >= 128
    out = []
    for i in range(1, len(raw) - 1):
        if letter(raw[i]):
            a, b, c = (raw[j] if letter(raw[j]) else 32 for j in (i - 1, i, i + 1))
            x = (a * 40_503 + b * 30_011 + c * 257) & 0xFFFFFFFF
            out.append((x ^ (x >> 11)) & (language_id.SLOTS - 1))
    return out


def brute_languages(rows, labelled):
    """{id: (language, posterior)} by plain loops. rows: (id, text, declared, suffix, host, domain, top); labelled: (text, language)."""
    L = language_id
    counts = {}
    for text, lang in labelled:
        counts.setdefault(lang, []).extend(slots_of(text))
    langs = [*sorted(x for x in counts if counts[x]), L.UND]
    milli = lambda p: round(1000 * math.log(p))
    table = {}
    for x in langs[:-1]:
        n = {}
        for s in counts[x]:
            n[s] = n.get(s, 0) + 1
        table[x] = lambda s, n=n, all=len(counts[x]): round(1000 * math.log((n.get(s, 0) + 0.5 / L.SLOTS) / (all + 0.5)))
    table[L.UND] = lambda s: round(-1000 * math.log(L.SLOTS))
    evidence, guess = {}, {}
    for k, (i, text, declared, suffix, *_) in enumerate(rows):
        slots = slots_of(text or "")
        if not slots:
            continue
        e = [sum(table[x](s) for s in slots) * min(len(slots), L.EFFECTIVE) // len(slots) for x in langs]
        for said, p in ((declared, L.P_DECLARED), (suffix, L.P_SUFFIX)):
            if said in langs[:-1]:
                e = [v + (milli(p) if x == said else milli((1 - p) / (len(langs) - 1))) for v, x in zip(e, langs)]
        evidence[k], guess[k] = e, e.index(max(e))
    total = [sum(g == j for g in guess.values()) for j in range(len(langs))]
    known = max(1, sum(total[:-1]))
    world = [(1 - L.P_UND) * (t + 1) / (known + len(langs) - 1) for t in total[:-1]] + [L.P_UND]
    out = {}
    for k, e in evidence.items():
        score = []
        for j, v in enumerate(e):
            p = world[j]
            for level, mass in ((6, L.TOP_MASS), (5, L.DOMAIN_MASS), (4, L.HOST_MASS)):
                like = [g for m, g in guess.items() if m != k and rows[m][4] is not None and rows[m][level] == rows[k][level]]
                p = (like.count(j) + mass * p) / (len(like) + mass)
            score.append(v + (milli(p) if rows[k][4] is not None else milli(world[j])))
        best = max(score)
        out[rows[k][0]] = (langs[score.index(best)], 1 / sum(math.exp((v - best) / 1000) for v in score))
    return out


def test_language_posterior_against_brute_force(spark):
    rng = random.Random(3)
    texts = [ENGLISH, GERMAN, "x", "the", "der", "Überall", "a e", "", None, "12 34"]
    hosts = [("a.site.co.uk", "site.co.uk", "co.uk"), ("b.site.co.uk", "site.co.uk", "co.uk"), ("w.de", "w.de", "de"), ("plain", "*", "*"), (None, None, None)]
    rows = []
    for i in range(120):
        h = rng.choice(hosts)
        rows.append((i, rng.choice(texts), rng.choice(["en", "EN-us", "de", "xx", None]), rng.choice(["en", "de", None]), *h))
    labelled = [(ENGLISH * 2, "EN-us"), (ENGLISH, "en"), (GERMAN * 3, " de ")]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(labelled)], "doc_id long, text string, lang string")
    langs, table = language_id.train(docs)
    assert langs == ["de", "en", "und"]
    df = spark.createDataFrame([(f"n{r[0]}", r[0], *r[1:5]) for r in rows], "doc_id string, h long, text string, declared string, suffix string, host string")
    got = {int(r["doc_id"][1:]): r for r in language_id.identify(df, langs, table).collect()}
    plain = lambda x: x and x.lower().split("-")[0]
    want = brute_languages([(r[0], r[1], plain(r[2]), *r[3:]) for r in rows], [(ENGLISH * 2, "en"), (ENGLISH, "en"), (GERMAN * 3, "de")])
    assert set(got) == set(range(120))
    for i, r in got.items():
        if i in want:
            assert r["lang"] == want[i][0] and abs(r["posterior"] - want[i][1]) < 2e-3 and r["accepted"] == (r["lang"] != "und" and r["posterior"] >= 0.5), rows[i]
        else:
            assert r["lang"] is None and not r["accepted"]


def undecided(docs):
    """A text that English and German fit alike, and better than chance."""
    langs, table = language_id.train(docs)
    rng, (de, en, und) = random.Random(1), (langs.index(x) for x in ("de", "en", "und"))
    while True:
        text = " ".join(rng.choice((ENGLISH + GERMAN).split()) for _ in range(6))
        e = table[slots_of(f" {text} ")].sum(axis=0)
        if abs(e[de] - e[en]) < 300 and e[en] > e[und] + 5000:
            return text


def test_language_of_pages(spark):
    """Markup, address and host each decide where the text doesn't; nulls and empties give no language."""
    docs = spark.createDataFrame([(i, (ENGLISH, GERMAN)[i % 2] * 2, ("en", "de")[i % 2]) for i in range(20)], "doc_id long, text string, lang string")
    text = undecided(docs)
    pages = [(i, f"https://www.host{i % 2}.example/p{i}", f"<html><script>var x = 'der die das';</script><p>{(ENGLISH, GERMAN)[i % 2]}&nbsp;</p>") for i in range(40)]
    pages += [(100, None, f"<HTML lang='de-AT'><b>{text}</b> "), (101, None, f'<html class=x lang="en"> <b>{text}</b>')]
    pages += [(i, url, f"<p>{text}</p>") for i, url in ((102, "https://x.de/q"), (103, "https://y.net/en/q"), (104, "http://host1.example/z"), (105, "http://host0.example/z"))]
    pages += [(106, None, None), (107, "https://x.de", ""), (None, None, "<p>"), (108, "no address", GERMAN)]
    got = {r["page_id"]: r for r in language_id.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert len(got) == len(pages)
    assert all(got[i]["lang"] == ("en", "de")[i % 2] and got[i]["accepted"] for i in range(40))
    assert [got[i]["lang"] for i in (100, 101, 102, 103, 104, 105, 108)] == ["de", "en", "de", "en", "de", "en", "de"]
    assert all(got[i]["lang"] is None and got[i]["posterior"] is None for i in (106, 107, None))
    assert language_id.identify_pages(spark.createDataFrame([], "page_id long, url string, html string"), docs).count() == 0


def test_language_host_prior_decides(spark):
    """A text that fits two languages alike goes to the one of its host."""
    rows = [(i, ENGLISH * 3, "en", "en.host.org", 1) for i in range(30)] + [(i, GERMAN * 3, "de", "de.host.net", 1) for i in range(30, 60)]
    text = undecided(spark.createDataFrame(rows, DOCS))
    rows += [(100, f" {text} ", None, "en.host.org", 1), (101, f" {text} ", None, "de.host.net", 1)]
    got = {r["doc_id"]: r["lang"] for r in language_id.identify_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[100] == "en" and got[101] == "de"


def test_language_rare_is_trained(spark):
    """The bound of the sample holds for each language: a rare one keeps all its rows however large the table is."""
    swedish = "Den snabba bruna räven hoppar över den lata hunden medan den gamla bonden tittar på från sin veranda. "
    rows = [(i, (ENGLISH, GERMAN)[i % 2] + str(i), ("en", "de")[i % 2], None, 1) for i in range(4000)] + [(i, swedish + str(i), "sv", None, 1) for i in range(4000, 4005)]
    docs = spark.createDataFrame(rows, DOCS)
    langs, table = language_id.train(docs, 100)
    assert langs == ["de", "en", "sv", "und"]
    assert (table[:, 2] == language_id.train(docs.where("lang = 'sv'"))[1][:, 0]).all()
    got = {r["doc_id"]: r for r in language_id.identify_documents(docs, 100).collect()}
    assert all(got[i]["lang"] == "sv" and got[i]["accepted"] for i in range(4000, 4005))
    assert got[0]["lang"] == "en" and got[1]["lang"] == "de"


def test_simhash_edges(spark, messy):
    got = simhash.deduplicate(messy)
    assert got.columns == messy.columns and len(got.columns) > 5
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(1) == 1 and 10 in ids and 11 in ids and 12 in ids and ids.count(None) >= 1
    assert 14 in ids and 15 not in ids
    assert simhash.deduplicate(empty(spark)).count() == 0
    pairs = {(r["doc_id"], r["dup_of"]) for r in simhash.near_duplicates(messy).collect()}
    assert (15, 14) in pairs and all(a != b for a, b in pairs)


    assert [tuple(r)[5:] for r in got.limit(1).collect()] == [tuple(CLASHING)]
    named = simhash.deduplicate(messy.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))))
    assert {r["doc_id"] for r in named.collect() if r["doc_id"]} == {f"d{i}" for i in ids if i is not None} and named.count() == len(ids)
    twice = spark.createDataFrame([(1, ENGLISH, "a"), (1, ENGLISH, "b"), (1, ENGLISH, "a"), (2, None, "a"), (2, None, "a")], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in simhash.deduplicate(twice).collect()) == [1, 2, 2]
    distinct = ["no it is not that", "yes we can do that", "a b", "b a", "x", "x!", "我们今天去北京看长城", "他们昨天在上海吃晚饭", "we go to it", "we go on it by us"]
    assert simhash.deduplicate(spark.createDataFrame(list(enumerate(distinct)), "doc_id long, text string")).count() == len(distinct)


def brute_fingerprint(text):
    """The fingerprint by plain loops: words by a regular expression, sums as whole numbers."""
    import re

    found = re.findall(r"[^\W_]+", text.lower())
    if len(found) < 2:
        return None
    hashes = {}
    M = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
        return x ^ (x >> 31)

    def hashed(word):
        if word not in hashes:
            base, total = 0x9E3779B97F4A7C15, 0
            for i, c in enumerate(word):
                total += mixed((ord(c) + 1) * base & M) * pow(base, i, 1 << 64)
            hashes[word] = mixed((total + len(word)) & M)
        return hashes[word]

    one = {hashed(w) >> 24 for w in found}
    two = {mixed((hashed(a) * 3 + hashed(b)) & M) >> 24 for a, b in zip(found, found[1:])}
    salts = [mixed(i * 0xD1B54A32D192ED03 & M) for i in range(1, 5)]
    sums, weight = np.zeros(256, int), 2 * len(one) + len(two)
    for keys, times in ((one, 2), (two, 1)):
        for key in keys:
            raw = b"".join(mixed(key ^ s).to_bytes(8, "little") for s in salts)
            sums += times * np.unpackbits(np.frombuffer(raw, np.uint8)).astype(int)
    return np.packbits((2 * sums > weight) | ((2 * sums == weight) & simhash._TIE)).tobytes()


def test_fingerprints_against_plain_loops(spark):
    real = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 2000").select("text").collect() if r["text"]][:150]
    texts = real + ["no it is not that", "Ab ab AB", "été über straße", "a_b c", ENGLISH * 40]
    got = simhash.fingerprints(pa.array(texts))
    for t, fp in zip(texts, got):
        want = brute_fingerprint(t)
        assert want is None or want == fp.tobytes(), t[:60]


def test_simhash_against_brute_force(spark):
    """Fingerprints by plain loops, all pairs of them, and groups by a plain union: nothing of the operator's own."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 6000")
    t = docs.select("doc_id", "text").where("text is not null").orderBy("doc_id").toPandas()
    prints = [brute_fingerprint(x) or x.encode() for x in t["text"]]
    bit = np.array([np.unpackbits(np.frombuffer(p, np.uint8)) if len(p) == 32 else np.random.default_rng(abs(hash(p))).integers(0, 2, 256) for p in prints], np.float32) * 2 - 1
    groups = vector_dedup.Groups(len(t))
    groups.join(*np.nonzero(np.triu((simhash.BITS - bit @ bit.T) / 2 <= simhash.RADIUS, 1)))
    want = {(int(t["doc_id"][i]), int(t["doc_id"][groups.label[i]])) for i in range(len(t)) if groups.label[i] != i}
    got = {(r["doc_id"], r["dup_of"]) for r in simhash.near_duplicates(docs).collect()}
    assert len(want) > 100 and len(got & want) >= 0.98 * len(want) and {a for a, _ in got} <= {a for a, _ in want}


def test_simhash_hot_buckets(spark):
    """Families that fill buckets, taken as hot at 40 members: the same groups as without, and as by brute force."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, (3, 256), dtype=np.uint8)
    base[1] = base[0] ^ (rng.random(256) < 0.22)
    rows = [b ^ (rng.random(256) < 0.06) for b in base for _ in range(150)] + list(rng.integers(0, 2, (150, 256), dtype=np.uint8))
    fp = np.unique(np.packbits(np.array(rows, np.uint8), axis=1), axis=0)
    prints = spark.createDataFrame([(bytearray(x.tobytes()),) for x in fp], "fp binary")
    bit = np.unpackbits(fp, axis=1).astype(np.float32) * 2 - 1
    groups = vector_dedup.Groups(len(fp))
    groups.join(*np.nonzero(np.triu((256 - bit @ bit.T) / 2 <= simhash.RADIUS, 1)))
    of = {x.tobytes(): i for i, x in enumerate(fp)}

    def grouped(edges):
        g = vector_dedup.Groups(len(fp))
        e = [(of[bytes(r["u"])], of[bytes(r["v"])]) for r in edges.collect()]
        g.join(np.array([a for a, _ in e]), np.array([b for _, b in e]))
        return g.label.tolist()

    plain = grouped(simhash.links(prints, len(fp)))
    assert simhash.hot_buckets(prints, len(fp), simhash._positions(*simhash.plan(len(fp))), 40)
    assert grouped(simhash.links(prints, len(fp), hot=40)) == plain == groups.label.tolist()
    wide = "bucket long, " + ", ".join(f"w{i} long" for i in range(4))
    members = spark.createDataFrame([(1, *x.view(np.int64).tolist()) for x in fp], wide)
    for rounds in (0, 1, 6):
        assert grouped(simhash.hot_edges(members, hot=40, block=64, rounds=rounds)) == groups.label.tolist()


@pytest.mark.parametrize("n", [10_000, 1_000_000, 10_000_000])
def test_simhash_recall_at_the_radius(n):
    """Pairs as far apart as the radius share a bucket as often as RECALL says, with the tables of a large input too."""
    rng = np.random.default_rng(7)
    positions = simhash._positions(*simhash.plan(n))
    a = rng.integers(0, 2, (4000, simhash.BITS), dtype=np.uint8)
    b = a.copy()
    far = rng.permuted(np.tile(np.arange(simhash.BITS), (4000, 1)), axis=1)[:, : simhash.RADIUS]
    np.put_along_axis(b, far, 1 - np.take_along_axis(b, far, 1), 1)
    keys = [simhash.bucket_keys(np.packbits(x, axis=1), positions) for x in (a, b)]
    assert (keys[0] == keys[1]).any(axis=1).mean() >= simhash.RECALL - 0.01


def test_bit_slices_count_exactly():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 256, (200, 32), dtype=np.uint8)
    fp[100:] = fp[:100] ^ (rng.random((100, 32)) < 0.1) * rng.integers(0, 8, (100, 32), dtype=np.uint8)
    a, b = simhash.bucket_edges(np.zeros(200, np.int64), fp)
    bit = np.unpackbits(fp, axis=1).astype(int)
    d = (bit[:, None] != bit[None]).sum(axis=2)
    groups = vector_dedup.Groups(200)
    groups.join(*np.nonzero(np.triu(d <= simhash.RADIUS, 1)))
    want = {(i, int(groups.label[i])) for i in range(200) if groups.label[i] != i}
    assert {(int(x), int(y)) for x, y in zip(a, b)} == want and want


PAGES = [
    (1, "http://www.shop.example.com/a.html?utm_source=x#top", "<link rel='canonical' href='https://other.example.org/x'>"),
    (2, "https://other.example.org/x/", None),
    (3, "https://m.shop.example.com/a", "<meta http-equiv=\"refresh\" content=\"0; url=/b\">"),
    (4, "https://shop.example.com/b?ref=q&page=2", "<p>"),
    (5, "https://spam-farm.example.org/q", "<link href=https://mirror.example.net/ rel=canonical>"),
    (6, "https://mirror.example.net", ""),
    (7, "https://cheap-pills.example.com/fr/9", "<link rel=canonical href=https://cheap-pills.example.com/en/9>"),
    (8, "http://cheap-pills.example.com/en/9#x", None),
    (9, None, "<html>"),
    (10, "mailto:a@b", "<link rel=canonical href=javascript:x>"),
    (11, "https://rel.example.com/a/b/c.html?x=1", "<link rel=canonical href='../d.html'><link rel=canonical href='#top'><meta http-equiv=refresh content='0;url=?page=2&amp;y=1'>"),
    (12, "https://rel.example.com/a/d", None),
    (13, "https://rel.example.com/a/b/c?page=2&y=1", ""),
    (14, "https://rel.example.com", "<link rel=canonical href=e/./f><link rel=canonical href='//other.example.org/x'>"),
    (15, "https://rel.example.com/e/f", "x" * 200_000),
    (5, "https://spam-farm.example.org/q", "<link href=https://mirror.example.net/ rel=canonical>"),
]


def test_url_filter(spark, tmp_path):
    import duckdb

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("node", "root", "u", "norm")})
    got = sorted((r["page_id"], str(r["url"]), str(r["alias_of"]), r["decision"]) for r in url_filter.decide(pages).collect())
    decisions = {g[0]: g[3] for g in got}
    assert decisions == {1: "unlisted", 2: "unlisted", 3: "unlisted", 4: "unlisted", 5: "blocked", 6: "blocked", 7: "allowed", 8: "allowed", 9: "unlisted", 10: "unlisted", **dict.fromkeys(range(11, 16), "unlisted")}
    alias = {g[0]: g[2] for g in got}
    assert alias[1] == alias[2] == alias[3] != alias[4] and alias[5] == alias[6] and alias[7] == alias[8] and alias[11] == alias[12] == alias[13] and alias[14] == alias[15] == alias[2] != alias[11]
    con = duckdb.connect()
    path = str(tmp_path / "pages.parquet")
    pages.select("page_id", "url", "html").toPandas().to_parquet(path)
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}'")
    want = sorted((r[0], str(r[1]), str(r[2]), r[3]) for r in con.sql(url_filter.oracle()).fetchall())
    assert got == want
    assert {r["page_id"] for r in url_filter.kept(pages).collect()} == {1, 2, 3, 4, *range(7, 16)}
    assert url_filter.kept(pages.withColumns({c: F.lit(1) for c in CLASHING})).count() == url_filter.kept(pages).count()
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.decide(none).count() == 0
    known = spark.createDataFrame([("https://clean.example.com/", "https://spam-farm.example.org/q"), (None, "x")], "src string, dst string")
    one = spark.createDataFrame([(1, "https://clean.example.com", None)], "page_id long, url string, html string")
    assert url_filter.decide(one, redirects=known).first()["decision"] == "blocked"


def test_url_filter_propagates_along_long_chains(spark):
    """60 chains of 12 hosts, linked by canonical links, refreshes and known redirects in turn; rules name single members."""
    at = lambda c, k: f"https://c{c}-{k}.example.com/p"
    pages, known = [], []
    for c in range(60):
        for k in range(12):
            to = at(c, k + 1)
            html = (f"<link rel=canonical href={to}>", f"<meta http-equiv=refresh content='0; url={to}'>", None)[k % 3] if k < 11 else None
            pages.append((c * 12 + k, at(c, k), html))
            if k % 3 == 2 and k < 11:
                known.append((at(c, k), to))
    rules = [("block", f"c{c}-{c % 12}.example.com") for c in range(60) if c % 3 != 0] + [("allow", f"c{c}-{(c + 5) % 12}.example.com/p") for c in range(60) if c % 3 == 2]
    got = url_filter.decide(spark.createDataFrame(pages, "page_id long, url string, html string"), rules=spark.createDataFrame(rules, "action string, value string"), redirects=spark.createDataFrame(known, "src string, dst string")).collect()
    assert {r["page_id"]: r["decision"] for r in got} == {c * 12 + k: ("unlisted", "blocked", "allowed")[c % 3] for c in range(60) for k in range(12)}
    assert len({r["alias_of"] for r in got}) == 60


def test_license_scan(spark, messy):
    texts = ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "x\nSPDX-License-Identifier: MIT\n" * 2, "Copyright 2020 A. All rights reserved.", "plain", "", None, "a " * 60_000 + " released under the MIT license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("rule", F.lit(1))
    got = license_scan.detect(docs).collect()
    by = {i: [(r["license"], r["matched"]) for r in got if r["doc_id"] == i] for i in range(len(texts))}
    assert [x[0] for x in by[0]] == ["apache-2.0"] and len(by[1]) == 2 and len(by[2]) == 2 and not by[3] and not by[4] and not by[5] and [x[0] for x in by[6]] == ["mit"]
    assert license_scan.detect(empty(spark)).count() == 0 and license_scan.detect(messy).count() == 0
    turkish = license_scan.detect(spark.createDataFrame([("a", "İİİ released under the MIT license now"), ("b", "SPDX-License-Identifier: GPL-2.0-only\n"), ("c", "// SPDX-License-Identifier: (MIT OR Apache-2.0)")], "doc_id string, text string")).collect()
    assert [(r["doc_id"], r["license"], r["matched"]) for r in turkish] == [("a", "mit", "released under the MIT license"), ("b", "gpl-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"), ("c", "mit or apache-2.0", "SPDX-License-Identifier: (MIT OR Apache-2.0)")]
    rules = license_scan.compiled()
    assert len(rules) >= 150

    def brute(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        return license_scan.resolve([(p, n, m.start(), m.end()) for n, p, _, _, rule in rules for m in rule.finditer(low) if m.end() > m.start()])

    real = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 3000").select("text").collect()][:300]
    scanner = license_scan.Scanner()
    for t in real + [t for t in texts if t]:
        assert scanner.scan(t) == brute(t)


@pytest.mark.parametrize(("n", "dim", "noise"), [(3000, 16, 0.25), (3000, 16, 0.45), (20_000, 64, 0.47)])
def test_vector_dedup_against_brute_force(spark, n, dim, noise):
    """Recall of 0.9 over planted pairs, those about the threshold too, and nothing below the threshold."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    for k in range(n // 10):
        x[n - 1 - k] = x[k] / np.linalg.norm(x[k]) + rng.normal(size=dim) * noise / math.sqrt(dim)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    y = x.astype(np.float32).astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    groups = vector_dedup.Groups(len(x))
    for lo in range(0, n, 2000):
        a, b = np.nonzero(y[lo : lo + 2000] @ y.T >= vector_dedup.THRESHOLD)
        groups.join(lo + a, b)
    want = {(i, int(groups.label[i])) for i in range(len(x)) if groups.label[i] != i}
    got = {(r["vec_id"], r["dup_of"]) for r in vector_dedup.duplicates(df).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(want) > 100
    assert {a for a, _ in got} <= {a for a, _ in want}


def test_vectors_in_bytes_settle_or_leave_open():
    """Pairs called sure reach the threshold, and no pair that reaches it is dropped."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.88, 0.92, (150, 1))
    x = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * side]).astype(np.float32)
    q, scale, error = vector_dedup.in_bytes(x)
    u, v, a, b = vector_dedup.cell_pairs(q.astype(np.float32) * scale[:, None], error, np.ones(300, bool), 0.9)
    true = x.astype(float) @ x.T.astype(float) >= 0.9
    assert 20 < len(a) and 20 < len(u) and len({*map(tuple, np.sort(np.stack([a, b]), axis=0).T)}) < 140
    got, want = vector_dedup.Groups(300), vector_dedup.Groups(300)
    exact = true[a, b]
    got.join(np.concatenate([u, a[exact]]), np.concatenate([v, b[exact]]))
    want.join(*np.nonzero(true))
    assert (got.label == want.label).all()


def test_vector_dedup_edges(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0, 0.0]), (4, None), (5, [1.0, 2.0]), (6, [float("nan"), 1.0, 1.0, 1.0]), (7, [0.0, 1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.0]), (8, [None, 1.0, 1.0, 1.0]), (9, [2.0, 4.0]), (10, []), (11, [3.0]), (12, [5.0]), (13, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "cell", "node", "home")})
    got = {(r["vec_id"], r["dup_of"]) for r in vector_dedup.duplicates(df).collect()}
    assert got == {(2, 1), (None, 1), (9, 5), (12, 11)}
    named = vector_dedup.duplicates(df.withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id")))).collect()
    assert {(r["vec_id"], r["dup_of"]) for r in named} == {("v2", "v1"), (None, "v1"), ("v9", "v5"), ("v12", "v11")}
    assert vector_dedup.duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_multi_sequence_order():
    rng = np.random.default_rng(0)
    a, b = rng.random((50, 7)), rng.random((50, 5))
    q, i, j = vector_dedup.multi_sequence(a, b, 0.05, 0.9)
    w = np.exp(-(a[:, :, None] + b[:, None]) / 0.1)
    for k in range(50):
        mine = q == k
        cost = a[k, i[mine]] + b[k, j[mine]]
        assert (np.diff(cost) >= -1e-12).all() and len(set(zip(i[mine], j[mine]))) == mine.sum()
        assert w[k, i[mine], j[mine]].sum() >= 0.9 * w[k].sum() - 1e-9
        assert np.isclose(cost, np.sort((a[k][:, None] + b[k]).ravel())[: mine.sum()]).all()


def test_packing(spark, messy):
    rng = random.Random(5)
    rows = [(i, "x" * rng.choice([0, 1, 7, 40, 99, 100, 101, 350, rng.randint(1, 120)]), "en", "s", 0) for i in range(800)] + [(None, "y" * 30, "en", "s", 0), (3, "z" * 10, None, None, None), (3, "z" * 10, None, None, None), (900, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("rest", F.lit(1))
    got = packing.pack(docs, 100).collect()
    total = sum(len(r[1] or "") for r in rows)
    assert sum(r["length"] for r in got) == total
    bins = {}
    for r in got:
        bins.setdefault(r["bin"], []).append((r["at"], r["at"] + r["length"]))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] >= 0 and spans[-1][1] <= 100 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    # brute force: best-fit decreasing over the same pieces
    pieces = sorted((p for r in rows for p in [100] * (len(r[1] or "") // 100) + [len(r[1] or "") % 100] if p), reverse=True)
    rooms = []
    for p in pieces:
        fit = [x for x in rooms if x >= p]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - p)
        else:
            rooms.append(100 - p)
    assert len(bins) <= 1.03 * len(rooms) + 1
    assert packing.pack(empty(spark)).count() == 0 and packing.pack(messy).count() > 0


PASSAGE = "It was on a cold and windy day that the three sisters left the village by the sea. They carried bread and cheese and a lamp for the night. Nobody saw them pass the old mill before the snow began to fall. Later the miller said that he had heard singing from the road."


def brute_sentences(text):
    """(first sign, sign behind the last, words) of each sentence, by walking the text."""
    import re

    is_word = lambda c: c.isalnum()
    alone = lambda c: 0x3400 <= ord(c) <= 0x9FFF or 0x3040 <= ord(c) <= 0x30FF
    units, i = [], 0
    for m in re.finditer(r"[^\W_]+", text):
        for run in re.findall(r"[\u3040-\u30ff\u3400-\u9fff]|[^\u3040-\u30ff\u3400-\u9fff]+", m[0]):
            at = text.index(run, max(i, m.start()))
            units.append((at, at + len(run), run.lower()))
            i = at + len(run)
    groups, now = [], []
    for k, (a, b, w) in enumerate(units):
        now.append(k)
        gap = text[b : units[k + 1][0]] if k + 1 < len(units) else "\n"
        ended = "\n" in gap or any(x in gap for x in "。！？") or re.search(r"[.!?][\"')\]]*\s", gap)
        if ended or k + 1 == len(units):
            groups.append(now)
            now = []
    out = []
    for g in groups:
        if len(g) <= span_dedup.LONG:
            out.append(g)
            continue
        now = []
        for k in g:
            now.append(k)
            h = int(common.words(pa.array([units[k][2]])).hash[0])
            if h % span_dedup.CUT == 0:
                out.append(now)
                now = []
        if now:
            out.append(now)
    assert is_word("a") and alone("東")
    starts = [0 if n == 0 else units[g[0]][0] for n, g in enumerate(out)] + [len(text)]
    return [(starts[n], starts[n + 1], tuple(units[k][2] for k in g)) for n, g in enumerate(out)]


def brute_dedup(texts):
    """Texts without repeated spans, which are compared as lists of words."""
    seen, out = set(), []
    for text in texts:
        parts = brute_sentences(text)
        gone = set()
        for n in range(len(parts)):
            m, size = n, 0
            while m < len(parts) and (m - n < span_dedup.SENTENCES or size < span_dedup.WORDS):
                size += len(parts[m][2])
                m += 1
            if m - n < span_dedup.SENTENCES or size < span_dedup.WORDS:
                continue
            key = tuple(w for p in parts[n:m] for w in p[2])
            if key in seen:
                gone.update(range(n, m))
            seen.add(key)
        out.append("".join(text[a:b] for n, (a, b, _) in enumerate(parts) if n not in gone).strip() if gone else text)
    return out


CHINESE = "我们今天早上一起去了北京的长城。天气非常好而且没有风！你知道那里有多少人吗？他们都带着孩子和相机。"


def passages(rng, n):
    noise = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 999)) + rng.choice(["", "", "", ".", ",", "?"]) for _ in range(40)) + ". "
    unpunctuated = " ".join(f"w{i * i % 97}" for i in range(90))
    fixed = [PASSAGE, CHINESE, unpunctuated, 'He said "stop it now!" She did not. (Nobody knew why.) Then it was over and done with at last.\nA line.\n']
    return [noise() + rng.choice(fixed) + " " + noise() for _ in range(n)]


def test_substring_dedup(spark, messy):
    rng = random.Random(2)
    line = "This work is licensed under the GNU General Public License, version 3.\n"
    texts = passages(rng, 25) + [PASSAGE, PASSAGE.upper(), line + "Here goes one text of its own.", "Another one has it too.\n" + line, PASSAGE + " " + PASSAGE, "A lone sentence of more than a dozen words stands here and it is in two texts.", "Other words. A lone sentence of more than a dozen words stands here and it is in two texts."]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS).withColumns({c: F.lit(c) for c in CLASHING})
    want = brute_dedup(texts)
    out = {r["doc_id"]: r for r in span_dedup.remove_repeats(docs).collect()}
    for i, w in enumerate(want):
        assert (out[i]["text"] if i in out else "") == w and (i not in out or out[i]["n_chars"] == len(w)), i
    assert sum(a != b for a, b in zip(texts, want)) > 20 and 26 not in out and [out[i]["text"] for i in (27, 28, 30, 31)] == [texts[i] for i in (27, 28, 30, 31)]
    assert span_dedup.remove_repeats(docs).columns == docs.columns and [tuple(r)[5:] for r in span_dedup.remove_repeats(docs).limit(1).collect()] == [tuple(CLASHING)]
    # the same where spans count as hot, and where ids are strings
    plain = sorted((r["doc_id"], r["text"], r["removed"]) for r in span_dedup.removals(docs).collect())
    assert sorted((r["doc_id"], r["text"], r["removed"]) for r in span_dedup.removals(docs, hot=8).collect()) == plain
    light = docs.select(F.col("doc_id").alias("doc_id"), "text").where("text is not null")
    assert span_dedup.hot_spans(light.select("doc_id", F.xxhash64("text").alias("h"), "text"), 8)
    named = span_dedup.removals(docs.withColumn("doc_id", F.format_string("d%03d", "doc_id"))).collect()
    assert sorted((int(r["doc_id"][1:]), r["text"], r["removed"]) for r in named) == plain
    kept = span_dedup.remove_repeats(messy)
    assert kept.columns == messy.columns and {10, 11, 14, 15} <= {r["doc_id"] for r in kept.collect()}
    assert span_dedup.remove_repeats(empty(spark)).count() == 0 and span_dedup.removals(empty(spark)).count() == 0
    again = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, PASSAGE + " More."), (None, PASSAGE)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in span_dedup.remove_repeats(again).collect())
    assert got[:2] == [("1", PASSAGE)] * 2 and len(got) == 3


def test_audio_against_naive():
    rng = np.random.default_rng(4)
    for rate in (8000, 44100, 22050, 16000, 48000):
        x = rng.normal(size=rate // 20) * 0.1
        y = audio.resample(x, rate)
        g = math.gcd(rate, audio.RATE)
        up, down = audio.RATE // g, rate // g
        if up == down:
            assert (y == x).all()
            continue
        filters, before = audio.phases(up, down)
        for m in list(range(0, len(y), 37)) + [len(y) - 1]:
            base, phase = divmod(m * down, up)
            want = sum(filters[phase][k] * x[base - before + k] for k in range(filters.shape[1]) if 0 <= base - before + k < len(x))
            assert abs(y[m] - want) < 1e-9
    x = rng.normal(size=1200) * 0.1
    mel, level = audio.log_mel(x)
    f, n = 2, np.arange(audio.WINDOW)
    frame = x[f * audio.HOP : f * audio.HOP + audio.WINDOW]
    spectrum = [abs(sum(frame * (0.5 - 0.5 * np.cos(2 * np.pi * n / audio.WINDOW)) * np.exp(-2j * np.pi * k * n / audio.FFT))) ** 2 for k in range(audio.FFT // 2 + 1)]
    assert np.allclose(mel[f], np.log(np.maximum(np.array(spectrum) @ audio.mel_weights(), audio.FLOOR)), atol=1e-4)
    assert abs(level[f] - 10 * np.log10((frame**2).mean())) < 1e-9
    t = np.arange(16000) / 16000
    tone = np.sin(2 * np.pi * 1000 * t) * ((t > 0.3) & (t < 0.6))
    ((_, start, end, frames, tensor, spans), *rest) = audio.features(audio.wav(np.round(tone * 20000), 16000))
    found = [s for r in [(0, start, end, frames, tensor, spans), *rest] for s in r[5]]
    assert abs(found[0][0] - 0.3) < 0.03 and abs(found[-1][1] - 0.6) < 0.03
    up = audio.resample(np.sin(2 * np.pi * 440 * np.arange(8000) / 8000), 8000)
    assert np.abs(up[200:-200] - np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)[200:-200]).max() < 0.01


def test_audio_edges(spark):
    good = audio.wav(np.round(np.sin(np.arange(20_000) / 5) * 9000), 8000)
    rows = [(1, good), (2, None), (3, b""), (4, b"RIFFxxxx"), (5, good[:50]), (6, audio.wav(np.zeros(0), 8000)), (1, good), (None, audio.wav(np.zeros(10), 8000))]
    df = spark.createDataFrame([(i, bytearray(a) if a is not None else None) for i, a in rows], "media_id long, audio binary").withColumn("mel", F.lit(1))
    out = audio.extract(df)
    got = out.orderBy("media_id", "chunk").collect()
    one = [r for r in got if r["media_id"] == 1]
    assert len(one) % 2 == 0 and len(one) > 4 and all(len(r["mel"]) == audio.FRAMES * audio.MELS for r in one)
    assert {r["media_id"]: r["ok"] for r in got} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False, None: True}
    table = audio.as_tensors(out.toArrow())
    assert table.schema.field("mel").type == pa.fixed_shape_tensor(pa.float32(), audio.SHAPE)
    assert audio.extract(df.limit(0)).count() == 0
    assert max(r["end_s"] for r in one) == pytest.approx(2.5)


def test_sharding(spark, messy, tmp_path):
    docs = spark.createDataFrame([(i, "t", "en", "abc"[min(i % 7, 2)], 1) for i in range(997)], DOCS).withColumns({c: F.lit(1) for c in ("n", "k", "b")})
    got = sharding.assign_shards(docs, 10).toPandas()
    assert len(got) == 997 and sorted(got["doc_id"]) == list(range(997))
    for source, n in got.groupby("source").size().items():
        per = got[got["source"] == source].groupby("shard").size().reindex(range(10), fill_value=0)
        assert per.max() - per.min() <= 1 and abs(per.mean() - n / 10) < 1e-9
    for _, g in got.groupby("shard"):
        assert sorted(g["position"]) == list(range(len(g)))
    assert sharding.assign_shards(messy, 4).count() == messy.count()
    path = str(tmp_path / "shards")
    sharding.write_shards(messy, path, 3)
    back = spark.read.parquet(path)
    assert back.columns[:-1] == messy.columns and back.columns[-1] == "shard_of"
    show = lambda df: sorted(map(repr, df.select(*[F.col(f"`{c}`") for c in messy.columns]).collect()))
    assert show(back) == show(messy)
    assert sharding.assign_shards(empty(spark)).count() == 0


def test_bpe_against_reference_library(spark, messy):
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    ranks = bpe.load()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    odd = ["", " ", "  a", "a  b   c", "I'll we've they're it's 'quoted' 'l 've", "x\n\n  y\t z ", "été über 東京 Ω≈ç 123abc ４５", "  a　", "🙂 👩‍👩‍👧 é", "''''s", "don''t  'S", "a" * 5000, "1" * 300 + " " * 50 + "!" * 60]
    odd += ["".join(rng.choice("ab 1'\n\tslrvetdm.éß東  !") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    real = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect() if r["text"]][:400]
    encoder, decoder = bpe.Encoder(ranks), bpe.Decoder(ranks)
    for batch in (odd, real):
        data, at = bpe.utf8(pa.array(batch))
        ids, offsets, head = encoder.encode(data, at)
        for i, t in enumerate(batch):
            mine = ids[head[i] : head[i + 1]].tolist()
            assert mine == own.encode_ordinary(t), repr(t)[:80]
            assert decoder.decode(ids[head[i] : head[i + 1]]).tobytes().decode() == t
            assert offsets[head[i] : head[i + 1]].tolist() == np.cumsum([0, *[len(own.decode_single_token_bytes(x)) for x in mine]])[:-1].tolist()
    spaced = messy.withColumnRenamed("doc_id", "my id")
    assert bpe.decode(bpe.encode(spaced, id_column="my id"), id_column="my id").columns == ["my id", "text"]
    assert bpe.encode(spaced, id_column="my id").count() == messy.count()
    got = bpe.encode(messy).collect()
    assert len(got) == messy.count() and all((r["ids"] is None) == (r["exact"] is None) for r in got) and all(r["exact"] in (True, None) for r in got)
    back = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in bpe.decode(bpe.encode(messy)).collect())
    assert back == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in messy.collect())
    assert bpe.encode(empty(spark)).count() == 0


def expansions(items):
    """Texts that an expression's parts match: every branch and member of a class, repeats at their least and once more."""
    out = {""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            own = {chr(arg)}
        elif name == "IN":
            own = {"x"} if str(arg[0][0]) == "NEGATE" else {chr(a if str(o) == "LITERAL" else a[0]) if str(o) != "CATEGORY" else "1" if "DIGIT" in str(a) else "x" for o, a in arg}
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            one = expansions(arg[2])
            own = {x * arg[0] for x in one} | {x * min(arg[0] + 1, arg[1]) for x in one}
        elif name == "SUBPATTERN":
            own = expansions(arg[3])
        elif name == "BRANCH":
            own = set().union(*[expansions(x) for x in arg[1]])
        else:
            own = {""} if name == "AT" else {"x"}
            assert name in ("ANY", "AT", "NOT_LITERAL"), name
        out = {a + b for a in out for b in own}
    return out


def test_license_keywords_are_in_every_match():
    from re import _parser

    bad = {}
    for n, _, _, word, rule in license_scan.RULES:
        texts = [" ".join(t.split()) for t in expansions(_parser.parse(rule))]
        missed = [t for t in texts if not any(w in t for w in word.split(";"))]
        if missed:
            bad[n] = missed[0]
    assert not bad


def test_license_scan_equals_every_rule_by_itself():
    """A text from each branch of each rule: what the gated scan finds is what all rules find without the gate."""
    from re import _parser

    scanner, rng = license_scan.Scanner(), random.Random(4)
    for n, _, _, _, rule in license_scan.RULES:
        texts = sorted(expansions(_parser.parse(rule)))
        for t in rng.sample(texts, min(4, len(texts))):
            text = f"Before it.\n{t.title() if rng.random() < 0.5 else t}\nand after it"
            low = license_scan.lowered(text)
            brute = license_scan.resolve([(p, k, m.start(), m.end()) for k, p, _, _, r in scanner.rules for m in r.finditer(low) if m.end() > m.start()])
            assert scanner.scan(text) == brute and brute, (n, t)


def test_license_spellings():
    scanner = license_scan.Scanner()
    names = lambda text: [scanner.rules[n][2] for _, n, _, _ in scanner.scan(text)]
    assert names("Bound by the End-User License Agreement.") == names("an end user licence\nagreement") == ["eula"]
    assert names("Released under the zlib/libpng license") == names("released under the zlib licence") == ["zlib"]
    assert names("No part of this publication may be reproduced without permission") == names("This work may not be reproduced in any form without written consent") == ["proprietary"]
    assert names("the Expat licence") == ["mit"] and names("ISC  licence") == ["isc"] and names("a BSD\nlicence") == ["bsd"]
    assert names("released under the PostgreSQL licence") == ["postgresql"] and names("Licensed under Open RAIL-M license") == ["openrail-m"]
    assert names("The Software is provided to you by the Licensor under the License, as defined below, subject to the following condition") == ["commons-clause"]
