"""Language identification by Bayesian evidence fusion.

The posterior of a language is the normalised product of independent evidence, in thousandths of a nat (whole numbers, so
that sums don't depend on their order):

* text: byte-trigram log likelihoods over the whole text, from counts of a bounded labelled sample of each language
  (``TRAIN_DOCS`` of it, in expectation, all where it has no more), tempered to at most ``EFFECTIVE`` trigrams, since neighbours overlap;
* declared language (the lang attribute of ``<html>``, or a column that is named), right with ``P_DECLARED``;
* address suffix (country or language suffix of the host, or a leading path segment), right with ``P_SUFFIX``;
* the host's prior: counts of each host's most likely languages over all rows, grouped by host, registered domain and public
  suffix, smoothed down the hierarchy: all rows, suffix, domain, host. A row's own guess is taken out of the counts it is
  judged by. ``source`` is the host of documents.

The ``lang`` column of documents is what the sample is labelled with, so it isn't evidence unless ``declared`` asks for it. Labels
and declared languages are taken in lower case and without region (``EN-us`` is ``en``).

"und" (undetermined) is one more language with uniform trigrams: what fits no trained language better than chance goes there.
A document is accepted if its best language isn't "und" and has at least ``MIN_POSTERIOR``.

Defined cases: null text, and text without letters, has no language, posterior null, and isn't accepted; null declared
language, address or host gives no such evidence; repeated rows get equal results; a table without labelled rows
leaves "und" alone, and nothing is accepted; ties go to the language that sorts first; very long texts count whole; an
empty table gives no rows; extra columns don't matter and pass through the filter, whatever their names; ids may be of any type.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind_of, less_rows, pick, portions, positional, small, stored, trimmed, utf8

TRAIN_DOCS = 20_000
SLOTS = 1 << 16
EFFECTIVE = 60
P_DECLARED, P_SUFFIX = 0.9, 0.8
P_UND = 0.01
TOP_MASS, DOMAIN_MASS, HOST_MASS = 100.0, 50.0, 20.0
#: Counts of hosts are broadcast up to this many bytes.
BROADCAST_BYTES = 48 << 20
MIN_POSTERIOR = 0.5
UND = "und"
_LETTER = np.zeros(256, bool)
_LETTER[list(range(97, 123)) + list(range(128, 256))] = True
#: Labels below a country's that are part of its public suffixes (``co.uk``).
SECOND = ("ac", "co", "com", "edu", "go", "gov", "gob", "mil", "ne", "net", "or", "org")
#: Country and language suffixes and path segments that speak for a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "en": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "se": "sv", "ru": "ru", "jp": "ja", "cn": "zh"}


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slot of the trigram around each byte of the lower-cased texts (SLOTS where it isn't a letter), and the texts' offsets."""
    data, at = utf8(pc.utf8_lower(column))
    letter = _LETTER[data]
    b = np.where(letter, data, 32).astype(np.uint32)
    slot = np.full(len(b), SLOTS, np.uint32)
    if len(b) > 2:
        x = b[:-2] * np.uint32(40_503) + b[1:-1] * np.uint32(30_011) + b[2:] * np.uint32(257)
        slot[1:-1] = (x ^ (x >> np.uint32(11))) & np.uint32(SLOTS - 1)
    slot[~letter] = SLOTS
    some = at[1:] > at[:-1]
    slot[at[:-1][some]] = SLOTS
    slot[at[1:][some] - 1] = SLOTS
    return slot, at


def _count(batches):
    for batch in batches:
        for part in portions(batch):
            code = part.column("lang").dictionary_encode()
            slot, at = trigrams(part.column("text"))
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            lang = code.indices.to_numpy()[row].astype(np.int64)
            use = slot < SLOTS
            n = np.bincount(lang[use] * SLOTS + slot[use])
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(k // SLOTS)), pa.array((k % SLOTS).astype(np.int32)), pa.array(n[k])], ["lang", "slot", "n"])


def plain_language(c: Column) -> Column:
    """A language tag without region, in lower case; null where it is empty."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(c.cast("string")), r"^([A-Za-z]+)", 1)), F.lit(""))


def train(labelled: DataFrame, most: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages, sorted and then "und", and (SLOTS + 1, languages) log likelihoods. labelled: (doc_id, text, lang).

    The sample of each language is a hash threshold on the id, set so that about ``most`` of its rows fall under it; a language
    with no more than ``most`` gives all its rows, so that a rare one is known in a table of any size. One without a
    single letter in its texts can't be told from "und" and is left out.
    """
    rows = pick(labelled, "doc_id", "text", "lang").withColumn("lang", plain_language(F.col("lang"))).where("text is not null and lang is not null").where(F.col("lang") != UND)
    counts = rows.groupBy("lang").count().collect()
    limits = [F.lit(x) for r in counts if r["count"] > most for x in (r["lang"], math.ceil(1_000_000 * most / r["count"]))]
    if limits:
        limit = F.coalesce(F.try_element_at(F.create_map(*limits), F.col("lang")), F.lit(1_000_000))
        rows = rows.where(F.abs(F.xxhash64(F.lit("train"), "doc_id") % 1_000_000) < limit)
    found = rows.select("text", "lang").mapInArrow(trimmed(_count), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    table = np.zeros((SLOTS + 1, len(langs) + 1), np.int32)
    table[:SLOTS, -1] = round(-1000 * math.log(SLOTS))
    for k, lang in enumerate(langs):
        own = found.filter(pc.equal(found.column("lang"), lang))
        n = np.zeros(SLOTS)
        n[own.column("slot").to_numpy()] = own.column("n").to_numpy()
        table[:SLOTS, k] = np.round(1000 * np.log((n + 0.5 / SLOTS) / (n.sum() + 0.5)))
    return [*langs, UND], table


_LIGHT = ("doc_id", "h", "declared", "suffix", "host", "domain", "top")


def _score(shared):
    def run(batches):
        table = shared.value
        for batch in batches:
            for part in portions(batch, most=1 << 19):
                slot, at = trigrams(part.column("text"))
                use = np.flatnonzero(slot < SLOTS)
                row = np.searchsorted(at, use, side="right") - 1
                n = np.bincount(row, minlength=len(at) - 1)
                sums = np.zeros((len(at) - 1, table.shape[1]), np.int64)
                if len(use):
                    bounds = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    got = slot[use]
                    for k in range(table.shape[1]):
                        sums[row[bounds], k] = np.add.reduceat(table[:, k][got], bounds, dtype=np.int64)
                ll = sums * np.minimum(n, EFFECTIVE)[:, None] // np.maximum(n, 1)[:, None]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ll) + 1, dtype=np.int32) * ll.shape[1]), pa.array(ll.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in _LIGHT], pa.array(n), flat], [*_LIGHT, "n", "ll"])

    return run


def _milli(p: float) -> int:
    return round(1000 * math.log(p))


def _evidence(langs: list[str], declared: Column, p: float) -> list[Column]:
    known = [x for x in langs if x != UND]
    wrong = _milli((1 - p) / max(1, len(known)))
    return [F.when(declared.isin(known), F.when(declared == x, _milli(p)).otherwise(wrong)).otherwise(0) for x in langs]


def host_parts(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host; a name without dots lies in the domain and suffix "*"."""
    top = F.regexp_extract(host, rf"\.((?:{'|'.join(SECOND)})\.[a-z]{{2}})$", 1)
    top = F.when(top != "", top).otherwise(F.regexp_extract(host, r"\.([^.]+)$", 1))
    domain = F.when(top == "", "*").otherwise(F.concat(F.element_at(F.split(F.substring(host, F.lit(1), F.char_length(host) - F.char_length(top) - 1), r"\."), -1), F.lit("."), top))
    return F.when(host.isNotNull(), domain), F.when(host.isNotNull(), F.when(top == "", "*").otherwise(top))


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host without www. and language suffix of an address; nulls where there is none."""
    host = F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", ""), F.lit(""))
    seg = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    tld = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    table = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    return host, F.coalesce(F.try_element_at(table, seg), F.try_element_at(table, tld))


def identify(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """(doc_id, h, lang, posterior, accepted) for rows (doc_id, h, text, declared, suffix, host)."""
    spark, size = rows.sparkSession, range(len(langs))
    shared = spark.sparkContext.broadcast(table.astype(np.int32))
    rows = rows.select("doc_id", F.col("h").cast("long").alias("h"), "text", plain_language(F.col("declared")).alias("declared"), *[F.col(c).cast("string").alias(c) for c in ("suffix", "host")])
    domain, top = host_parts(F.col("host"))
    rows = rows.withColumns({"domain": domain, "top": top})
    light = stored(rows.mapInArrow(trimmed(_score(shared)), f"doc_id {kind_of(rows, 'doc_id')}, h long, declared string, suffix string, host string, domain string, top string, n long, ll array<long>"), "language")
    dec, suf = _evidence(langs, F.col("declared"), P_DECLARED), _evidence(langs, F.col("suffix"), P_SUFFIX)
    light = light.select("doc_id", "h", "host", "domain", "top", "n", *[(F.col("ll")[k] + dec[k] + suf[k]).alias(f"e{k}") for k in size])
    best = F.greatest(*[F.col(f"e{k}") for k in size]) if len(langs) > 1 else F.col("e0")
    guess = F.lit(None).cast("int")
    for k in reversed(size):
        guess = F.when(F.col(f"e{k}") == best, k).otherwise(guess)
    light = light.withColumn("guess", guess)
    # grouped aggregation of all rows: once by host, then rolled up
    ones = [F.sum(F.when(F.col("guess") == k, 1).otherwise(0)).alias(f"h{k}") for k in size]
    hosts = stored(light.where("n > 0").groupBy("top", "domain", "host").agg(*ones), "language-hosts")
    total = [x or 0 for x in hosts.agg(*[F.sum(f"h{k}") for k in size]).first()]
    known = max(1, sum(total[:-1]))
    world = [(1 - P_UND) * (t + 1) / (known + len(langs) - 1) for t in total[:-1]] + [P_UND]
    domains = hosts.groupBy("top", "domain").agg(*[F.sum(f"h{k}").alias(f"d{k}") for k in size])
    tops = hosts.groupBy("top").agg(*[F.sum(f"h{k}").alias(f"t{k}") for k in size])
    prior = hosts.where("host is not null").join(domains, ["top", "domain"]).join(tops, "top")
    prior = stored(prior.select(F.col("host").alias("p_host"), *[f"{x}{k}" for x in "hdt" for k in size]), "language-priors")
    joined = light.join(small(prior, BROADCAST_BYTES // (64 + 24 * len(langs))), light["host"] == prior["p_host"], "left")
    n = {x: sum([F.col(f"{x}{k}") for k in size], F.lit(0)) for x in "hdt"}

    def prior_of(k: int) -> Column:
        own = F.when(F.col("guess") == k, 1).otherwise(0)
        p = F.lit(world[k])
        for x, mass in (("t", TOP_MASS), ("d", DOMAIN_MASS), ("h", HOST_MASS)):
            p = (F.col(f"{x}{k}") - own + mass * p) / (n[x] - 1 + mass)
        return F.coalesce(F.round(1000 * F.log(p)).cast("long"), F.lit(_milli(world[k])))

    s = joined.where("n > 0").select("doc_id", "h", *[(F.col(f"e{k}") + prior_of(k)).alias(f"s{k}") for k in size])
    best = F.greatest(*[F.col(f"s{k}") for k in size]) if len(langs) > 1 else F.col("s0")
    lang = F.lit(None).cast("string")
    for k in reversed(size):
        lang = F.when(F.col(f"s{k}") == best, langs[k]).otherwise(lang)
    mass = sum([F.exp((F.col(f"s{k}") - best) / 1000.0) for k in size], F.lit(0.0))
    out = s.select("doc_id", "h", lang.alias("lang"), F.round(1 / mass, 6).alias("posterior"))
    out = out.withColumn("accepted", (F.col("lang") != UND) & (F.col("posterior") >= MIN_POSTERIOR))
    bare = light.where("n = 0").select("doc_id", "h", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("accepted"))
    return out.unionByName(bare)


KEY = ("doc_id", "text", "lang", "source")


def identify_documents(docs: DataFrame, most: int = TRAIN_DOCS, declared: bool = False) -> DataFrame:
    """(doc_id, h, lang, posterior, accepted) of documents; ``lang`` labels the sample, ``source`` is the host."""
    langs, table = train(docs, most)
    host = F.nullif(F.lower(F.trim(F.col("source").cast("string"))), F.lit(""))
    said = F.col("lang").cast("string") if declared else F.lit(None).cast("string")
    lookup = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    rows = pick(docs, *KEY).select("doc_id", F.xxhash64(*KEY).alias("h"), "text", said.alias("declared"), F.try_element_at(lookup, F.regexp_extract(host, r"\.([a-z]{2})$", 1)).alias("suffix"), host.alias("host"))
    return identify(rows, langs, table)


def identify_pages(pages: DataFrame, labelled: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """The same of web pages (page_id, url, html), trained on labelled documents: markup language, address and host count."""
    langs, table = train(labelled, most)
    host, suffix = address_parts(F.col("url").cast("string"))
    text = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&[#A-Za-z0-9]+;", " ")
    declared = F.nullif(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1), F.lit(""))
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").alias("doc_id"), F.xxhash64("url", "html").alias("h"), text.alias("text"), declared.alias("declared"), suffix.alias("suffix"), host.alias("host"))
    return identify(rows, langs, table).withColumnRenamed("doc_id", "page_id")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` less the documents that aren't accepted."""
    bad = stored(identify_documents(docs).where("not accepted").select("doc_id", "h").distinct(), "language-rejects")
    plain, key = positional(docs, *KEY)
    keyed = plain.withColumns({"k0": key[0], "k1": F.xxhash64(*key)})
    return less_rows(keyed, bad).select(*plain.columns).toDF(*docs.columns)
