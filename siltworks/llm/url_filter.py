"""URL filters by redirect equivalence.

Addresses that lead to each other are one resource: a redirect (a known one, or a page's meta refresh), a canonical link, and
the plain form an address has without fragment, tracking parameters, default prefixes and endings are edges of a graph, whose
connected components are found by distributed star contraction. Rules (block or allow; a host with its subdomains, or a
host and leading path segments) are looked up for every address in the graph by joins on all of its host suffixes and path
prefixes, so a rule table may be large. A block on any alias blocks all of them; an explicit allow on any alias takes
precedence over every block.

Every canonical link and refresh of a page counts; ``&amp;`` in them is decoded, and what isn't an address is resolved against
the page's own.

Defined cases: a null address has no alias and is "unlisted"; null and malformed html has no links; links to another scheme than
http(s), and into the page itself, are ignored; repeated rows get equal results; very long html is read whole; an empty table
gives no rows; several rules at once: allow wins; extra columns don't matter, and pass through the filter, whatever their
names; ids may be of any type. ``alias_of`` is the component's least address, in binary order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, positional, small, stored
from .components import connected_components

#: (action, host or host/path)
RULES = [("block", "cheap-pills.example.com"), ("block", "spam-farm.example.org"), ("block", "casino.example.com"), ("block", "casino.example.net"), ("block", "malware.example.net"), ("allow", "cheap-pills.example.com/fr"), ("allow", "spam-farm.example.org/about")]
_CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"
_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_AMPERSAND = r"&(?:amp|#38|#[xX]26);"
#: Applied in turn to make the plain form.
PLAIN = [
    (r"^[Hh][Tt][Tt][Pp][Ss]?://(?:[^/?#@]*@)?", ""),
    (r"#.*$", ""),
    (r"([?&])(?:(?:utm_[a-z]+|ref|gclid|fbclid)=[^&]*(?:&|$))+", "$1"),
    (r"[?&]+$", ""),
    (r"^([^/?]*?):(?:80|443)(/|\?|$)", "$1$2"),
    (r"^((?:[^/?]*)(?:/[^?]*)?/)index\.(?:html?|php)(\?|$)", "$1$2"),
    (r"^([^?]*)\.html?(\?|$)", "$1$2"),
    (r"^([^?]*[^/?])/+(\?|$)", "$1$2"),
]
_PREFIX = r"^(?:www|m)\.([^/?]+\.)"


def plain(url: Column) -> Column:
    """``https://`` host and path of an address in plain form; null where it isn't http(s)."""
    x = url
    for pattern, new in PLAIN:
        x = F.regexp_replace(x, pattern, new)
    host = F.lower(F.regexp_extract(x, r"^([^/?]*)", 1))
    rest = F.regexp_extract(x, r"^[^/?]*(.*)$", 1)
    bare = F.concat(F.regexp_replace(F.concat(host, F.lit(".")), _PREFIX, "$1"), F.lit(""))
    return F.when(url.rlike(r"^[Hh][Tt][Tt][Pp][Ss]?://[^/?#]") & (host != ""), F.concat(F.lit("https://"), F.substring(bare, F.lit(1), F.char_length(bare) - 1), rest))


def links(pages: DataFrame) -> DataFrame:
    """(src, dst) of canonical links and meta refreshes of pages (url, html)."""
    light = pick(pages, "url", "html").where("url is not null and html is not null")
    tags = lambda outer, inner: F.transform(F.regexp_extract_all("html", F.lit(outer), F.lit(0)), lambda t: F.regexp_extract(t, inner, 1))
    light = light.select(F.col("url").cast("string").alias("src"), F.explode(F.array_distinct(F.concat(tags(_CANONICAL, _HREF), tags(_REFRESH, _TARGET)))).alias("to"))
    light = light.withColumn("to", F.regexp_replace("to", _AMPERSAND, "&")).where(F.col("to").rlike(r"^[^#]"))
    src, to = F.col("src"), F.col("to")
    path, query = F.regexp_extract(to, r"^([^?#]*)", 1), F.regexp_extract(to, r"^[^?#]*(.*)$", 1)
    own = F.regexp_extract(src, _PATH, 1)
    whole = F.when(path == "", own).when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace(F.when(own == "", "/").otherwise(own), r"[^/]*$", ""), path))
    steps = F.split(whole, "/")
    step = lambda done, x: F.when(x == "..", F.regexp_replace(done, r"/[^/]*$", "")).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x))
    clean = F.aggregate(F.slice(steps, F.lit(2), F.size(steps)), F.lit(""), step)
    full = F.when(to.rlike(r"^[Hh][Tt][Tt][Pp][Ss]?://[^/?#]"), to).when(to.startswith("//"), F.concat(F.regexp_extract(src, r"^([A-Za-z]+:)", 1), to))
    full = full.when(~to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & src.rlike(_ORIGIN), F.concat(F.regexp_extract(src, _ORIGIN, 1), clean, query))
    return light.select("src", full.alias("dst")).where("dst is not null")


def _node(url: Column) -> Column:
    return F.unhex(F.md5(url))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "action string, value string")


def decide(pages: DataFrame, rules: DataFrame | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, alias_of, decision): "allowed", "blocked" or "unlisted" for every row of ``pages``.

    rules: (action, value); redirects: (src, dst), further known redirects.
    """
    spark = pages.sparkSession
    rules = default_rules(spark) if rules is None else rules
    pairs = links(pages)
    if redirects is not None:
        pairs = pairs.unionByName(pick(redirects, "src", "dst").where("src is not null and dst is not null"))
    urls = pick(pages, "url").select(F.col("url").cast("string").alias("url")).where("url is not null")
    ends = stored(pairs.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct(), "url-links")
    named = stored(urls.unionByName(ends.select(F.col("src").alias("url"))).unionByName(ends.select(F.col("dst").alias("url"))).distinct().select("url", plain(F.col("url")).alias("norm")), "url-nodes")
    nodes = named.select("url", "norm").unionByName(named.where("norm is not null").select(F.col("norm").alias("url"), "norm")).distinct().select(_node(F.col("url")).alias("node"), "url", "norm")
    edges = named.where("norm is not null and norm != url").select(_node(F.col("url")).alias("u"), _node(F.col("norm")).alias("v"))
    edges = edges.unionByName(ends.select(_node(F.col("src")).alias("u"), _node(F.col("dst")).alias("v")))
    roots = connected_components(edges)
    # rules by all host suffixes and path prefixes
    bare = F.regexp_replace(F.col("norm"), r"^https://", "")
    host = F.split(F.regexp_extract(bare, r"^([^/?]*)", 1), r"\.")
    path = F.split(F.regexp_replace(bare, r"\?.*$", ""), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(host)), lambda i: F.array_join(F.slice(host, i, F.size(host)), "."))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(path, F.lit(1), i), "/"))
    rule = small(stored(rules.select(F.lower("action").alias("action"), F.col("value").alias("key")).where("action in ('allow', 'block') and key is not null").distinct(), "url-rules"))
    hit = nodes.where("norm is not null").select("node", F.explode(F.array_distinct(F.concat(suffixes, prefixes))).alias("key")).join(rule, "key").groupBy("node").agg(F.bool_or(F.col("action") == "allow").alias("allow"), F.bool_or(F.col("action") == "block").alias("block"))
    full = nodes.join(roots, "node", "left").join(hit, "node", "left").select("node", "url", F.coalesce("root", "node").alias("root"), "allow", "block")
    classes = full.groupBy("root").agg(F.min("url").alias("alias_of"), F.bool_or(F.coalesce("allow", F.lit(False))).alias("allow"), F.bool_or(F.coalesce("block", F.lit(False))).alias("block"))
    decision = F.when(F.col("allow"), "allowed").when(F.col("block"), "blocked").otherwise("unlisted")
    known = full.select(F.col("url").alias("known_url"), "root").join(classes, "root").select("known_url", "alias_of", decision.alias("decision"))
    rows = pick(pages, "page_id", "url").withColumn("url", F.col("url").cast("string"))
    return rows.join(known, rows["url"] == known["known_url"], "left").select("page_id", "url", "alias_of", F.coalesce("decision", F.lit("unlisted")).alias("decision"))


def kept(pages: DataFrame, rules: DataFrame | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` less those whose address is blocked."""
    bad = stored(decide(pages, rules, redirects).where("decision = 'blocked'").select(F.col("url").alias("bad")).distinct(), "url-blocked")
    plain_pages, (url,) = positional(pages, "url")
    return plain_pages.join(small(bad), url.cast("string") == F.col("bad"), "left_anti").toDF(*pages.columns)


def oracle() -> str:
    """The same as DuckDB SQL over ``pages``."""
    x = "url"
    for pattern, new in PLAIN:
        x = f"regexp_replace({x}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    values = ", ".join(f"('{a}', '{v}')" for a, v in RULES)
    q = lambda p: p.replace("'", "''")
    return f"""
WITH RECURSIVE raw AS (
  SELECT url AS src, regexp_replace(unnest(list_distinct(list_concat(list_transform(regexp_extract_all(html, '{q(_CANONICAL)}'), lambda t: regexp_extract(t, '{q(_HREF)}', 1)),
    list_transform(regexp_extract_all(html, '{q(_REFRESH)}'), lambda t: regexp_extract(t, '{q(_TARGET)}', 1))))), '{_AMPERSAND}', '&', 'g') AS t
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
parts AS (SELECT src, t, regexp_extract(t, '^([^?#]*)', 1) AS path, regexp_extract(t, '^[^?#]*(.*)$', 1) AS query, regexp_extract(src, '{_PATH}', 1) AS own FROM raw WHERE regexp_matches(t, '^[^#]')),
steps AS (SELECT *, string_split(CASE WHEN path = '' THEN own WHEN starts_with(path, '/') THEN path ELSE regexp_replace(CASE WHEN own = '' THEN '/' ELSE own END, '[^/]*$', '') || path END, '/') AS s FROM parts),
links AS (
  SELECT DISTINCT src, CASE WHEN regexp_matches(t, '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#]') THEN t WHEN starts_with(t, '//') THEN regexp_extract(src, '^([A-Za-z]+:)', 1) || t
    WHEN NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') AND regexp_matches(src, '{_ORIGIN}') THEN regexp_extract(src, '{_ORIGIN}', 1)
      || CASE WHEN len(s) < 2 THEN '' ELSE list_reduce(list_concat([''], s[2:]), lambda d, x: CASE x WHEN '..' THEN regexp_replace(d, '/[^/]*$', '') WHEN '.' THEN d ELSE d || '/' || x END) END || query END AS dst FROM steps),
urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT src FROM links WHERE dst IS NOT NULL UNION SELECT dst FROM links WHERE dst IS NOT NULL),
stripped AS (SELECT url, {x} AS x FROM urls),
named AS (
  SELECT url, CASE WHEN regexp_matches(url, '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#]') AND regexp_extract(x, '^([^/?]*)', 1) <> '' THEN
    'https://' || rtrim(regexp_replace(lower(regexp_extract(x, '^([^/?]*)', 1)) || '.', '{_PREFIX}', '\\1'), '.') || regexp_extract(x, '^[^/?]*(.*)$', 1) END AS norm FROM stripped),
nodes AS (SELECT url, norm FROM named UNION SELECT norm, norm FROM named WHERE norm IS NOT NULL),
edges AS (SELECT url AS u, norm AS v FROM named WHERE norm IS NOT NULL UNION SELECT src, dst FROM links WHERE dst IS NOT NULL),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT url AS a, url AS b FROM nodes UNION SELECT r.a, w.v FROM reach r JOIN both_ways w ON w.u = r.b),
roots AS (SELECT a AS url, min(b) AS root FROM reach GROUP BY a),
rules(action, value) AS (VALUES {values}),
hit AS (
  SELECT n.url, r.action FROM (SELECT url, regexp_replace(norm, '^https://', '') AS bare, regexp_extract(regexp_replace(norm, '^https://', ''), '^([^/?]*)', 1) AS host FROM nodes WHERE norm IS NOT NULL) n
  JOIN rules r ON n.host = r.value OR n.host LIKE '%.' || r.value OR regexp_replace(n.bare, '\\?.*$', '') = r.value OR starts_with(n.bare, r.value || '/')),
classes AS (
  SELECT o.root, coalesce(bool_or(h.action = 'allow'), false) AS allow, coalesce(bool_or(h.action = 'block'), false) AS block
  FROM roots o LEFT JOIN hit h ON h.url = o.url GROUP BY o.root)
SELECT p.page_id, p.url, o.root AS alias_of, CASE WHEN c.allow THEN 'allowed' WHEN c.block THEN 'blocked' ELSE 'unlisted' END AS decision
FROM pages p LEFT JOIN roots o ON o.url = p.url LEFT JOIN classes c ON c.root = o.root
"""
