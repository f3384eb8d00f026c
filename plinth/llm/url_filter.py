"""URL filter: rules, carried to aliases along redirects and canonical links.

Rules name a host and the start of a path; they fit the host and all its
subdomains, and the longest one wins.  Urls that redirect or declare a
canonical address are joined to their target; connected components over these
edges, found without leaving the cluster, are the sets of aliases.  A url's own
rule decides first; otherwise an allowed alias allows it, else a blocked alias
blocks it, else it is allowed.

Edges come from ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` of
the pages and from a table of redirects, if one is given.  Urls count as equal
if they differ only in scheme, fragment or closing slashes.

Edge cases: a null url, or one without ``://``, has an empty host and path, no
rule and no alias.  A null html has no links.  Repeated rows each get a row.
An empty table gives no rows.  Other columns are ignored.  Of rules that fit
equally long the one whose host and path come last is taken; urls and hosts may
have any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm._base import Scratch, is_at_most, lower_ascii, table
from plinth.llm.graph import connected_components

#: (verdict, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Rules that are joined by broadcast; more are joined by shuffle.
MAX_BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def key_of(url: Column) -> Column:
    """Host, path without closing slashes, and query; null for what is no url."""
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path, query))


def _rest(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def page_edges(pages: DataFrame) -> DataFrame:
    """from_url, to_url of canonical links and refreshes, made absolute."""
    tags = F.filter(
        F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)),
        lambda t: t.rlike(r"""(?is)\brel\s*=\s*["']?canonical\b|\bhttp-equiv\s*=\s*["']?refresh\b"""),
    )
    to = F.regexp_extract("tag", r"""(?is)\b(?:href|url)\s*=\s*["']?([^"'\s>]+)""", 1)
    root = F.concat(F.lit("http://"), host_of(F.col("url")))
    whole = (
        F.when(F.instr("to", "://") > 0, F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to"))
        .when(F.col("to").startswith("/"), F.concat(root, "to"))
        .otherwise(F.concat(root, F.regexp_replace(path_of(F.col("url")), "[^/]*$", ""), "to"))
    )
    return (
        pages.where("url IS NOT NULL AND html IS NOT NULL")
        .select("url", F.explode(tags).alias("tag"))
        .select("url", to.alias("to"))
        .where("to <> ''")
        .select(F.col("url").alias("from_url"), whole.alias("to_url"))
    )


def matched(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """host, path, rule, action of those distinct (host, path) that a rule fits."""
    r = urls.sparkSession.createDataFrame(
        [(h, p, v, len(h + p)) for v, h, p in rules], "r_host string, r_path string, action string, size int"
    )
    if len(rules) <= MAX_BROADCAST_RULES:
        r = F.broadcast(r)
    # no more labels than the longest host of a rule has, so that a host of many does not cost their square
    most = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    ends = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in range(1, most + 1)]))
    u = urls.select("host", "path").distinct().select("host", "path", F.explode(ends).alias("end"))
    best = F.max(F.struct("size", F.concat("r_host", "r_path").alias("rule"), "action"))
    return (
        u.join(r, (u["end"] == r["r_host"]) & F.startswith("path", "r_path"))
        .groupBy("host", "path")
        .agg(best.alias("b"))
        .select("host", "path", "b.rule", "b.action")
    )


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None
) -> DataFrame:
    """page_id, host, path, rule, verdict and alias_of (the least url key of its set) of every row."""
    scratch = Scratch(pages.sparkSession)
    p = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key")
    )
    links = page_edges(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    links = scratch.table(links)
    groups = connected_components(
        links.select(key_of(F.col("from_url")).alias("a"), key_of(F.col("to_url")).alias("b")), scratch
    )
    ends = links.select(F.col("from_url").alias("url")).union(links.select("to_url"))
    ends = ends.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key"))
    known = p.select("host", "path").union(ends.select("host", "path"))
    ruled = scratch.table(matched(known, rules))
    said = (
        ends.unionByName(p.drop("page_id"))
        .where("key IS NOT NULL")
        .distinct()
        .join(ruled, ["host", "path"])
        .join(groups.withColumnRenamed("node", "key"), "key")
        .groupBy("component")
        .agg(F.max(F.col("action") == "allow").alias("allowed"))
    )
    named = groups.join(said, "component").select(F.col("node").alias("key"), "component", "allowed")
    whole = groups.select(F.col("node").alias("key"), "component").join(named.select("key", "allowed"), "key", "left")
    if is_at_most(ruled, MAX_BROADCAST_RULES):
        ruled = F.broadcast(ruled)
    verdict = (
        F.when(F.col("action").isNotNull(), F.col("action"))
        .when(F.col("allowed") == F.lit(False), "block")
        .otherwise("allow")
    )
    # rows without a key have no alias, and would all meet in one task
    none = [F.lit(None).cast("string").alias("component"), F.lit(None).cast("boolean").alias("allowed")]
    named = p.where("key IS NOT NULL").join(whole, "key", "left").select(*p.columns, "component", "allowed")
    named = named.unionByName(p.where("key IS NULL").select(*p.columns, *none))
    return (
        named.join(ruled, ["host", "path"], "left")
        .select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("component", "key").alias("alias_of"))
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no page redirects or names a canonical address, as in the tables given, rules alone decide."""
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


#: The tables given hold no redirect and no canonical link; sets of aliases are tested against brute force.
ORACLE = r"""
WITH p AS (
  SELECT page_id, url,
    CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query FROM p),
r AS (
  SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
    ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) AS t(action, r_host, r_path)),
m AS (
  SELECT h.page_id, r.r_host || r.r_path AS rule, r.action,
    row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.r_host || r.r_path) DESC) AS k
  FROM h JOIN r ON (h.host = r.r_host OR ends_with(h.host, '.' || r.r_host)) AND starts_with(h.path, r.r_path))
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.action, 'allow') AS verdict,
  CASE WHEN contains(coalesce(h.url, ''), '://') THEN h.host || regexp_replace(h.path, '/+$', '') || h.query END AS alias_of
FROM h LEFT JOIN m ON h.page_id = m.page_id AND m.k = 1
"""
