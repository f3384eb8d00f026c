"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``width`` consecutive words of an item, or all words of a shorter
one.  Its shingles are runs of up to three words.  A window that occurs in a
document has all its shingles there, so the rarest one over all documents is a
necessary prefix: only that is joined.  A match fixes where the window would
start; the start must not be negative and the window must end within the
document; then the words are compared.

Shingles are exploded as hash and place alone, so that the work is linear in a
text's length.  Up to ``BLOCK`` tokens (counted first) are broadcast and meet the
shingles inside the scan, without a shuffle; more are joined by shuffle, in one
scan as well.  The few places that match are gathered by document and the
words of each are compared there.

Edge cases: null and empty texts have no words and are never hit.  An item
without words or with a null text has no window; a null item_id hits words but
counts as no item.  Repeated rows of documents each get a row; rows that share
a doc_id are told apart by their text.  Of equally rare shingles the first in
the window is taken.  Texts may have any length.  Empty tables give no hits.  Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm._base import Scratch, folded_words, is_at_most, table, text_key, windows_of

SHINGLE = 3
#: Tokens (about 30 bytes each) or windows (about 150) in a broadcast; more are joined by shuffle.
BLOCK = 200_000
#: NON_WORD before lower-casing: what splits words without changing them.
SPLITS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and _key (of the text)."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.table(_item_windows(benchmark, width))
    windows = scratch.table(
        found.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), "words")
    )
    items = scratch.table(found.where("item_id IS NOT NULL").join(windows, "words").select("window", "item_id").distinct())
    hits = scratch.table(_hits(docs, windows, scratch))
    spans = hits.groupBy("doc_id", "_key").agg(F.collect_set(F.struct("start", "len")).alias("spans"))
    spans = spans.select("doc_id", "_key", _covered(F.col("spans")).alias("n_hit"))
    named = hits.select("doc_id", "_key", "window").distinct().join(items, "window")
    named = named.groupBy("doc_id", "_key").agg(F.collect_set("item_id").alias("items"))
    d = docs.select(
        "doc_id",
        text_key(F.col("text")).alias("_key"),
        F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPLITS), "")).cast("long").alias("n_words"),
    )
    for part in (spans, named):
        p = part.withColumnsRenamed({"doc_id": "_id", "_key": "_k"})
        d = d.join(p, d["doc_id"].eqNullSafe(p["_id"]) & (d["_key"] == p["_k"]), "left").drop("_id", "_k")
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return d.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(ids, F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "_key",
    )


def _item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    items = benchmark.select("item_id", folded_words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    starts = F.when(F.col("n") >= width, F.sequence(F.lit(0), F.col("n") - width)).otherwise(F.array(F.lit(0)))
    return items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, width))).alias("words"))


def _shingles(words: str, size: int) -> Column:
    """Hashes of the runs of so many words, by start."""
    h = F.transform(words, lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(
        windows_of(F.size(h), size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])
    )
    return F.transform(F.array(h), runs)[0]


def _hits(docs: DataFrame, windows: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, _key, start, len, window: each place where a window occurs."""
    spark = docs.sparkSession
    sized = windows.withColumn("len", F.size("words"))
    shingle = F.least(F.col("len"), F.lit(SHINGLE))
    sizes = [r[0] for r in sized.select(shingle).distinct().collect()]  # of 1 to SHINGLE
    if not sizes:
        return spark.range(0).select(
            F.col("id").alias("doc_id"), F.col("id").alias("_key"), *[F.lit(0).alias(c) for c in ("start", "len")], F.col("id").alias("window")
        )
    tokens = None
    for k in sizes:
        some = sized.where(shingle == k).select("window", F.posexplode(_shingles("words", k)).alias("off", "token"))
        tokens = some if tokens is None else tokens.unionByName(some)
    tokens = scratch.table(tokens)
    wanted = scratch.table(tokens.select("token").distinct())
    seen = _exploded(docs, sizes).select("token").join(_small(wanted), "token")
    counts = scratch.table(seen.groupBy("token").agg(F.count("*").alias("df")))
    rarest = (
        tokens.join(counts, "token", "left")
        .groupBy("window")
        .agg(F.min(F.struct("df", "off", "token")).alias("r"), F.count("*").alias("all"), F.count("df").alias("seen"))
        .where("all = seen")
        .select("window", "r.off", "r.token")
    )
    prefixes = scratch.table(rarest.join(sized, "window").select("window", "token", "off", "len", "words"))
    # the bounds on place and length come before any words do
    start = F.col("pos") - F.col("off")
    p = _small(prefixes.select("window", F.col("token").alias("_token"), "off", "len"))
    d = _exploded(docs, sizes)
    met = d.join(p, (d["token"] == F.col("_token")) & (start >= 0) & (start + F.col("len") <= F.col("n")))
    met = scratch.table(met.select("doc_id", "_key", start.alias("start"), "len", "window").distinct())
    met = met.join(_small(prefixes.select("window", "words")), "window")
    met = met.groupBy("doc_id", "_key").agg(F.collect_list(F.struct("start", "len", "window", "words")).alias("met"))
    met = scratch.table(met.withColumnsRenamed({"doc_id": "_id", "_key": "_k"}))
    # of rows that repeat as they are, one is compared
    t = docs.select("doc_id", text_key(F.col("text")).alias("_key"), "text")
    # texts without a match are left out by their ids alone, before any is moved
    ids = _small(met.select(F.col("_id").alias("_in"), F.col("_k").alias("_in_k")))
    t = t.join(ids, t["doc_id"].eqNullSafe(F.col("_in")) & (t["_key"] == F.col("_in_k")), "left_semi")
    t = t.join(met, t["doc_id"].eqNullSafe(met["_id"]) & (t["_key"] == met["_k"])).dropDuplicates(["doc_id", "_key"])
    same = lambda w: F.filter("met", lambda m: F.slice(w, m["start"] + 1, m["len"]) == m["words"])
    found = F.transform(F.array(folded_words(F.col("text"))), same)[0]
    hits = t.select("doc_id", "_key", F.explode(found).alias("m"))
    return hits.select("doc_id", "_key", "m.start", "m.len", "m.window")


def _exploded(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, _key, n (words), pos, token: each shingle of each document."""
    d = docs.select("doc_id", text_key(F.col("text")).alias("_key"), folded_words(F.col("text")).alias("w"))
    d = d.select("doc_id", "_key", F.size("w").alias("n"), "w")
    out = None
    for k in sizes:
        some = d.select("doc_id", "_key", "n", F.posexplode(_shingles("w", k)).alias("pos", "token"))
        out = some if out is None else out.unionByName(some)
    return out


def _small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are few enough."""
    return F.broadcast(rows) if is_at_most(rows, BLOCK) else rows


def _covered(spans: Column) -> Column:
    """Words inside any (start, len)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(a, s):
        end = s["start"] + s["len"]
        more = F.greatest(end - F.greatest(s["start"], a["end"]), F.lit(0))
        return F.struct((a["n"] + more).alias("n"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(F.array_sort(spans), zero, add)["n"]


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("_key")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[s:s + 9] AS words, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT doc_id, s, n, w[s:s + n - 1] AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.s, p.n, win.item_id FROM places p JOIN win ON p.words = win.words AND p.n = win.n),
covered AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""
