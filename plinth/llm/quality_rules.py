"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Words and pairs of words are hashed into ``buckets`` features.  A feature's
weight is the logarithm of its share in trusted text over its share in the raw
corpus, both smoothed multinomials; a document's score is the mean weight of
its features.  All of it is built-in expressions.  One pass counts features,
combined before the shuffle; the weights, ``buckets`` numbers whatever the
input, go into the plan as one constant array; a second pass scores each document
where it lies, without a shuffle.

Weights are whole micro-units, so sums do not depend on the order of rows and
the same documents always get the same scores and verdicts.

Edge cases: a null text has no words; base_failed holds for fewer than 10
words, so null and empty texts are never kept.  Repeated rows each get a row.
A null doc_id stays null.  Equal scores get equal verdicts; texts may have any
length.  Without a trusted document no ratio exists: the
score is 0 and the base rules decide.  Without a held-out one the floor is
minus the margin.  Other columns of docs are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from plinth.llm._base import MAX_BROADCAST_IDS, Scratch, is_at_most, plain_words, table, text_key, windows_of

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MICRO = 1_000_000
FITS, HELD_OUT = 1, 2


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    buckets: int = 1 << 16,
    smoothing: float = 0.5,
    trusted_loss: float = 0.002,
    margin: float = 0.02,
) -> DataFrame:
    """doc_id, the base counts, llr, base_failed, kept and _key (of the text).

    labels: doc_id, quality, toxic; trusted are rows of quality 1 and not toxic.
    Half of their texts (by hash, so that copies stay together) make the target
    multinomial; the other half, which it has not seen, set the floor: the score
    of which ``trusted_loss`` of them fall short, less ``margin``.
    """
    scratch = Scratch(docs.sparkSession)
    marked = _marked(docs, labels)
    counts = scratch.table(
        _hashed(marked.select("_trusted", plain_words(F.col("text")).alias("w")))
        .select("_trusted", F.explode(_features(buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count_if(F.col("_trusted") == FITS).alias("good"))
    )
    weights = _weights(counts, buckets, smoothing)

    hashed = _hashed(
        marked.select(
            "doc_id",
            "_trusted",
            text_key(F.col("text")).alias("_key"),
            F.coalesce("text", F.lit("")).alias("t"),
            plain_words(F.col("text")).alias("w"),
        )
    )
    five = lambda i: F.xxhash64(F.get("h2", i), F.get("h2", i + 2), F.get("h1", i + 4))
    hashed = hashed.withColumn("h5", F.transform(windows_of(F.col("n"), 5), five))
    total = F.aggregate(_features(buckets), F.lit(0).cast("long"), lambda a, b: a + F.get(weights, b))
    scored = hashed.select(
        "doc_id",
        "_trusted",
        "_key",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _dup_lines(F.col("t")).alias("n_dup_lines"),
        _repeated(F.col("h5"), 5).alias("n_repeat_words"),
        total.alias("total"),
    ).withColumn("score", F.expr("CASE WHEN n_words > 0 THEN total div (2 * n_words - 1) ELSE 0L END"))
    scored = scratch.table(scored)
    floor = _floor(scored.where((F.col("_trusted") == HELD_OUT) & (F.col("n_words") >= 10)), trusted_loss, margin)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.select(
        "doc_id",
        *BASE,
        (F.col("score") / MICRO).alias("llr"),
        failed.alias("base_failed"),
        (~failed & (F.col("score") >= floor)).alias("kept"),
        "_key",
    )


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and _trusted (0, FITS or HELD_OUT)."""
    good = (
        labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL")
        .select(F.col("doc_id").alias("_good"))
        .distinct()
    )
    if is_at_most(good, MAX_BROADCAST_IDS):
        good = F.broadcast(good)
    d = docs.select("doc_id", "text")
    return d.join(good, d["doc_id"] == F.col("_good"), "left").select(
        "doc_id",
        "text",
        F.when(F.col("_good").isNull(), 0)
        .when(F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(2)) == 0, FITS)
        .otherwise(HELD_OUT)
        .alias("_trusted"),
    )


def _hashed(words: DataFrame) -> DataFrame:
    """Adds n, the number of words w, and the hashes of words (h1) and of pairs of neighbours (h2)."""
    return (
        words.withColumn("n", F.size("w"))
        .withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))
        .withColumn("h2", F.transform(windows_of(F.col("n"), 2), lambda i: F.xxhash64(F.get("h1", i), F.get("h1", i + 1))))
    )


def _features(buckets: int) -> Column:
    """Bucket of each word and of each pair of neighbours."""
    return F.transform(F.concat("h1", "h2"), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long")


def _repeated(hashes: Column, width: int) -> Column:
    """Words covered by windows whose hash occurs twice or more in the row."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s: F.filter(
        s,
        lambda x, k: (F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(True),
    )
    starts = F.transform(F.array(pairs), lambda s: F.array_sort(F.transform(same(s), lambda x: x["i"])))[0]
    covered = F.transform(
        F.array(starts),
        lambda s: F.aggregate(
            F.transform(s, lambda x, k: F.least(F.coalesce(F.get(s, k + 1) - x, F.lit(width)), F.lit(width))),
            F.lit(0),
            lambda a, x: a + x,
        ),
    )[0]
    has_repeat = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(has_repeat, covered).otherwise(0).cast("long")


def _weights(counts: DataFrame, buckets: int, smoothing: float) -> Column:
    """Micro-units by bucket, as one array of ``buckets`` places; zeros if nothing is trusted."""
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("r"), F.coalesce(F.sum("good"), F.lit(0)).alias("g")).first()
    shift = math.log(total["r"] + smoothing * buckets) - math.log(total["g"] + smoothing * buckets)
    ratio = F.log(F.coalesce("good", F.lit(0)) + smoothing) - F.log(F.coalesce("raw", F.lit(0)) + smoothing) + shift
    weight = F.round(ratio * MICRO).cast("long") if total["g"] else F.lit(0).cast("long")
    empty = math.log(smoothing) - math.log(smoothing) + shift if total["g"] else 0.0
    weights = [round(empty * MICRO)] * buckets
    for bucket, w in counts.select("bucket", weight).collect():  # at most ``buckets`` rows
        weights[bucket] = w
    # one text that the optimizer folds into one array
    return F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")


def _floor(trusted: DataFrame, loss: float, margin: float) -> int:
    """The score, in steps of a thousandth, below which the given share of trusted lies, less the margin."""
    bins = trusted.groupBy(F.expr("score div 1000").alias("bin")).count()
    running = bins.select(
        "bin",
        F.sum("count").over(Window.orderBy("bin")).alias("upto"),
        F.sum("count").over(Window.partitionBy()).alias("all"),
    )
    low = running.where(F.col("upto") > F.col("all") * loss).agg(F.min("bin")).first()[0]
    return (low or 0) * 1000 - round(margin * MICRO)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.drop("_key")
