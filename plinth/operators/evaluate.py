"""Measures of rankings and of labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The four labels, their other spellings, and how grave they are.
LABELS = ["근거 있음", "무근거", "모순", "Benign"]
ALIASES = {
    "근거 있음": "근거 있음", "근거있음": "근거 있음", "근거 존재": "근거 있음", "supported": "근거 있음",
    "무근거": "무근거", "근거없음": "무근거", "근거 없음": "무근거", "unsupported": "무근거",
    "모순": "모순", "contradiction": "모순", "contradicted": "모순", "충돌": "모순",
    "Benign": "Benign", "benign": "Benign", "benign_true": "Benign", "상식참": "Benign",
}
SEVERITY = {"모순": 3, "무근거": 2, "근거 있음": 1, "Benign": 0}
#: The two labels that a check of support must not miss.
GRAVE = ["무근거", "모순"]
CUTOFFS = (1, 3, 5, 10)


def lookup(key: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def canonical_label(label: Column) -> Column:
    """The label that a spelling stands for, also in other case; null for none, blank, NaN and unknown ones."""
    t = F.trim(label)
    return F.coalesce(lookup(t, ALIASES), lookup(F.lower(t), ALIASES))


def first_ranks(gold: DataFrame, run: DataFrame, by: list[str]) -> DataFrame:
    """by, claim_id, first: the best rank of a gold passage, null if none is ranked.

    gold: by, claim_id, passage_id; run: by, claim_id, passage_id, rank.  Claims
    that the run does not have are left out.
    """
    have = run.select(*by, "claim_id").distinct()
    hits = gold.join(run, [*[c for c in by if c in gold.columns], "claim_id", "passage_id"])
    first = hits.groupBy(*by, "claim_id").agg(F.min("rank").alias("first"))
    asked = gold.select("claim_id").distinct().join(have, "claim_id")
    return asked.join(first, [*by, "claim_id"], "left")


def recall_and_mrr(firsts: DataFrame, by: list[str], cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    at = [F.round(F.avg(F.coalesce((F.col("first") <= c).cast("int"), F.lit(0))), 6).alias(f"recall_{c}") for c in cutoffs]
    return firsts.groupBy(*by).agg(F.count("*").alias("n"), *at, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def length_bucket(n: Column) -> Column:
    return F.when(n < 10, "short").when(n < 30, "middle").otherwise("long")


def confusion(rows: DataFrame) -> DataFrame:
    """truth, predicted and n for all pairs of labels, also those without rows; rows: truth, predicted."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(a, b) for a in LABELS for b in LABELS], "truth string, predicted string")
    counts = rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, label, support, precision, recall, f1 (0 where undefined), for all four labels of each group."""
    each = F.explode(F.array(*map(F.lit, LABELS)))
    groups = (rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()).select(*by, each.alias("label"))
    sides = rows.select(*by, F.explode(F.array_distinct(F.array("truth", "predicted"))).alias("label"), "truth", "predicted")
    is_t, is_p = F.col("truth") == F.col("label"), F.col("predicted") == F.col("label")
    n = sides.groupBy(*by, "label").agg(F.count_if(is_t & is_p).alias("tp"), F.count_if(is_p & ~is_t).alias("fp"), F.count_if(is_t & ~is_p).alias("fn"))
    tp, fp, fn = (F.coalesce(c, F.lit(0)) for c in ("tp", "fp", "fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return groups.join(n, [*by, "label"], "left").select(
        *by,
        "label",
        (tp + fn).alias("support"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, n, accuracy, macro_f1, and the normal-approximation interval of the accuracy."""
    macro = class_scores(rows, by).groupBy(*by).agg(F.avg("f1").alias("m"))
    acc = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("predicted")).cast("int")).alias("a"))
    both = acc.join(macro, by) if by else acc.crossJoin(F.broadcast(macro))  # one row each
    half = 1.96 * F.sqrt(F.col("a") * (1 - F.col("a")) / F.col("n"))
    r = lambda c, name: F.round(c, 6).alias(name)
    return both.select(*by, "n", r(F.col("a"), "accuracy"), r(F.col("m"), "macro_f1"), r(F.col("a") - half, "acc_low"), r(F.col("a") + half, "acc_high"))


def bootstrap_draws(names: DataFrame, resamples: int, seed: int) -> DataFrame:
    """resample, name, times: how often each of the distinct names (name) is drawn; each resample draws as many as there are.

    Names are numbered by buckets and the counts of the buckets before, and each
    slot of a resample draws a number by its hash, so no task holds all names.
    """
    b = names.withColumn("b", F.pmod(F.xxhash64("name"), F.lit(64)))
    sizes = b.groupBy("b").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy())
    sizes = sizes.select("b", F.coalesce(before, F.lit(0)).alias("base"), total.alias("all"))  # 64 rows
    numbered = b.join(F.broadcast(sizes), "b")
    k = F.col("base") + F.row_number().over(Window.partitionBy("b").orderBy("name")) - 1
    numbered = numbered.select("name", k.alias("k"), "all")
    each = numbered.select("k", "all", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample"))
    drawn = each.select("resample", F.pmod(F.xxhash64(F.lit(seed), "resample", "k"), F.col("all")).alias("k"))
    times = drawn.groupBy("resample", "k").agg(F.count("*").alias("times"))
    return times.join(numbered.select("name", "k"), "k").select("resample", "name", "times")


def bootstrap_macro_f1(rows: DataFrame, cluster: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """low and high: 2.5 and 97.5 percentiles of macro-F1 over resamples of clusters, which are drawn with replacement.

    Clusters first become counts of (truth, predicted), so what a resample needs
    grows with clusters, not rows.
    """
    counts = rows.groupBy(F.col(cluster).alias("name"), "truth", "predicted").agg(F.count("*").alias("n"))
    draws = bootstrap_draws(counts.where("name IS NOT NULL").select("name").distinct(), resamples, seed)
    w = counts.join(draws, "name").select("resample", "truth", "predicted", (F.col("times") * F.col("n")).alias("w"))
    cells = w.groupBy("resample", "truth", "predicted").agg(F.sum("w").alias("w"))
    f1 = []
    for label in LABELS:
        t, p = F.col("truth") == label, F.col("predicted") == label
        both = F.coalesce(F.sum(F.when(t & p, F.col("w"))), F.lit(0))
        either = F.coalesce(F.sum(F.when(t, F.col("w"))), F.lit(0)) + F.coalesce(F.sum(F.when(p, F.col("w"))), F.lit(0))
        f1.append(F.when(either > 0, 2 * both / either).otherwise(0.0))
    scores = cells.groupBy("resample").agg((reduce(lambda a, b: a + b, f1) / len(LABELS)).alias("m"))
    return scores.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))


def fleiss_kappa(votes: DataFrame) -> DataFrame:
    """kappa, items and disagreements of votes (item, label), each item having as many."""
    per = votes.groupBy("item", "label").agg(F.count("*").alias("c"))
    item = per.groupBy("item").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    agree = item.agg(
        F.avg((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("p"),
        F.count("*").alias("items"),
        F.count_if(F.col("sq") < F.col("n") * F.col("n")).alias("disagreements"),
    )
    shares = per.groupBy("label").agg(F.sum("c").alias("c")).agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("e"))
    # one row each
    return agree.crossJoin(F.broadcast(shares)).select(
        F.round((F.col("p") - F.col("e")) / (1 - F.col("e")), 6).alias("kappa"), "items", "disagreements"
    )


def class_weights(rows: DataFrame, power: float = 0.5) -> DataFrame:
    """label, n, weight: (all / n) ** power, divided by the mean over the four labels."""
    names = rows.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    counts = F.broadcast(names).join(rows.groupBy("label").agg(F.count("*").alias("n")), "label", "left")
    one = counts.agg(F.collect_list(F.struct("label", F.coalesce("n", F.lit(0)).alias("n"))).alias("all"), F.sum("n").alias("total"))
    raw = F.transform("all", lambda x: F.pow(F.col("total") / F.greatest(x["n"], F.lit(1)), F.lit(power)))
    one = one.withColumn("raw", raw).withColumn("mean", F.aggregate("raw", F.lit(0.0), lambda a, x: a + x) / len(LABELS))
    e = one.select("mean", F.explode(F.arrays_zip("all", "raw")).alias("x"))
    return e.select(F.col("x.all.label").alias("label"), F.col("x.all.n").alias("n"), F.round(F.col("x.raw") / F.col("mean"), 6).alias("weight"))


def upper_medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by and upper_median, the upper of the middle values.

    Values are counted first, and the running counts find the middle: a group is
    never gathered in one place, only its distinct values are ordered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    upto = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("all", F.sum("c").over(w))
    middle = F.expr("upto > all div 2")
    return upto.where(middle).groupBy(*by).agg(F.min(value).alias("upper_median"))
