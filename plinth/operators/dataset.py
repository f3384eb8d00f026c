"""Assembly of labelled datasets: fallbacks, replacement by document, splits, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.functions.udfs import nfkc


def claim_id(deck: Column, slide: Column, n: Column) -> Column:
    return F.format_string("%s_s%02d_c%02d", deck.cast("string"), slide, n)


def numbered_claims(claims: DataFrame) -> DataFrame:
    """deck, slide, ord, claim with claim_id, counted within each slide."""
    n = F.row_number().over(Window.partitionBy("deck", "slide").orderBy("ord"))
    return claims.withColumn("claim_id", claim_id(F.col("deck"), F.col("slide"), n))


def first_seen(rows: DataFrame, by: list[str], ord: str) -> DataFrame:
    """The first row of each key, in order."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(ord))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def claim_suffix(id: Column) -> Column:
    return F.nullif(F.regexp_extract(id, r"_(s\d+_c\d+)$", 1), F.lit(""))


def with_candidates(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """claims (deck, claim_id, ord) with run_id and how it was found: same id, same suffix, or place where counts agree."""
    c = claims.withColumn("suffix", claim_suffix(F.col("claim_id")))
    r = runs.select("deck", F.col("claim_id").alias("run_id"), F.col("ord").alias("r_ord"))
    counts = c.groupBy("deck").count().join(r.groupBy("deck").agg(F.count("*").alias("r")), "deck").where("count = r").select("deck")
    c = c.join(r.select("deck", F.col("run_id").alias("a"), F.col("run_id").alias("claim_id")), ["deck", "claim_id"], "left")
    suffixes = first_seen(r.withColumn("suffix", claim_suffix(F.col("run_id"))).where("suffix IS NOT NULL"), ["deck", "suffix"], "r_ord")
    c = c.join(suffixes.select("deck", "suffix", F.col("run_id").alias("b")), ["deck", "suffix"], "left")
    placed = r.join(counts, "deck", "left_semi").select("deck", F.col("r_ord").alias("ord"), F.col("run_id").alias("p"))
    c = c.join(placed, ["deck", "ord"], "left")
    how = F.when(F.col("a").isNotNull(), "id").when(F.col("b").isNotNull(), "suffix").when(F.col("p").isNotNull(), "place").otherwise("none")
    return c.select("deck", "claim_id", "ord", F.coalesce("a", "b", "p").alias("run_id"), how.alias("how"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows of keys that new does not have, and all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def first_source(sources: list[DataFrame], key: str) -> DataFrame:
    """All rows of the first source that has any for a key."""
    every = None
    for i, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(i))
        every = s if every is None else every.unionByName(s)
    best = every.groupBy(key).agg(F.min("_source").alias("_best"))
    return every.join(best, key).where("_source = _best").drop("_source", "_best")


def nested_candidates(ranked: DataFrame, passages: DataFrame, most: int = 5) -> DataFrame:
    """claim_id and candidates, the passages' texts in order of rank; a passage that is missing has an empty text."""
    top = ranked.where(F.col("rank") <= most).join(passages.select("passage_id", "text"), "passage_id", "left")
    item = F.struct("rank", "passage_id", F.coalesce("text", F.lit("")).alias("text"), "score")
    return top.groupBy("claim_id").agg(F.array_sort(F.collect_list(item)).alias("candidates"))


def leaked(test: DataFrame, train: DataFrame, key: str) -> DataFrame:
    return test.join(train.select(key).distinct(), key, "left_semi")


def clean(test: DataFrame, train: DataFrame, key: str) -> DataFrame:
    return test.join(train.select(key).distinct(), key, "left_anti")


def held_out_in(rows: DataFrame, held_out: Column) -> DataFrame:
    """Rows of a part that is kept apart."""
    return rows.where(F.coalesce(held_out, F.lit(False)))


def no_leak(rows: DataFrame, held_out: Column) -> DataFrame:
    """The rows themselves; an error if any is of the part that is kept apart."""
    if not held_out_in(rows, held_out).isEmpty():
        raise ValueError("training holds rows of the part kept apart")
    return rows


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, left, right of settings (key, value) that differ or that only one side has."""
    both = a.withColumnRenamed("value", "left").join(b.withColumnRenamed("value", "right"), "key", "full_outer")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def presence(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """key and an O or X for each source, from what their keys are."""
    every = None
    for name, s in sources.items():
        s = s.select(key).distinct().withColumn("_in", F.lit(name))
        every = s if every is None else every.unionByName(s)
    flags = [F.when(F.max(F.col("_in") == n), "O").otherwise("X").alias(n) for n in sources]
    return every.groupBy(key).agg(*flags)


def fill_rates(rows: DataFrame) -> DataFrame:
    """field, filled, missing, kinds of every column: neither null nor empty counts as filled."""
    names = rows.columns
    text = rows.select(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in names])
    long = text.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in names])).alias("x")).select("x.*")
    # values are counted first, so that distinct ones need no second pass over rows
    per = long.groupBy("field", "v").agg(F.count("*").alias("c"))
    return per.groupBy("field").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0)).alias("filled"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("missing"),
        F.count("v").alias("kinds"),
    )


def feature_vector(claim: Column, candidates: Column, scores: Column) -> Column:
    """claim, best candidate, their absolute difference and product, and five score statistics; zeros without candidates."""
    dim = F.size(claim)
    best = F.element_at(candidates, F.array_position(scores, F.array_max(scores)).cast("int"))
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n
    std = F.sqrt(F.aggregate(scores, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    stats = F.array(F.array_max(scores), mean, std, F.array_min(scores), n / 5.0)
    parts = F.concat(claim, best, F.zip_with(claim, best, lambda a, b: F.abs(a - b)), F.zip_with(claim, best, lambda a, b: a * b), stats)
    empty = F.concat(claim, F.array_repeat(F.lit(0.0), dim * 3 + 5))
    return F.when(n > 0, parts).otherwise(empty)


def judge_input(claim: Column, title: Column, context: Column, candidates: Column, caps: tuple[int, int, int] = (64, 96, 64), most: int = 510) -> Column:
    """Tokens of claim, slide context and candidates, each block cut to its cap, with marks between, cut to ``most``."""
    words = lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), r"(?U)\s+"), lambda x: x != "")
    block = lambda t, cap: F.slice(words(t), 1, cap)
    sep = F.array(F.lit("[SEP]"))
    around = F.array_join(F.filter(F.concat(F.array(title), F.slice(context, 1, 6)), lambda x: F.coalesce(x, F.lit("")) != ""), " / ")
    cands = F.transform(F.slice(candidates, 1, 5), lambda c: block(c, caps[2]))
    tail = F.flatten(F.transform(F.filter(cands, lambda c: F.size(c) > 0), lambda c: F.concat(c, sep)))
    ids = F.concat(F.array(F.lit("[CLS]")), block(claim, caps[0]), sep, block(around, caps[1]), sep, tail)
    return F.slice(ids, 1, most)


def match_verdicts(verdicts: DataFrame, gold: DataFrame) -> DataFrame:
    """verdict_id, how (claim_id, claim_text, nospace or none) and gold_id of verdicts (ord, verdict_id, claim_text).

    gold: ord, claim_id, claim_text.  A verdict that names a claim has it.
    Others look for the first claim of their text, else of their text without
    spaces, and have it if no verdict before them has come to it.
    """
    form = T.alike(nfkc("claim_text"))
    g = gold.select("ord", "claim_id", form.alias("t")).withColumn("n", T.unspaced(F.col("t")))
    of = lambda c: g.groupBy(F.col(c).alias(f"_{c}")).agg(F.min(F.struct("ord", "claim_id"))["claim_id"].alias(f"by_{c}"))
    v = verdicts.select("ord", "verdict_id", form.alias("_t")).withColumn("_n", T.unspaced(F.col("_t")))
    v = v.join(gold.select(F.col("claim_id").alias("by_id")).distinct(), F.col("verdict_id") == F.col("by_id"), "left")
    v = v.join(of("t"), "_t", "left").join(of("n"), "_n", "left")
    v = v.withColumn("g", F.coalesce("by_id", "by_t", "by_n"))
    v = v.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("ord", "verdict_id")))
    named, free = F.col("by_id").isNotNull(), F.col("g").isNotNull() & (F.col("k") == 1)
    how = F.when(named, "claim_id").when(~free, "none").when(F.col("by_t").isNotNull(), "claim_text").otherwise("nospace")
    return v.select("verdict_id", how.alias("how"), F.when(named | free, F.col("g")).alias("gold_id"))


def judgment_context(judgments: DataFrame, sents: DataFrame, extra: DataFrame, key: str, around: int = 1) -> DataFrame:
    """judgments (key, ref) with core, context and place: the sentence that ref names between its neighbours, else the extra text of that name.

    sents: key, sents (array); extra: key, name, text, note.
    """
    n = F.regexp_extract("ref", r"^s(\d+)$", 1).try_cast("int")
    j = judgments.join(sents, key, "left").withColumn("_n", n)
    has = F.col("_n").between(F.lit(1), F.size("sents"))
    low = F.greatest(F.col("_n") - around, F.lit(1))
    j = j.join(extra.withColumnRenamed("name", "ref"), [key, "ref"], "left")
    core = F.when(has, F.try_element_at("sents", F.when(F.col("_n") > 0, F.col("_n")))).otherwise(F.coalesce("text", F.lit("")))
    near = F.array_join(F.slice("sents", F.greatest(low, F.lit(1)), F.greatest(F.col("_n") + around - low + 1, F.lit(0))), " ")
    place = F.when(has, F.col("ref")).when(F.col("text").isNotNull(), "extra").otherwise("")
    context = F.when(has, near).otherwise(F.coalesce("note", F.lit("")))
    return j.select(*judgments.columns, core.alias("core"), context.alias("context"), place.alias("place"))


def rejected(rows: DataFrame, known: Column, by: str, value: str) -> DataFrame:
    """kind (``by`` or ``value``), name, n: rows that are not known, counted by group and by what stands there."""
    bad = rows.where(~F.coalesce(known, F.lit(False)))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("name")) for c in (by, value)])).alias("r")
    return bad.select(each).groupBy("r.kind", "r.name").agg(F.count("*").alias("n"))


def best_mode(modes: DataFrame, key: str, pattern: str) -> DataFrame:
    """key, mode, ratio, sents: of several readings (key, mode, sents) of a document the one with most sentences that end as the
    pattern has it; headings do not count, and the first of equals is taken."""
    body = F.filter("sents", lambda s: ~T.is_heading(s))
    ratio = F.when(F.size(body) > 0, F.size(F.filter(body, lambda s: F.trim(s).rlike(pattern))) / F.size(body)).otherwise(0.0)
    m = modes.select(key, "mode", F.round(ratio, 9).alias("ratio"), F.size(body).alias("n"))
    best = F.max(F.struct("ratio", (-F.col("mode")).alias("first"), "n")).alias("b")
    return m.groupBy(key).agg(best).select(key, (-F.col("b.first")).alias("mode"), F.col("b.ratio").alias("ratio"), F.col("b.n").alias("sents"))
