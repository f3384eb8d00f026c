"""Small field rules, budgets, splits and checks of dataset assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.operators import dataset as D
from plinth.operators import evaluate as E
from plinth.plans import retrieval as R
from plinth.plans.pages import KEPT, items
from plinth.plans.registry import query, table

_DOMAIN_SQL = " ".join(f"WHEN starts_with(deck, '{k}') THEN '{v}'" for k, v in T.DOMAINS.items())
#: Documents with ids, markers and domains as people write them.
RAW_IDS = """m AS (
  SELECT doc_id AS id, source || CASE doc_id % 3 WHEN 0 THEN '__toola' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '_s0' || doc_id % 9 || '_c' || doc_id % 40 END AS claim,
    CASE doc_id % 5 WHEN 0 THEN 'arts_01__toola' WHEN 1 THEN 'bio_02__x__' || source WHEN 2 THEN 'socio-7' WHEN 3 THEN source END AS deck,
    CASE doc_id % 6 WHEN 0 THEN '1' WHEN 1 THEN ' 1 (test)' WHEN 2 THEN '12' WHEN 3 THEN '' WHEN 4 THEN lang END AS marker,
    CASE doc_id % 4 WHEN 1 THEN '?' WHEN 2 THEN lang WHEN 3 THEN '' END AS domain FROM documents)"""


def _case(n: int, *values) -> Column:
    """The value at the place of doc_id's remainder; null beyond."""
    out = F.lit(None).cast("string")
    for k, v in enumerate(values):
        out = F.when(F.col("doc_id") % n == k, v).otherwise(out)
    return out


@query(
    rf"""WITH {RAW_IDS}
SELECT id, nullif(regexp_extract(claim, '_(s\d+_c\d+)$', 1), '') AS suffix,
  CASE WHEN contains(deck, '__') THEN split_part(deck, '__', -1) END AS tool, CASE WHEN contains(deck, '__') THEN split_part(deck, '__', 1) END AS doc,
  coalesce(regexp_matches(marker, '^\s*1(\D|$)'), false) AS is_test,
  CASE WHEN coalesce(domain, '') <> '' AND NOT contains(domain, '?') THEN domain {_DOMAIN_SQL} ELSE domain END AS domain FROM m"""
)
def id_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR9, STR19, F9, P9: what ids, markers and domains say."""
    id = F.col("doc_id")
    tail = F.concat(F.lit("_s0"), (id % 9).cast("string"), F.lit("_c"), (id % 40).cast("string"))
    m = table(spark, sf_dir, "documents").select(
        id.alias("id"),
        F.concat("source", F.when(id % 3 == 0, "__toola").otherwise(""), F.when(id % 4 == 0, "").otherwise(tail)).alias("claim"),
        _case(5, F.lit("arts_01__toola"), F.concat(F.lit("bio_02__x__"), "source"), F.lit("socio-7"), F.col("source")).alias("deck"),
        _case(6, F.lit("1"), F.lit(" 1 (test)"), F.lit("12"), F.lit(""), F.col("lang")).alias("marker"),
        _case(4, F.lit(None).cast("string"), F.lit("?"), F.col("lang"), F.lit("")).alias("domain"),
    )
    two = F.contains("deck", F.lit("__"))
    return m.select(
        "id",
        D.claim_suffix(F.col("claim")).alias("suffix"),
        F.when(two, F.substring_index("deck", "__", -1)).alias("tool"),
        F.when(two, F.substring_index("deck", "__", 1)).alias("doc"),
        F.coalesce(T.is_test_marker(F.col("marker")), F.lit(False)).alias("is_test"),
        T.inferred_domain(F.col("domain"), F.col("deck")).alias("domain"),
    )


@query(
    f"""WITH {R.CONV}, {R._fused_cte('fused', 0.5, 0.5)},
t AS (SELECT f.claim_id, f.rank, CASE WHEN p.ord % 4 = 1 THEN ' ' ELSE p.text END AS text FROM fused f JOIN passages p USING (passage_id))
SELECT claim_id, count(*) FILTER (rank <= 5) AS taken, count(*) FILTER (rank <= 5 AND trim(text) <> '') AS kept FROM t GROUP BY claim_id"""
)
def candidate_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first five candidates, of these the ones that are not blank (here every other passage is blanked)."""
    run = R.hybrid_run(spark, sf_dir)
    p = R.sides(spark, sf_dir)[1].select("passage_id", F.when(F.col("ord") % 4 == 1, " ").otherwise(F.col("text")).alias("text"))
    all_of = run.join(p, "passage_id").groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c"))
    taken = F.slice("c", 1, 5)
    return all_of.select("claim_id", F.size(taken).cast("long").alias("taken"), F.size(F.filter(taken, lambda c: F.trim(c["text"]) != "")).cast("long").alias("kept"))


@query(
    r"""WITH t AS (SELECT lang, least(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')), 64) AS c, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT lang, round(avg((n > 512)::INTEGER), 6) AS over_ratio, floor((512 - 8 - quantile_cont(c, 0.95)) / 5)::INTEGER AS budget_5, floor((512 - 8 - quantile_cont(c, 0.95)) / 3)::INTEGER AS budget_3 FROM t GROUP BY lang"""
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many inputs exceed 512 tokens, and what is left for each of five or three candidates."""
    n = F.size(T.tokens(F.col("text")))
    t = table(spark, sf_dir, "documents").select("lang", n.alias("n"), F.least(n, F.lit(64)).alias("c"))
    a = t.groupBy("lang").agg(F.avg((F.col("n") > 512).cast("int")).alias("o"), F.percentile("c", F.lit(0.95)).alias("p"))
    left = F.lit(512 - 8) - F.col("p")
    return a.select("lang", F.round("o", 6).alias("over_ratio"), F.floor(left / 5).cast("int").alias("budget_5"), F.floor(left / 3).cast("int").alias("budget_3"))


@query(
    """WITH d AS (SELECT source, CASE WHEN row_number() OVER (ORDER BY md5('7' || source), source) <= 4 THEN 'dev' ELSE 'train' END AS part FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, part FROM documents JOIN d USING (source)"""
)
def dev_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML4: whole groups go to the development set, the first four in an order given by a seeded hash."""
    d = table(spark, sf_dir, "documents")
    first = d.select("source").distinct().orderBy(F.md5(F.concat(F.lit("7"), "source").cast("binary")), "source").limit(4)
    first = first.select(F.col("source").alias("s"))
    return d.join(F.broadcast(first), d["source"] == first["s"], "left").select(  # four rows
        "doc_id", F.when(F.col("s").isNotNull(), "dev").otherwise("train").alias("part")
    )


@query(
    """WITH f AS (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'role', role FROM conversations)
SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value)::INTEGER AS place FROM f GROUP BY field, value"""
)
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by how often they occur; what is ranked are counts, a row for each value of fields that have few."""
    d, c = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    one = lambda t, f: t.groupBy(F.lit(f).alias("field"), F.col(f).alias("value")).agg(F.count("*").alias("n"))
    every = one(d, "lang").unionByName(one(d, "source")).unionByName(one(c, "role"))
    return every.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value")))


@query(
    f"""WITH {R.EVAL}, votes AS (
  SELECT 'after' AS annotator, claim_id, passage_id FROM gold UNION
  SELECT 'before', c.claim_id, p.passage_id FROM claims c JOIN passages p ON c.conv_id = p.conv_id AND p.ord = c.turn - 1),
all_gold AS (SELECT DISTINCT claim_id, passage_id FROM votes),
g AS (SELECT annotator, claim_id, passage_id FROM votes UNION ALL SELECT 'pooled', * FROM all_gold),
tried AS (SELECT DISTINCT g.annotator, r.method, g.claim_id FROM g JOIN runs r USING (claim_id)),
f AS (SELECT a.annotator, a.method, a.claim_id, h.first FROM tried a LEFT JOIN (
  SELECT g.annotator, r.method, g.claim_id, min(r.rank) AS first FROM g JOIN runs r USING (claim_id, passage_id) GROUP BY ALL) h USING (annotator, method, claim_id))
SELECT annotator, method, count(*) AS n, {R.MEASURES} FROM f GROUP BY ALL"""
)
def pooled_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures by annotator (the turn after, the turn before) and pooled, in one pass."""
    claims, passages = R.sides(spark, sf_dir)
    at = lambda name, step: claims.join(
        passages.select("conv_id", (F.col("ord") - step).alias("turn"), "passage_id"), ["conv_id", "turn"]
    ).select(F.lit(name).alias("annotator"), "claim_id", "passage_id")
    votes = at("after", 1).unionByName(at("before", -1))
    gold = votes.unionByName(votes.select(F.lit("pooled").alias("annotator"), "claim_id", "passage_id").distinct())
    runs = R.runs(spark, sf_dir)
    asked = gold.select("annotator", "claim_id").distinct().join(runs.select("method", "claim_id").distinct(), "claim_id")
    first = gold.join(runs, ["claim_id", "passage_id"]).groupBy("annotator", "method", "claim_id").agg(F.min("rank").alias("first"))
    return E.recall_and_mrr(asked.join(first, ["annotator", "method", "claim_id"], "left"), ["annotator", "method"])


@query(
    rf"""WITH {KEPT}, l AS (SELECT deck_id, slide, item_id, top, "left", list_filter(list_transform(string_split(text, E'\n'), lambda x: trim(x)), lambda x: x <> '') AS l, trim(text) AS whole FROM kept),
c AS (SELECT deck_id, slide, top, "left", item_id, unnest(CASE WHEN len(l) > 1 AND len(list_filter(l, lambda x: regexp_matches(x, '{T.BULLET}'))) = len(l)
  THEN list_transform(l, lambda x: trim(regexp_replace(x, '{T.BULLET}', ''))) ELSE [trim(regexp_replace(whole, '{T.BULLET}', ''))] END) AS claim FROM l)
SELECT deck_id, slide, claim, min(item_id)::INTEGER AS item_id FROM c WHERE claim <> '' GROUP BY ALL"""
)
def slide_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR7, W8, O1: claims of a slide, each once, from where it is first seen."""
    from plinth.operators.layout import without_page_numbers

    i = without_page_numbers(items(spark, sf_dir)).select("deck_id", "slide", "item_id", F.explode(T.bullet_claims(F.col("text"))).alias("claim"))
    return D.first_seen(i, ["deck_id", "slide", "claim"], "item_id").select("deck_id", "slide", "claim", "item_id")


@query(
    """WITH m AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations),
c AS (SELECT conv_id, turn, [w[1], '', w[2], NULL, w[3]] AS cells, CASE turn % 3 WHEN 0 THEN w[4] WHEN 1 THEN '' END AS series FROM m)
SELECT conv_id, turn, CASE WHEN coalesce(series, '') <> '' THEN series || ': ' ELSE '' END || array_to_string(list_filter(cells, lambda x: coalesce(x, '') <> ''), ' | ') AS line FROM c"""
)
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR18: rows of tables and charts as one line; the cells are words of turns, some of them empty or missing."""
    w = lambda i: F.get(F.split("text", " "), F.lit(i))
    m = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array(w(0), F.lit(""), w(1), F.lit(None).cast("string"), w(2)).alias("cells"),
        F.when(F.col("turn") % 3 == 0, w(3)).when(F.col("turn") % 3 == 1, "").alias("series"),
    )
    cells = F.array_join(F.filter("cells", lambda x: F.coalesce(x, F.lit("")) != ""), " | ")
    series = F.when(F.coalesce("series", F.lit("")) != "", F.concat("series", F.lit(": "))).otherwise("")
    return m.select("conv_id", "turn", F.concat(series, cells).alias("line"))


@query(
    """WITH m AS (SELECT doc_id AS id, source AS a, CASE doc_id % 4 WHEN 0 THEN source || '__x' WHEN 1 THEN replace(source, 'src', 's_rc') WHEN 2 THEN 'src' || doc_id % 20 ELSE substr(source, 2) END AS b FROM documents),
n AS (SELECT id, a, b, replace(a, '_', '') AS x, replace(b, '_', '') AS y FROM m)
SELECT id, a, b, CASE WHEN x = y THEN 'equal' WHEN contains(y, x) OR contains(x, y) THEN 'part' ELSE 'none' END AS match FROM n"""
)
def deck_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are equal, or of which one holds the other, once underscores are gone."""
    src = F.col("source")
    b = _case(4, F.concat(src, F.lit("__x")), F.replace(src, F.lit("src"), F.lit("s_rc")), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")), F.substring(src, 2, 1 << 20))
    m = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), src.alias("a"), b.alias("b"))
    x, y = (F.replace(F.col(c), F.lit("_"), F.lit("")) for c in "ab")
    return m.select("id", "a", "b", F.when(x == y, "equal").when(F.contains(y, x) | F.contains(x, y), "part").otherwise("none").alias("match"))


@query(
    f"""WITH {R.EVAL}, s AS (SELECT method, conv_id % 3 AS seed, avg(CASE WHEN first <= 1 THEN 1 ELSE 0 END) AS x FROM firsts JOIN claims USING (claim_id) GROUP BY ALL),
a AS (SELECT method, avg(x) AS m, stddev_pop(x) AS s FROM s GROUP BY method)
SELECT h.method, round(h.m - b.m, 6) AS effect, round(sqrt(h.s * h.s + b.s * b.s), 6) AS spread, abs(round(h.m - b.m, 6)) > round(sqrt(h.s * h.s + b.s * b.s), 6) AS clear
FROM a h CROSS JOIN (SELECT * FROM a WHERE method = 'bm25') b WHERE h.method <> 'bm25'"""
)
def ablation_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML9: what a method adds over the first one, against the pooled spread of runs (here thirds of conversations)."""
    firsts = E.first_ranks(R.gold_of(spark, sf_dir), R.runs(spark, sf_dir), ["method"])
    seed = R.sides(spark, sf_dir)[0].select("claim_id", (F.col("conv_id") % 3).alias("seed"))
    s = firsts.join(seed, "claim_id").groupBy("method", "seed").agg(F.avg(F.coalesce((F.col("first") <= 1).cast("int"), F.lit(0))).alias("x"))
    a = s.groupBy("method").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    b = a.where("method = 'bm25'").select(F.col("m").alias("bm"), F.col("s").alias("bs"))
    both = a.where("method <> 'bm25'").crossJoin(F.broadcast(b))  # one row
    effect, spread = F.round(F.col("m") - F.col("bm"), 6), F.round(F.sqrt(F.col("s") * F.col("s") + F.col("bs") * F.col("bs")), 6)
    return both.select("method", effect.alias("effect"), spread.alias("spread"), (F.abs(effect) > spread).alias("clear"))


@query(
    r"""WITH w AS (SELECT conv_id, turn, least(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')), 64) AS n FROM conversations)
SELECT conv_id, turn, n::INTEGER AS n, (max(n) OVER (PARTITION BY conv_id) - n)::INTEGER AS padding FROM w"""
)
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: conversations as batches, each padded to its longest turn; the mask has as many zeros as there is padding."""
    ids = F.slice(T.tokens(F.col("text")), 1, 64)
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(ids).alias("n"), ids.alias("ids"))
    longest = F.max("n").over(Window.partitionBy("conv_id"))
    padded = F.concat("ids", F.array_repeat(F.lit("[PAD]"), longest - F.col("n")))
    mask = F.concat(F.array_repeat(F.lit(1), F.col("n")), F.array_repeat(F.lit(0), longest - F.col("n")))
    t = t.select("conv_id", "turn", "n", padded.alias("ids"), mask.alias("mask"))
    return t.select("conv_id", "turn", "n", F.size(F.filter("mask", lambda m: m == 0)).alias("padding"))


@query(
    """SELECT doc_id, source FROM documents WHERE source = 'src0' AND doc_id % 5 < 3"""
)
def leak_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: rows of the domain kept for generalization, src0, that a split by id alone puts into training; ``D.no_leak`` raises if there are any."""
    return D.held_out_in(table(spark, sf_dir, "documents").where("doc_id % 5 < 3"), F.col("source") == "src0").select("doc_id", "source")
