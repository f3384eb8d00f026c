"""Labels: canonical forms, eligibility, confusion, scores, weights, agreement.

Truth is a label made of a document's quality and toxicity; a rule over text
and length stands in for a classifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.operators import dataset as D
from plinth.operators import evaluate as E
from plinth.plans.registry import literal, query, table


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, truth, predicted."""
    truth = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "근거 있음")
        .when((F.col("quality") == 0) & (F.col("toxic") == 0), "무근거")
        .when(F.col("toxic") == 1, F.when(F.col("quality") == 0, "모순").otherwise("Benign"))
    )
    rule = F.when(F.contains("text", F.lit("###")), "무근거").when(F.contains("text", F.lit("!!")), "모순").when(F.col("n_chars") < 200, "Benign").otherwise("근거 있음")
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return j.select("doc_id", "source", "lang", truth.alias("truth"), rule.alias("predicted"))


JUDGED = """
judged AS (
  SELECT doc_id, source, lang,
    CASE WHEN quality = 1 AND toxic = 0 THEN '근거 있음' WHEN quality = 0 AND toxic = 0 THEN '무근거' WHEN quality = 0 THEN '모순' ELSE 'Benign' END AS truth,
    CASE WHEN contains(text, '###') THEN '무근거' WHEN contains(text, '!!') THEN '모순' WHEN n_chars < 200 THEN 'Benign' ELSE '근거 있음' END AS predicted
  FROM labels JOIN documents USING (doc_id)),
names AS (SELECT unnest(['근거 있음', '무근거', '모순', 'Benign']) AS label)
"""


def _scores(by: str) -> str:
    k, on = (f"{by}, ", f"g.{by} = j.{by} AND") if by else ("", "")
    groups = f"(SELECT DISTINCT {by} FROM judged) g CROSS JOIN names" if by else "names"
    return f"""scores AS (
  SELECT {'g.' + by + ',' if by else ''} names.label, count(*) FILTER (j.truth = label) AS support,
    count(*) FILTER (j.truth = label AND j.predicted = label) AS tp, count(*) FILTER (j.truth <> label AND j.predicted = label) AS fp,
    count(*) FILTER (j.truth = label AND j.predicted <> label) AS fn
  FROM {groups} LEFT JOIN judged j ON {on} (j.truth = names.label OR j.predicted = names.label) GROUP BY ALL),
f AS (SELECT {k} label, support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM scores)"""


@query(
    f"WITH {JUDGED} SELECT a.label AS truth, b.label AS predicted, count(j.doc_id) AS n FROM names a CROSS JOIN names b LEFT JOIN judged j ON j.truth = a.label AND j.predicted = b.label GROUP BY ALL"
)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return E.confusion(judged(spark, sf_dir))


@query(f"WITH {JUDGED}, {_scores('')} SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.class_scores(judged(spark, sf_dir), [])
    return s.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _summary(by: str) -> str:
    k = f"{by}, " if by else ""
    join = f"JOIN m USING ({by})" if by else "CROSS JOIN m"
    return f"""WITH {JUDGED}, {_scores(by)}, m AS (SELECT {k} avg(f1) AS m FROM f GROUP BY ALL),
a AS (SELECT {k} count(*) AS n, avg((truth = predicted)::INTEGER) AS a FROM judged GROUP BY ALL)
SELECT {k} n, round(a, 6) AS accuracy, round(m, 6) AS macro_f1, round(a - 1.96 * sqrt(a * (1 - a) / n), 6) AS acc_low,
  round(a + 1.96 * sqrt(a * (1 - a) / n), 6) AS acc_high FROM a {join}"""


@query(_summary(""))
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, A15."""
    return E.summary(judged(spark, sf_dir), [])


@query(_summary("source"))
def per_source_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return E.summary(judged(spark, sf_dir), ["source"])


@query(
    f"""WITH {JUDGED}, {_scores('lang')}, m AS (SELECT lang, avg(f1) AS m FROM f GROUP BY lang)
SELECT x.lang, round(a.m - x.m, 6) AS loss, round(CASE WHEN a.m = 0 THEN 0 ELSE (a.m - x.m) / a.m END, 6) AS share
FROM m x CROSS JOIN (SELECT m FROM m WHERE lang = 'en') a"""
)
def domain_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each language loses against English."""
    m = E.class_scores(judged(spark, sf_dir), ["lang"]).groupBy("lang").agg(F.avg("f1").alias("m"))
    a = m.where("lang = 'en'").select(F.col("m").alias("a"))
    loss = F.col("a") - F.col("m")
    return m.crossJoin(F.broadcast(a)).select(  # one row
        "lang", F.round(loss, 6).alias("loss"), F.round(F.when(F.col("a") == 0, 0.0).otherwise(loss / F.col("a")), 6).alias("share")
    )


@query(f"WITH {JUDGED}, {_scores('source')} SELECT source, label FROM f WHERE f1 = 0 AND label IN ('무근거', '모순')")
def zero_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources without a right answer for one of the two labels that matter most."""
    return E.class_scores(judged(spark, sf_dir), ["source"]).where((F.col("f1") == 0) & F.col("label").isin(*E.GRAVE)).select("source", "label")


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of macro-F1 over resampled sources."""
    return E.bootstrap_macro_f1(judged(spark, sf_dir), "source")


@query(
    f"""WITH {JUDGED} SELECT source, arg_max(truth, CASE truth WHEN '모순' THEN 3 WHEN '무근거' THEN 2 WHEN '근거 있음' THEN 1 ELSE 0 END) AS gravest
FROM judged GROUP BY source"""
)
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    j = judged(spark, sf_dir)
    return j.groupBy("source").agg(F.max_by("truth", E.lookup(F.col("truth"), E.SEVERITY)).alias("gravest"))


@query(
    f"""WITH {JUDGED}, c AS (SELECT label, count(doc_id) AS n FROM names LEFT JOIN judged ON truth = label GROUP BY label),
w AS (SELECT label, n, sqrt(sum(n) OVER () / greatest(n, 1)) AS w FROM c)
SELECT label, n, round(w / avg(w) OVER (), 6) AS weight FROM w"""
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    return E.class_weights(judged(spark, sf_dir).select(F.col("truth").alias("label")))


@query(
    f"""WITH {JUDGED}, s AS (SELECT doc_id % 3 AS seed, avg((truth = predicted)::INTEGER) AS a FROM judged GROUP BY 1)
SELECT count(*) AS runs, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std FROM s"""
)
def seed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation over runs, here thirds of the rows."""
    s = judged(spark, sf_dir).groupBy((F.col("doc_id") % 3).alias("seed")).agg(F.avg((F.col("truth") == F.col("predicted")).cast("int")).alias("a"))
    return s.agg(F.count("*").alias("runs"), F.round(F.avg("a"), 6).alias("mean"), F.round(F.stddev_pop("a"), 6).alias("std"))


@query(
    """WITH r AS (
  SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'no label' WHEN l.quality = 0 THEN 'label without evidence' WHEN trim(d.text) = '' THEN 'empty evidence'
    WHEN d.n_chars < 100 THEN 'claim unmatched' WHEN l.toxic = 1 THEN 'not found' ELSE 'made' END AS reason
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT reason, count(*) AS n FROM r GROUP BY reason"""
)
def gold_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """why a row becomes gold, or why not; the first reason counts."""
    return reasons(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    reason = (
        F.when(F.col("quality").isNull(), "no label")
        .when(F.col("quality") == 0, "label without evidence")
        .when(F.trim("text") == "", "empty evidence")
        .when(F.col("n_chars") < 100, "claim unmatched")
        .when(F.col("toxic") == 1, "not found")
        .otherwise("made")
    )
    return j.select("doc_id", "source", "lang", reason.alias("reason"))


@query(
    """WITH r AS (
  SELECT d.source, CASE WHEN l.doc_id IS NULL THEN 'no label' WHEN l.quality = 0 THEN 'label without evidence' WHEN trim(d.text) = '' THEN 'empty evidence'
    WHEN d.n_chars < 100 THEN 'claim unmatched' WHEN l.toxic = 1 THEN 'not found' ELSE 'made' END AS reason
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, count(*) FILTER (reason = 'made') AS exact, count(*) FILTER (reason IN ('made', 'not found')) AS created,
  round(CASE WHEN count(*) FILTER (reason IN ('made', 'not found')) > 0 THEN count(*) FILTER (reason = 'made') / count(*) FILTER (reason IN ('made', 'not found')) ELSE 0 END, 6) AS clean
FROM r GROUP BY source"""
)
def gold_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of gold that was found exactly."""
    made = F.col("reason") == "made"
    r = reasons(spark, sf_dir).groupBy("source").agg(F.count_if(made).alias("exact"), F.count_if(made | (F.col("reason") == "not found")).alias("created"))
    return r.withColumn("clean", F.round(F.when(F.col("created") > 0, F.col("exact") / F.col("created")).otherwise(0.0), 6))


@query(
    f"""WITH {JUDGED}, v AS (SELECT doc_id AS item, truth AS label FROM judged UNION ALL SELECT doc_id, predicted FROM judged),
p AS (SELECT item, label, count(*) AS c FROM v GROUP BY ALL), i AS (SELECT item, sum(c) AS n, sum(c * c) AS sq FROM p GROUP BY item),
a AS (SELECT avg((sq - n) / (n * (n - 1))) AS p, count(*) AS items, count(*) FILTER (sq < n * n) AS disagreements FROM i),
e AS (SELECT sum(c * c) / (sum(c) * sum(c)) AS e FROM (SELECT label, sum(c) AS c FROM p GROUP BY label))
SELECT round((p - e) / (1 - e), 6) AS kappa, items, disagreements FROM a, e"""
)
def fleiss_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two raters, truth and rule."""
    j = judged(spark, sf_dir)
    return E.fleiss_kappa(j.select(F.col("doc_id").alias("item"), F.explode(F.array("truth", "predicted")).alias("label")))


MESSY = [
    "근거있음", " 근거 있음 ", "Supported", "무근거", "UNSUPPORTED", "모순", "contradiction", "benign", "Benign", "nan", "", None, "기타 의견", "상식참", "충돌",
]
#: Labels as people type them, one for each labelled document.
RAW_LABELS = f"m AS (SELECT doc_id AS id, [{', '.join(map(literal, MESSY))}][doc_id % {len(MESSY)} + 1] AS label FROM labels)"
_ALIAS_SQL = ", ".join(f"('{k}', '{v}')" for k, v in E.ALIASES.items())


@query(
    f"""WITH {RAW_LABELS}, a AS (SELECT * FROM (VALUES {_ALIAS_SQL}) AS t(k, v))
SELECT m.id, coalesce(x.v, y.v) AS label, coalesce(x.v, y.v) IS NULL AS rejected
FROM m LEFT JOIN a x ON x.k = trim(m.label) LEFT JOIN a y ON y.k = lower(trim(m.label))"""
)
def label_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings become labels; blank, NaN and unknown ones are null and counted as rejected."""
    m = typed_labels(spark, sf_dir)
    label = E.canonical_label(F.col("label"))
    return m.select("id", label.alias("label"), label.isNull().alias("rejected"))


@query(
    f"""WITH {RAW_LABELS}, a AS (SELECT * FROM (VALUES {_ALIAS_SQL}) AS t(k, v)),
bad AS (SELECT d.source, m.label FROM m JOIN documents d ON d.doc_id = m.id
  WHERE trim(coalesce(m.label, '')) NOT IN (SELECT k FROM a) AND lower(trim(coalesce(m.label, ''))) NOT IN (SELECT k FROM a))
SELECT 'source' AS kind, source AS name, count(*) AS n FROM bad GROUP BY ALL UNION ALL SELECT 'label', label, count(*) FROM bad GROUP BY ALL"""
)
def rejected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels that are none, counted by source and by what stands there."""
    m = typed_labels(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return D.rejected(m, E.canonical_label(F.col("label")).isNotNull(), "source", "label")


def typed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label."""
    at = F.array(*[F.lit(x) for x in MESSY])
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.get(at, (F.col("doc_id") % len(MESSY)).cast("int")).alias("label"))


@query(
    r"""WITH m AS (
  SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN ' Fin_' || source || '__toolb ' WHEN 1 THEN upper(source) || ' 04__x__y' WHEN 2 THEN 'Finance_' || source ELSE source END AS deck,
    CASE doc_id % 5 WHEN 0 THEN 'p. ' || doc_id % 30 WHEN 1 THEN '3' WHEN 2 THEN 's007' WHEN 3 THEN '' END AS slide,
    CASE doc_id % 3 WHEN 0 THEN replace(substr(text, 1, 40), ' ', ' | ') WHEN 1 THEN ' | ' || lang || ' || ' ELSE lang END AS context FROM documents)
SELECT id, regexp_replace(replace(split_part(lower(trim(deck)), '__', 1), ' ', ''), '^fin_', 'finance_') AS deck,
  coalesce(try_cast(regexp_replace(slide, '[^0-9]', '', 'g') AS INTEGER), 1) AS slide,
  array_to_string(list_filter(list_transform(string_split(context, '|'), lambda x: trim(x)), lambda x: x <> ''), ';') AS context FROM m"""
)
def deck_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deck ids, slide numbers and contexts as people type them."""
    id, src = F.col("doc_id"), F.col("source")
    deck = F.when(id % 4 == 0, F.concat(F.lit(" Fin_"), src, F.lit("__toolb "))).when(id % 4 == 1, F.concat(F.upper(src), F.lit(" 04__x__y")))
    deck = deck.when(id % 4 == 2, F.concat(F.lit("Finance_"), src)).otherwise(src)
    slide = F.when(id % 5 == 0, F.concat(F.lit("p. "), (id % 30).cast("string"))).when(id % 5 == 1, "3").when(id % 5 == 2, "s007").when(id % 5 == 3, "")
    context = F.when(id % 3 == 0, F.replace(F.substring("text", 1, 40), F.lit(" "), F.lit(" | "))).when(id % 3 == 1, F.concat(F.lit(" | "), "lang", F.lit(" || ")))
    m = table(spark, sf_dir, "documents").select(id.alias("id"), deck.alias("deck"), slide.alias("slide"), context.otherwise(F.col("lang")).alias("context"))
    return m.select(
        "id", T.normalized_deck(F.col("deck")).alias("deck"), T.slide_number(F.col("slide")).alias("slide"), F.array_join(T.context_items(F.col("context")), ";").alias("context")
    )


RAW_QUOTES = """m AS (
  SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN substr(text, 1, 30) || ' ... ' || substr(text, 31, 30) WHEN 1 THEN substr(text, 1, 20) || ' || ' || substr(text, 21, 20)
    WHEN 2 THEN substr(text, 1, 40) || ' (p.131, heading)' WHEN 3 THEN substr(text, 1, 40) || ' — my own remark' WHEN 4 THEN '  ' || substr(text, 1, 4) || '  '
    ELSE 'ab … cd' || substr(text, 1, 3) END AS raw FROM documents)"""


@query(
    rf"""WITH {RAW_QUOTES},
c AS (SELECT id, raw, unnest(string_split(raw, ' || ')) AS c, unnest(range(0, len(string_split(raw, ' || ')))) AS i FROM m),
p AS (SELECT id, raw, i, unnest(string_split_regex(c, '\s*(?:\.{{2,}}|…|⋯)\s*')) AS p, unnest(range(0, len(string_split_regex(c, '\s*(?:\.{{2,}}|…|⋯)\s*')))) AS j FROM c),
k AS (SELECT id, raw, i, j, trim(regexp_replace(regexp_replace(p, '\s*[（(]\s*p\.?\s*\d+[^)）]*[)）]\s*$', ''), '\s*[—–]\s*[^—–]+$', '')) AS part FROM p),
g AS (SELECT id, any_value(raw) AS raw, list(part ORDER BY i, j) FILTER (length(part) >= 6) AS parts FROM k GROUP BY id)
SELECT id, coalesce(array_to_string(parts, ' / '), trim(raw)) AS parts FROM g"""
)
def evidence_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4."""
    id, part = F.col("doc_id"), lambda a, n: F.substring("text", a, n)
    raw = F.when(id % 6 == 0, F.concat(part(1, 30), F.lit(" ... "), part(31, 30))).when(id % 6 == 1, F.concat(part(1, 20), F.lit(" || "), part(21, 20)))
    raw = raw.when(id % 6 == 2, F.concat(part(1, 40), F.lit(" (p.131, heading)"))).when(id % 6 == 3, F.concat(part(1, 40), F.lit(" — my own remark")))
    raw = raw.when(id % 6 == 4, F.concat(F.lit("  "), part(1, 4), F.lit("  "))).otherwise(F.concat(F.lit("ab … cd"), part(1, 3)))
    m = table(spark, sf_dir, "documents").select(id.alias("id"), raw.alias("raw"))
    return m.select("id", F.array_join(T.evidence_parts(F.col("raw")), " / ").alias("parts"))


@query(
    """SELECT l.doc_id, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id) WHERE d.doc_id % 5 >= 3 AND l.quality IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id % 5 < 3 AND s.text = d.text)"""
)
def aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: test rows that training does not have and that have been judged."""
    d = table(spark, sf_dir, "documents")
    test = D.clean(d.where("doc_id % 5 >= 3"), d.where("doc_id % 5 < 3"), "text").select("doc_id")
    return table(spark, sf_dir, "labels").where("quality IS NOT NULL").join(test, "doc_id", "left_semi").select("doc_id", "quality", "toxic")


@query()
def nested_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML2-ML3, O5: a small grid of logistic models on vectors, cross-validated by groups; the best by score, spread and simplicity."""
    from plinth.operators.models import grouped_search

    return grouped_search(table(spark, sf_dir, "embeddings"), features="embedding", label="label", group=F.col("vec_id") % 3)
