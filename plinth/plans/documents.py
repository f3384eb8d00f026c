"""Documents cut into sentences and passages, evidence in them, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.operators import dataset as D
from plinth.operators import evaluate as E
from plinth.operators import evidence as V
from plinth.operators import segment as S
from plinth.plans.registry import query, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


SENTS = r"""
sents AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)
"""


def _windows(w: int) -> str:
    return rf"""WITH {SENTS}, k AS (
  SELECT doc_id, s, CASE WHEN len(s) > {w} THEN range(1, len(s) - {w} + 2) WHEN len(s) > 0 THEN [1] ELSE [] END AS starts FROM sents),
x AS (SELECT doc_id, s, unnest(starts) AS i FROM k)
SELECT concat_ws('_', doc_id::VARCHAR, printf('w{w}_%03d', i)) AS passage_id, doc_id, printf('w{w}_%03d', i) AS span_id, 'w{w}' AS window,
  i::INTEGER AS ord, i::INTEGER AS first, array_to_string(s[i:i + {w} - 1], ' ') AS text,
  list_transform(range(i, least(i + {w}, len(s) + 1)), lambda j: printf('s%03d', j)) AS sent_ids,
  length(array_to_string(s[i:i + {w} - 1], ' '))::INTEGER AS n_chars FROM x"""


@query(
    rf"""WITH {SENTS}, o AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS ord, unnest(s) AS text FROM sents)
SELECT doc_id, ord::INTEGER AS ord, printf('s%03d', ord) AS sent_id, text,
  regexp_matches(text, '^(?:\d+(?:\.\d+)*|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+|[가-힣])[.)]\s*\S') AND length(text) <= 60 AND NOT ends_with(text, '다.') AS is_heading FROM o"""
)
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, STR15 with the default splitter."""
    return S.sentences(documents(spark, sf_dir))


@query(_windows(3))
def passage_w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, P1."""
    return S.passages(documents(spark, sf_dir), 3)


@query(_windows(5))
def passage_w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.passages(documents(spark, sf_dir), 5)


@query(
    f"""WITH {SENTS} SELECT doc_id, len(s)::INTEGER AS n_sents, greatest(len(s) - 2, 1)::INTEGER AS n_windows,
  least(len(s), 3)::INTEGER AS widest, (CASE WHEN len(s) >= 5 THEN 3 WHEN len(s) = 4 THEN 2 ELSE 1 END)::BIGINT AS most_cover FROM sents WHERE len(s) > 0"""
)
def window_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invariants of W1, measured: windows, the widest, and in how many windows a sentence stands at most."""
    s = S.sentence_arrays(documents(spark, sf_dir))
    s = s.select("doc_id", F.size("sents").alias("n_sents"), S.windows(F.col("sents"), 3).alias("w")).where("n_sents > 0")
    ids = F.flatten(F.transform("w", lambda x: x["ids"]))
    # a sentence stands in the windows that start up to two before it
    starts = F.transform("w", lambda x: x["first"])
    cover = F.transform(
        F.sequence(F.lit(1), F.col("n_sents")), lambda i: F.size(F.filter(F.slice(starts, F.greatest(i - 2, F.lit(1)), 3), lambda a: (a <= i) & (a > i - 3)))
    )
    return s.select(
        "doc_id", "n_sents", F.size("w").alias("n_windows"), F.array_max(F.transform("w", lambda x: F.size(x["ids"]))).alias("widest"),
        F.when(F.size(ids) > 0, F.array_max(cover)).cast("long").alias("most_cover"),
    )


@query(
    rf"""WITH p AS (SELECT passage_id FROM ({_windows(3)}))
SELECT passage_id, regexp_extract(passage_id, '^(.*)_(w\d+_\d+)$', 1) AS doc, regexp_extract(passage_id, '^(.*)_(w\d+_\d+)$', 2) AS span FROM p"""
)
def passage_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2."""
    p = S.passages(documents(spark, sf_dir), 3)
    return p.select("passage_id", S.passage_doc(F.col("passage_id")).alias("doc"), S.passage_span(F.col("passage_id")).alias("span"))


@query()
def sentence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that were cut too early, put back together."""
    return S.merged_arrays(S.paragraph_arrays(documents(spark, sf_dir)))


@query(
    r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, E'\n'), lambda x: trim(x)), lambda x: x <> '') AS l, trim(text) AS whole FROM documents),
p AS (SELECT doc_id, CASE WHEN len(list_filter(l, lambda x: length(x) >= 20)) >= 2 THEN l ELSE [whole] END AS p FROM l)
SELECT doc_id, unnest(range(0, len(p)))::INTEGER AS n, unnest(p) AS part FROM p"""
)
def claim_box_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR8."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(T.box_parts(F.col("text"))).alias("n", "part"))


@query(
    rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, E'\n'), lambda x: trim(x)), lambda x: x <> '') AS l, trim(text) AS whole FROM documents),
p AS (SELECT doc_id, list_filter(CASE WHEN len(l) > 1 AND len(list_filter(l, lambda x: regexp_matches(x, '{T.BULLET}'))) = len(l)
  THEN list_transform(l, lambda x: trim(regexp_replace(x, '{T.BULLET}', ''))) ELSE [trim(regexp_replace(whole, '{T.BULLET}', ''))] END, lambda x: x <> '') AS p FROM l)
SELECT doc_id, unnest(range(0, len(p)))::INTEGER AS n, unnest(p) AS claim FROM p"""
)
def claim_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR7."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(T.bullet_claims(F.col("text"))).alias("n", "claim"))


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("evidence"))
    return e, S.sentence_arrays(documents(spark, sf_dir))


GROUPS = f"""{SENTS}, groups AS (
  SELECT doc_id, n, i AS first, array_to_string(s[i:i + n - 1], ' ') AS text FROM (
    SELECT doc_id, s, n, unnest(range(1, len(s) - n + 2)) AS i FROM sents, (VALUES (1), (2), (3)) AS t(n) WHERE len(s) >= n))"""


@query(
    rf"""WITH {GROUPS}, b AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS e FROM benchmark),
h AS (SELECT item_id, doc_id, min(n * 1000000 + first) AS g FROM b JOIN groups ON contains(trim(regexp_replace(groups.text, '\s+', ' ', 'g')), e) WHERE e <> '' GROUP BY ALL)
SELECT item_id, doc_id, (g // 1000000)::INTEGER AS n, (g % 1000000)::INTEGER AS first FROM h"""
)
def evidence_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6, exact: benchmark passages in up to three consecutive sentences."""
    e, sents = _evidence(spark, sf_dir)
    return V.first_group_in(V.candidates(e, sents), e, sents, "doc_id")


@query(
    rf"""WITH {GROUPS}, b AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS e FROM benchmark),
h AS (SELECT item_id, doc_id, min(n * 1000000 + first) AS g FROM b JOIN groups ON contains(regexp_replace(groups.text, '\s+', '', 'g'), e) WHERE e <> '' GROUP BY ALL)
SELECT item_id, doc_id, (g // 1000000)::INTEGER AS n, (g % 1000000)::INTEGER AS first FROM h"""
)
def evidence_nospace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 without white space."""
    e, sents = _evidence(spark, sf_dir)
    return V.first_group_in(V.unspaced_candidates(e, sents), e, sents, "doc_id", unspaced=True)


@query(
    f"""WITH p AS ({_windows(3)}), want AS (SELECT doc_id, ['s001', 's002', 's003', 's004'] AS want FROM documents UNION ALL SELECT doc_id, ['s002', 's003'] FROM documents),
b AS (SELECT want, doc_id, span_id, list_has_all(sent_ids, want) AS f FROM want JOIN p USING (doc_id) WHERE list_has_any(sent_ids, want)),
m AS (SELECT *, bool_or(f) OVER (PARTITION BY doc_id, len(want)) AS any_full FROM b)
SELECT len(want)::INTEGER AS id, doc_id, span_id, f AS "full" FROM m WHERE f = any_full"""
)
def spans_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that hold all of some sentences, else any of them."""
    docs = documents(spark, sf_dir)
    ids = lambda *n: F.array(*[F.lit(f"s{i:03d}") for i in n])
    want = docs.select(F.lit(4).alias("id"), "doc_id", ids(1, 2, 3, 4).alias("want")).unionByName(
        docs.select(F.lit(2).alias("id"), "doc_id", ids(2, 3).alias("want"))
    )
    return V.spans_for(want, S.passages(docs, 3).select("doc_id", "span_id", "sent_ids"), "doc_id")


@query(
    """WITH c AS (SELECT source, n_chars, count(*) AS c FROM documents GROUP BY ALL)
SELECT source, list(n_chars ORDER BY n_chars)[count(*) // 2 + 1] AS upper_median FROM documents GROUP BY source"""
)
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    return E.upper_medians(documents(spark, sf_dir), ["source"], "n_chars")


@query(
    """SELECT lang, floor(quantile_cont(n_chars, 0.5))::INTEGER AS p50, floor(quantile_cont(n_chars, 0.9))::INTEGER AS p90,
  floor(quantile_cont(n_chars, 0.95))::INTEGER AS p95, floor(quantile_cont(n_chars, 0.99))::INTEGER AS p99, max(n_chars)::INTEGER AS p100 FROM documents GROUP BY lang"""
)
def percentiles_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear percentiles, cut to whole numbers."""
    p = F.percentile("n_chars", F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99, 1.0)])).alias("p")
    out = documents(spark, sf_dir).groupBy("lang").agg(p)
    return out.select("lang", *[F.col("p")[i].cast("int").alias(f"p{x}") for i, x in enumerate((50, 90, 95, 99, 100))])


TRAIN = "doc_id % 5 < 3"


@query(f"SELECT doc_id, source FROM documents t WHERE NOT ({TRAIN}) AND EXISTS (SELECT 1 FROM documents s WHERE s.doc_id % 5 < 3 AND s.text = t.text)")
def leak_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test texts that training also has."""
    d = documents(spark, sf_dir)
    return D.leaked(d.where(f"NOT ({TRAIN})"), d.where(TRAIN), "text").select("doc_id", "source")


@query(f"SELECT doc_id, source FROM documents t WHERE NOT ({TRAIN}) AND NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id % 5 < 3 AND s.text = t.text)")
def leak_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return D.clean(d.where(f"NOT ({TRAIN})"), d.where(TRAIN), "text").select("doc_id", "source")


@query(
    """SELECT doc_id, 'new' AS version, n_chars + 1 AS n_chars FROM documents WHERE source = 'src1'
UNION ALL SELECT doc_id, 'old', n_chars FROM documents WHERE source <> 'src1'"""
)
def upsert_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: rows of one source come anew and replace those that are there."""
    d = documents(spark, sf_dir).where("source IS NOT NULL")
    old = d.select("doc_id", F.lit("old").alias("version"), "n_chars")
    new = d.where("source = 'src1'").select("doc_id", F.lit("new").alias("version"), (F.col("n_chars") + 1).alias("n_chars"))
    return D.upsert(old, new, "doc_id")


@query(
    """WITH k AS (SELECT doc_id, 1 AS d, 0 AS l, 0 AS p FROM documents UNION ALL SELECT doc_id, 0, 1, 0 FROM labels UNION ALL SELECT page_id, 0, 0, 1 FROM pages)
SELECT doc_id, CASE WHEN max(d) = 1 THEN 'O' ELSE 'X' END AS documents, CASE WHEN max(l) = 1 THEN 'O' ELSE 'X' END AS labels,
  CASE WHEN max(p) = 1 THEN 'O' ELSE 'X' END AS pages FROM k GROUP BY doc_id"""
)
def asset_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables know an id."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    return D.presence({"documents": documents(spark, sf_dir), "labels": table(spark, sf_dir, "labels"), "pages": pages}, "doc_id")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label registers."""
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "source")


@query(
    """WITH a AS (SELECT source AS key, count(*) AS left FROM documents WHERE lang = 'en' GROUP BY 1), b AS (SELECT source AS key, count(*) AS right FROM documents WHERE lang = 'de' GROUP BY 1)
SELECT key, a.left, b.right FROM a FULL JOIN b USING (key) WHERE a.left IS DISTINCT FROM b.right"""
)
def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings, here documents by source, that differ between two sides."""
    side = lambda lang: documents(spark, sf_dir).where(F.col("lang") == lang).groupBy(F.col("source").alias("key")).agg(F.count("*").alias("value"))
    return D.config_diff(side("en"), side("de"))


@query(
    """SELECT doc_id, CASE WHEN source = 'src0' THEN 'generalization' WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents"""
)
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML5: one domain is kept for generalization, marked rows for the test."""
    s = F.when(F.col("source") == "src0", "generalization").when(F.col("doc_id") % 5 == 0, "test").otherwise("train")
    return documents(spark, sf_dir).select("doc_id", s.alias("split"))


@query(
    """WITH s AS (SELECT text, CASE WHEN source = 'src0' THEN 'generalization' WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents)
SELECT sha256(text) AS text_sha, count(DISTINCT split) AS splits, string_agg(DISTINCT split, ',' ORDER BY split) AS names FROM s GROUP BY text HAVING count(DISTINCT split) > 1"""
)
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that more than one split has."""
    s = documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("text_sha")).join(split_assign(spark, sf_dir), "doc_id")
    names = s.groupBy("text_sha").agg(F.array_sort(F.collect_set("split")).alias("n")).where(F.size("n") > 1)
    return names.select("text_sha", F.size("n").cast("long").alias("splits"), F.array_join("n", ",").alias("names"))


@query("""SELECT doc_id, sha256(concat_ws(chr(0), source, lang, text)) AS fingerprint, substring(sha256(text), 1, 16) AS key FROM documents""")
def doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes as cache keys."""
    return documents(spark, sf_dir).select(
        "doc_id", F.sha2(F.concat_ws("\0", "source", "lang", "text"), 256).alias("fingerprint"), F.substring(F.sha2("text", 256), 1, 16).alias("key")
    )


@query(
    """WITH f AS (
  SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS field,
    unnest([doc_id::VARCHAR, nullif(text, ''), nullif(lang, ''), nullif(source, ''), n_chars::VARCHAR]) AS v FROM documents)
SELECT field, count(v)::BIGINT AS filled, (count(*) - count(v))::BIGINT AS missing, count(DISTINCT v)::BIGINT AS kinds FROM f GROUP BY field"""
)
def field_fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    return D.fill_rates(documents(spark, sf_dir))


@query(
    """SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping(source)::INTEGER AS all_sources, grouping(lang)::INTEGER AS all_langs
FROM documents GROUP BY ROLLUP (source, lang)"""
)
def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with subtotals and a total row, as reports append them."""
    return documents(spark, sf_dir).rollup("source", "lang").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping("source").cast("int").alias("all_sources"), F.grouping("lang").cast("int").alias("all_langs")
    )


@query(
    rf"""WITH {SENTS}, x AS (SELECT doc_id, unnest(s) AS t FROM sents),
q AS (SELECT doc_id, avg(regexp_matches(t, '[.!?]$')::INTEGER) AS r, count(*) AS n FROM x GROUP BY doc_id)
SELECT source, round(avg(r), 6) AS ratio, sum(n)::BIGINT AS sents FROM q JOIN documents USING (doc_id) GROUP BY source"""
)
def sentence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of sentences that end as sentences do."""
    s = S.sentence_arrays(documents(spark, sf_dir).withColumn("k", F.struct("doc_id", "source")), "k").where(F.size("sents") > 0)
    good = F.size(F.filter("sents", lambda t: t.rlike(r"[.!?]$"))) / F.size("sents")
    return s.groupBy("k.source").agg(F.round(F.avg(good), 6).alias("ratio"), F.sum(F.size("sents")).alias("sents"))


HEADED = r"(regexp_matches(x, '^(?:\d+(?:\.\d+)*|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+|[가-힣])[.)]\s*\S') AND length(x) <= 60 AND NOT ends_with(x, '다.'))"


@query(
    rf"""WITH t AS (SELECT doc_id, 0 AS mode, text FROM documents UNION ALL SELECT doc_id, 1, replace(text, E'\n', ' ') FROM documents UNION ALL SELECT doc_id, 2, substr(text, 1, n_chars // 2) FROM documents),
s AS (SELECT doc_id, mode, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '' AND NOT {HEADED}) AS s FROM t),
r AS (SELECT doc_id, mode, len(s) AS n, CASE WHEN len(s) > 0 THEN round(len(list_filter(s, lambda x: regexp_matches(x, '[.!?]$'))) / len(s), 9) ELSE 0.0 END AS ratio FROM s)
SELECT doc_id, mode::INTEGER AS mode, ratio, n::INTEGER AS sents FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ratio DESC, mode) = 1"""
)
def extraction_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three readings of a document (as it is, on one line, its first half) the one whose sentences are most often whole."""
    d = documents(spark, sf_dir)
    texts = [F.col("text"), F.replace("text", F.lit("\n"), F.lit(" ")), F.substr("text", F.lit(1), F.floor(F.col("n_chars") / 2).cast("int"))]
    modes = d.select("doc_id", F.posexplode(F.array(*texts)).alias("mode", "text"))
    arrays = S.sentence_arrays(modes.withColumn("k", F.struct("doc_id", "mode")), "k").select("k.doc_id", "k.mode", "sents")
    return D.best_mode(arrays, "doc_id", r"[.!?]$")


@query(
    rf"""WITH {SENTS}, j AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'x' || doc_id % 40 WHEN 1 THEN '-' ELSE printf('s%03d', doc_id % 7 + 1) END AS ref FROM labels),
k AS (SELECT j.doc_id, ref, s, try_cast(nullif(regexp_extract(ref, '^s(\d+)$', 1), '') AS INTEGER) AS n, b.text, 'item ' || b.item_id AS note
  FROM j LEFT JOIN sents USING (doc_id) LEFT JOIN benchmark b ON 'x' || b.item_id = ref)
SELECT doc_id, ref, CASE WHEN n BETWEEN 1 AND len(s) THEN s[n] ELSE coalesce(text, '') END AS core,
  CASE WHEN n BETWEEN 1 AND len(s) THEN array_to_string(s[greatest(n - 1, 1):n + 1], ' ') ELSE coalesce(note, '') END AS context,
  CASE WHEN n BETWEEN 1 AND len(s) THEN ref WHEN text IS NOT NULL THEN 'extra' ELSE '' END AS place FROM k"""
)
def judgment_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged documents with the sentence that the judgment names, its neighbours, or the extra text of that name (here of `benchmark`)."""
    id = F.col("doc_id")
    ref = F.when(id % 5 == 0, F.concat(F.lit("x"), (id % 40).cast("string"))).when(id % 5 == 1, "-").otherwise(F.format_string("s%03d", id % 7 + 1))
    j = table(spark, sf_dir, "labels").select("doc_id", ref.alias("ref"))
    named = F.concat(F.lit("x"), F.col("item_id").cast("string"))
    extra = table(spark, sf_dir, "benchmark").select(named.alias("ref"), "text", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("note"))
    extra = j.select("doc_id", "ref").distinct().join(extra, "ref").withColumnRenamed("ref", "name")
    return D.judgment_context(j, S.sentence_arrays(documents(spark, sf_dir)), extra, "doc_id")


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, least(len(w), 64) + 3 + least(greatest(len(w) - 64, 0), 64) + (CASE WHEN len(w) > 64 THEN 1 ELSE 0 END) AS n FROM w)
SELECT doc_id, least(n, 100)::INTEGER AS n_tokens, n > 100 AS over FROM t"""
)
def judge_input_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR17, A21: the first 64 tokens as claim, no context, the rest as one candidate, against a budget of 100."""
    w = documents(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("w"))
    claim = F.array_join(F.slice("w", 1, 64), " ")
    rest = F.array_join(F.slice("w", 65, F.greatest(F.size("w") - 64, F.lit(0))), " ")
    empty = F.array().cast("array<string>")
    ids = lambda most: F.size(D.judge_input(claim, F.lit(""), empty, F.array(rest), most=most))
    return w.select("doc_id", ids(100).alias("n_tokens"), (ids(510) > 100).alias("over"))


@query(
    """SELECT doc_id, source, (dense_rank() OVER (ORDER BY source) - 1)::INTEGER % 5 AS fold FROM documents"""
)
def group_cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML3: folds by source, so that no source is split; the table of sources is small and numbered on its own."""
    d = documents(spark, sf_dir)
    folds = d.select("source").distinct().withColumn("fold", (F.dense_rank().over(Window.orderBy("source")) - 1) % 5)
    return d.select("doc_id", "source").join(folds, "source")
