"""Retrieval within conversations and vector labels: scoring, ranking, fusion, evaluation.

Scopes are conversations: user turns are the claims, assistant turns the
passages; the turn that follows a claim is its gold passage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.operators import dataset as D
from plinth.operators import evaluate as E
from plinth.operators import evidence as V
from plinth.operators import retrieve as R
from plinth.plans.registry import query, table

DEPTH = 20


def claims_of(conversations: DataFrame) -> DataFrame:
    return _turns(conversations, "user").select("conv_id", F.col("id").alias("claim_id"), "turn", F.col("t").alias("claim_text"))


def passages_of(conversations: DataFrame) -> DataFrame:
    return _turns(conversations, "assistant").select("conv_id", F.col("id").alias("passage_id"), F.col("turn").alias("ord"), F.col("t").alias("text"))


def _turns(conversations: DataFrame, role: str) -> DataFrame:
    c = conversations.where(F.col("role") == role)
    return c.select("conv_id", "turn", F.format_string("c%d_t%d", "conv_id", "turn").alias("id"), T.squeeze(F.col("text")).alias("t"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations")
    return claims_of(c), passages_of(c)


def sparse_run(spark: SparkSession, sf_dir: str, depth: int = DEPTH) -> DataFrame:
    claims, passages = sides(spark, sf_dir)
    return R.ranked(R.bm25(claims, passages, "conv_id", depth), depth)


def bigram_run(spark: SparkSession, sf_dir: str, depth: int = DEPTH) -> DataFrame:
    claims, passages = sides(spark, sf_dir)
    return R.ranked(R.bigram_overlap(claims, passages, "conv_id"), depth)


def both_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, passage_id, sparse, bigram: ranks of both retrievers, found in one pass."""
    return R.both_ranks(*sides(spark, sf_dir), "conv_id", DEPTH)


def hybrid_run(spark: SparkSession, sf_dir: str, a: float = 0.5, b: float = 0.5) -> DataFrame:
    """claim_id, passage_id, score, rank of the fusion of both."""
    return R.fused_ranks(both_runs(spark, sf_dir), a, b).select("claim_id", "passage_id", "score", "rank")


def gold_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, passage_id: the assistant turn right after a claim."""
    claims, passages = sides(spark, sf_dir)
    p = passages.select("conv_id", (F.col("ord") - 1).alias("turn"), "passage_id")
    return claims.join(p, ["conv_id", "turn"]).select("claim_id", "passage_id")


TURN = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
CONV = rf"""
claims AS (SELECT conv_id, 'c' || conv_id || '_t' || turn AS claim_id, turn, {TURN} AS claim_text FROM conversations WHERE role = 'user'),
passages AS (SELECT conv_id, 'c' || conv_id || '_t' || turn AS passage_id, turn AS ord, {TURN} AS text FROM conversations WHERE role = 'assistant'),
ptok AS (SELECT conv_id, passage_id, ord, list_filter(string_split(text, ' '), lambda x: x <> '') AS t FROM passages),
post AS (SELECT conv_id, passage_id, dl, term, count(*) AS f FROM (SELECT conv_id, passage_id, len(t) AS dl, unnest(t) AS term FROM ptok) GROUP BY ALL),
sizes AS (SELECT conv_id, count(*) AS n, avg(len(t)) AS avgdl FROM ptok GROUP BY conv_id),
terms AS (SELECT conv_id, term, count(*) AS df FROM post GROUP BY ALL),
asked AS (SELECT conv_id, claim_id, term, count(*) AS qf FROM (
  SELECT conv_id, claim_id, unnest(list_filter(string_split(claim_text, ' '), lambda x: x <> '')) AS term FROM claims) GROUP BY ALL),
sums AS (
  SELECT conv_id, claim_id, passage_id,
    sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS s
  FROM asked JOIN post USING (conv_id, term) JOIN terms USING (conv_id, term) JOIN sizes USING (conv_id) GROUP BY ALL),
sparse_scores AS (
  SELECT c.conv_id, c.claim_id, p.passage_id, p.ord, round(coalesce(s, 0.0), 9) AS x
  FROM claims c JOIN passages p USING (conv_id) LEFT JOIN sums USING (conv_id, claim_id, passage_id)),
sparse AS (
  SELECT claim_id, passage_id, ord, round(x, 6) AS score,
    (row_number() OVER (PARTITION BY claim_id ORDER BY x DESC, ord, passage_id))::INTEGER AS rank FROM sparse_scores QUALIFY rank <= 20),
cb AS (SELECT *, replace(claim_text, ' ', '') AS u FROM claims),
pb AS (SELECT *, replace(text, ' ', '') AS u FROM passages),
cbi AS (SELECT conv_id, claim_id, list_distinct(list_transform(range(1, length(u)), lambda i: substring(u, i, 2))) AS want FROM cb),
pbi AS (SELECT conv_id, passage_id, ord, list_distinct(list_transform(range(1, length(u)), lambda i: substring(u, i, 2))) AS have FROM pb),
bi_scores AS (
  SELECT conv_id, claim_id, passage_id, ord,
    CASE WHEN len(want) > 0 THEN round(len(list_intersect(want, have)) / len(want), 9) ELSE 0.0 END AS x
  FROM cbi JOIN pbi USING (conv_id)),
bi AS (
  SELECT claim_id, passage_id, ord, round(x, 6) AS score,
    (row_number() OVER (PARTITION BY claim_id ORDER BY x DESC, ord, passage_id))::INTEGER AS rank FROM bi_scores QUALIFY rank <= 20),
gold AS (
  SELECT c.claim_id, p.passage_id FROM claims c JOIN passages p ON c.conv_id = p.conv_id AND p.ord = c.turn + 1)
"""


def _fused_cte(name: str, a: float, b: float) -> str:
    return f"""
{name}_s AS (
  SELECT claim_id, passage_id, round(sum(w / (60 + rank)), 12) AS x, min(run * 1000 + rank) AS first
  FROM (SELECT claim_id, passage_id, rank, 0 AS run, {a}::DOUBLE AS w FROM sparse UNION ALL
        SELECT claim_id, passage_id, rank, 1 AS run, {b}::DOUBLE AS w FROM bi) GROUP BY ALL),
{name} AS (
  SELECT claim_id, passage_id, round(x, 9) AS score,
    (row_number() OVER (PARTITION BY claim_id ORDER BY x DESC, first))::INTEGER AS rank FROM {name}_s)"""


@query(f"WITH {CONV} SELECT claim_id, passage_id, ord, score, rank FROM sparse WHERE rank <= 5")
def bm25_conv_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best passages of each claim."""
    return sparse_run(spark, sf_dir, 5)


DOC_TOKENS = r"""
tok AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS t FROM documents)
"""


@query(
    f"""WITH {DOC_TOKENS}, df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY term),
n AS (SELECT count(*) AS n FROM documents)
SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, n"""
)
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A2 over all documents as one scope."""
    docs = table(spark, sf_dir, "documents")
    terms = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    n = docs.agg(F.count("*").alias("n"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    # one row
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(
    f"""WITH {DOC_TOKENS}, a AS (SELECT avg(len(t)) AS avgdl FROM tok)
SELECT doc_id, len(t)::INTEGER AS dl, round(len(t) / avgdl, 6) AS ratio FROM tok, a"""
)
def bm25_doclen(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("dl"))
    mean = docs.agg(F.avg("dl").alias("avgdl"))
    return docs.crossJoin(F.broadcast(mean)).select("doc_id", "dl", F.round(F.col("dl") / F.col("avgdl"), 6).alias("ratio"))


@query(
    """WITH s AS (
  SELECT q.vec_id AS claim, p.vec_id AS passage,
    round(list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9) AS x
  FROM embeddings q JOIN embeddings p ON q.label = p.label AND q.vec_id <> p.vec_id WHERE q.vec_id % 20 = 0)
SELECT 'q' || claim AS claim_id, 'v' || passage AS passage_id, passage AS ord, round(x, 6) AS score,
  (row_number() OVER (PARTITION BY claim ORDER BY x DESC, passage))::INTEGER AS rank FROM s QUALIFY rank <= 5"""
)
def dense_label_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 20, each against all others of its label."""
    e = table(spark, sf_dir, "embeddings")
    place, vec = F.col("vec_id").alias("ord"), F.col("embedding").alias("vec")
    claims = e.where("vec_id % 20 = 0").select("label", F.format_string("q%d", "vec_id").alias("claim_id"), place, vec)
    passages = e.select("label", F.format_string("v%d", "vec_id").alias("passage_id"), place, vec)
    return R.nearest(claims, passages, "label", 5)


def _rrf(name: str, a: float, b: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return hybrid_run(spark, sf_dir, a, b)

    run.__name__ = name
    run.__doc__ = f"A5, O3: reciprocal rank fusion of two retrievers, weights {a} and {b}."
    query(f"WITH {CONV}, {_fused_cte('fused', a, b)} SELECT * FROM fused")(run)


_rrf("rrf_equal", 0.5, 0.5)
_rrf("rrf_sparse_heavy", 0.7, 0.3)
_rrf("rrf_dense_heavy", 0.3, 0.7)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, claim_id, passage_id, rank of both retrievers and their even fusion."""
    every = R.fused_ranks(both_runs(spark, sf_dir), 0.5, 0.5)
    names = {"bm25": "sparse", "bigram": "bigram", "hybrid": "rank"}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("rank")) for m, c in names.items()])).alias("r")
    return every.select("claim_id", "passage_id", each).select("r.method", "claim_id", "passage_id", "r.rank").where("rank IS NOT NULL")


EVAL = f"""{CONV}, {_fused_cte('fused', 0.5, 0.5)},
runs AS (
  SELECT 'bm25' AS method, claim_id, passage_id, rank FROM sparse UNION ALL SELECT 'bigram', claim_id, passage_id, rank FROM bi
  UNION ALL SELECT 'hybrid', claim_id, passage_id, rank FROM fused),
firsts AS (
  SELECT a.method, a.claim_id, f.first FROM (SELECT DISTINCT method, claim_id FROM runs SEMI JOIN gold USING (claim_id)) a
  LEFT JOIN (SELECT method, claim_id, min(rank) AS first FROM runs JOIN gold USING (claim_id, passage_id) GROUP BY ALL) f USING (method, claim_id))"""
MEASURES = ", ".join(
    [f"round(avg(CASE WHEN first <= {c} THEN 1 ELSE 0 END), 6) AS recall_{c}" for c in E.CUTOFFS]
    + ["round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr"]
)


@query(f"WITH {EVAL} SELECT method, count(*) AS n, {MEASURES} FROM firsts GROUP BY method")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, J5, W6."""
    return E.recall_and_mrr(E.first_ranks(gold_of(spark, sf_dir), runs(spark, sf_dir), ["method"]), ["method"])


@query(
    f"""WITH {EVAL} SELECT method, CASE WHEN length(claim_text) < 10 THEN 'short' WHEN length(claim_text) < 30 THEN 'middle' ELSE 'long' END AS bucket,
  count(*) AS n, {MEASURES} FROM firsts JOIN claims USING (claim_id) GROUP BY ALL"""
)
def recall_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    firsts = E.first_ranks(gold_of(spark, sf_dir), runs(spark, sf_dir), ["method"])
    claims = sides(spark, sf_dir)[0].select("claim_id", E.length_bucket(F.length("claim_text")).alias("bucket"))
    return E.recall_and_mrr(firsts.join(claims, "claim_id"), ["method", "bucket"])


@query(
    f"""WITH {EVAL}, h AS (
  SELECT claim_id, bool_or(method = 'bm25' AND coalesce(first <= 1, false)) AS a, bool_or(method = 'bigram' AND coalesce(first <= 1, false)) AS b
  FROM firsts GROUP BY claim_id)
SELECT count(*) FILTER (a AND NOT b) AS only_sparse, count(*) FILTER (b AND NOT a) AS only_bigram, count(*) FILTER (a AND b) AS both_hit,
  count(*) FILTER (NOT a AND NOT b) AS neither FROM h"""
)
def hit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which claims either retriever puts first."""
    firsts = E.first_ranks(gold_of(spark, sf_dir), runs(spark, sf_dir), ["method"])
    hit = lambda m: F.max((F.col("method") == m) & F.coalesce(F.col("first") <= 1, F.lit(False)))
    h = firsts.groupBy("claim_id").agg(hit("bm25").alias("a"), hit("bigram").alias("b"))
    a, b = F.col("a"), F.col("b")
    return h.agg(
        F.count_if(a & ~b).alias("only_sparse"), F.count_if(b & ~a).alias("only_bigram"), F.count_if(a & b).alias("both_hit"), F.count_if(~a & ~b).alias("neither")
    )


@query(
    f"""WITH {EVAL}, r AS (SELECT method, count(*) AS n, {MEASURES} FROM firsts GROUP BY method)
SELECT method, recall_5, mrr, recall_5 = max(recall_5) OVER () AS best_recall, mrr = max(mrr) OVER () AS best_mrr FROM r"""
)
def best_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the best methods of each measure, all of equals."""
    r = recall_mrr(spark, sf_dir)
    best = r.agg(F.max("recall_5").alias("r"), F.max("mrr").alias("m"))
    return r.crossJoin(F.broadcast(best)).select(  # one row
        "method", "recall_5", "mrr", (F.col("recall_5") == F.col("r")).alias("best_recall"), (F.col("mrr") == F.col("m")).alias("best_mrr")
    )


@query(
    f"""WITH {CONV}, {_fused_cte('fused', 0.5, 0.5)}
SELECT f.claim_id, to_json(list(json_object('rank', f.rank, 'passage_id', f.passage_id, 'text', p.text) ORDER BY f.rank))::VARCHAR AS candidates
FROM fused f JOIN passages p USING (passage_id) WHERE f.rank <= 5 GROUP BY f.claim_id"""
)
def candidates_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their texts, nested in order of rank, written as JSON."""
    run = hybrid_run(spark, sf_dir)
    n = D.nested_candidates(run, sides(spark, sf_dir)[1])
    slim = F.transform("candidates", lambda c: F.struct(c["rank"].alias("rank"), c["passage_id"].alias("passage_id"), c["text"].alias("text")))
    return n.select("claim_id", F.to_json(slim).alias("candidates"))


@query(
    f"""WITH {CONV}, {_fused_cte('fused', 0.5, 0.5)},
top AS (SELECT f.claim_id, p.text, f.score FROM fused f JOIN passages p USING (passage_id) WHERE f.rank = 1)
SELECT claim_id, CASE WHEN score >= 0.016 THEN '근거 있음' ELSE '무근거' END AS verdict,
  CASE WHEN score >= 0.016 THEN text ELSE '-' END AS evidence FROM top"""
)
def online_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML8: the best passage is shown with verdicts that need one; a stand-in threshold serves as judge."""
    run = hybrid_run(spark, sf_dir).where("rank = 1")
    top = run.join(sides(spark, sf_dir)[1], "passage_id")
    yes = F.col("score") >= 0.016
    return top.select("claim_id", F.when(yes, "근거 있음").otherwise("무근거").alias("verdict"), F.when(yes, F.col("text")).otherwise("-").alias("evidence"))


@query(
    f"""WITH {CONV}, p AS (
  SELECT c.claim_id AS id, b.passage_id AS span_id, c.want, b.have FROM cbi c JOIN pbi b USING (conv_id) WHERE len(c.want) >= 8),
s AS (SELECT id, span_id, round(len(list_intersect(want, have)) / len(want), 9) AS share FROM p)
SELECT id, span_id, share FROM (SELECT *, max(share) OVER (PARTITION BY id) AS best FROM s WHERE share >= 0.55) WHERE share >= round(best - 0.05, 9)"""
)
def evidence_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, STR5: passages of the conversation that hold most of a claim's bigrams, near the best."""
    claims, passages = sides(spark, sf_dir)
    e = claims.select("conv_id", F.col("claim_id").alias("id"), F.col("claim_text").alias("evidence"))
    return V.overlap_spans(e, passages.select("conv_id", F.col("passage_id").alias("span_id"), "text"), "conv_id")


@query()
def evidence_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 in all stages, STR6: claims looked for in the sentences of the next turn."""
    claims, passages = sides(spark, sf_dir)
    pairs = gold_of(spark, sf_dir).select(F.col("claim_id").alias("item_id"), "passage_id")
    evidence = claims.select(F.col("claim_id").alias("item_id"), F.col("claim_text").alias("evidence"))
    from plinth.operators.segment import sentence_arrays

    return V.find(pairs, evidence, sentence_arrays(passages, "passage_id"), "passage_id", floor=0.3)


@query(
    """WITH t AS (SELECT conv_id, turn, role, text,
  lag(text) OVER w AS before, lead(text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, concat_ws(' / ', before, text, after) AS context FROM t WHERE role = 'user'"""
)
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim between its neighbours."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumn("b", F.lag("text").over(w)).withColumn("a", F.lead("text").over(w))
    return t.where("role = 'user'").select("conv_id", "turn", F.concat_ws(" / ", "b", "text", "a").alias("context"))


@query(
    r"""WITH l AS (
  SELECT conv_id, turn, unnest(range(1, len(x) + 1)) AS ord, unnest(x) AS claim FROM (
    SELECT conv_id, turn, list_filter(list_transform(string_split(text, E'\n'), lambda y: trim(y)), lambda y: y <> '') AS x FROM conversations))
SELECT conv_id AS deck, turn::INTEGER AS slide, ord::INTEGER AS ord, claim,
  printf('%d_s%02d_c%02d', conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ord)) AS claim_id FROM l"""
)
def claim_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of turns as claims, numbered within their turn."""
    c = table(spark, sf_dir, "conversations")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    c = c.select(F.col("conv_id").alias("deck"), F.col("turn").cast("int").alias("slide"), F.posexplode(lines).alias("p", "claim"))
    return D.numbered_claims(c.select("deck", "slide", (F.col("p") + 1).alias("ord"), "claim"))


@query(
    r"""SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS query_text,
  length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))::INTEGER AS n_chars FROM conversations"""
)
def query_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.squeeze(F.col("text")).alias("query_text"))
    return c.withColumn("n_chars", F.length("query_text"))


@query(
    f"""WITH {CONV}, r AS (SELECT conv_id, passage_id AS run_id, row_number() OVER (PARTITION BY conv_id ORDER BY ord) AS k FROM passages),
c AS (SELECT conv_id, claim_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM claims),
same AS (SELECT conv_id FROM (SELECT conv_id, count(*) AS a FROM c GROUP BY 1) JOIN (SELECT conv_id, count(*) AS b FROM r GROUP BY 1) USING (conv_id) WHERE a = b)
SELECT c.conv_id AS deck, c.claim_id, c.k::INTEGER AS ord, r.run_id, CASE WHEN r.run_id IS NULL THEN 'none' ELSE 'place' END AS how
FROM c LEFT JOIN (SELECT * FROM r SEMI JOIN same USING (conv_id)) r USING (conv_id, k)"""
)
def candidate_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs found for claims by id, by suffix or by place where counts agree."""
    claims, passages = sides(spark, sf_dir)
    k = lambda o: F.row_number().over(Window.partitionBy("conv_id").orderBy(o))
    c = claims.select(F.col("conv_id").alias("deck"), "claim_id", k("turn").alias("ord"))
    r = passages.select(F.col("conv_id").alias("deck"), F.col("passage_id").alias("claim_id"), k("ord").alias("ord"))
    return D.with_candidates(c, r)


VERDICTS = """
verdicts AS (
  SELECT conv_id * 1000 + turn AS ord, CASE WHEN turn % 3 = 0 THEN '' ELSE 'lost-' END || claim_id AS verdict_id,
    CASE (conv_id + turn) % 4 WHEN 0 THEN claim_text WHEN 1 THEN replace(claim_text, ' ', '  ') WHEN 2 THEN replace(claim_text, ' ', '') ELSE 'not ' || claim_text END AS claim_text
  FROM claims UNION ALL
  SELECT conv_id * 1000 + turn + 500, 'again-' || claim_id, claim_text FROM claims WHERE conv_id % 2 = 0)"""


@query(
    f"""WITH {CONV}, {VERDICTS},
t AS (SELECT claim_text AS t, arg_min(claim_id, conv_id * 1000 + turn) AS g FROM claims GROUP BY 1),
n AS (SELECT replace(claim_text, ' ', '') AS t, arg_min(claim_id, conv_id * 1000 + turn) AS g FROM claims GROUP BY 1),
m AS (
  SELECT v.ord, v.verdict_id, c.claim_id AS by_id, t.g AS by_text, n.g AS by_ns FROM verdicts v LEFT JOIN claims c ON c.claim_id = v.verdict_id
  LEFT JOIN t ON t.t = trim(regexp_replace(v.claim_text, '\\s+', ' ', 'g')) LEFT JOIN n ON n.t = replace(v.claim_text, ' ', '')),
k AS (SELECT *, coalesce(by_id, by_text, by_ns) AS g, row_number() OVER (PARTITION BY coalesce(by_id, by_text, by_ns) ORDER BY ord, verdict_id) AS k FROM m)
SELECT verdict_id, CASE WHEN by_id IS NOT NULL THEN 'claim_id' WHEN g IS NULL OR k > 1 THEN 'none' WHEN by_text IS NOT NULL THEN 'claim_text' ELSE 'nospace' END AS how,
  CASE WHEN by_id IS NOT NULL OR k = 1 THEN g END AS gold_id FROM k"""
)
def verdict_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13, STR20: verdicts find their claim by id, else by its text, else by its text without spaces; by text each claim is found once.

    The verdicts are the claims of the conversations: two in three have lost their id, and some their spacing or wording.
    """
    claims = sides(spark, sf_dir)[0].withColumn("ord", F.col("conv_id") * 1000 + F.col("turn"))
    text = F.col("claim_text")
    kind = F.expr("(conv_id + turn) % 4")
    said = (
        F.when(kind == 0, text)
        .when(kind == 1, F.replace(text, F.lit(" "), F.lit("  ")))
        .when(kind == 2, F.replace(text, F.lit(" "), F.lit("")))
        .otherwise(F.concat(F.lit("not "), text))
    )
    lost = F.when(F.col("turn") % 3 == 0, "").otherwise("lost-")
    first = claims.select("ord", F.concat(lost, "claim_id").alias("verdict_id"), said.alias("claim_text"))
    again = claims.where("conv_id % 2 = 0").select(F.col("ord") + 500, F.concat(F.lit("again-"), "claim_id"), "claim_text")
    return D.match_verdicts(first.union(again), claims.select("ord", "claim_id", "claim_text"))


@query(
    """WITH s AS (SELECT q.vec_id, p.vec_id AS c, round(list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9) AS x
  FROM embeddings q JOIN embeddings p ON q.label = p.label AND q.vec_id <> p.vec_id WHERE q.vec_id % 20 = 0),
t AS (SELECT vec_id, round(x, 6) AS x, row_number() OVER (PARTITION BY vec_id ORDER BY s.x DESC, c) AS k FROM s QUALIFY k <= 5)
SELECT t.vec_id, 261::INTEGER AS dim, round(max(x), 6) AS s_max, round(avg(x), 6) AS s_mean, round(stddev_pop(x), 6) AS s_std, round(min(x), 6) AS s_min,
  round(count(*) / 5.0, 6)::DOUBLE AS s_n FROM t GROUP BY t.vec_id"""
)
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: four blocks and five score statistics of each query vector and its candidates."""
    e = table(spark, sf_dir, "embeddings")
    top = dense_label_top5(spark, sf_dir).select(
        F.substr("claim_id", F.lit(2)).cast("long").alias("vec_id"), F.col("ord").alias("c"), "rank", F.col("score")
    )
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    cand = top.join(e.select(F.col("vec_id").alias("c"), doubles.alias("v")), "c")
    cand = cand.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("rank", "v", "score"))).alias("k"))
    q = e.where("vec_id % 20 = 0").select("vec_id", doubles.alias("v")).join(cand, "vec_id")
    f = D.feature_vector(F.col("v"), F.transform("k", lambda x: x["v"]), F.transform("k", lambda x: x["score"]))
    q = q.select("vec_id", f.alias("f"))
    at = lambda i, name: F.round(F.element_at("f", i), 6).alias(name)
    return q.select("vec_id", F.size("f").alias("dim"), at(-5, "s_max"), at(-4, "s_mean"), at(-3, "s_std"), at(-2, "s_min"), at(-1, "s_n"))
