"""Where quoted evidence stands: groups of sentences, spans, similarity.

The search loosens in stages (exact, without white space, similar); each stage
sees only what the one before has not found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.functions.udfs import similarity


#: Bytes of the runs by which evidence is looked for without white space.
GRAM = 16
#: Hashes of evidence that are sent to the tasks, eight bytes each.
MOST = 4_000_000


def sentence_groups(sents: DataFrame, key: str, most: int = 3) -> DataFrame:
    """key, n, first, text: runs of 1 to ``most`` sentences, from arrays (key, sents)."""

    def runs(n: int) -> Column:
        starts = F.when(F.size("sents") >= n, F.sequence(F.lit(1), F.size("sents") - n + 1)).otherwise(F.array().cast("array<int>"))
        one = lambda i: F.struct(F.lit(n).alias("n"), i.alias("first"), F.array_join(F.slice("sents", i, n), " ").alias("text"))
        return F.transform(starts, one)

    every = F.concat(*[runs(n) for n in range(1, most + 1)])
    return sents.select(key, F.explode(every).alias("g")).select(key, "g.n", "g.first", "g.text")


def inner_words(evidence: Column) -> Column:
    """Words that are neither the first nor the last: where the evidence stands, they stand whole."""
    words = T.tokens(evidence)
    return F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))


def candidates(evidence: DataFrame, sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(item_id, key) that may hold together: by the inner word of the evidence that fewest documents have or, where it has none, by its characters.

    sents: key, sents; words are those of the sentences, as groups have them.  A
    necessary condition for literal containment, found by an equi-join; without
    it every item would have to be compared with every document.
    """
    e = evidence.select("item_id", "evidence", inner_words(T.squeeze(F.col("evidence"))).alias("inner"))
    words = e.select("item_id", F.explode("inner").alias("word"))
    d = sents.select(key, F.explode(F.array_distinct(T.tokens(F.array_join("sents", " ")))).alias("word"))
    often = d.join(words.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    # a word that no document has is the rarest
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")
    rarest = words.join(often, "word", "left").groupBy("item_id").agg(F.min(rank)["word"].alias("word"))
    found = d.join(rarest, "word").select("item_id", key)
    return found.unionByName(unspaced_candidates(e.where(F.size("inner") == 0), sents, key)).distinct()


def unspaced_candidates(evidence: DataFrame, sents: DataFrame, key: str = "doc_id", most: int = MOST) -> DataFrame:
    """(item_id, key) that may hold together whatever the white space: documents that have the rarest run of GRAM
    bytes of the evidence, or all of it if it is shorter; both without white space.

    Runs are told by hashes, so that a few more pairs may come out.  Up to
    ``most`` hashes of evidence are sent to the tasks, which leave out all other
    runs of documents before they become rows; more are joined without that.
    """
    e = evidence.select("item_id", T.unspaced(F.col("evidence")).alias("t")).where("t <> ''")
    sizes = sorted(r["size"] for r in e.select(F.least(F.octet_length("t"), F.lit(GRAM)).alias("size")).distinct().collect())  # at most GRAM
    if not sizes:
        none = F.lit(None).cast(evidence.schema["item_id"].dataType)
        return sents.select(none.alias("item_id"), key).where(F.lit(False))
    grams = _run_hashes(e, "item_id", [GRAM], None, whole=True)
    d = sents.select(key, T.unspaced(F.array_join("sents", "")).alias("t"))
    few = lambda rows: _few(rows, most)
    often = _run_hashes(d, key, sizes, few(grams)).join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a run that no document has is the rarest
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")
    rarest = grams.join(often, "gram", "left").groupBy("item_id").agg(F.min(rank).alias("r")).select("item_id", "r.n", "r.gram").where("n > 0").drop("n")
    rarest = rarest.localCheckpoint()  # a row for an item; hashes are taken from it and joined with it
    return _run_hashes(d, key, sizes, few(rarest)).join(rarest, "gram").select("item_id", key).distinct()


def _few(rows: DataFrame, most: int) -> np.ndarray | None:
    """The distinct hashes, in order, if there are no more than so many."""
    found = rows.select("gram").distinct().limit(most + 1).toArrow()["gram"].to_numpy()
    return np.sort(found) if len(found) <= most else None


def _run_hashes(rows: DataFrame, key: str, sizes: list[int], kept: np.ndarray | None, whole: bool = False) -> DataFrame:
    """key, gram: hashes of the distinct runs of so many bytes of t, those in ``kept`` if given; whole: a shorter text is a run by itself."""
    sent = None
    if kept is not None:
        # a table of the hashes' low bits tells most others at once
        bits = max(12, min(24, int(len(kept)).bit_length() + 6))
        table = np.zeros(1 << bits, dtype=bool)
        table[kept.view(np.uint64) & np.uint64((1 << bits) - 1)] = True
        sent = rows.sparkSession.sparkContext.broadcast((kept, np.packbits(table), bits))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        if sent is not None:
            kept, packed, bits = sent.value
            table = np.unpackbits(packed).view(bool)
        for batch in batches:
            at, hashes = [], []
            for i, text in enumerate(batch.column(1)):
                data = text.as_buffer()
                own = [min(len(data), GRAM)] if whole else sizes
                for size in own:
                    h = run_hashes(data, size)
                    if table is not None:
                        h = h[table[h & np.uint64(len(table) - 1)]]
                    h = np.unique(h.view(np.int64))
                    if table is not None and len(h):
                        h = h[kept[np.minimum(np.searchsorted(kept, h), len(kept) - 1)] == h]
                    if len(h):
                        at.append(np.full(len(h), i))
                        hashes.append(h)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(hashes))], [key, "gram"])

    return rows.select(key, "t").mapInArrow(each, f"`{key}` {rows.schema[key].dataType.simpleString()}, gram long")


def run_hashes(data: bytes, size: int) -> np.ndarray:
    """A hash of every run of ``size`` bytes, up to 16; the same for equal runs wherever they stand."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    b = np.frombuffer(data, dtype=np.uint8)
    h = np.full(n, size, dtype=np.uint64)
    if size >= 8:
        # the first and the last eight bytes; together they are the run
        words = np.ndarray((len(b) - 7,), "<u8", b, 0, (1,))
        h ^= words[:n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += words[size - 8 : size - 8 + n]
    else:
        for j in range(size):
            h = (h << np.uint64(8)) | b[j : j + n].astype(np.uint64)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def first_group_in(pairs: DataFrame, evidence: DataFrame, sents: DataFrame, key: str, unspaced: bool = False) -> DataFrame:
    """As first_group, from arrays (key, sents): groups are made of those documents alone that hold the evidence at all."""
    form = T.unspaced if unspaced else T.squeeze
    e = evidence.select("item_id", form(F.col("evidence")).alias("e")).where("e <> ''")
    hit = pairs.distinct().join(e, "item_id").join(sents, key).select("item_id", key, first_run(F.col("sents"), F.col("e"), form).alias("g"))
    return hit.where("g IS NOT NULL").select("item_id", key, "g.n", "g.first")


def first_run(sents: Column, e: Column, form, most: int = 3) -> Column:
    """n and first of the first run of 1 to ``most`` sentences, the shortest first, that holds e; null if none does."""

    def found(n: int) -> Column:
        starts = F.when(F.size(sents) >= n, F.sequence(F.lit(1), F.size(sents) - n + 1))
        # by places, since a slice would read the whole array each time
        text = lambda i: F.concat_ws(" ", *[F.get(sents, i + (j - 1)) for j in range(n)])
        holds = F.filter(starts, lambda i: F.contains(form(text(i)), e))
        return F.try_element_at(F.transform(holds, lambda i: F.struct(F.lit(n).alias("n"), i.alias("first"))), F.lit(1))

    return F.when((e != "") & F.contains(form(F.array_join(sents, " ")), e), F.coalesce(*[found(n) for n in range(1, most + 1)]))


def first_group(pairs: DataFrame, evidence: DataFrame, groups: DataFrame, key: str, unspaced: bool = False) -> DataFrame:
    """item_id, key, n, first: the first group, the shortest first, that holds the evidence."""
    form = T.unspaced if unspaced else T.squeeze
    e = evidence.select("item_id", form(F.col("evidence")).alias("e")).where("e <> ''")
    hit = pairs.join(e, "item_id").join(groups, key).where(F.contains(form(F.col("text")), F.col("e")))
    return hit.groupBy("item_id", key).agg(F.min(F.struct("n", "first")).alias("g")).select("item_id", key, "g.n", "g.first")


def find(pairs: DataFrame, evidence: DataFrame, sents: DataFrame, key: str, floor: float = 0.85) -> DataFrame:
    """item_id, key, method (exact, nospace, fuzzy or none), n, first, score of every pair.

    pairs: item_id, key; evidence: item_id, evidence; sents: key, sents.
    """
    groups = sentence_groups(sents, key)
    exact = first_group(pairs, evidence, groups, key).withColumns({"method": F.lit("exact"), "score": F.lit(1.0)})
    rest = pairs.join(exact, ["item_id", key], "left_anti")
    loose = first_group(rest, evidence, groups, key, unspaced=True).withColumns({"method": F.lit("nospace"), "score": F.lit(1.0)})
    rest = rest.join(loose, ["item_id", key], "left_anti")
    e = evidence.select("item_id", T.unspaced(F.col("evidence")).alias("e"))
    scored = rest.join(e, "item_id").join(groups, key).withColumn("score", similarity("e", T.unspaced(F.col("text"))))
    best = scored.groupBy("item_id", key).agg(F.max(F.struct("score", -F.col("n"), -F.col("first"))).alias("b"))
    fuzzy = best.select("item_id", key, (-F.col("b.col2")).alias("n"), (-F.col("b.col3")).alias("first"), F.col("b.score").alias("score"))
    ok = F.col("score") >= floor
    fuzzy = fuzzy.select(
        "item_id", key, F.when(ok, F.col("n")).alias("n"), F.when(ok, F.col("first")).alias("first"),
        F.when(ok, "fuzzy").otherwise("none").alias("method"), "score",
    )
    return exact.unionByName(loose).unionByName(fuzzy)


def find_parts(pairs: DataFrame, evidence: DataFrame, sents: DataFrame, key: str, floor: float = 0.85) -> DataFrame:
    """item_id, key, method, sent_ns (numbers of the sentences, in the order found) and score of every pair.

    Evidence of several parts, set apart by ``||``, is looked for part by part:
    the sentences are those of all parts, the score is the best, and the method
    is none if any part is not found, else that of the last part that was not
    found exactly, if there is one.
    """
    parts = F.filter(F.split("evidence", r"(?U)\s*\|\|\s*"), lambda p: F.trim(p) != "")
    e = evidence.select("item_id", F.posexplode_outer(parts).alias("part", "evidence"))
    e = e.select(F.struct("item_id", F.coalesce("part", F.lit(0)).alias("part")).alias("item_id"), F.coalesce("evidence", F.lit("")).alias("evidence"))
    p = pairs.join(e.select(F.col("item_id.item_id").alias("i"), F.col("item_id").alias("part")), F.col("item_id") == F.col("i"))
    one = find(p.select(F.col("part").alias("item_id"), key), e, sents, key, floor)
    found = one.select(
        F.col("item_id.item_id").alias("item_id"), key,
        F.struct(F.col("item_id.part").alias("part"), "method", "score", F.when(F.col("n").isNotNull(), F.sequence("first", F.col("first") + F.col("n") - 1)).alias("ids")).alias("x"),
    )
    all_ = found.groupBy("item_id", key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    methods = F.transform("x", lambda x: x["method"])
    loose = F.filter(methods, lambda m: m != "exact")
    method = F.when(F.array_contains(methods, "none"), "none").otherwise(F.coalesce(F.try_element_at(loose, F.lit(-1)), F.lit("exact")))
    ids = F.array_distinct(F.flatten(F.filter(F.transform("x", lambda x: x["ids"]), lambda i: i.isNotNull())))
    return all_.select("item_id", key, method.alias("method"), ids.alias("sent_ns"), F.array_max(F.transform("x", lambda x: x["score"])).alias("score"))


def spans_for(wanted: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """wanted (id, key, want: sentence ids) with span_id of the spans that hold all of them or, if none does, any of them."""
    size = F.size(F.array_except("want", "sent_ids"))
    both = wanted.join(spans, key).where(F.arrays_overlap("want", "sent_ids")).withColumn("full", size == 0)
    best = F.max("full").over(Window.partitionBy("id", key))
    return both.withColumn("best", best).where("full = best").select("id", key, "span_id", "full")


def overlap_spans(evidence: DataFrame, spans: DataFrame, scope: str, floor: float = 0.55, least: int = 8, slack: float = 0.05) -> DataFrame:
    """(id, span_id, share) of evidence (scope, id, evidence) and spans (scope, span_id, text) that have the floor of its
    bigrams and are near the best.  Bigrams are made once for each text, before the join."""
    e = evidence.select(scope, "id", T.bigrams(F.col("evidence")).alias("want")).where(F.size("want") >= least)
    s = spans.select(scope, "span_id", T.bigrams(F.col("text")).alias("have"))
    share = F.round(F.size(F.array_intersect("want", "have")) / F.size("want"), 9)
    p = e.join(s, scope).select("id", "span_id", share.alias("share")).where(F.col("share") >= floor)
    best = F.max("share").over(Window.partitionBy("id"))
    return p.withColumn("best", best).where(F.col("share") >= F.round(F.col("best") - slack, 9)).select("id", "span_id", "share")
