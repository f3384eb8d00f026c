"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts characters from the ``order - 1`` before them within a word,
whose start and end are symbols too.  Counts come from all trusted documents
but a held-out half, combined within partitions.  Probabilities are built order
by order with joins of the counts by gram, context and suffix, sharded by their
hash.  Documents are scored in one pass: the ``hot`` most frequent grams are
broadcast, and a Bloom filter of fixed size tells which others the model may
hold.  Windows that need none of those are scored where they lie; all others are
joined with the sharded model, whatever its size, and their scores are summed
back by document.

The labels of a language set its threshold: the log-perplexity at which the mean
of the shares of junk (quality 0) and of toxic documents caught, less the share of
held-out trusted documents lost, is greatest, among those that lose no more than
``most_lost`` of the latter.  A language with fewer than ``least`` held-out
trusted documents, or fewer junk and toxic ones, takes the threshold of all
languages together; if nothing is labelled junk or toxic, the threshold is the
quantile ``kept_share`` of the held-out trusted.

Edge cases: null and empty texts have no words, a null perplexity and are not
kept; a null lang is a language of its own.  Repeated rows each get a row; a
null doc_id stays null; of limits that gain equally the highest is taken; words
and texts may have any length.  Without trusted text nothing can be judged: perplexity
and threshold are null and all texts with words are kept.  Empty tables give no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm._base import MAX_BROADCAST_IDS, Scratch, is_at_most, label_kinds, label_limits, plain_words, table

#: Noncharacters that no text should hold.
START, STOP = "﷐", "﷑"
#: What separates words: the characters that ``bytes.split`` splits at.
SPACES = " \t\n\v\f\r"
REMEMBERED = 1 << 19
#: Bits of the Bloom filter (four megabytes, whatever the model's size) and places set for a gram.
BLOOM, PLACES = 1 << 25, 3
FITS, HELD_OUT, JUNK, TOXIC = 1, 2, 3, 4
#: Log-probabilities are whole micro-units, so that sums do not depend on their order.
MICRO = 1_000_000


def windows(word: str, order: int) -> list[str]:
    """For each predicted symbol of a word, it and the ``order - 1`` before it, or as many as there are."""
    s = START + word + STOP
    return [s[max(0, i - order + 1) : i + 1] for i in range(1, len(s))]


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    """gram and c: how often each window occurs over the column text.

    Shorter grams need no counting: what the model wants of them is how many
    kinds of longer ones end in them.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words: Counter = Counter()
            for text in b["text"]:
                words.update((text or "").encode().split())
            grams: Counter = Counter()
            for w, n in words.items():
                for g in windows(w.decode(), order):
                    grams[g] += n
            if grams:  # Arrow does not take a frame without rows
                yield pd.DataFrame({"gram": list(grams), "c": list(grams.values())})

    return texts.select("text").mapInPandas(each, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(sizes: dict[int, int]) -> tuple[float, float, float]:
    """What one, two, and three or more occurrences lose, from the numbers of grams that occur 1 to 4 times."""
    n = [sizes.get(j, 0) for j in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
    out = []
    for j in (1, 2, 3):
        d = j - (j + 1) * y * n[j + 1] / n[j] if n[j] else j / 2
        out.append(min(max(d, 0.1), j - 0.1))
    return tuple(out)


def build(counts: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """gram, lp (log-probability of its last symbol after the others), lb (log-weight of what is shorter, where the gram is a
    context), either of which may be null, and seen (how often).  The empty gram's lp is that of an unknown symbol."""
    counts = counts.withColumn("k", F.length("gram"))
    used = level = scratch.table(counts.where(F.col("k") == order).select("gram", "k", F.col("c").alias("a")))
    for k in range(order - 1, 0, -1):
        # grams at a word's start keep their counts; others count the kinds of grams one longer that end in them
        kinds = level.groupBy(F.substr("gram", F.lit(2)).alias("gram")).agg(F.lit(k).alias("k"), F.count("*").alias("a"))
        first = counts.where(F.col("k") == k).select("gram", "k", F.col("c").alias("a"))
        level = scratch.table(kinds.unionByName(first))
        used = used.unionByName(level)
    used = used.withColumn("ctx", F.substr("gram", F.lit(1), F.col("k") - 1))

    sizes: dict[int, dict[int, int]] = {}
    for k, a, n in used.where("a <= 4").groupBy("k", "a").count().collect():  # four rows an order
        sizes.setdefault(k, {})[a] = n
    off = {k: discounts(sizes.get(k, {})) for k in range(1, order + 1)}

    def lost(k: Column, a: Column) -> Column:
        out = F.lit(0.0)
        for o, d in off.items():
            out = F.when(k == o, F.when(a == 1, d[0]).when(a == 2, d[1]).otherwise(d[2])).otherwise(out)
        return out

    contexts = used.groupBy("k", "ctx").agg(F.sum("a").alias("total"), F.sum(lost(F.col("k"), F.col("a"))).alias("free"))
    contexts = scratch.table(contexts.withColumn("weight", F.col("free") / F.col("total")).withColumn("total", F.col("total").cast("long")))
    own = used.join(contexts, ["k", "ctx"]).select(
        "gram", "k", "a", ((F.col("a") - lost(F.col("k"), F.col("a"))) / F.col("total")).alias("own"), "weight"
    )
    own = scratch.table(own)
    first = contexts.where("k = 1").select("weight").first()
    kinds = own.where("k = 1").count() + 1
    unknown = first["weight"] / kinds if first else 1.0
    known = own.where("k = 1").select("gram", "a", (F.col("own") + unknown).alias("p"))
    all_p = known
    for k in range(2, order + 1):
        suffix = known.select(F.col("gram").alias("suffix"), F.col("p").alias("shorter"))
        now = own.where(F.col("k") == k).withColumn("suffix", F.substr("gram", F.lit(2)))
        known = scratch.table(
            now.join(suffix, "suffix").select("gram", "a", (F.col("own") + F.col("weight") * F.col("shorter")).alias("p"))
        )
        all_p = all_p.unionByName(known)
    micro = lambda p: F.round(F.log(p) * MICRO).cast("long")
    back = contexts.where("k > 1").select(F.col("ctx").alias("gram"), "total", micro(F.col("weight")).alias("lb"))
    seen = F.greatest("a", "total").alias("seen")
    out = all_p.select("gram", "a", micro(F.col("p")).alias("lp")).join(back, "gram", "full").select("gram", "lp", "lb", seen)
    empty = round(math.log(unknown) * MICRO)
    last = own.sparkSession.range(1).select(F.lit("").alias("gram"), F.lit(empty).cast("long").alias("lp"), F.lit(None).cast("long").alias("lb"), F.lit(None).cast("long").alias("seen"))
    return out.unionByName(last)


class Scores:
    """The broadcast part of a model: grams with lp and lb, and a filter of the others."""

    def __init__(self, lp: dict[str, int], lb: dict[str, int], bits: np.ndarray):
        self.lp, self.lb, self.bits = lp, lb, bits

    def may_hold(self, gram: str) -> bool:
        """Whether the model may hold a gram that is not among the broadcast ones; never wrong if it says no."""
        h = xxhash.xxh64_intdigest(gram, 42)
        step = h >> 32 | 1
        return all(self.bits[at >> 5] >> (at & 31) & 1 for at in ((h + i * step) % BLOOM for i in range(PLACES)))

    def gram(self, gram: str) -> int | None:
        """Log-probability of a gram's last symbol after the others, in micro-units; None if it takes the whole model."""
        total = 0
        while (p := self.lp.get(gram)) is None:
            if self.may_hold(gram):
                return None
            if len(gram) == 1:
                return total + self.lp[""]
            b = self.lb.get(gram[:-1])
            if b is None and len(gram) > 1 and self.may_hold(gram[:-1]):
                return None
            total += b or 0
            gram = gram[1:]
        return total + p

    def word(self, word: str, order: int, known: dict[str, int | None]) -> tuple[int, list[str]]:
        """Log-probability of a word with its end, less its windows that take the whole model, and those; known keeps the scores of windows."""
        total, rest = 0, []
        for g in windows(word, order):
            if g not in known:
                known[g] = self.gram(g)
            if (p := known[g]) is None:
                rest.append(g)
            else:
                total += p
        return total, rest


def split_model(model: DataFrame, hot: int) -> Scores:
    """At most ``hot`` grams, those most often seen beside those of one symbol, and the filter of all others."""
    # grams of one symbol count as seen most often, if the alphabet is not larger than the bound
    level = F.when(F.length("gram") <= 1, 1 << 20).otherwise(F.floor(16 * F.log2(F.coalesce("seen", F.lit(1))))).cast("long")
    leveled = model.withColumn("level", level)
    least, held = 1 << 21, 0
    for row in leveled.groupBy("level").count().orderBy(F.desc("level")).collect():  # some 1,000 rows at most
        if held + row["count"] > hot:
            break
        least, held = row["level"], held + row["count"]
    rows = leveled.where((F.col("level") >= least) | (F.col("gram") == "")).select("gram", "lp", "lb").toArrow()  # no more than hot + 1
    columns = [rows[c].to_pylist() for c in ("gram", "lp", "lb")]
    lp = {g: p for g, p, _ in zip(*columns, strict=True) if p is not None}
    lb = {g: b for g, _, b in zip(*columns, strict=True) if b is not None}
    h = F.xxhash64("gram")
    # unsigned remainders, as Python has them
    low = F.pmod(h, F.lit(BLOOM))
    step = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    at = F.explode(F.array(*[F.pmod(low + i * F.pmod(step, F.lit(BLOOM)), F.lit(BLOOM)) for i in range(PLACES)])).alias("at")
    rest = leveled.where((F.col("level") < least) & (F.col("gram") != "")).select(at)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").cast("int") % 32)
    words = rest.groupBy((F.col("at") / 32).cast("int").alias("i")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most BLOOM / 32 rows
    bits = np.zeros(BLOOM // 32, np.uint32)
    bits[words["i"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return Scores(lp, lb, bits)


_memory: dict[str, tuple[dict, dict]] = {}


def remembered(name: str) -> tuple[dict, dict]:
    """Scores of words and windows that this Python worker has met under the model of that name; only the last model's are kept."""
    if name not in _memory:
        _memory.clear()
        _memory[name] = {}, {}
    return _memory[name]


def score(docs: DataFrame, model: DataFrame, order: int, hot: int, scratch: Scratch) -> DataFrame:
    """docs' columns but text, with n_words, n_symbols and total."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, split_model(model, hot)))
    names = [c for c in docs.columns if c != "text"]
    kinds = [docs.schema[c].dataType.simpleString() for c in names]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, scores = shared.value
        known, grams = remembered(name)
        for b in batches:
            sizes, symbols, totals, rest, times = [], [], [], [], []
            for text in b["text"]:
                words = Counter((text or "").encode().split())
                total, left = 0, Counter()
                for w, n in words.items():
                    if (got := known.get(w)) is None:
                        got = known[w] = scores.word(w.decode(), order, grams)
                    total += n * got[0]
                    for g in got[1]:
                        left[g] += n
                sizes.append(words.total())
                # the characters of the words, and an end for each
                symbols.append(len(text or "") - sum(map((text or "").count, SPACES)) + sizes[-1])
                totals.append(total)
                rest.append(list(left))
                times.append(list(left.values()))
                for memory in (known, grams):
                    if len(memory) > REMEMBERED:
                        memory.clear()
            yield b[[*names, "_row"]].assign(n_words=sizes, n_symbols=symbols, total=totals, rest=rest, times=times)

    # all as text, so that nulls do not change types
    d = docs.select(*[F.col(c).cast("string").alias(c) for c in names], F.monotonically_increasing_id().alias("_row"), "text")
    made = ", ".join(f"{c} string" for c in names) + ", _row long, n_words long, n_symbols long, total long, rest array<string>, times array<long>"
    out = d.mapInPandas(each, made)
    own = [F.col(c).cast(k).alias(c) for c, k in zip(names, kinds, strict=True)]
    scored = scratch.table(out.select(*own, "_row", "n_words", "n_symbols", "total", "rest", "times"))
    left = scored.select("_row", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("_row", "r.rest", "r.times")
    by_window = scratch.table(window_scores(left.select(F.col("rest").alias("window")).distinct(), model, order))
    sums = left.join(by_window, F.col("rest") == F.col("window")).groupBy("_row").agg(F.sum(F.col("times") * F.col("score")).alias("more"))
    total = (F.col("total") + F.coalesce("more", F.lit(0))).cast("long").alias("total")
    return scored.join(sums, "_row", "left").select(*names, "n_words", "n_symbols", total)


def window_scores(seen: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """window and score (micro-units) of distinct windows, by joins of their suffixes and contexts with the sharded model."""
    size = F.length("window")
    tried = seen.select("window", F.explode(F.sequence(F.lit(1), F.least(F.lit(order), size))).alias("k"))
    gram = F.substr("window", size - F.col("k") + 1, F.col("k"))
    ctx = F.when(F.col("k") > 1, F.substr("window", size - F.col("k") + 1, F.col("k") - 1))
    tried = tried.select("window", "k", gram.alias("gram"), ctx.alias("ctx"))
    tried = tried.join(model.select("gram", "lp"), "gram", "left")
    tried = tried.join(model.where("lb IS NOT NULL").select(F.col("gram").alias("ctx"), "lb"), "ctx", "left")
    unknown = model.where("gram = ''").select(F.col("lp").alias("unknown"))  # one row
    best = F.max(F.when(F.col("lp").isNotNull(), F.col("k"))).over(Window.partitionBy("window"))
    steps = tried.withColumn("best", F.coalesce(best, F.lit(0))).where("k >= best")
    part = F.when(F.col("k") == F.col("best"), F.col("lp")).otherwise(F.coalesce("lb", F.lit(0)))
    sums = steps.groupBy("window", "best").agg(F.sum(part).alias("score"))
    last = F.when(F.col("best") == 0, F.col("unknown")).otherwise(0)
    return sums.join(F.broadcast(unknown)).select("window", (F.col("score") + last).alias("score"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    order: int = 5,
    kept_share: float = 0.995,
    most_lost: float = 0.05,
    least: int = 50,
    hot: int = 1 << 18,
) -> DataFrame:
    """doc_id, lang, n_words, n_symbols, perplexity, threshold and kept of every row.

    hot bounds the grams that are broadcast; it does not change any score.
    """
    scratch = Scratch(docs.sparkSession)
    good = label_kinds(labels)
    if is_at_most(good, MAX_BROADCAST_IDS):
        good = F.broadcast(good)
    d = docs.select("doc_id", "text", "lang")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(2))
    d = d.join(good, d["doc_id"] == F.col("_good"), "left").select(
        "doc_id",
        "text",
        "lang",
        F.when(F.col("_good").isNull(), 0)
        .when(F.col("_kind") == "junk", JUNK)
        .when(F.col("_kind") == "toxic", TOXIC)
        .when(fold == 0, FITS)
        .otherwise(HELD_OUT)
        .alias("_trusted"),
    )
    counts = scratch.table(count_grams(d.where(F.col("_trusted") == FITS), order))
    if counts.isEmpty():
        out = d.select("doc_id", "lang", F.size(plain_words(F.col("text"))).cast("long").alias("n_words"))
        none = F.lit(None).cast("double")
        return out.select(
            "doc_id", "lang", "n_words", F.lit(None).cast("long").alias("n_symbols"), none.alias("perplexity"), none.alias("threshold"),
            (F.col("n_words") > 0).alias("kept"),
        )
    model = scratch.table(build(counts, order, scratch))
    scored = score(d, model, order, hot, scratch)
    # thousandths of the log-perplexity
    scored = scratch.table(scored.withColumn("bin", F.expr("CASE WHEN n_symbols > 0 THEN -total div (1000 * n_symbols) END")))
    known = scored.where((F.col("_trusted") >= HELD_OUT) & F.col("bin").isNotNull())
    kinds = {"held": HELD_OUT, "junk": JUNK, "toxic": TOXIC}
    bins = scratch.table(known.groupBy("lang", "bin").agg(*[F.count_if(F.col("_trusted") == k).alias(c) for c, k in kinds.items()]))
    limits = scratch.table(label_limits(bins, most_lost, kept_share, least))
    alike = bins.groupBy(F.lit(None).cast("string").alias("lang"), "bin").agg(*[F.sum(c).alias(c) for c in kinds])
    every = label_limits(alike, most_lost, kept_share, 1).first()
    limits = limits.withColumnsRenamed({"lang": "_lang", "limit": "_limit"})
    # one row for each language that has so many trusted documents
    limit = F.coalesce("_limit", F.lit(every["limit"] if every else None).cast("long"))
    joined = scored.join(limits, scored["lang"].eqNullSafe(limits["_lang"]), "left").withColumn("limit", limit)
    return joined.select(
        "doc_id",
        "lang",
        "n_words",
        "n_symbols",
        F.when(F.col("n_symbols") > 0, F.exp(-F.col("total") / F.col("n_symbols") / MICRO)).alias("perplexity"),
        F.exp(F.col("limit") / 1000).alias("threshold"),
        (F.col("bin").isNotNull() & F.coalesce(F.col("bin") <= F.col("limit"), F.lit(True))).alias("kept"),
    )


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
