"""Substring dedup: repeated word windows, found by level-wise doubling.

A window of ``length`` words can only be repeated if every shorter window in it
is.  Windows of 9 words are judged first (for 35); only where they occur twice
or more are they extended to twice that length, 18, and so on until the length
is reached (35, the last step, may be shorter than twice) or no candidate
survives.

Before the last level not every place needs a row.  A window of the next length
is a candidate if all windows of the present length in it have survived; of
these the one with the least hash (the first of equals) stands for it.  The
choice depends on the words alone, so equal windows choose equally, and a
repeated one shows as a repeated choice.  That leaves two places in eleven at 9
words and, of what survives, two in nineteen at 18.

Windows are compared by 96 bits of hash from two polynomials over the words'
XXH64.  Counting combines before the shuffle; the counts are written before they
are joined back, so that adaptive execution can split a window that a third of
all rows share.  Texts go by 96 bits of hash.  After the first level, of equal
texts only that of the least doc_id is read, with its weight; all words of such
texts go, so their starts are not carried to the copies, and the join that tells
the copies is salted.

Edge cases: null and empty texts have no words, are left as they are and hash as
the empty text.  Texts of fewer words than a window lose nothing.  Repeated rows
each count as an occurrence, and each gets a row; no row comes first, so there
are no ties.  Texts may have any length.  A null doc_id stays null.
Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm._base import Scratch, table

#: Odd multipliers of the two polynomials.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ROW = "k1 long, k2 int, pos int, ha long, hb int, weight int"
SALTS = 16


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: only ASCII space splits


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Hash of each run of so many words, put together from runs of doubled length."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, run, size = None, 0, h, 1
    while True:
        power = np.uint64(pow(factor, size, 1 << 64))
        if width & size:
            part = run[done : done + n]
            out = part if out is None else out[:n] * power + part
            done += size
        if done == width:
            break
        run = run[:-size] * power + run[size:]
        size *= 2
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def chosen(short: np.ndarray, span: int) -> np.ndarray:
    """For each run of so many short windows the place of the least one, the first of equals."""
    if len(short) < span:
        return np.empty(0, np.int64)
    best, place, size = short, np.arange(len(short)), 1

    def join(n: int, gap: int) -> None:
        nonlocal best, place
        left, right = best[:n], best[gap : gap + n]
        later = right < left
        best, place = np.where(later, right, left), np.where(later, place[gap : gap + n], place[:n])

    while 2 * size <= span:
        join(len(best) - size, size)
        size *= 2
    if size < span:  # two runs that overlap
        join(len(best) - (span - size), span - size)
    return place


def levels(length: int, shortest: int) -> list[int]:
    """Lengths of the windows judged, each at most twice the one before."""
    out = [length]
    while out[0] > shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _keyed(docs: DataFrame, *names: str) -> DataFrame:
    """text, its identity, doc, the doc_id, and the columns named, in a struct, so that no names clash."""
    keys = F.xxhash64("text").alias("k1"), F.hash("text").alias("k2")
    return docs.select("text", *keys, F.col("doc_id").alias("doc"), *([F.struct(*names).alias("own")] if names else []))


def _salt(id: str) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(SALTS)).cast("int")


def _rows(docs: DataFrame, width: int, starts: Callable[[np.ndarray, np.ndarray | None], np.ndarray]) -> DataFrame:
    """A row for the window at each of the starts that the function picks from a text's hashes and its column at."""
    has = "at" in docs.columns
    docs = docs.select("k1", "k2", "text", *(["at", "weight"] if has else []))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts: list[list[np.ndarray]] = []
            held = 0
            ats, weights = (b["at"], b["weight"]) if has else ([None] * len(b), [1] * len(b))
            copies = Counter(zip(b["k1"], b["k2"], strict=True))
            for k1, k2, text, at, weight in zip(b["k1"], b["k2"], b["text"], ats, weights, strict=True):
                weight *= copies.pop((k1, k2), 0)
                if not weight:  # counted with the first copy in the batch
                    continue
                h = word_hashes(words_of(text))
                pos = starts(h, at)
                if len(pos):
                    ha = window_hashes(h, width, FACTORS[0])[pos].view(np.int64)
                    hb = (window_hashes(h, width, FACTORS[1])[pos] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    own = [np.full(len(pos), x, kind) for x, kind in ((k1, np.int64), (k2, np.int32), (weight, np.int32))]
                    parts.append([own[0], own[1], pos.astype(np.int32), ha, hb, own[2]])
                    held += len(pos)
                if held > 100_000:
                    yield frame(parts)
                    parts, held = [], 0
            if parts:
                yield frame(parts)

    def frame(parts: list[list[np.ndarray]]) -> pd.DataFrame:
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("k1", "k2", "pos", "ha", "hb", "weight"), zip(*parts, strict=True), strict=True)})

    return docs.mapInPandas(each, ROW)


def _repeated(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """k1, k2 and at, the sorted starts of a text's windows that occur twice or more."""
    rows = scratch.table(rows)
    scratch.release()
    twice = scratch.table(rows.groupBy("ha", "hb").agg(F.sum("weight").alias("n")).where("n > 1").drop("n"))
    scratch.release()
    # texts that are read several times name the same starts once more
    out = rows.join(twice, ["ha", "hb"]).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    out = scratch.table(out)
    scratch.drop(rows, twice)
    scratch.release()
    return out


def repeated_windows(docs: DataFrame, length: int, shortest: int, scratch: Scratch) -> DataFrame:
    """k1, k2, rep (the least doc_id that has the text), copies, at: the starts of the windows that occur anywhere else."""
    widths = levels(length, shortest)
    texts = _keyed(docs)
    groups = scratch.table(texts.groupBy("k1", "k2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")))

    def first_copies(found: DataFrame) -> DataFrame:
        """The texts found, each where its least doc_id is: other copies have other keys, so none is hot."""
        f = found.join(groups, ["k1", "k2"]).withColumn("weight", F.least("copies", F.lit(2)).cast("int"))
        f = f.withColumnsRenamed({"k1": "f1", "k2": "f2"})
        return texts.join(f, (texts["k1"] == f["f1"]) & (texts["k2"] == f["f2"]) & texts["doc"].eqNullSafe(f["rep"]))

    if len(widths) == 1:
        found = _repeated(_rows(texts, length, lambda h, at: np.arange(max(0, len(h) - length + 1))), scratch)
        return found.join(groups, ["k1", "k2"])

    def starts(k: int) -> Callable[[np.ndarray, np.ndarray | None], np.ndarray]:
        """Which windows of widths[k] get a row, given where chosen windows of the width before have survived."""

        def pick(h: np.ndarray, at: np.ndarray | None) -> np.ndarray:
            ok = None
            if k:
                ok = np.isin(chosen(window_hashes(h, widths[k - 1], FACTORS[0]), widths[k] - widths[k - 1] + 1), at)
                if k == len(widths) - 1:
                    return np.flatnonzero(ok)
            span = widths[k + 1] - widths[k] + 1
            place = chosen(window_hashes(h, widths[k], FACTORS[0]), span)
            if ok is not None and len(place):
                gaps = np.concatenate([[0], np.cumsum(~ok)])
                place = place[gaps[span:] == gaps[:-span]]
            return np.unique(place)

        return pick

    found = None
    for k, width in enumerate(widths):
        if found is not None and found.isEmpty():
            break
        now = _repeated(_rows(texts if found is None else first_copies(found), width, starts(k)), scratch)
        if found is not None:
            scratch.drop(found)
        found = now
    return found.join(groups, ["k1", "k2"])


def remove_repeats(docs: DataFrame, *, length: int = 35, shortest: int = 9, with_columns: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    with_columns: in place of doc_id a struct, own, of all columns of docs but
    text, and kept_text, which is the text itself where nothing goes and else
    the kept words joined by spaces.
    """
    scratch = Scratch(docs.sparkSession)
    found = repeated_windows(docs, length, shortest, scratch)
    names = [c for c in docs.columns if c != "text"] if with_columns else ["doc_id"]
    # other columns cross to Python and back as one JSON text, whatever their types and names
    keyed = _keyed(docs, *names).withColumn("salt", _salt("doc"))
    kind = keyed.schema["own"].dataType
    many = F.col("copies") > 1
    salts = F.when(many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(_salt("rep")))
    found = found.select("k1", "k2", F.when(~many, F.col("at")).alias("at"), many.alias("whole"), F.explode(salts).alias("salt"))
    marked = keyed.join(found, ["k1", "k2", "salt"], "left").select(
        F.to_json("own", {"ignoreNullFields": "true"}).alias("own"), "text", "at", F.coalesce("whole", F.lit(False)).alias("whole")
    )

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for own, text, at, whole in zip(b["own"], b["text"], b["at"], b["whole"], strict=True):
                words = words_of(text)
                kept, n = words, 0
                if whole:
                    kept, n = [], len(words)
                elif at is not None:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length, -1)
                    kept = list(compress(words, np.cumsum(edge[:-1]) == 0))
                    n = len(words) - len(kept)
                joined = b" ".join(kept)
                rest = (joined.decode() if n else text) if with_columns else None
                out.append((own, len(words), n, hashlib.sha256(joined).hexdigest(), rest))
            yield pd.DataFrame(out, columns=["own", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = marked.mapInPandas(each, "own string, n_words long, n_removed long, kept_sha256 string, kept_text string")
    out = out.withColumn("own", F.from_json("own", kind))
    return out if with_columns else out.select("own.doc_id", "n_words", "n_removed", "kept_sha256")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM win JOIN twice USING (h)),
rest AS (
  SELECT r, count(*) AS n, list(i) AS at FROM gone GROUP BY r),
words AS (
  SELECT d.r, i, d.w[i] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) d
  ANTI JOIN gone ON gone.r = d.r AND gone.i = d.i),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM words GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(rest.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN rest USING (r) LEFT JOIN kept USING (r)
"""
