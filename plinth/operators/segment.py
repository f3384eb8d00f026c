"""Sentences, windows of sentences, passages.

A document's sentences stay together in one array, so windows need no shuffle
and no sort: every step below is a projection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.functions.udfs import mask_dots

#: The default splitter: up to closing marks or the end of the line.
SENTENCE = r"[^.!?\n]+[.!?]*"


def sentence_arrays(docs: DataFrame, key: str = "doc_id", text: str = "text", protect: bool = False) -> DataFrame:
    """key and sents, the trimmed sentences in order.  protect: full stops of abbreviations, dates and the like do not end one."""
    t = mask_dots(F.col(text)) if protect else F.col(text)
    found = F.transform(F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(F.translate(s, "\0", ".")))
    return docs.select(key, F.filter(found, lambda s: s != "").alias("sents"))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ord (from 1), sent_id, text, is_heading."""
    s = sentence_arrays(docs, key, text).select(key, F.posexplode("sents").alias("p", "text"))
    return s.select(key, (F.col("p") + 1).alias("ord"), sent_id(F.col("p") + 1).alias("sent_id"), "text", T.is_heading(F.col("text")).alias("is_heading"))


def sent_id(ord: Column) -> Column:
    return F.format_string("s%03d", ord)


def windows(sents: Column, size: int, stride: int = 1) -> Column:
    """Array of (ord, first, ids, text) of runs of so many sentences; one shorter run where there are no more."""
    n = F.size(sents)
    starts = F.when(n > size, F.sequence(F.lit(1), n - size + 1, F.lit(stride))).when(n > 0, F.array(F.lit(1)))

    def one(first: Column, i: Column) -> Column:
        part = F.slice(sents, first, size)
        ids = F.transform(part, lambda _, j: sent_id(first + j))
        return F.struct((i + 1).alias("ord"), first.alias("first"), ids.alias("ids"), F.array_join(part, " ").alias("text"))

    return F.transform(starts, one)


def passages(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """passage_id, key, span_id, window, ord, first, text, sent_ids, n_chars."""
    s = sentence_arrays(docs, key, text)
    s = s.select(key, F.explode(windows(F.col("sents"), size)).alias("w"))
    span = F.format_string(f"w{size}_%03d", F.col("w.ord"))
    return s.select(
        F.concat_ws("_", F.col(key).cast("string"), span).alias("passage_id"),
        key,
        span.alias("span_id"),
        F.lit(f"w{size}").alias("window"),
        F.col("w.ord").alias("ord"),
        F.col("w.first").alias("first"),
        F.col("w.text").alias("text"),
        F.col("w.ids").alias("sent_ids"),
        F.length("w.text").alias("n_chars"),
    )


def passage_doc(passage_id: Column) -> Column:
    return F.regexp_extract(passage_id, r"^(.*)_(w\d+_\d+)$", 1)


def passage_span(passage_id: Column) -> Column:
    return F.regexp_extract(passage_id, r"^(.*)_(w\d+_\d+)$", 2)


def merged_sentences(sents: DataFrame, key: str = "doc_id", least: int = 6) -> DataFrame:
    """Sentences put back together that were cut too early.

    sents: key, paragraph, ord, text, is_heading.  A sentence joins the one
    before if both are of one paragraph and no heading, and it is very short, or
    what is before, as already merged, has open brackets or no proper end.
    Each step depends on the one before, so a document's sentences are folded in
    order.
    """
    one = F.struct("ord", F.col("paragraph").cast("int").alias("paragraph"), "text", "is_heading")
    s = F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("ord"))
    return merged_arrays(sents.groupBy(key).agg(s.alias("sents")), key, least)


def merged_arrays(rows: DataFrame, key: str = "doc_id", least: int = 6, most: int = 100_000) -> DataFrame:
    """As merged_sentences, of arrays: key and sents (paragraph, text, is_heading) of a document in order.

    No rows are shuffled.  What tells whether a merged sentence is whole is kept
    up as it grows, so it is not read again with each part; about ``most`` parts
    are folded at once.
    """
    marks = re.compile("[" + re.escape("".join(T.PAIRS)) + "]")
    endings = tuple(T.ENDINGS)

    def merge(docs: pa.Array, first: list[int], sents: pa.StructArray) -> pa.RecordBatch:
        paragraphs, texts, heads = (sents.field(i).to_pylist() for i in range(3))
        out: list[tuple] = []
        for doc, (a, b) in enumerate(zip(first, first[1:])):
            n, last, parts, open_, tail = 0, None, [], {}, ""
            for p, text, head in zip(paragraphs[a:b], texts[a:b], heads[a:b]):
                if n and last == p and not head and not out[-1][3] and (
                    len(text.strip()) < least or any(open_.values()) or not tail.endswith(endings)
                ):
                    parts.append(text)
                else:
                    n, last, parts, open_, tail = n + 1, p, [text], {}, ""
                    out.append((doc, p, n, head, parts))
                if marks.search(text):
                    for x, y in T.PAIRS:
                        open_[x] = open_.get(x, 0) + text.count(x) - text.count(y)
                tail = text.rstrip() or tail
        doc, paragraph, ord, head, parts = zip(*out)
        return pa.RecordBatch.from_arrays(
            [docs.take(pa.array(doc)), pa.array(paragraph, pa.int32()), pa.array(ord, pa.int32()), pa.array([" ".join(x) for x in parts], pa.string()), pa.array(head, pa.bool_())],
            [key, "paragraph", "ord", "text", "is_heading"],
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sents = batch.column(0), batch.column(1)
            offsets = np.asarray(sents.offsets)
            for a, b in spans(offsets, most):
                x, y = offsets[a], offsets[b]
                if y > x:
                    yield merge(docs.slice(a, b - a), (offsets[a : b + 1] - x).tolist(), sents.values.slice(x, y - x))

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "sents").mapInArrow(each, f"{key} {kind}, paragraph int, ord int, text string, is_heading boolean")


def paragraph_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, paragraph, ord, text, is_heading of raw sentences; paragraphs are lines."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("paragraph", "line"))
    s = lines.select(key, "paragraph", F.posexplode(F.regexp_extract_all("line", F.lit(r"[^.!?]+[.!?]*"), F.lit(0))).alias("i", "t"))
    s = s.select(key, "paragraph", (F.col("paragraph") * 100_000 + F.col("i")).alias("ord"), F.trim("t").alias("text")).where("text <> ''")
    return s.withColumn("is_heading", T.is_heading(F.col("text")))


def paragraph_arrays(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and sents (paragraph, text, is_heading), the raw sentences of paragraph_sentences in order, without a shuffle."""

    def of_line(line: Column, i: Column) -> Column:
        found = F.transform(F.regexp_extract_all(line, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda t: F.trim(t))
        return F.transform(
            F.filter(found, lambda t: t != ""), lambda t: F.struct(i.alias("paragraph"), t.alias("text"), T.is_heading(t).alias("is_heading"))
        )

    return docs.select(key, F.flatten(F.transform(F.split(text, "\n"), of_line)).alias("sents"))


def clustered_lines(fragments: DataFrame, eps: float = 2.5) -> DataFrame:
    """doc_id, page, side, line, indent, text: fragments (doc_id, page, x, y, text) of a page in reading order.

    Fragments left of ``gutter`` come first.  A fragment joins a line whose first
    fragment lies within eps of its height; later ones do not move that height,
    so lines are folded from the top, one page side at a time.
    """
    sided = fragments.where("NOT rotated").withColumn("side", (F.col("x") >= F.col("gutter")).cast("int"))
    part = F.struct(F.col("page").cast("int").alias("page"), "side", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "text")
    parts = F.collect_list(part).alias("parts")
    return lines_of_parts(sided.groupBy("doc_id", "page", "side").agg(parts).select("doc_id", "parts"), eps)


def lines_of_parts(rows: DataFrame, eps: float = 2.5, most: int = 200_000) -> DataFrame:
    """As clustered_lines, of arrays: doc_id and parts (page, side, x, y, text), all fragments of a page side in one row; side is 0 left of the gutter.

    No rows are shuffled.  Sorting is done for very many page sides at once, of
    about ``most`` fragments.
    """

    def lines(docs: pa.Array, first: list[int], parts: pa.StructArray) -> pa.RecordBatch:
        page, side = (np.asarray(parts.field(i)) for i in (0, 1))
        x, y = (np.asarray(parts.field(i), dtype=float) for i in (2, 3))
        text = parts.field(4).to_pylist()
        row = np.repeat(np.arange(len(docs)), np.diff(first))
        order = np.lexsort((x, -y, side, page, row))
        row, page, side, x, y = (v[order] for v in (row, page, side, x, y))
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (page[1:] != page[:-1]) | (side[1:] != side[:-1])
        top, starts = 0.0, new.tolist()
        for i, (start, height) in enumerate(zip(starts, y.tolist(), strict=True)):
            if start or not abs(top - height) <= eps:
                top, starts[i] = height, True
        begin = np.flatnonzero(starts)
        # within a line from left to right; equals stay in order of height
        inner = np.lexsort((x, np.cumsum(starts)))
        joined = [text[i] for i in order[inner].tolist()]
        ends = [*begin[1:].tolist(), len(joined)]
        texts = [" ".join("".join(joined[a:b]).split()) for a, b in zip(begin.tolist(), ends, strict=True)]
        kept = np.array([t != "" for t in texts], dtype=bool)
        # lines with text are counted from 1 within their page side
        n = np.cumsum(kept)
        of_side = np.cumsum(new)[begin]
        before = np.concatenate(([0], n))[:-1][np.searchsorted(of_side, of_side)]
        at = begin[kept]
        columns = [page[at], side[at], (n - before)[kept], np.rint(x[inner][at])]
        return pa.RecordBatch.from_arrays(
            [docs.take(pa.array(row[at])), *[pa.array(c.astype(np.int32)) for c in columns], pa.array([t for t in texts if t], pa.string())],
            ["doc_id", "page", "side", "line", "indent", "text"],
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, parts = batch.column(0), batch.column(1)
            offsets = np.asarray(parts.offsets)
            for a, b in spans(offsets, most):
                first = offsets[a : b + 1]
                if first[-1] > first[0]:
                    yield lines(docs.slice(a, b - a), first, parts.values.slice(first[0], first[-1] - first[0]))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, page int, side int, line int, indent int, text string")


def spans(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of array rows with about so many elements together; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b
