"""Best-fit packing of token sequences by pattern packing with non-negative least squares.

Documents become tokens and an end mark; those longer than a sequence are cut.
Lengths are counted: at most one row for each length, whatever the corpus, goes
to the driver.  There, patterns of two or three lengths that fill a sequence
exactly are enumerated; non-negative least squares fits how often each is used
to the counts; the repeats, or a share of them, are rounded so that no length is
used up twice; and what remains is packed best-fit decreasing, length by length.
The plan is a list of (lengths of one sequence, repeats).

Pieces of equal length are alike, so a piece needs only its rank among those of
its length to find its place in the plan.  Ranks come from counts by length and
partition, so no task holds all pieces of a length.

Edge cases: a null or empty text is the end mark alone; texts of any length and
with any run of one character have the tokenizer's ids.  Pieces of equal length
are ranked by partition, doc_id, piece and checksum; equal plans by share.  Repeated rows each get
their pieces.  A null doc_id stays null.  An empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm._base import Scratch, table

#: How a byte-level vocabulary of this kind cuts text before merging (fixed value; such files only name the rule).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: White space that the pattern may have to walk back over is left to the slower library, whose stack it does not use up.
LONG_BLANK = 100_000


def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ids of a byte-level BPE file by bytes, and of its special tokens by text.

    In such a file a token's id is its rank, so that ids alone give the merges.
    """
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    of = byte_symbols()
    ids = {bytes(of[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
    return ids, special


class Coder:
    """Ids of a text; the pattern's backtracking ends at some 500,000 blanks, so texts with long runs take the other library."""

    def __init__(self, ids: dict[bytes, int], special: dict[str, int], file: str):
        import tiktoken

        self.special, self.file, self.other = special, file, None
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ids, special_tokens=special)
        self.long = re.compile(rf"\s{{{LONG_BLANK}}}")

    def __call__(self, text: str) -> list[int]:
        if len(text) >= LONG_BLANK and self.long.search(text):
            if self.other is None:
                from tokenizers import Tokenizer

                self.other = Tokenizer.from_str(self.file)
            return self.other.encode(text, add_special_tokens=False).ids
        marks = {s for s in self.special if s in text}
        return self.fast.encode(text, allowed_special=marks, disallowed_special=())


def tokenized(docs: DataFrame, path: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece."""
    # read here and sent once to each executor; its size is that of the vocabulary
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast((*vocabulary(path), f.read()))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(*shared.value)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                got = [*coder(text or ""), 0]
                whole, start = np.array(got, "<u4"), 0
                cut = (len(got) - 1) % capacity + 1 if len(got) > capacity else len(got)
                for piece, end in enumerate(range(cut, len(got) + 1, capacity)):
                    part = whole[start:end]
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(part.tobytes()), part if with_ids else None))
                    start = end
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    # ids travel as text, so that nulls do not turn them into floats
    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = d.mapInPandas(each, "doc_id string, piece int, start long, length long, ids_crc32 long, ids array<long>")
    out = out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    return out if with_ids else out.drop("ids")


def patterns(capacity: int, stride: int) -> np.ndarray:
    """All pairs of lengths that add up to capacity, and one in ``stride`` of the triples; 0 pads."""
    a = np.arange(1, capacity // 2 + 1)
    pairs = np.stack([capacity - a, a, np.zeros_like(a)], axis=1)
    triples = []
    for big in range(1, capacity):  # one at a time: the square of all would take the driver 170 MB
        mid = np.arange((capacity - big + 1) // 2, min(big, capacity - big - 1) + 1)
        mid = mid[(big + 3 * mid) % stride == 0]
        triples.append(np.stack([np.full_like(mid, big), mid, capacity - big - mid], axis=1))
    return np.concatenate([pairs, *triples])


def nonnegative_least_squares(index: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that brings the counts of lengths in x times the patterns near target, by accelerated projected gradients."""
    apply = lambda x: np.bincount(index.ravel(), np.repeat(x, index.shape[1]), len(target)) * (np.arange(len(target)) > 0)
    back = lambda r: r[index].sum(axis=1)
    target = target.astype(float) * (np.arange(len(target)) > 0)
    v = np.ones(len(index))
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = back(apply(v))
        v /= np.linalg.norm(v)
    step = 0.9 / np.linalg.norm(back(apply(v)))
    x = y = np.zeros(len(index))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(apply(y) - target))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / after * (new - x), after
    return x


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of sequences that hold counts[n] pieces of each length n."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    free: list[int] = []  # the keys of room, sorted

    def put(lengths: tuple[int, ...], repeats: int) -> None:
        left = capacity - sum(lengths)
        if left not in room:
            room[left] = []
            insort(free, left)
        room[left].append((lengths, repeats))

    for n in range(capacity, 0, -1):
        todo = int(counts[n])
        while todo:
            at = bisect_left(free, n)
            if at == len(free):  # no sequence has room: new ones
                lengths, repeats, each = (), todo, capacity // n
            else:
                left = free[at]
                lengths, repeats = room[left].pop()
                if not room[left]:
                    del room[left], free[at]
                each = left // n
            if todo >= each:
                used = min(repeats, todo // each)
                put(lengths + (n,) * each, used)
                todo -= used * each
                rest = repeats - used
            else:
                put(lengths + (n,) * todo, 1)
                todo, rest = 0, repeats - 1
            if rest and lengths:
                put(lengths, rest)
    return [x for left in free for x in room[left]]


def plan(counts: np.ndarray, capacity: int, stride: int = 61, shares: tuple[float, ...] = (1.0, 0.5, 0.25, 0.1)) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of the sequences; counts[n] is the number of pieces of length n.

    Exact patterns leave little room for what the fit misses.  So the fit is
    rounded at several shares of its repeats, the residual of each is packed, and
    the plan of fewest sequences is taken; where the fit is good that is the
    whole fit.
    """
    index = patterns(capacity, stride)
    full = int(counts[capacity])
    rest = counts.astype(np.int64).copy()
    rest[capacity] = 0
    fit = nonnegative_least_squares(index, rest)
    order = np.argsort(-fit, kind="stable")
    best: list[tuple[tuple[int, ...], int]] | None = None
    for share in shares:
        left, out = rest.copy(), []
        for k in order:
            lengths = tuple(int(n) for n in index[k] if n)
            wanted = int(fit[k] * share + 0.5)
            if not wanted:
                break
            repeats = min(wanted, *(int(left[n]) // lengths.count(n) for n in lengths))
            if repeats:
                out.append((lengths, repeats))
                for n in lengths:
                    left[n] -= repeats
        out += best_fit_decreasing(left, capacity)
        if best is None or sum(many for _, many in out) < sum(many for _, many in best):
            best = out
    return [((capacity,), full), *best] if full else best


def places(sequences: list[tuple[tuple[int, ...], int]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: ranks from there on follow one sequence each."""
    used = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for lengths, repeats in sequences:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], base, offset))
            used[n] += repeats
            offset += n
        base += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str, *, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    pieces = scratch.table(tokenized(docs, path, capacity, with_ids).withColumn("_part", F.spark_partition_id()))
    counts = np.zeros(capacity + 1, np.int64)
    for n, many in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[n] = many
    found = places(plan(counts, capacity), capacity)
    shared = spark.sparkContext.broadcast(found)

    before = pieces.groupBy("length", "_part").count().select(
        F.col("length").alias("_l"),
        F.col("_part").alias("_p"),
        (F.sum("count").over(Window.partitionBy("length").orderBy("_part")) - F.col("count")).alias("_before"),
    )
    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p")))
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows = shared.value
        key = rows[:, 0] << 44 | rows[:, 1]
        at = np.searchsorted(key, length.to_numpy() << 44 | rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": rows[at, 2] + rank.to_numpy() - rows[at, 1], "offset": rows[at, 3]})

    out = ranked.withColumn("_place", place("length", "_rank"))
    ids = ["ids"] if with_ids else []
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset", *ids)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
