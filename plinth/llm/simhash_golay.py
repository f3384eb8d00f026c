"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits.  Two
fingerprints that differ in at most two bits have, by the pigeonhole principle,
an equal segment whose successor (in a circle) differs in at most one.  The
successor, as a word of the binary Golay code of length 23, is decoded to
nearby codewords: those at distance 3 or less, or, where the only one is at
distance 3, also the five at distance 4.  Words that differ in up to two bits
always share such a codeword, so segment and codeword index together make up
to six keys a segment, and each near pair shares a key.

Equal fingerprints are one fingerprint before the join.  Whoever shares a key
with another is verified by a second join that emits no pairs: fingerprints
differ in at most two bits if and only if both are within one bit of a common
centre, and all those around one centre are linked to the least of them.  That
is 65 rows for each such fingerprint, however many share its keys.

Two bits are few for copies that were edited.  With ``floor``, texts are also
linked whose sets of five-word runs have at least that Jaccard similarity.
Candidates share a band of a MinHash or, where that leaves them apart, a Golay
key of one of several further fingerprints, whatever their distance.  There is one path for groups of every
size: no pairs are formed within a group, but each member meets the group's
hubs, which are the text that shares most keys with others, by the sizes of
the groups (in a cluster of copies that is the text they were made from), and
the first by two hashed orders.  So candidates grow with the keys, and each is
verified by the exact sets.  Hubs join nearly all; like texts of which neither
is a hub, or that share no key, are found by an exact search among the texts
that are then still apart (``apart``), so that every link counts.

Edge cases: null, empty and blank texts have fingerprint zero and are linked
like any other; a text of one or two words has one shingle, the whole.  Repeated
rows each get a row.  A null doc_id is never the name of a component unless no
copy has another.  Equally well connected hubs are told apart by the hash of
their texts.  Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm._base import Scratch, table, text_key
from plinth.llm.graph import connected_components

#: Lowest bit and length of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101
#: Further fingerprints whose keys are grouped in one go, so that keys need little disk at a time.
AT_ONCE = 3
#: Hashed orders whose first member is a hub.
ORDERS = 2
#: Words of a run whose sets tell similarity, bands of the MinHash and minima in each: at 0.8 one pair in 2,500 shares no band.
RUN, BANDS, MINIMA = 5, 20, 5
#: Share of the runs that tells most texts without a partner; any is exact, a share over 1 - floor tells something.
SAMPLE = 0.35
_rng = np.random.default_rng(5)
FACTORS, SHIFTS = _rng.integers(0, 1 << 63, (2, BANDS * MINIMA), np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, shingle: int = 3, tables: int = 1) -> list[int]:
    """For each table the bits set in over half of the hashes of word shingles, as a signed long.

    The hashes of the first table are XXH64, those of others are mixed from them.
    """
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return [0] * tables
    runs = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(42)), np.uint64)
    out = []
    for t in range(tables):
        h = _mixed(hashes, t) if t else hashes
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0]))
    return out


def _mixed(h: np.ndarray, table: int) -> np.ndarray:
    h = h + np.uint64(table * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_set(text: str | None) -> np.ndarray:
    """Distinct hashes of the runs of RUN words; of the whole, where there are fewer words; none without words."""
    words = (text or "").encode().lower().split()
    runs = zip(*(words[k:] for k in range(RUN)), strict=False) if len(words) >= RUN else [words] * bool(words)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(42)), np.uint64))


def bands(text: str | None) -> list[int]:
    """A hash of each band of the text's MinHash, as a signed long; none without words."""
    hashes = run_set(text)
    if not len(hashes):
        return []
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at : at + 4096, None] * FACTORS + SHIFTS).min(axis=0))
    digests = [xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, MINIMA))]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def fingerprints(docs: DataFrame, shingle: int = 3, tables: int = 1, banded: bool = False) -> DataFrame:
    """doc_id, _key (of the text), fp (of the first table), more (those of the others, none without words) and bands (if banded) of every row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [fingerprint(t, shingle, tables) for t in b["text"]]
            cut = [bands(t) if banded else [] for t in b["text"]]
            more = [f[1:] if t and not t.isspace() else [] for f, t in zip(found, b["text"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "_key": b["_key"], "fp": [f[0] for f in found], "more": more, "bands": cut})

    # ids travel as text, so that nulls do not turn them into floats
    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_key(F.col("text")).alias("_key"), "text")
    out = d.mapInPandas(each, "doc_id string, _key long, fp long, more array<long>, bands array<long>")
    return out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), "_key", "fp", "more", "bands")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each single bit; for each syndrome what to add to a word to get its codewords, -1 for none."""

    def rest(v: int) -> int:
        for k in range(22, 10, -1):
            if v >> k & 1:
                v ^= GENERATOR << (k - 11)
        return v

    single = np.array([rest(1 << k) for k in range(23)])
    near = np.full((1 << 11, 6), -1, np.int32)
    near[0, 0] = 0
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            syndrome = int(np.bitwise_xor.reduce(single[list(bits)]))
            near[syndrome, 0] = sum(1 << k for k in bits)
    words = [m << 11 ^ rest(m << 11) for m in range(1 << 12)]
    for w in (w for w in words if w.bit_count() == 7):
        for bits in combinations([k for k in range(23) if w >> k & 1], 3):
            e = sum(1 << k for k in bits)
            row = near[int(np.bitwise_xor.reduce(single[list(bits)]))]
            row[np.argmax(row == -1)] = w ^ e
    return single, near


def golay_keys(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords near each word, six places each, -1 for none."""
    single, near = _golay()
    syndrome = np.zeros(len(words), np.int64)
    for k in range(23):
        syndrome ^= (words >> k & 1) * single[k]
    add = near[syndrome]
    return np.where(add < 0, -1, (words[:, None] ^ add) >> 11)


def segment_keys(fps: np.ndarray) -> np.ndarray:
    """The keys of each fingerprint, 18 places each, -1 for none."""
    u = fps.view(np.uint64)
    parts = [((u >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    out = []
    for i in range(3):
        near = golay_keys(parts[(i + 1) % 3])
        out.append(np.where(near < 0, -1, (i << 34) | (parts[i][:, None] << 12) | near))
    return np.concatenate(out, axis=1)


def keyed(fps: DataFrame) -> DataFrame:
    """The columns of fps, which are numbers, and key: a row for each key of each fingerprint fp."""
    names = fps.columns

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = segment_keys(b["fp"].to_numpy(np.int64))
            i, j = np.nonzero(keys >= 0)
            yield pd.DataFrame({c: b[c].to_numpy()[i] for c in names} | {"key": keys[i, j]})

    return fps.mapInPandas(each, ", ".join(f"{c} long" for c in names) + ", key long")


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of the distinct fp that join all fingerprints within two bits."""
    keys = scratch.table(keyed(fps.select("fp")))
    shared = scratch.table(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    # merged at every size: whether the shared keys are few enough to send depends on the input
    mates = keys.hint("merge").join(shared.select("key"), "key").select("fp").distinct()
    flip = lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))
    centres = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), flip))
    balls = scratch.table(mates.select("fp", F.explode(centres).alias("centre")))
    hubs = balls.groupBy("centre").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    hubs = scratch.table(hubs)
    stars = balls.join(hubs, "centre").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    out = scratch.table(stars.distinct())
    scratch.drop(keys, shared, balls, hubs)
    return out


def band_pairs(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(x, y), x < y: each text of rows (k, _key) with the hubs of the groups k that it is in; and (_key, weight) of the texts in groups."""
    rows = scratch.table(rows)
    sizes = scratch.table(rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))
    # merged, so that adaptive execution can split a group that a third of all texts share
    shared = scratch.table(rows.hint("merge").join(sizes, "k"))
    scratch.drop(rows, sizes)
    weight = scratch.table(shared.groupBy("_key").agg(F.sum("n").alias("weight")))
    order = lambda i: F.struct(F.xxhash64(F.lit(i), "_key").alias("order"), "_key")
    first = [F.min(order(i))["_key"] for i in range(ORDERS)]
    best = F.max(F.struct("weight", "_key"))["_key"]
    hubs = shared.hint("merge").join(weight, "_key").groupBy("k").agg(F.array_distinct(F.array(best, *first)).alias("hubs"))
    hubs = scratch.table(hubs)
    met = shared.hint("merge").join(hubs, "k").select("_key", F.explode("hubs").alias("hub")).where("_key <> hub")
    out = scratch.table(met.select(F.least("_key", "hub").alias("x"), F.greatest("_key", "hub").alias("y")).distinct())
    scratch.drop(shared, hubs)
    scratch.release()
    return out, weight


def golay_pairs(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): each rank of rows (k, rank, part) with two hubs of its group k, if it is of another part.

    Texts go by rank, a number that holds their weight and, below it, their
    hash, so that the one pass over all keys has only numbers to compare.  Hubs
    are the greatest rank and the greatest hash: of a group that is nearly all
    of one part both nearly always belong to it, and only the others meet them.
    """
    rows = scratch.table(rows)
    turned = F.shiftleft("rank", 20).bitwiseOR(F.shiftrightunsigned("rank", 44))
    back = F.shiftrightunsigned("any", 20).bitwiseOR(F.shiftleft("any", 44))
    ends = [F.min("part").alias("p"), F.max("part").alias("q"), F.max("rank").alias("most"), F.max(turned).alias("any")]
    mixed = rows.groupBy("k").agg(*ends).where("p < q").select("k", F.explode(F.array_distinct(F.array("most", back))).alias("hub"))
    mixed = scratch.table(mixed)
    parts = rows.select(F.col("rank").alias("hub"), F.col("part").alias("hub_part")).join(mixed.select("hub").distinct(), "hub", "left_semi")
    hubs = scratch.table(mixed.join(parts.distinct(), "hub"))
    # members of the hub's own part, which may be a third of all texts, are not even listed
    met = rows.hint("merge").join(hubs, (rows["k"] == hubs["k"]) & (rows["part"] != hubs["hub_part"]))
    out = scratch.table(met.select(F.least("rank", "hub").alias("a"), F.greatest("rank", "hub").alias("b")).distinct())
    scratch.drop(rows, mixed, hubs)
    scratch.release()
    return out


def run_sets(docs: DataFrame, fps: DataFrame, keys: DataFrame) -> DataFrame:
    """_key, fp and runs (their hashes) of the texts with these keys."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_key": b["_key"], "fp": b["fp"], "runs": [run_set(t).view(np.int64) for t in b["text"]]})

    # of equal texts one is read
    wanted = fps.join(keys, "_key", "left_semi").groupBy("_key").agg(F.min("doc_id").alias("one"), F.first("fp").alias("fp"))
    wanted = wanted.withColumnRenamed("_key", "wanted")
    d = docs.select(F.col("doc_id").alias("doc"), text_key(F.col("text")).alias("_key"), "text")
    d = d.join(wanted, (d["_key"] == wanted["wanted"]) & d["doc"].eqNullSafe(wanted["one"])).select("_key", "fp", "text")
    return d.mapInPandas(each, "_key long, fp long, runs array<long>").dropDuplicates(["_key"])


def sampled_sets(docs: DataFrame) -> DataFrame:
    """_key, n (the size of the set of runs) and runs, those of it whose hash is in the lowest SAMPLE, of each text with words."""

    def sample(text: str | None) -> tuple[int, np.ndarray]:
        runs = run_set(text)  # in order of the hashes
        return len(runs), runs[: np.searchsorted(runs, np.uint64(SAMPLE * 2.0**64))].view(np.int64).copy()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [sample(t) for t in b["text"]]
            yield pd.DataFrame({"_key": b["_key"], "n": [n for n, _ in found], "runs": [r for _, r in found]})

    d = docs.select(text_key(F.col("text")).alias("_key"), "text").mapInPandas(each, "_key long, n long, runs array<long>")
    return d.where("n > 0").groupBy("_key").agg(F.first("n").alias("n"), F.first("runs").alias("runs"))


def similar(docs: DataFrame, fps: DataFrame, met: DataFrame, floor: float, scratch: Scratch) -> DataFrame:
    """(a, b): first fingerprints of those pairs of texts (x, y) whose sets of runs have at least the similarity floor."""
    met = scratch.table(met)
    wanted = scratch.table(met.select(F.explode(F.array("x", "y")).alias("_key")).distinct())
    sets = scratch.table(run_sets(docs, fps, wanted))
    of = lambda side: sets.select(*[F.col(c).alias(f"{c}_{side}") for c in sets.columns])
    both = F.size(F.array_intersect("runs_x", "runs_y"))
    least = floor * (F.size("runs_x") + F.size("runs_y") - both)
    # sizes alone rule out most of the unlike
    alike = (F.size("runs_x") >= floor * F.size("runs_y")) & (F.size("runs_y") >= floor * F.size("runs_x"))
    near = met.join(of("x"), F.col("x") == F.col("_key_x")).join(of("y"), (F.col("y") == F.col("_key_y")) & alike).where(both >= least)
    out = scratch.table(near.where("fp_x <> fp_y").select(F.col("fp_x").alias("a"), F.col("fp_y").alias("b")).distinct())
    scratch.drop(met, wanted, sets)
    scratch.release()
    return out


def apart(docs: DataFrame, fps: DataFrame, known: DataFrame, floor: float, scratch: Scratch) -> DataFrame:
    """(x, y): texts that the known components (node, component) leave in different parts, among them every such pair with at least the similarity floor.

    Nothing here depends on groups, hubs or chance.  Like texts of two parts
    share floor of the runs of each, so whoever lacks more than the rest, among
    the runs that occur in two parts, has no partner; a sample of the runs tells
    that of most.  In an order of all runs, rare ones first, like texts share one
    of so many first runs as they may differ in, and one more (the prefix
    filter), and from the first that they share enough must be left.
    """
    parts = known.withColumnsRenamed({"node": "fp", "component": "part"})
    placed = fps.groupBy("_key").agg(F.first("fp").alias("fp")).join(parts, "fp", "left")
    placed = scratch.table(placed.select("_key", F.coalesce("part", "fp").alias("part")))
    spare = F.col("n") - F.ceil(F.col("n") * floor)
    ends = [F.min("part").alias("p"), F.max("part").alias("q")]

    some = scratch.table(sampled_sets(docs).join(placed, "_key"))
    rows = some.select("_key", "part", F.explode("runs").alias("run"))
    crossing = scratch.table(rows.groupBy("run").agg(*ends).where("p < q").select("run"))
    held = rows.hint("merge").join(crossing, "run", "left_semi").groupBy("_key").agg(F.count("*").alias("held"))
    open_ = some.join(held, "_key", "left").where(F.size("runs") - F.coalesce("held", F.lit(0)) <= spare).select("_key")
    open_ = scratch.table(open_)
    scratch.drop(some, crossing)

    sets = scratch.table(run_sets(docs, fps, open_).join(placed, "_key").select("_key", "part", F.size("runs").alias("n"), "runs"))
    rows = sets.select("_key", "part", "n", F.explode("runs").alias("run"))
    crossing = scratch.table(rows.groupBy("run").agg(*ends, F.count("*").alias("texts")).where("p < q").select("run", "texts"))
    shared = rows.hint("merge").join(crossing, "run")
    w = Window.partitionBy("_key")
    at = F.col("n") - F.count("*").over(w) + F.row_number().over(w.orderBy("texts", "run")) - 1
    first = scratch.table(shared.select("_key", "part", "n", "run", at.alias("at")).where(F.col("at") <= spare))
    scratch.drop(open_, placed, sets, crossing)
    scratch.release()

    # a pair of two parts has a member outside of any one part; that of a text by hash is nearly always the one that holds nearly all
    one = F.max(F.struct(F.xxhash64("run", "_key").alias("order"), "part"))["part"]
    main = scratch.table(first.groupBy("run").agg(*ends, one.alias("main")).where("p < q").select("run", "main"))
    of = lambda df, side: df.select("run", *[F.col(c).alias(f"{c}_{side}") for c in ("_key", "part", "n", "at")])
    others = of(first.hint("merge").join(main, "run").where("part <> main"), "x")
    left = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    enough = left >= floor * (F.col("n_x") + F.col("n_y") - left)
    sizes = (F.col("n_x") >= floor * F.col("n_y")) & (F.col("n_y") >= floor * F.col("n_x"))
    y = of(first, "y").withColumnRenamed("run", "run_y")
    met = others.hint("merge").join(y, (F.col("run") == F.col("run_y")) & (F.col("part_x") != F.col("part_y")) & sizes & enough)
    out = scratch.table(met.select(F.least("_key_x", "_key_y").alias("x"), F.greatest("_key_x", "_key_y").alias("y")).distinct())
    scratch.drop(first, main)
    scratch.release()
    return out


def similar_parts(docs: DataFrame, fps: DataFrame, known: DataFrame, tables: int, floor: float, scratch: Scratch) -> DataFrame:
    """(node, component) of first fingerprints by the known links (a, b) and the similarity of texts.

    Bands come first; Golay keys then propose only pairs that are still apart.
    What both leave apart is searched exactly, so that no link is lost.
    """
    texts = scratch.table(fps.groupBy("_key").agg(*[F.first(c).alias(c) for c in ("fp", "more", "bands")]))
    met, weight = band_pairs(texts.select(F.explode("bands").alias("k"), "_key"), scratch)
    whole = scratch.table(connected_components(known.unionByName(similar(docs, fps, met, floor, scratch)), scratch))
    if tables > 1:
        parts = whole.withColumnsRenamed({"node": "fp", "component": "part"})
        rank = F.least(F.coalesce("weight", F.lit(0)), F.lit((1 << 20) - 1)) * (1 << 43) + F.pmod(F.xxhash64("_key"), F.lit(1 << 43))
        placed = texts.join(parts, "fp", "left").join(weight, "_key", "left")
        placed = scratch.table(placed.select("_key", rank.alias("rank"), F.coalesce("part", "fp").alias("part"), "more"))
        pairs = None
        for t in range(0, tables - 1, AT_ONCE):
            some = placed.select("rank", "part", F.posexplode(F.slice("more", t + 1, AT_ONCE)).alias("t", "fp"))
            keys = keyed(some.select("rank", "part", (F.col("t") + t).cast("long").alias("t"), "fp"))
            now = golay_pairs(keys.select(F.xxhash64("t", "key").alias("k"), "rank", "part"), scratch)
            pairs = now if pairs is None else pairs.unionByName(now)
        of = lambda side, name: placed.select(F.col("rank").alias(side), F.col("_key").alias(name))
        met = pairs.distinct().join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
        whole = connected_components(similar(docs, fps, met.distinct(), floor, scratch), scratch, known=whole)
        scratch.drop(placed)
    scratch.drop(texts, weight)
    last = similar(docs, fps, apart(docs, fps, whole, floor, scratch), floor, scratch)
    return connected_components(last, scratch, known=whole)


def near_duplicates(docs: DataFrame, *, shingle: int = 3, tables: int = 1, floor: float | None = None, banded: bool = True) -> DataFrame:
    """doc_id, _key, fp, component (its least fingerprint) and component_id (its least doc_id) of every row.

    Texts are linked if their fingerprints differ in at most two bits.  With
    floor, texts whose five-word similarity reaches it are linked as well, all
    of them: first those that share a key of one of the tables beyond the first
    or, if banded, a band, then those that these leave apart.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.table(fingerprints(docs, shingle, tables if floor is not None else 1, banded and floor is not None))
    reps = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = links(reps, scratch)
    scratch.release()
    if floor is not None:
        parts = similar_parts(docs, fps, found, tables, floor, scratch)
        scratch.release()
    else:
        parts = connected_components(found, scratch)
    whole = reps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    whole = scratch.table(whole)
    names = scratch.table(whole.groupBy("component").agg(F.min("rep").alias("component_id")))
    whole = scratch.table(whole.join(names, "component").select("fp", "component", "component_id"))
    return fps.join(whole, "fp").select("doc_id", "_key", "fp", "component", "component_id")


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
