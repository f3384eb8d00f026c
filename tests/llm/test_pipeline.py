"""Each stage against what its operator decides, and the whole against the stages put together."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest

import corpus_pipeline as P
from plinth.llm._base import Scratch
from tests.llm.conftest import ROWS, SCHEMA, collected
from tests.llm.test_brute_force import BPE, brute_components, brute_fingerprint, brute_hits, brute_repeats, plain
from tests.oracle import SF

REGISTERED = P.TABLES


@pytest.fixture(autouse=True)
def few_tables(monkeypatch):
    """Two fingerprints do for what is tested here, and take less time."""
    monkeypatch.setattr(P, "TABLES", 2)


def test_stage_names_and_columns(spark, docs):
    assert [n for n, _ in P.STAGES] == ["quality rules", "near-dedup", "substring dedup", "decontamination", "packing"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_take_odd_columns_and_empty_tables(spark, docs, odd_docs, no_docs):
    for name, stage in P.STAGES:
        out = stage(spark, odd_docs, SF)
        assert collected(out.select(*stage(spark, docs, SF).columns).drop("sequence_id", "offset")) == collected(stage(spark, docs, SF).drop("sequence_id", "offset")), name
        if name != "packing":
            assert out.columns == odd_docs.columns
        assert stage(spark, no_docs, SF).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark, docs):
    rows = P.near_dedup(spark, docs, SF).collect()
    texts = [r.text for r in rows]
    blank = [t for t in texts if not plain(t)]
    assert len(blank) == 1  # null, empty and blank texts are copies of each other
    assert texts.count("one two") == 1 and sum(r.doc_id == 8 for r in rows) == 2
    assert sorted(r.doc_id for r in rows if r.text == ROWS[0][1]) == [1]
    assert sum(r.doc_id is None for r in rows) == 1


def test_substrings_and_decontamination(spark, docs):
    got = {(r.doc_id, r.text): r for r in P.substrings(spark, docs, SF).collect()}
    want = brute_repeats([(r[0], r[1]) for r in ROWS], 35)
    gone = [w[0] for w in want if w[2] and w[1] == w[2]]
    assert gone and not any(r.doc_id in gone and plain(r.text) for r in got.values() if r.doc_id in (1, 2))
    assert (4, None) in got and (5, "") in got  # nothing goes from texts without words
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    d = spark.read.parquet(f"{SF}/documents.parquet")
    hit = {r[0] for r in brute_hits([(r.doc_id, r.text) for r in d.collect()], items) if r[5]}
    kept = {r.doc_id for r in P.decontaminated(spark, d, SF).collect()}
    assert kept == {r.doc_id for r in d.collect()} - hit


def test_run_is_the_stages_in_turn(spark):
    docs, scratch = spark.read.parquet(f"{SF}/documents.parquet"), Scratch(spark)
    for _, stage in P.STAGES:
        docs = scratch.table(stage(spark, docs, SF))
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert collected(P.run(spark, SF).select(keys)) == collected(docs.select(keys))
    assert docs.count() > 0 and re.fullmatch("doc_id long.*", SCHEMA)


def edited(rng, words, share):
    """The words with some changed in place, until the five-word similarity to the original is just over the share."""
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    out = list(words)
    while True:
        before = list(out)
        out[rng.randrange(len(out))] = "".join(rng.choice("aeiourstln") for _ in range(6))
        a, b = runs(words), runs(out)
        if len(a & b) < share * len(a | b):
            return before


def test_run_equals_a_plain_chain(spark, monkeypatch):
    """With the registered number of tables: all stages but the verdicts of the first, in plain Python."""
    monkeypatch.setattr(P, "TABLES", REGISTERED)
    from tokenizers import Tokenizer

    docs = [(r.doc_id, r.text) for r in P.quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()]
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for _, t in docs]
    runs = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in map(plain, low)]
    fps = [brute_fingerprint(t) for _, t in docs]
    alike = lambda a, b: len(runs[a] & runs[b]) >= P.SIMILAR * len(runs[a] | runs[b]) or (fps[a] ^ fps[b]).bit_count() <= 2
    parts = brute_components(range(len(docs)), [(a, b) for a, b in combinations(range(len(docs)), 2) if alike(a, b)])
    least = {}
    for i, c in parts.items():
        least[c] = min(least.get(c, docs[i]), docs[i])
    docs = sorted(least.values())
    seen = Counter(tuple(w[i : i + 35]) for _, t in docs for w in [plain(t)] for i in range(len(w) - 34))
    kept = []
    for d, t in docs:
        w = plain(t)
        gone = {j + k for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(35)}
        if not gone or len(gone) < len(w):
            kept.append((d, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in brute_hits(kept, items) if r[5]}
    coder = Tokenizer.from_file(BPE)
    want = {d: len(coder.encode(t, add_special_tokens=False).ids) + 1 for d, t in kept if d not in hit}
    got = Counter()
    for r in P.run(spark, SF).collect():
        got[r.doc_id] += r.length
    assert dict(got) == want and len(want) < 200


@pytest.mark.parametrize("share", [0.8, 0.9, 0.5])
def test_near_dedup_merges_edited_copies(spark, share, monkeypatch):
    """With the registered similarity and tables; unrelated texts and copies of half the text stay."""
    monkeypatch.setattr(P, "TABLES", REGISTERED)
    rng = random.Random(int(share * 100))
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(3, 8)))
    rows = []
    for i in range(40):
        w = [word() for _ in range(300)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(edited(rng, w, share)))]
    kept = {r.doc_id for r in P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert kept >= {d for d, _ in rows if d % 2 == 0}
    if share >= P.SIMILAR:
        assert len(kept) == 40
    else:
        assert len(kept) > 70


def test_near_dedup_merges_copies_of_which_neither_is_a_hub(spark, monkeypatch):
    """All texts share one band: three hubs meet every text, so copies of the others must be found without them."""
    monkeypatch.setattr(P, "TABLES", 1)
    monkeypatch.setattr(P.simhash_golay, "bands", lambda text: [7])
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(3, 8)))
    line = [word() for _ in range(20)]
    rows = []
    for i in range(30):
        w = [word() for _ in range(120)] + line
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(edited(rng, w, P.SIMILAR)))]
    kept = {r.doc_id for r in P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert kept == {d for d, _ in rows if d % 2 == 0}
