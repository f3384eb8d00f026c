import random

import pytest
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.functions.udfs import masked, nfkc
from plinth.operators import dataset as D
from plinth.operators import evaluate as E
from plinth.operators import evidence as V
from plinth.operators import layout as L
from plinth.operators import retrieve as R
from plinth.operators import segment as S


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_white_space_is_unicode(spark):
    assert column(spark, ["a　 b c\n", None, "  "], T.squeeze) == ["a b c", "", ""]
    assert column(spark, ["a　 b", None], T.unspaced) == ["ab", ""]


def test_normalizer(spark):
    assert column(spark, ["말했다.8)9) “인용” — 끝", "식", None], T.normalized) == ['말했다. "인용" - 끝', "□식", ""]
    assert column(spark, ["１２", None], lambda c: nfkc(c)) == ["12", None]


def test_headings(spark):
    cases = ["2) 항구 도시의 음악", "3. 강변에서", "가. 소제목", "1) 이것은 문장이다.", "그냥 글", "1. " + "x" * 60]
    assert column(spark, cases, T.is_heading) == [True, True, True, False, False, False]


def test_brackets_and_ends(spark):
    assert column(spark, ["(열린", "(닫힌)", "“하나", ""], T.is_unbalanced) == [True, False, True, False]
    assert column(spark, ["끝났다. ", "끝나지", "정말?"], T.is_finished) == [True, False, True]


def test_bigrams_of_short_texts(spark):
    assert column(spark, ["", "a", "a b", "abab", None], T.bigrams) == [[], [], ["ab"], ["ab", "ba"], []]


def test_masked_dots_keep_length():
    for t, n in [("see p. 5 and pp. 6-7.", 2), ("et al. said 3.5 in 1995.12.6.", 5), ("A. Miller.", 1), ("plain.", 0)]:
        assert len(masked(t)) == len(t) and masked(t).count("\0") == n, t


@pytest.mark.parametrize("n", range(7))
def test_windows_cover(spark, n):
    docs = spark.createDataFrame([(1, " ".join(f"s{i} x." for i in range(n)))], "doc_id long, text string")
    for w in (3, 5):
        got = S.passages(docs, w).orderBy("ord").collect()
        assert len(got) == (0 if n == 0 else max(1, n - w + 1))
        assert [r.span_id for r in got] == [f"w{w}_{i:03d}" for i in range(1, len(got) + 1)]
        seen = [i for r in got for i in r.sent_ids]
        assert set(seen) == {f"s{i:03d}" for i in range(1, n + 1)}


def merged(rows):
    out = []
    for p, text, head in rows:
        if out and out[-1][0] == p and not head and not out[-1][2]:
            before = out[-1][1]
            odd = any(before.count(a) != before.count(b) for a, b in T.PAIRS)
            if len(text) < 6 or odd or not before.endswith(tuple(T.ENDINGS)):
                out[-1] = (p, before + " " + text, False)
                continue
        out.append((p, text, head))
    return out


def test_sentence_merge_equals_loop(spark):
    rng = random.Random(7)
    pieces = ["짧.", "(열린 괄호가 있다", "닫힌다)", "이것은 문장이다.", "끝나지 않은 조각", "Is it done?", "2. 제목", "ok"]
    rows, want = [], {}
    for d in range(30):
        own = [(rng.randint(0, 2), rng.choice(pieces)) for _ in range(rng.randint(0, 9))]
        own = [(p, t, t.startswith("2.")) for p, t in sorted(own, key=lambda x: x[0])]
        rows += [(d, p, i, t, h) for i, (p, t, h) in enumerate(own)]
        want[d] = [t for _, t, _ in merged(own)]
    got = S.merged_sentences(spark.createDataFrame(rows, "doc_id long, paragraph int, ord int, text string, is_heading boolean"))
    found = {}
    for r in got.orderBy("doc_id", "ord").collect():
        found.setdefault(r.doc_id, []).append(r.text)
    assert found == {d: t for d, t in want.items() if t}


def test_sentence_merge_needs_no_shuffle(spark):
    """The query folds arrays of whole documents and gives what rows of sentences give; so do pieces of few sentences."""
    from plinth.plans.documents import sentence_merge
    from tests.oracle import SF

    q = sentence_merge(spark, SF)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FlatMapGroupsInPandas" not in plan
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {tuple(r) for r in q.collect()}
    assert got == {tuple(r) for r in S.merged_sentences(S.paragraph_sentences(docs)).collect()} and len(got) > 1000
    assert got == {tuple(r) for r in S.merged_arrays(S.paragraph_arrays(docs), most=5).collect()}
    raw = {}
    for r in S.paragraph_sentences(docs).orderBy("doc_id", "ord").collect():
        raw.setdefault(r.doc_id, []).append((r.paragraph, r.text, r.is_heading))
    assert got == {(d, p, n, t, h) for d, own in raw.items() for n, (p, t, h) in enumerate(merged(own), 1)}


def test_sentence_merge_of_one_long_open_bracket(spark):
    """A bracket that never closes: many thousand parts of one sentence, each looked at once; blank parts keep the end before."""
    parts = ["(open."] + ["more of it here."] * 60_000
    schema = "doc_id int, sents array<struct<paragraph:int,text:string,is_heading:boolean>>"
    rows = [(1, [(0, t, False) for t in parts]), (2, [(0, "End.", False), (0, "\t", False), (0, "Another one.", False)]), (3, [])]
    got = {(r.doc_id, r.ord): r.text for r in S.merged_arrays(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 1): " ".join(parts), (2, 1): "End. \t", (2, 2): "Another one."}


def test_fusion_ties_go_to_the_first_run(spark):
    a = spark.createDataFrame([("c", "p1", 1), ("c", "p2", 2)], "claim_id string, passage_id string, rank int")
    b = spark.createDataFrame([("c", "p3", 1), ("c", "p2", 2)], "claim_id string, passage_id string, rank int")
    got = [r.passage_id for r in R.fused([(a, 0.5), (b, 0.5)]).orderBy("rank").collect()]
    assert got == ["p2", "p1", "p3"]
    assert [r.passage_id for r in R.fused([(a, 0.3), (b, 0.7)]).orderBy("rank").collect()] == ["p2", "p3", "p1"]


def test_nearest_in_blocks_equals_all_pairs(spark):
    """Blocks of few rows, of one scope and with many equal vectors, give what all pairs ranked give."""
    rng = random.Random(8)
    vecs = [[rng.choice([0.0, 0.6, 0.8, -0.6]) for _ in range(4)] for _ in range(120)]
    rows = [(i % 7 // 5, f"v{i}", i, v) for i, v in enumerate(vecs)] + [(2, "v900", 900, vecs[0]), (3, "v901", 901, vecs[1]), (3, "v902", 902, vecs[1])]
    p = spark.createDataFrame(rows, "label int, passage_id string, ord long, vec array<float>")
    c = p.where("ord % 3 = 0 OR ord = 901").select("label", F.replace("passage_id", F.lit("v"), F.lit("q")).alias("claim_id"), "ord", "vec")
    scores = R.cosine(c, p, "label").where(F.substr("claim_id", F.lit(2)) != F.substr("passage_id", F.lit(2)))
    want = sorted(map(tuple, R.ranked(scores, 5).collect()))
    for block in (1, 4, 1024):
        got = R.nearest(c, p, "label", 5, block=block)
        assert sorted(map(tuple, got.select("claim_id", "passage_id", "ord", "score", "rank").collect())) == want and len(want) > 190
    # a scope is dealt over many tasks
    assert "CoGroup" in got._jdf.queryExecution().executedPlan().toString()


def test_feature_vectors_take_candidates_in_blocks(spark):
    """The candidates of feature_vector come by the step of dense_label_top5, which holds no whole label in a task."""
    from plinth.plans.retrieval import feature_vector
    from tests.oracle import SF

    assert "CoGroup" in feature_vector(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_zero_scores_are_ranked(spark):
    claims = spark.createDataFrame([(1, "c", "apple")], "s int, claim_id string, claim_text string")
    passages = spark.createDataFrame([(1, "a", 1, "pear"), (1, "b", 2, "apple pie"), (2, "x", 1, "apple")], "s int, passage_id string, ord int, text string")
    got = [(r.passage_id, r.rank) for r in R.ranked(R.bm25(claims, passages, "s"), 20).orderBy("rank").collect()]
    assert got == [("b", 1), ("a", 2)]


def test_overlapping_windows_can_be_dropped(spark):
    run = spark.createDataFrame([("c", "a", 1), ("c", "b", 2), ("c", "d", 3)], "claim_id string, passage_id string, rank int")
    spans = spark.createDataFrame([("a", ["s1", "s2"]), ("b", ["s2", "s3"]), ("d", ["s9"])], "passage_id string, sent_ids array<string>")
    assert {r.passage_id for r in R.without_overlaps(run, spans).collect()} == {"a", "d"}


def test_evidence_stages(spark):
    sents = spark.createDataFrame([(1, ["첫 문장이 여기 있다.", "둘째 문장은 다른 말을 한다.", "셋째로 끝난다."])], "doc_id int, sents array<string>")
    ev = [(1, "문장은 다른 말을 한다. 셋째로"), (2, "둘째문장은 다른말을 한다."), (3, "둘째 문장은 딴 말을 한다."), (4, "전혀 다른 내용이며 없다"), (5, "")]
    e = spark.createDataFrame(ev, "item_id int, evidence string")
    pairs = e.select("item_id").withColumn("doc_id", F.lit(1))
    got = {r.item_id: (r.method, r.n, r.first) for r in V.find(pairs, e, sents, "doc_id").collect()}
    assert got[1] == ("exact", 2, 2) and got[2] == ("nospace", 1, 2) and got[3] == ("fuzzy", 1, 2)
    assert got[4][0] == got[5][0] == "none"


def test_evidence_is_found_whatever_the_spacing(spark):
    """Every pair that brute force finds, also where spacing differs within words and for items of one or two words."""
    docs = [(1, ["aa b bb cc dd."]), (2, ["xx aabbb cc", "dd ee."]), (3, ["foo.", "bar baz qux."]), (4, ["a long evidence of sev", "eral words stands here"]), (5, ["𝒳𝒴 한국 어"]), (6, [])]
    items = ["aa bbb cc", "aabbb", "cc dd", "foo. bar baz", "longevidence of several wordsstands", "a long evidence of sev eral", "qux.", "a", "한국어", "𝒴 한", "", None, "not there at all, in none of them"]
    sents = spark.createDataFrame(docs, "doc_id int, sents array<string>")
    e = spark.createDataFrame(list(enumerate(items)), "item_id int, evidence string")
    groups = V.sentence_groups(sents, "doc_id")
    runs = [(d, " ".join(s[i : i + n])) for d, s in docs for n in (1, 2, 3) for i in range(len(s) - n + 1)]
    for unspaced, pairs in ((False, V.candidates(e, sents)), (True, V.unspaced_candidates(e, sents))):
        form = (lambda x: "".join(x.split())) if unspaced else (lambda x: " ".join(x.split()))
        got = {(r.item_id, r.doc_id) for r in V.first_group(pairs, e, groups, "doc_id", unspaced=unspaced).collect()}
        assert got == {(i, d) for i, x in enumerate(items) if x for d, t in runs if form(x) in form(t)}, unspaced
    assert V.unspaced_candidates(e.where("item_id > 99"), sents).count() == 0


def test_evidence_in_arrays_equals_groups(spark):
    """The search in arrays finds what rows of groups give, whether or not hashes are sent ahead, and for runs of every length."""
    from plinth.plans.documents import evidence_nospace
    from tests.oracle import SF

    words = ["ab", "c", "def", "한국", "é"]
    rng = random.Random(4)
    docs = [(d, [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) + "." for _ in range(rng.randint(0, 6))]) for d in range(40)]
    items = [(0, ""), (1, None), (2, "zz"), (3, "é")]
    for i, (_, s) in enumerate(docs):
        t = " ".join(s)
        a = rng.randint(0, max(len(t) - 1, 0))
        items.append((4 + i, t[a : a + rng.randint(1, 40)].strip()))
    sents = spark.createDataFrame(docs, "doc_id int, sents array<string>")
    e = spark.createDataFrame(items, "item_id int, evidence string")
    groups = V.sentence_groups(sents, "doc_id")
    every = e.select("item_id").crossJoin(sents.select("doc_id"))
    for unspaced in (False, True):
        want = sorted(map(tuple, V.first_group(every, e, groups, "doc_id", unspaced=unspaced).collect()))
        for pairs in (every, V.unspaced_candidates(e, sents), V.unspaced_candidates(e, sents, most=0)):
            assert sorted(map(tuple, V.first_group_in(pairs, e, sents, "doc_id", unspaced=unspaced).collect())) == want and len(want) > 40
    # no rows of groups or of characters of documents any more
    plan = evidence_nospace(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_evidence_of_the_review(spark):
    """Spacing that differs at the longest word, and evidence of two words."""
    docs = [(1, ["alpha beta gamma delta omega"]), (2, ["alpha betagamma delta omega"])]
    sents = spark.createDataFrame(docs, "doc_id int, sents array<string>")
    e = spark.createDataFrame([(1, "alpha betagamma delta omega"), (2, "beta gamma")], "item_id int, evidence string")
    got = V.first_group(V.unspaced_candidates(e, sents), e, V.sentence_groups(sents, "doc_id"), "doc_id", unspaced=True)
    assert {(r.item_id, r.doc_id) for r in got.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_evidence_equals_loop_over_random_spacing(spark):
    rng = random.Random(9)
    letters = "abc"
    docs = [(d, ["".join(rng.choice(letters + "  ") for _ in range(rng.randint(1, 25))).strip() or "x" for _ in range(rng.randint(0, 4))]) for d in range(40)]
    whole = [t for _, s in docs for t in s]
    items = []
    for i in range(60):
        t = rng.choice(whole)
        a = rng.randrange(len(t))
        piece = t[a : a + rng.randint(1, 18)]
        items.append((i, "".join(c + " " * (rng.random() < 0.2) for c in piece if c != " " or rng.random() < 0.8)))
    sents = spark.createDataFrame(docs, "doc_id int, sents array<string>")
    e = spark.createDataFrame(items, "item_id int, evidence string")
    runs = [(d, " ".join(s[i : i + n])) for d, s in docs for n in (1, 2, 3) for i in range(len(s) - n + 1)]
    for unspaced, pairs in ((False, V.candidates(e, sents)), (True, V.unspaced_candidates(e, sents))):
        form = (lambda x: "".join(x.split())) if unspaced else (lambda x: " ".join(x.split()))
        got = {(r.item_id, r.doc_id) for r in V.first_group(pairs, e, V.sentence_groups(sents, "doc_id"), "doc_id", unspaced=unspaced).collect()}
        assert got == {(i, d) for i, x in items for d, t in runs if form(x) and form(x) in form(t)}, unspaced


def test_evidence_in_parts(spark):
    sents = spark.createDataFrame([(1, ["첫 문장이 여기 있다.", "둘째 문장은 다른 말을 한다.", "셋째로 끝난다."])], "doc_id int, sents array<string>")
    ev = [(1, "셋째로 끝난다. || 첫 문장이"), (2, "첫문장이 || 둘째 문장은"), (3, "첫 문장이 || 전혀 다른 내용이며 없다"), (4, "첫 문장이"), (5, " || "), (6, "첫문장이여기 || 둘째 문장은 딴 말을 한다.")]
    e = spark.createDataFrame(ev, "item_id int, evidence string")
    got = {r.item_id: (r.method, r.sent_ns) for r in V.find_parts(e.select("item_id").withColumn("doc_id", F.lit(1)), e, sents, "doc_id").collect()}
    assert got == {1: ("exact", [3, 1]), 2: ("nospace", [1, 2]), 3: ("none", [1]), 4: ("exact", [1]), 5: ("none", []), 6: ("fuzzy", [1, 2])}


def test_fuzzy_evidence_equals_loop(spark):
    from difflib import SequenceMatcher

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeg") for _ in range(rng.randint(1, 5)))
    docs = {d: [" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 5))] for d in range(12)}
    items = {}
    for i in range(25):
        own = rng.choice([s for s in docs.values() if s])
        t = rng.choice(own)
        items[i] = "".join(c for c in t if rng.random() < 0.9) or "q"
    pairs = [(i, d) for i in items for d in docs if rng.random() < 0.4]

    def loop(text, sents):
        groups = [(n, k + 1, " ".join(sents[k : k + n])) for n in (1, 2, 3) for k in range(len(sents) - n + 1)]
        for name, form in (("exact", lambda x: " ".join(x.split())), ("nospace", lambda x: "".join(x.split()))):
            for n, k, g in groups:
                if form(text) and form(text) in form(g):
                    return name, n, k
        best = (0.0, None, None)
        for n, k, g in groups:
            r = SequenceMatcher(None, "".join(text.split()), "".join(g.split())).ratio()
            if r > best[0]:
                best = (r, n, k)
        return ("fuzzy", *best[1:]) if best[0] >= 0.6 else ("none", None, None)

    e = spark.createDataFrame(list(items.items()), "item_id int, evidence string")
    s = spark.createDataFrame(list(docs.items()), "doc_id int, sents array<string>")
    p = spark.createDataFrame([(i, d) for i, d in pairs if docs[d]], "item_id int, doc_id int")
    got = {(r.item_id, r.doc_id): (r.method, r.n, r.first) for r in V.find(p, e, s, "doc_id", floor=0.6).collect()}
    assert got == {(i, d): loop(items[i], docs[d]) for i, d in pairs if docs[d]}


def test_verdicts_find_each_claim_once(spark):
    gold = spark.createDataFrame([(1, "a", "하나 둘"), (2, "b", "셋"), (3, "c", "하나  둘"), (4, "d", "‘넷’")], "ord int, claim_id string, claim_text string")
    rows = [(1, "x", "하나 둘"), (2, "y", "하나둘"), (3, "b", "다른"), (4, "z", "셋"), (5, "w", "'넷'"), (6, "v", "없음"), (7, "a", "")]
    got = {r.verdict_id: (r.how, r.gold_id) for r in D.match_verdicts(spark.createDataFrame(rows, "ord int, verdict_id string, claim_text string"), gold).collect()}
    assert got == {"x": ("claim_text", "a"), "y": ("none", None), "b": ("claim_id", "b"), "z": ("none", None), "w": ("claim_text", "d"), "v": ("none", None), "a": ("claim_id", "a")}


def test_resamples_draw_as_many_as_there_are(spark):
    rng = random.Random(2)
    rows = [(f"d{d}", t, t if rng.random() < 0.6 else rng.choice(E.LABELS)) for d in range(17) for t in E.LABELS for _ in range(2)]
    df = spark.createDataFrame(rows, "doc string, truth string, predicted string")
    draws = E.bootstrap_draws(df.select(F.col("doc").alias("name")).distinct(), 40, 0).collect()
    by = {}
    for r in draws:
        by.setdefault(r.resample, {})[r.name] = r.times
    assert len(by) == 40 and all(sum(t.values()) == 17 for t in by.values()) and len({tuple(sorted(t.items())) for t in by.values()}) > 35

    def macro(times):
        out = 0
        for x in E.LABELS:
            tp = sum(times.get(d, 0) for d, t, p in rows if t == p == x)
            either = sum(times.get(d, 0) * ((t == x) + (p == x)) for d, t, p in rows)
            out += 2 * tp / either if either else 0
        return out / 4

    import numpy as np

    ci = E.bootstrap_macro_f1(df, "doc", resamples=40).first()
    want = np.percentile([macro(t) for t in by.values()], [2.5, 97.5])
    assert abs(ci.low - want[0]) < 2e-6 and abs(ci.high - want[1]) < 2e-6


def test_leak_guard_raises(spark):
    df = spark.createDataFrame([("a",), (None,)], "source string")
    assert D.no_leak(df, F.col("source") == "b").count() == 2
    with pytest.raises(ValueError):
        D.no_leak(df, F.col("source") == "a")


def test_labels(spark):
    cases = ["근거있음", " Supported ", "NaN", "", None, "그 밖에"]
    assert column(spark, cases, E.canonical_label) == ["근거 있음", "근거 있음", None, None, None, None]


def test_claims_without_a_run_do_not_count(spark):
    gold = spark.createDataFrame([("c1", "p1"), ("c2", "p9"), ("c3", "p1")], "claim_id string, passage_id string")
    run = spark.createDataFrame([("m", "c1", "p0", 1), ("m", "c1", "p1", 2), ("m", "c2", "p1", 1)], "method string, claim_id string, passage_id string, rank int")
    r = E.recall_and_mrr(E.first_ranks(gold, run, ["method"]), ["method"]).first()
    assert (r.n, r.recall_1, r.recall_3, r.mrr) == (2, 0.0, 0.5, 0.25)


def test_macro_f1_counts_absent_labels(spark):
    rows = spark.createDataFrame([("무근거", "무근거"), ("무근거", "모순")], "truth string, predicted string")
    assert abs(E.summary(rows, []).first().macro_f1 - (2 / 3) / 4) < 1e-6


def test_bootstrap_brackets_the_estimate(spark):
    rng = random.Random(1)
    rows = [(d, t, t if rng.random() < 0.7 else rng.choice(E.LABELS)) for d in range(60) for t in E.LABELS for _ in range(3)]
    df = spark.createDataFrame(rows, "doc int, truth string, predicted string")
    ci, point = E.bootstrap_macro_f1(df, "doc", resamples=300).first(), E.summary(df, []).first().macro_f1
    assert ci.low < point < ci.high and ci.high - ci.low < 0.2


def test_upsert_and_first_source(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert {tuple(r) for r in D.upsert(old, new, "k").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {tuple(r) for r in D.first_source([old, new], "k").collect()} == {("a", 1), ("b", 2), ("c", 4)}


def test_candidates_by_suffix_and_place(spark):
    claims = spark.createDataFrame([("d", "x_s01_c01", 1), ("d", "y_s01_c02", 2), ("e", "q", 1)], "deck string, claim_id string, ord int")
    runs = spark.createDataFrame([("d", "x_s01_c01", 1), ("d", "z_s01_c02", 2), ("d", "w", 3), ("e", "r", 1)], "deck string, claim_id string, ord int")
    got = {r.claim_id: (r.run_id, r.how) for r in D.with_candidates(claims, runs).collect()}
    assert got == {"x_s01_c01": ("x_s01_c01", "id"), "y_s01_c02": ("z_s01_c02", "suffix"), "q": ("r", "place")}


def test_shape_without_title(spark):
    items = spark.createDataFrame([("d", 1, 1, "12", 100, 0, 10, 10, 40.0, "text", 1000, 1000)], "deck_id string, slide int, item_id int, text string, top int, left int, width int, height int, font_size double, source_type string, slide_width int, slide_height int")
    assert L.titles(items).count() == 0
    assert L.tagged(items).count() == 1


def test_rules_for_ends_see_last_line_breaks(spark):
    """As in SQL, an end is the end of the text, not the place before a last line break."""
    schema = "deck_id string, slide int, item_id int, text string, top int, left int, width int, height int, font_size double, source_type string, slide_width int, slide_height int"
    texts = ["Title", "a.", "a.\n", "12%\n", "7\n", "1 / 2\u2028"]
    rows = [("d", 1, i, t, 990 if i else 0, 900 - i, 10, 10, 10.0 if i else 40.0, "text", 1000, 1000) for i, t in enumerate(texts)]
    items = spark.createDataFrame(rows, schema)
    assert {r.item_id for r in L.without_page_numbers(items).collect()} == {0, 1, 2, 3, 4, 5}
    assert [r.tag for r in L.tagged(items).orderBy("item_id").collect()][:4] == ["제목", "카드본문", "본문", "본문"]
    low = spark.createDataFrame([("d", 1, 0, "목차\n", 0, 0, 10, 10, 40.0, "text", 1000, 1000), ("d", 1, 1, "x", 500, 1, 10, 10, 10.0, "text", 1000, 1000), ("e", 1, 0, "12\n", 0, 0, 10, 10, 40.0, "text", 1000, 1000)], schema)
    assert L.titles(low).count() == 2
    assert {r.tag for r in L.tagged(low.where("deck_id = 'd'")).collect()} == {"제목", "본문"}
    assert column(spark, ["a 12", "a 12\r"], T.is_running_head) == [True, False]


def test_line_clusters_compare_with_the_first(spark):
    f = [("d", 1, float(x), y, t, False, 300.0) for x, y, t in [(1, 10.0, "a"), (2, 8.0, "b"), (3, 6.5, "c")]]
    df = spark.createDataFrame(f, "doc_id string, page int, x double, y double, text string, rotated boolean, gutter double")
    assert [r.text for r in S.clustered_lines(df).orderBy("line").collect()] == ["ab", "c"]


def test_line_clusters_equal_loop(spark):
    from plinth.plans.pages import fragments
    from tests.oracle import SF

    want = []
    sides = {}
    for r in fragments(spark, SF).collect():
        if not r.rotated:
            sides.setdefault((r.doc_id, r.page, int(r.x >= r.gutter)), []).append(r)
    for (doc, page, side), own in sides.items():
        lines = []
        for r in sorted(own, key=lambda r: (-r.y, r.x)):
            if lines and abs(lines[-1][0] - r.y) <= 2.5:
                lines[-1][1].append(r)
            else:
                lines.append((r.y, [r]))
        k = 0
        for _, parts in lines:
            parts.sort(key=lambda r: r.x)
            text = " ".join("".join(r.text for r in parts).split())
            if text:
                k += 1
                want.append((doc, page, side, k, round(parts[0].x), text))
    got = [tuple(r) for r in S.clustered_lines(fragments(spark, SF)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 1000


def test_line_clusters_need_no_shuffle(spark):
    """The query folds arrays of whole documents, in Python for many page sides at once, and gives the lines that rows give."""
    from plinth.plans.pages import fragments, line_cluster
    from tests.oracle import SF

    q = line_cluster(spark, SF)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FlatMapGroupsInPandas" not in plan
    assert sorted(map(tuple, q.collect())) == sorted(map(tuple, S.clustered_lines(fragments(spark, SF)).collect()))


def test_line_clusters_in_small_pieces(spark):
    """Pages of many heights, blank fragments and equal places, in pieces of a few fragments."""
    rng = random.Random(3)
    schema = "doc_id string, parts array<struct<page:int,side:int,x:double,y:double,text:string>>"
    docs = []
    for d in range(40):
        parts = [(rng.randint(1, 3), rng.randint(0, 1), float(rng.randint(0, 9)), rng.randint(0, 40) / 2, rng.choice(["a ", "b", " ", "", "c\n"])) for _ in range(rng.randint(0, 30))]
        docs.append((f"d{d}", parts))
    want = []
    for doc, parts in docs:
        for page, side in sorted({p[:2] for p in parts}):
            lines = []
            for p in sorted([p for p in parts if p[:2] == (page, side)], key=lambda p: (-p[3], p[2])):
                if lines and lines[-1][0][3] - p[3] <= 2.5:
                    lines[-1].append(p)
                else:
                    lines.append([p])
            lines = [sorted(x, key=lambda p: p[2]) for x in lines]
            texts = [(round(x[0][2]), " ".join("".join(p[4] for p in x).split())) for x in lines]
            want += [(doc, page, side, n, i, t) for n, (i, t) in enumerate([x for x in texts if x[1]], 1)]
    got = S.lines_of_parts(spark.createDataFrame(docs, schema), most=7).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_body_clean_equals_python(spark):
    import re
    import unicodedata

    from plinth.plans.pages import body_clean
    from tests.oracle import SF

    private = re.compile("[\ue000-\uf8ff\U000f0000-\U0010fffd]")
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        t = private.sub("□", unicodedata.normalize("NFKC", r.text)).translate(str.maketrans(*T.LOOKALIKES))
        n = " ".join(re.sub(r"""(?<=[가-힣.'")])\d{1,2}\)""", "", t).split())
        c = private.sub("□", r.text.translate(str.maketrans("․∙． ", "··. ")))
        c = re.sub(r"""(?<=[가-힣.’”"')])(\d{1,2})\)""", "", c)
        c = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", c)).strip(" ")
        want[r.doc_id] = (len(n), len(n.replace(" ", "")), len(c), masked(r.text).count("\0"))
    got = {r.doc_id: (r.n_normalized, r.n_unspaced, r.n_clean, r.n_masked) for r in body_clean(spark, SF).collect()}
    assert got == want


def test_macro_f1_of_models_equals_loop(spark):
    from plinth.operators.models import macro_f1

    rows = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 1.0), (1.0, 1.0)]
    want = []
    for k in (0.0, 1.0, 2.0):
        tp = sum(a == b == k for a, b in rows)
        want.append(2 * tp / sum((a == k) + (b == k) for a, b in rows))
    assert abs(macro_f1(spark.createDataFrame(rows, "label double, prediction double")) - sum(want) / 3) < 1e-12
