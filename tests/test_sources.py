import json

import pytest
from pyspark.sql import functions as F

from plinth.sources import readers as R
from plinth.sources import writers as W
from plinth.streaming.upsert import stream_upserts


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"sent_id": "s001", "text": "1961"}\n\n{"sent_id": "s002", "text": "x"}\n', encoding="utf-8")
    got = R.read_numbered_jsonl(spark, str(tmp_path / "a.jsonl"), R.SCHEMAS["sents"]).orderBy("ord").collect()
    assert [(r.ord, r.sent_id, r.text) for r in got] == [(1, "s001", "1961"), (2, "s002", "x")]
    assert R.read_jsonl(spark, str(tmp_path / "none"), R.SCHEMAS["sents"], missing_ok=True).count() == 0


def test_whole_documents_and_listing(spark, tmp_path):
    (tmp_path / "arts_01.txt").write_text("첫 줄\n\n둘째", encoding="utf-8")
    (tmp_path / "~$lock.txt").write_text("x")
    docs = {r.doc_id: r.text for r in R.read_documents(spark, str(tmp_path / "arts_01.txt")).collect()}
    assert docs == {"arts_01": "첫 줄\n\n둘째"}
    assert [r.name for r in R.list_assets(spark, str(tmp_path), "*.txt").collect()] == ["arts_01.txt"]
    assert len(R.fingerprints(spark, str(tmp_path / "arts_01.txt")).first().sha256) == 64


def test_manifest_with_mark(spark, tmp_path):
    names = ",".join(f.name for f in R.SCHEMAS["manifest"].fields)
    (tmp_path / "m.csv").write_text(f"﻿{names}\narts_01,T,S,D,O,L,U,ko,12,train,arts_01__x,tool,p,\n", encoding="utf-8")
    m = R.read_manifest(spark, str(tmp_path / "m.csv"))
    r = m.first()
    assert (r.doc_id, r.pages, r.slide_count) == ("arts_01", 12, None)
    claims = spark.createDataFrame([("arts_01__x",), ("bio_02__y",)], "deck_id string")
    got = {r.deck_id: r.doc_id for r in R.with_document(claims, R.deck_documents(m)).collect()}
    assert got == {"arts_01__x": "arts_01", "bio_02__y": "bio_02"}


def test_tsv_dialects(spark, tmp_path):
    (tmp_path / "j.tsv").write_text('c1\t모순\t"s001"\n\t무근거\ts002\n', encoding="utf-8")
    plain = R.read_tsv(spark, str(tmp_path / "j.tsv"), R.SCHEMAS["judgments"])
    quoted = R.read_tsv(spark, str(tmp_path / "j.tsv"), R.SCHEMAS["judgments"], quoted=True)
    assert [r.ref for r in plain.where("claim_id = 'c1'").collect()] == ['"s001"'] and plain.count() == 2
    assert [r.ref for r in quoted.collect()] == ["s001"]


def test_annotations_of_one_deck(spark, tmp_path):
    (tmp_path / "a.csv").write_text('deck_id,claim_text\nd1,"two\nlines"\nd2,x\n', encoding="utf-8")
    got = R.read_annotations(spark, str(tmp_path / "a.csv"), "d1", R._fields(deck_id=R.S, claim_text=R.S)).collect()
    assert [r.claim_text for r in got] == ["two\nlines"]


def test_metrics_folder(spark, tmp_path):
    schema = R._fields(deck_id=R.S, n_gold=R.I)
    (tmp_path / "a.json").write_text(json.dumps({"deck_id": "d", "n_gold": 3}, indent=1))
    assert R.read_metrics(spark, str(tmp_path), schema).first().n_gold == 3
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        R.read_metrics(spark, str(tmp_path / "empty"), schema)


def test_strict_json(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "i int, x double")
    W.write_jsonl(df, str(tmp_path / "o"))
    assert {(r.i, r.x) for r in spark.read.json(str(tmp_path / "o")).collect()} == {(1, None), (2, 0.5)}


def test_csv_round_trip(spark, tmp_path):
    W.write_csv(spark.createDataFrame([("a,\"b\"", 1)], "t string, n int"), str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().t == 'a,"b"'


def test_upsert_table(spark, tmp_path):
    at = str(tmp_path / "t")
    W.upsert_table(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), at, "k")
    W.upsert_table(spark.createDataFrame([("b", 3)], "k string, v int"), at, "k")
    assert {tuple(r) for r in W.read_table(spark, at).collect()} == {("a", 1), ("b", 3)}


@pytest.mark.parametrize("step", ["_commit", "_sweep", "upsert"])
def test_upsert_that_dies_loses_nothing(spark, tmp_path, monkeypatch, step):
    at = str(tmp_path / "t")
    for v in (1, 2):
        W.upsert_table(spark.createDataFrame([(f"k{i}", v) for i in range(50)], "k string, v int"), at, "k")

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(W, step, dies)
        W.upsert_table(spark.createDataFrame([("k1", 9), ("new", 9)], "k string, v int"), at, "k")
    old = {(f"k{i}", 2) for i in range(50)}
    now = {("new", 9), *((k, 9 if k == "k1" else v) for k, v in old)}
    # the new version counts from the moment its manifest is in place
    assert {tuple(r) for r in W.read_table(spark, at).collect()} == (now if step == "_sweep" else old)
    W.upsert_table(spark.createDataFrame([("k1", 9), ("new", 9)], "k string, v int"), at, "k")
    assert {tuple(r) for r in W.read_table(spark, at).collect()} == now
    assert len(list((tmp_path / "t" / "manifests").glob("*.json"))) <= 2


def test_writers_replace_when_complete(spark, tmp_path):
    at = str(tmp_path / "o")
    W.write_jsonl(spark.createDataFrame([(1,)], "i int"), at)
    broken = spark.createDataFrame([(1,)], "i int").selectExpr("raise_error('no') AS i")
    with pytest.raises(Exception, match="no"):
        W.write_jsonl(broken, at)
    assert [r.i for r in spark.read.json(at).collect()] == [1]
    W.write_jsonl(spark.createDataFrame([(2,)], "i int"), at)
    assert [r.i for r in spark.read.json(at).collect()] == [2]


def test_strict_json_at_any_depth(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, [nan, 1.0, -inf], (inf, "x"), {"a": nan})], "i int, a array<double>, s struct<d: double, t: string>, m map<string, double>")
    r = W.strict(df).first()
    assert (r.a, tuple(r.s), r.m) == ([None, 1.0, None], (None, "x"), {"a": None})


def test_csv_with_mark(spark, tmp_path):
    W.write_csv(spark.createDataFrame([("a", 1)], "t string, n int").coalesce(1), str(tmp_path / "c"), mark=True)
    body = next((tmp_path / "c").glob("*.csv")).read_bytes()
    assert body.startswith("\ufefft,n".encode()) and spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1


def test_encodings(spark, tmp_path):
    line = '{"sent_id": "s001", "text": "한글"}\n'
    for name, data in {"u": line.encode(), "b": b"\xef\xbb\xbf" + line.encode(), "k": line.encode("cp949")}.items():
        (tmp_path / f"{name}.jsonl").write_bytes(data)
        assert [(r.sent_id, r.text) for r in R.read_jsonl_any(spark, str(tmp_path / f"{name}.jsonl"), R.SCHEMAS["sents"]).collect()] == [("s001", "한글")], name
    assert R.read_jsonl_any(spark, str(tmp_path / "none"), R.SCHEMAS["sents"]).count() == 0


def test_results_in_both_formats(spark, tmp_path):
    labels = {"yes it is": "yesitis", "No": "no"}
    one = {"macro_f1": 0.5, "accuracy": 0.6, "classification_report": {"yes it is": {"f1-score": 0.4, "support": 2}, "No": {"f1-score": 0.6}, "accuracy": 0.6}}
    run = lambda m, per: {"test": {"macro_f1": m, "accuracy": m, "per_class_f1": per}}
    many = {"runs": [run(0.2, {"yesitis": 0.5, "no": 0.1}), run(0.4, {"no": 0.3})]}
    for name, x in (("m1", one), ("m2", many), ("other", {"a": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(x))
    got = {r.name: r for r in R.read_results(spark, str(tmp_path), labels).collect()}
    assert set(got) == {"m1", "m2"}
    assert (got["m1"].macro_f1, got["m1"].std, got["m1"].seeds, tuple(got["m1"].per_class)) == (0.5, None, 1, (0.4, 0.6))
    r = got["m2"]
    assert [round(x, 9) for x in (r.macro_f1, r.std, r.accuracy, *r.per_class)] == [0.3, 0.1, 0.3, 0.25, 0.2] and r.seeds == 2


def test_cached_vectors(spark):
    texts = spark.createDataFrame([(1, "x"), (2, "y")], "id int, text string")
    key = texts.where("id = 1").select(F.substring(F.sha2(F.concat_ws("\0", F.lit("m"), "text"), 256), 1, 16).alias("key"))
    cache = key.withColumn("vec", F.array(F.lit(1.0)))
    got = {r.id: r.vec for r in W.cached_vectors(texts, cache, "m").collect()}
    assert got == {1: [1.0], 2: None}


def test_stream_replaces_documents(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = R._fields(doc_id=R.S, n=R.I)
    for name, rows in (("1", [("a", 1), ("b", 1)]), ("2", [("b", 2)])):
        (source / f"{name}.json").write_text("".join(json.dumps({"doc_id": k, "n": n}) + "\n" for k, n in rows))
        stream_upserts(spark, str(source), schema, target, "doc_id", str(tmp_path / "cp"), order="n").awaitTermination()
    assert {tuple(r) for r in W.read_table(spark, target).collect()} == {("a", 1), ("b", 2)}
