"""Every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plinth.llm import decontamination, kneser_ney, license_scan, packing, quality_rules, sharding, simhash_golay, substring_dedup, token_counts, url_filter
from tests.llm.conftest import ROWS, collected

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("word_bpe_49k.json")


def benchmark(spark):
    return spark.createDataFrame([(1, "gamma1 gamma2 gamma3"), (None, "one two"), (3, None), (4, "")], "item_id long, text string")


OPERATORS = {
    "packing": lambda d, spark, labels: packing.pack(d, BPE).drop("sequence_id", "offset"),
    "kneser_ney": lambda d, spark, labels: kneser_ney.classify(d, labels),
    "license_scan": lambda d, spark, labels: license_scan.scan_licenses(d),
    "simhash": lambda d, spark, labels: simhash_golay.near_duplicates(d),
    "substring_dedup": lambda d, spark, labels: substring_dedup.remove_repeats(d),
    "sharding": lambda d, spark, labels: sharding.shard_by_bytes(d, 3),
    "decontamination": lambda d, spark, labels: decontamination.decontaminate(d, benchmark(spark)),
    "quality_rules": lambda d, spark, labels: quality_rules.quality_rules(d, labels),
    "token_counts": lambda d, spark, labels: token_counts.count_tokens(d, PIECES),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, docs, odd_docs, no_docs, labels, name):
    run = OPERATORS[name]
    got = collected(run(docs, spark, labels))
    assert len(got) >= len(ROWS)
    if name != "packing":
        assert len(got) == len(ROWS)
    assert collected(run(odd_docs, spark, labels)) == got
    assert run(no_docs, spark, labels).count() == 0
    assert run(no_docs, spark, labels).columns == run(docs, spark, labels).columns


@pytest.mark.parametrize("name", ["kneser_ney", "quality_rules"])
def test_no_labels(spark, docs, labels, name):
    out = OPERATORS[name](docs, spark, labels.where("false"))
    assert out.count() == len(ROWS)
    assert out.where("doc_id = 3 AND kept").count() == 1


def test_no_benchmark(spark, docs):
    out = decontamination.decontaminate(docs, benchmark(spark).where("false"))
    assert out.count() == len(ROWS) and out.where("contaminated OR n_hit > 0").count() == 0


def test_odd_pages(spark):
    """Nulls, clashing columns, a url of a million characters, a host of 10,000 labels, repeated rows."""
    long = "http://a.test/" + "x" * 1_000_000
    many = "http://" + "a." * 10_000 + "example.com/en/1"
    rows = [(1, long, None), (2, many, ""), (2, many, ""), (None, None, None), (3, "", "<link rel=canonical href=/x>"), (4, "://", None), (5, "x://?q", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    names = ["host", "path", "key", "rule", "action", "component", "allowed", "verdict", "end", "size", "tag", "to", "a", "b", "node"]
    got = collected(url_filter.filter_urls(pages, url_filter.RULES))
    assert collected(url_filter.filter_urls(pages.withColumns({c: F.lit("clash") for c in names}), url_filter.RULES)) == got
    verdicts = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.RULES).collect()}
    assert verdicts[2] == ("com/en/", "block") and verdicts[1] == verdicts[None] == verdicts[3] == verdicts[4] == (None, "allow") and len(got) == len(rows)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.filter_urls(pages, url_filter.RULES).count() == 0
