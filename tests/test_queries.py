import importlib
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from plinth.plans import catalog
from tests.oracle import SF, same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", ["sentence_merge", "bootstrap_ci", "line_cluster", "body_clean", "evidence_fuzzy"])
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_session():
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, check=True).stdout) > 60


def test_rest_does_not_need_the_corpus_operators():
    code = (
        "import sys; sys.modules['plinth.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; print(sum(q[:2] == 'op' and q[2].isdigit() or q == 'pipeline' for q in e.queries()))"
    )
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, check=True).stdout.strip() == b"0"
    importlib.import_module("plinth.plans.catalog")


def test_no_product_joins(spark):
    """Joins within documents and conversations never become products of rows."""
    for name in ("bm25_conv_top5", "evidence_exact", "evidence_bigram", "dense_label_top5", "spans_for"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_scans_read_only_what_they_need(spark):
    plan = catalog.queries()["upper_median"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<source:string,n_chars:bigint>" in plan
