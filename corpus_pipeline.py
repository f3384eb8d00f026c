"""A corpus pipeline over ``documents``: five operators, each on all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written and read again before the next begins.  All but the last return the
columns of ``documents``.

Edge cases: extra columns pass through the filtering stages, nulls in them
included.  Null and empty texts fail the quality rules; each stage by itself
takes them as texts without words.  Texts may have any length.  Rows that repeat
stay together or go together, except in the near-duplicate stage, which keeps
one row of each group, that of the least doc_id and, of equal ones, of the least
text.  Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm import decontamination, packing, quality_rules, simhash_golay, substring_dedup
from plinth.llm._base import Scratch, keep_rows, table, text_key

#: Fingerprints of a text in the near-duplicate stage.
TABLES = 16
#: Five-word similarity from which texts are near copies whatever their fingerprints.
SIMILAR = 0.8
#: SQL cannot hash and cluster as stages 2 and 5 do.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    verdicts = quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"))
    return keep_rows(docs, verdicts.where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the least doc_id.

    Texts are linked if their fingerprints differ in at most two bits, or if their five-word similarity is SIMILAR or more;
    the Golay keys of TABLES - 1 further fingerprints and the bands of a MinHash find who to compare first, an exact search
    whom they leave apart.
    """
    groups = simhash_golay.near_duplicates(docs, tables=TABLES, floor=SIMILAR)
    order = F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "_key")
    stays = groups.groupBy("component").agg(F.min(order).alias("r")).select("r.doc_id", "r._key")
    # rows that repeat as they are: one of them
    n = F.row_number().over(Window.partitionBy("doc_id", text_key(F.col("text"))).orderBy("text"))
    kept = keep_rows(docs, stays).select(F.struct("*").alias("row"), n.alias("n"))
    return kept.where("n = 1").select("row.*")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of repeated passages; documents of which nothing is left go."""
    kept = substring_dedup.remove_repeats(docs, with_columns=True)
    kept = kept.where("n_removed = 0 OR n_words > n_removed")
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        own = F.col("own")["n_chars"]
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(own).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[new.get(c, F.col("own")[c]).alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    hits = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return keep_rows(docs, hits.where("contaminated"), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("substring dedup", substrings),
    ("decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        after = scratch.table(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        scratch.release()
        docs = after
    return docs
