"""Readers with explicit schemas.

Claims may look like numbers (``1961``), so no schema is ever inferred.  Tables
that come from files get an ordinal, ``ord``, where the order of lines carries
meaning: lines are numbered within their file on the way in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from plinth.functions.udfs import decoded

S, I, B, D = StringType(), IntegerType(), BooleanType(), DoubleType()


def _fields(**kinds) -> StructType:
    return StructType([StructField(n, k) for n, k in kinds.items()])


#: Columns of the logical tables.
SCHEMAS = {
    "sents": _fields(sent_id=S, text=S, start=I, end=I, is_heading=B),
    "spans": _fields(span_id=S, text=S, sent_ids=ArrayType(S)),
    "passages": _fields(passage_id=S, doc_id=S, span_id=S, window=S, text=S, sent_ids=ArrayType(S), n_chars=I),
    "claims": StructType(
        [StructField("Slide #", I), StructField("Claim (PPT)", S), StructField("Slide_Title", S), StructField("Context (PPT)", ArrayType(S))]
    ),
    "queries": _fields(claim_id=S, deck_id=S, doc_id=S, slide_no=I, claim_text=S, query_text=S, slide_title=S, context=ArrayType(S)),
    "runs": _fields(
        claim_id=S, deck_id=S, doc_id=S, retriever=S, model=S, window=S, query_text=S,
        results=ArrayType(_fields(rank=I, passage_id=S, score=D, sent_ids=ArrayType(S))),
    ),
    "manifest": _fields(
        doc_id=S, title=S, source=S, domain=S, owner=S, license=S, source_url=S, lang=S, pages=I, split=S, deck_id=S, tool=S, prompt_id=S, slide_count=I
    ),
    "judgments": _fields(claim_id=S, label=S, ref=S),
}


def read_jsonl(spark: SparkSession, path: str, schema: StructType, encoding: str = "UTF-8", missing_ok: bool = False) -> DataFrame:
    """JSON lines; blank lines count for nothing.  missing_ok: a path that does not exist is an empty table."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("encoding", encoding).option("lineSep", "\n").option("mode", "FAILFAST")
    return reader.json(path)


def read_jsonl_any(spark: SparkSession, path: str, schema: StructType, other: str = "cp949") -> DataFrame:
    """JSON lines in UTF-8, with or without a byte order mark, or else in the other encoding; a path that does not exist is an empty table.

    Lines that are no UTF-8 are looked for first, where they lie; what neither
    encoding reads is an error, not an empty table.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path)
    if not lines.where(~F.is_valid_utf8("value")).isEmpty():
        lines = lines.select(decoded(other)(F.col("value").cast("binary")).alias("value"))
    kept = lines.select(F.regexp_replace("value", "^\ufeff", "").alias("value")).where("trim(value) <> ''")
    return kept.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_results(spark: SparkSession, path: str, labels: dict[str, str]) -> DataFrame:
    """name (of the file), macro_f1, std, accuracy, per_class (by label) and seeds of result files in either format.

    One format has a ``classification_report`` of a single run, the other
    ``runs``, one for each seed, which are averaged.  labels: the names of the
    labels in the second format, by those in the first; a label that a run does
    not name counts as 0 there.  Files of neither format are left out.
    """
    score = StructType([StructField("f1-score", D)])
    test = _fields(macro_f1=D, accuracy=D, per_class_f1=StructType([StructField(x, D) for x in labels.values()]))
    schema = StructType(
        [StructField("macro_f1", D), StructField("accuracy", D), StructField("classification_report", StructType([StructField(x, score) for x in labels])),
         StructField("runs", ArrayType(StructType([StructField("test", test)])))]
    )
    r = spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.input_file_name().alias("file"))
    one, n = F.col("classification_report").isNotNull(), F.size("runs")
    mean = lambda get: F.aggregate("runs", F.lit(0.0), lambda a, x: a + F.coalesce(get(x["test"]), F.lit(0.0))) / n
    average = mean(lambda t: t["macro_f1"])
    std = F.sqrt(F.aggregate("runs", F.lit(0.0), lambda a, x: a + F.pow(x["test"]["macro_f1"] - average, F.lit(2))) / n)
    per = lambda x: F.when(one, F.col("classification_report")[x]["f1-score"]).otherwise(mean(lambda t: t["per_class_f1"][labels[x]]))
    return r.where(one | F.col("runs").isNotNull()).select(
        F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"),
        F.when(one, F.col("macro_f1")).otherwise(average).alias("macro_f1"),
        F.when(~one, std).alias("std"),
        F.when(one, F.col("accuracy")).otherwise(mean(lambda t: t["accuracy"])).alias("accuracy"),
        F.struct(*[per(x).alias(x) for x in labels]).alias("per_class"),
        F.when(one, 1).otherwise(n).alias("seeds"),
    )


def read_numbered_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines with file and ord, the number of the line among those of its file that are not blank.

    Lines are numbered by their place in the file, so the numbers do not depend on
    how the file is cut into partitions.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    lines = lines.select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("_at"))
    n = F.row_number().over(Window.partitionBy("file").orderBy("_at"))
    parsed = lines.select("file", n.alias("ord"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("file", "ord", "r.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's name without extension) and text of whole text files."""
    d = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return d.select(F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), F.col("value").alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; the schema names the columns, so a byte order mark before the first does no harm."""
    m = spark.read.option("header", True).option("enforceSchema", True).option("multiLine", True).schema(SCHEMAS["manifest"]).csv(path)
    return m.select(*[F.trim(c).alias(c) if isinstance(m.schema[c].dataType, StringType) else F.col(c) for c in m.columns])


def deck_documents(manifest: DataFrame) -> DataFrame:
    """deck_id and doc_id where both are given."""
    return manifest.where("deck_id <> '' AND doc_id <> ''").select("deck_id", "doc_id").distinct()


def with_document(claims: DataFrame, decks: DataFrame) -> DataFrame:
    """claims (deck_id) with doc_id, from the manifest or else from what is before ``__`` in the deck's name."""
    guess = F.substring_index("deck_id", "__", 1)
    return claims.join(decks, "deck_id", "left").withColumn("doc_id", F.coalesce("doc_id", guess))


def read_tsv(spark: SparkSession, path: str, schema: StructType, quoted: bool = False) -> DataFrame:
    """Tab-separated rows without a header.  quoted: quotes enclose fields, and rows with an empty first field are dropped."""
    t = spark.read.option("sep", "\t").option("quote", '"' if quoted else "").schema(schema).csv(path)
    return t.where(F.trim(t.columns[0]) != "") if quoted else t


def read_annotations(spark: SparkSession, path: str, deck_id: str, schema: StructType) -> DataFrame:
    """Annotations of one deck from a CSV file with quoted line breaks; the filter goes into the scan."""
    a = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    return a.where(F.col("deck_id") == deck_id)


def read_metrics(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON object a file; an empty folder is an error."""
    m = spark.read.schema(schema).option("multiLine", True).json(path)
    if m.isEmpty():
        raise ValueError(f"no metrics in {path}")
    return m


def list_assets(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name and size of the files in a folder, without lock files; nothing is read of them."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    f = f.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.col("length").alias("size"))
    return f.where(~F.startswith("name", F.lit("~$"))).distinct()


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """name and SHA-256 of whole files."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.sha2("content", 256).alias("sha256"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
