"""Writers.  What is there stays until what replaces it is complete."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from plinth.operators.dataset import upsert
from plinth.sources.readers import exists

#: Folders by hash of the key; a batch rewrites those that it touches.
BUCKETS = 32


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, in place of what is there; numbers that are none become null."""
    _in_place_of(df.sparkSession, path, lambda at: strict(df).write.option("ignoreNullFields", "false").json(at))


def strict(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, which JSON has a word for, at any depth."""
    return df.select(*[_strict(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _strict(c: Column, kind: DataType) -> Column:
    if isinstance(kind, DoubleType | FloatType):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _strict(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: _strict(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_strict(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return c


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header.  mark: a byte order mark before it, by which spreadsheets tell the encoding."""
    if mark:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    _in_place_of(df.sparkSession, path, lambda at: df.write.option("header", True).option("escape", '"').csv(at))


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _in_place_of(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Written beside, then swapped: a crash leaves the old folder, or its like under another name, never neither."""
    path = path.rstrip("/")
    beside, before = f"{path}.{uuid.uuid4().hex}.new", f"{path}.before"
    write(beside)
    files, at = _files(spark, path)
    if exists(spark, path):
        files.delete(at(before), True)
        files.rename(at(path), at(before))
    files.rename(at(beside), at(path))
    files.delete(at(before), True)


def upsert_table(new: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Replace the rows of a table whose key new has, and keep the others.

    The table is a folder of data folders, by hash of the key, and of numbered
    manifests, each naming the data folders of one version.  Only folders that
    new touches are written, under new names; the version begins to exist when
    its manifest is renamed into place.  A crash before that leaves the version
    before as it was, and files that no manifest names, which the next call
    removes.  One writer at a time; readers keep a version while the next comes.
    """
    spark, path = new.sparkSession, path.rstrip("/")
    number, parts = _manifest(spark, path)
    buckets = parts.pop("buckets", buckets)
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    name = uuid.uuid4().hex
    touched = {str(r[0]) for r in new.select(bucket.alias("b")).distinct().collect()}  # at most ``buckets``
    old = [parts[b] for b in touched if b in parts]
    whole = upsert(spark.read.parquet(*[f"{path}/{d}" for d in old]), new, key) if old else new
    whole.withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(f"{path}/data/{name}")
    files, at = _files(spark, path)
    for b in touched:
        folder = f"data/{name}/_bucket={b}"
        parts.pop(b, None)
        if files.exists(at(f"{path}/{folder}")):
            parts[b] = folder
    _commit(spark, path, number + 1, {"buckets": buckets, **parts})
    _sweep(spark, path, number + 1, parts)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the table's last complete version."""
    path = path.rstrip("/")
    _, parts = _manifest(spark, path)
    parts.pop("buckets", None)
    return spark.read.parquet(*[f"{path}/{d}" for d in parts.values()])


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the last manifest; 0 and nothing where there is none."""
    if not exists(spark, f"{path}/manifests"):
        return 0, {}
    files, at = _files(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(at(f"{path}/manifests"))]
    last = max((n for n in names if n.endswith(".json")), default=None)
    if last is None:
        return 0, {}
    line = spark.read.text(f"{path}/manifests/{last}", wholetext=True).first()[0]
    return int(last.split(".")[0]), json.loads(line)


def _commit(spark: SparkSession, path: str, number: int, parts: dict) -> None:
    files, at = _files(spark, path)
    files.mkdirs(at(f"{path}/manifests"))
    draft = at(f"{path}/manifests/{number:012d}.draft")
    out = files.create(draft, True)
    out.write(json.dumps(parts).encode())
    out.close()
    if not files.rename(draft, at(f"{path}/manifests/{number:012d}.json")):
        raise OSError(f"version {number} of {path} could not be put in place")


def _sweep(spark: SparkSession, path: str, number: int, parts: dict) -> None:
    """Remove what neither this version nor the one before names."""
    files, at = _files(spark, path)
    used = {d.split("/")[1] for d in parts.values()}
    for f in files.listStatus(at(f"{path}/manifests")):
        n = f.getPath().getName().split(".")[0]
        if int(n) < number - 1 or int(n) > number:
            files.delete(f.getPath(), False)
        elif int(n) == number - 1 and f.getPath().getName().endswith(".json"):
            line = spark.read.text(f.getPath().toString(), wholetext=True).first()[0]
            used |= {d.split("/")[1] for b, d in json.loads(line).items() if b != "buckets"}
    for f in files.listStatus(at(f"{path}/data")):
        if f.getPath().getName() not in used:
            files.delete(f.getPath(), True)


def cached_vectors(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """texts (id, text) with key and vec, where the cache (key, vec) has it; rows without vec are what remains to be encoded."""
    keyed = texts.withColumn("key", F.substring(F.sha2(F.concat_ws("\0", F.lit(model), "text"), 256), 1, 16))
    return keyed.join(cache, "key", "left")
