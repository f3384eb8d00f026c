"""What the operators of this package share: tables, scratch space, words."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators of plain words: space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: Separators of lower-cased words: ASCII that is neither a digit nor a letter.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Labelled ids (some 50 bytes each) that are joined by broadcast; more are joined by shuffle.
MAX_BROADCAST_IDS = 500_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays, also accented capitals."""
    return F.when(
        text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(text, UPPER, UPPER.lower())
    ).otherwise(F.lower(text))


def plain_words(text: Column) -> Column:
    """White-space separated words, unchanged; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def folded_words(text: Column) -> Column:
    """Lower-cased words of digits, a-z and non-ASCII characters; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NON_WORD), "")


def windows_of(n: Column, width: int) -> Column:
    """Starts 0 to n - width; empty for fewer than width words."""
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def text_key(text: Column) -> Column:
    """Tells rows of one id with different texts apart; null has a key of its own."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text))


class Scratch:
    """Tables in the folder that all executors share, one folder for each call.

    The folder is the session's ``spark.checkpoint.dir``.  Where that is unset
    a temporary folder serves, but only in local mode.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="plinth-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.path = f"{root.rstrip('/')}/plinth-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._remove, self.path)

    def table(self, df: DataFrame) -> DataFrame:
        """Write df and read it back: what follows no longer depends on df's plan."""
        self.n += 1
        at = f"{self.path}/{self.n}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing needs any more."""
        for df in tables:
            self._remove(df._scratch_path)

    def release(self) -> None:
        """Let Spark remove the shuffle files of finished jobs."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended before the interpreter does
            pass


def is_at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has no more than so many rows, without counting all of a large one."""
    return df.limit(rows + 1).count() <= rows


def label_limits(bins: DataFrame, most_lost: float, kept_share: float, least: int) -> DataFrame:
    """lang and limit, the last bin to keep, from bins (lang, bin and the counts held, junk and toxic).

    Of the limits that lose no more than most_lost of a language's held-out
    trusted documents it is the one that gains most: the mean of the shares of
    junk and of toxic documents caught, less the share of trusted lost.  Without
    junk and toxic ones it is the quantile kept_share of the trusted.  A language
    needs so many trusted documents, and as many others unless least is one.
    """
    w = Window.partitionBy("lang")
    upto = {c: F.sum(c).over(w.orderBy("bin")) for c in ("held", "junk", "toxic")}
    run = bins.select("lang", "bin", *[f.alias(c) for c, f in upto.items()], *[F.sum(c).over(w).alias(f"all_{c}") for c in upto])
    caught = lambda c: F.when(F.col(f"all_{c}") > 0, 1 - F.col(c) / F.col(f"all_{c}")).otherwise(0.0)
    kinds = F.when((F.col("all_junk") > 0) & (F.col("all_toxic") > 0), 2).otherwise(1)
    gain = (caught("junk") + caught("toxic")) / kinds - caught("held")
    bad = F.col("all_junk") + F.col("all_toxic")
    run = run.where((F.col("all_held") >= least) & (bad >= (least if least > 1 else 0)))
    run = run.where(F.col("held") >= F.when(bad > 0, 1 - most_lost).otherwise(kept_share) * F.col("all_held"))
    rank = F.struct(F.when(bad > 0, F.round(gain, 9)).otherwise(-F.col("bin").cast("double")).alias("gain"), F.col("bin").alias("bin"))
    return run.groupBy("lang").agg(F.max(rank)["bin"].alias("limit"))


def label_kinds(labels: DataFrame) -> DataFrame:
    """_good (a doc_id) and _kind of each labelled id: good (quality 1 and not toxic, by any of its rows), junk or toxic."""
    kind = F.when(F.expr("quality = 1 AND coalesce(toxic, 0) = 0"), 3).when(F.expr("quality = 0"), 2).when(F.expr("toxic = 1"), 1)
    known = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_good"), kind.alias("k")).where("k IS NOT NULL")
    return known.groupBy("_good").agg(F.max("k").alias("k")).select("_good", F.element_at(F.array(*map(F.lit, ("toxic", "junk", "good"))), F.col("k")).alias("_kind"))


def keep_rows(docs: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of docs whose (doc_id, text) is among keys (doc_id, _key); nulls match nulls."""
    k = keys.select(F.col("doc_id").alias("_k_id"), F.col("_key").alias("_k_text")).distinct()
    on = docs["doc_id"].eqNullSafe(k["_k_id"]) & (text_key(docs["text"]) == k["_k_text"])
    return docs.join(k, on, how)
