"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: The setting that removes shuffle files when a query ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it. Where it is unset, a fresh one is made
    for a session whose driver and executor are one process (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='leadloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leadloom/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")  # once the table is written, its shuffle files are of no use
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


class KeyFilter:
    """Which rows may hold one of some keys: one bit a key, hashed, in a table of 2^24 bits at most that is broadcast.

    The number of bits follows the number of keys; where there are more keys than bits, more rows pass, and none is lost.
    """

    def __init__(self, keys: DataFrame, most_bits: int = 24):
        self.log = min(max((8 * keys.count()).bit_length(), 16), most_bits)
        bucket = self._bucket(F.xxhash64(*keys.columns))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bucket").bitwiseAND(63).cast("int"))
        words = keys.select(bucket.alias("bucket")).groupBy(F.shiftright("bucket", 6).alias("filter_word"))
        self.table = F.broadcast(words.agg(F.bit_or(one).alias("filter_bits")))

    def _bucket(self, hashed: Column) -> Column:
        return F.shiftrightunsigned(hashed, 64 - self.log)

    def passing(self, df: DataFrame, *key: Column) -> DataFrame:
        """Rows of df (no column of which is named filter_word or filter_bits) whose key may be among the keys."""
        bucket = self._bucket(F.xxhash64(*key))
        hit = F.call_function("shiftright", F.col("filter_bits"), bucket.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
        return df.join(self.table, (F.shiftright(bucket, 6) == F.col("filter_word")) & hit).select(*df.columns)

    def missing(self, df: DataFrame, *key: Column) -> DataFrame:
        """The other rows."""
        bucket = self._bucket(F.xxhash64(*key))
        hit = F.call_function("shiftright", F.col("filter_bits"), bucket.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
        return df.join(self.table, (F.shiftright(bucket, 6) == F.col("filter_word")) & hit, "left_anti")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression, so that the optimizer cannot inline it into a lambda."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text as an array; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shingles(ws: Column, k: int) -> Column:
    """64-bit hashes of the k-word windows in order; with fewer words the whole sequence as one; none without words."""

    def hashed(w: Column) -> Column:
        n = F.size(w)
        windows = F.arrays_zip(*[F.slice(w, F.lit(i + 1), F.greatest(n - (k - 1), F.lit(0))) for i in range(k)])
        return (
            F.when(n >= k, F.transform(windows, lambda s: F.xxhash64(s)))
            .when(n > 0, F.array(F.xxhash64(w)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(ws, hashed)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
