"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_dir

#: Between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


WRITTEN: list[str] = []
#: Spark's own switch: an execution that is done leaves no shuffle files.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: And the bytes of rows at which it sends a batch to a Python worker.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, batch: str | None = None) -> DataFrame:
    """As cut(), for larger results: columnar, compressed, read back by column. The shuffle files that led to it go at once.

    batch: what a Python worker on the way gets at once, as "4m"; every row still goes, a longer one by itself.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    now = {FREE: "true"} | ({BATCH: batch} if batch else {})
    before = {k: spark.conf.get(k, None) for k in now}
    try:
        for k, v in now.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Removes the tables of written() so far; results that still read them must be done."""
    jvm = spark.sparkContext._jvm
    while WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of results, one a document, that go into a file.
ROWS_A_FILE = 25_000


def in_files(df: DataFrame, docs: int) -> DataFrame:
    """df, dealt to as many tasks as the results of so many documents fill files, instead of a file for each task before.

    On a local file system Spark starts three processes (chmod) for each file it writes, and until one runs its own program it shows its
    executor's whole memory as its own. No row is moved by a key, so none can crowd a task.
    """
    return df.repartition(max(1, -(-docs // ROWS_A_FILE)))


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, keys: list[str], order: list[str], into: str, buckets: int = 64, bucket: Column | None = None) -> DataFrame:
    """Adds the rank of each row (long, from 0) among the rows of its keys, in a fixed order.

    A key may hold any share of the rows: rows are ranked within (key, bucket) and the counts
    of earlier buckets (at most `buckets` rows a key) are added. Equal rows share no rank. Buckets are
    dealt by hash; with `bucket`, a number that never falls along `order`, ranks follow that order.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int") if bucket is None else bucket.cast("int"))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket") == F.col("_b")]
    joined = ranked.join(starts, on=same, how="inner")
    return joined.select(*df.columns, (F.col("_start") + F.col("_rank")).cast("long").alias(into))
