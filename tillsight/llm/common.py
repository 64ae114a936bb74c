"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillsight.session import ensure_checkpoint_dir

#: A word of the size, shingle and mixing contracts: a run without ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared checkpoint folder, deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it from there.

    The lineage ends at the files, so a lost executor costs only the tasks that
    read them, and every later pass sees the same rows.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_released(spark: SparkSession):
    """Spark deletes the shuffle files of each query that ends in here at once, not when its plan is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more, and let go of finished shuffles.

    Spark removes shuffle files once the driver has collected the plans that made them.
    """
    for table in tables:
        for file in table.inputFiles()[:1]:
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    session = SparkSession.getActiveSession()
    if session is not None:
        session._jvm.System.gc()


def text_of(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def md5_bits(value: Column, digits: int = 15) -> Column:
    """The first ``digits`` hex digits (4 bits each, 15 at most) of an md5 as a long."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def id_bits(col: str = "doc_id") -> Column:
    """60 evenly spread bits of a document id; null has bits of its own."""
    return md5_bits(F.coalesce(F.col(col).cast("string"), F.lit("null")))


def small(df: DataFrame, rows: int, known: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcasting if its counted size is at most ``rows``.

    A larger table is left to Spark's shuffled joins (with AQE skew splitting).
    """
    n = df.count() if known is None else known
    return F.broadcast(df) if n <= rows else df


def two_level_rank(df: DataFrame, group: list[str], part: list[str], order: list[str],
                   name: str = "rank", broadcast_rows: int = 1_000_000) -> DataFrame:
    """Row number 1..n within ``group``, ordered by ``part`` then ``order``.

    Rows are ranked inside (group, part) only; a window over one counted row per
    (group, part) gives the offset of each part. A group holding a third of all
    rows is thus ranked in as many tasks as it has parts.
    """
    keys = group + part
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    offsets = written(offsets, "offsets")
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (df.join(small(offsets, broadcast_rows), keys)
              .withColumn(name, F.row_number().over(inside).cast("long") + F.col("_before"))
              .drop("_before"))
