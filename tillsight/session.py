"""Spark session defaults and the shared checkpoint folder.

Every operator in this package is a plain ``f(df, **params) -> DataFrame``; the
only session-level choices are the ones below: UTC session time zone (timestamps
in the driver tables are zone-less), ANSI mode on (bad casts go through the
``try_*`` functions explicitly), and adaptive query execution so shuffle
partition counts, broadcast choices and skewed joins are re-planned from runtime
statistics instead of guessed up front.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # cp1252 input (S1) needs the legacy charset list in Spark 4.
    "spark.sql.legacy.javaCharsets": "true",
    # Checkpointed intermediates are deleted once their DataFrame is gone.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Suggested settings for a large cluster (~1000 executors, ~100 TB of input).
# Scan splits of 256 MB keep the task count near 400k for 100 TB; the initial
# shuffle partition count is set high and AQE coalesces toward 256 MB per
# partition, so a 100 TB shuffle lands near that size per task and small
# shuffles shrink automatically. Broadcasts stay Spark's measured decision,
# with a threshold that fits the dimension-sized sides only.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "40000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(64 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def build_session(master: str | None = None, app: str = "tillsight",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local or cluster session with the package defaults.

    On a cluster ``master`` stays ``None`` so spark-submit decides. The shuffle
    partition count defaults to twice the local cores; on a cluster it should be
    sized so one partition is ~128-256 MB of shuffle data (AQE coalesces the
    small ones).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is None and master and master.startswith("local"):
        n = master[6:-1] if master.startswith("local[") else "1"
        cores = (os.cpu_count() or 8) if n in ("*", "") else int(n)
        shuffle_partitions = max(2 * int(cores), 4)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    The cluster's ``spark.checkpoint.dir`` wins. Only a local master without one
    (tests) gets a private scratch folder: executors on other machines could not
    read it, so there its absence is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError(f"spark.checkpoint.dir is not set: on {sc.master} intermediate tables need a folder "
                             "that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tillsight-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared checkpoint folder, deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df, partition_by: str | None = None):
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it from there.

    With ``partition_by`` (an int column) there is a folder per value, and filters on it
    read only those folders.

    Used where several jobs read the same expensive intermediate (a deduped
    table, model features): each would otherwise recompute the joins and
    shuffles behind it, and a cache would be lost with its executor. Later reads
    fetch only the columns they use.
    """
    spark = df.sparkSession
    untyped = [c for c, t in df.dtypes if t == "void"]  # Parquet has no such type
    kept = df.drop(*untyped) if untyped else df
    if not kept.columns:
        return df.checkpoint(eager=True) if ensure_checkpoint_dir(spark) else df
    path = shared_folder(spark, "rows")
    (kept.write.partitionBy(partition_by) if partition_by else kept.write).parquet(path)
    back = spark.read.schema(kept.schema).parquet(path)
    return back.withColumns({c: F.lit(None) for c in untyped}).select(*df.columns) if untyped else back


#: Rows that one task of a fit takes at most: a forest of 100 trees caches 0.5 to 1.5 kB a row.
FIT_ROWS = 200_000


def fit_partitions(rows: int) -> int:
    """Partitions of a model fit over so many rows: grows with the data, and depends on nothing else."""
    return max(1, min(-(-rows // 50_000), 8), -(-rows // FIT_ROWS))


def deal_for_fit(rows):
    """The (narrow, written) rows of a fit, dealt by hash of all columns and sorted.

    Bagging draws per partition and row: with partitions that follow from the
    number of rows alone, in a fixed order, the same rows give the same model,
    however they were partitioned before, and the tasks grow with the rows.
    """
    dealt = rows.repartition(fit_partitions(rows.count()), *rows.columns)
    ensure_checkpoint_dir(rows.sparkSession)
    return dealt.sortWithinPartitions(*rows.columns).checkpoint(eager=True)
