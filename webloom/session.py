"""Session defaults and the one way this package cuts lineage: tables in shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Settings every entry point of this package relies on.  Sizes are per task, so they hold for any
# number of executors; AQE merges or splits the shuffle partitions at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HTML rows are up to 10 MB: keep Arrow batches to a few hundred rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def build_session(app_name: str = "webloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package defaults; `conf` uses `__` for dots in the option name."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    options = {**DEFAULTS, **{key.replace("__", "."): value for key, value in conf.items()}}
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: `spark.checkpoint.dir`, else a folder below a warehouse that was set.

    The default warehouse lies on one machine: it serves a local session, and a cluster with neither setting is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local") and not (hasattr(context, "getConf") and context.getConf().contains("spark.sql.warehouse.dir")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/webloom-scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/webloom-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as Parquet in the scratch folder and read it back.

    Unlike a cached or locally checkpointed frame the result survives executor loss, keeps column
    pruning, and carries file sizes that AQE can use.  `release` removes it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def release(*tables: DataFrame) -> None:
    """Remove the files of materialised tables that no later plan reads."""
    for table in tables:
        folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch)
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt evenly over a few tasks per core: for short rows that take long each.

    A file is read by one task per few megabytes and row group, however long its rows take.  The number of tasks is that of a
    shuffle, and two per core at least; it is given, so AQE does not merge them by their few bytes.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """`df` with `name` = 0, 1, … in the given order, without sorting everything in one task.

    Rows are dealt by ranges of the order and stored with their range; a range is numbered by one task and starts where the
    ranges before it end (one row per range).
    """
    dealt = materialize(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(starts, "_range").withColumn(name, (F.col("_own") + F.col("_start")).cast("bigint")).drop("_range", "_own", "_start")
