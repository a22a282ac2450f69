"""Structured Streaming forms of ingestion, progress, change detection and windowed quality."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom.functions.hashing import content_hash
from webloom.model import CleanerRule
from webloom.operators import quality, radar
from webloom.operators.clean import clean
from webloom.sources.writers import new_records


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    """The table at `path`, or None before its first write."""
    conf = spark._jsc.hadoopConfiguration()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(conf).exists(folder):
        return None
    return spark.read.schema(like.schema).parquet(path)


def _once(df: DataFrame, checkpoint: str, body: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (df.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def ingest_records(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("job_id", "content_hash"),
                   order_col: str | None = None, buckets: int | None = None) -> StreamingQuery:
    """Insert-or-ignore into the table at `path`, exact over all time.

    With `buckets` the table lies in that many hash buckets of the key (`ingested` reads it), and a batch reads the stored keys
    of its own buckets only; without, those of the whole table.  Replaying a batch after a failure finds its keys stored and
    adds nothing."""
    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if buckets is None:
            new_records(batch, _stored(spark, path, batch), keys, order_col).write.mode("append").parquet(path)
            return
        own = F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in keys]), F.lit(buckets)).cast("int")
        batch = batch.withColumn("_bucket", own)
        stored = _stored(spark, path, batch)
        if stored is not None:
            touched = [r["_bucket"] for r in batch.select("_bucket").distinct().collect()]      # at most `buckets`
            stored = stored.where(F.col("_bucket").isin(*touched))
        new = new_records(batch, stored, keys, order_col)
        new.repartition("_bucket").write.mode("append").partitionBy("_bucket").parquet(path)
    return _once(stream, checkpoint, body)


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """The table that `ingest_records` fills, without its layout."""
    return spark.read.parquet(path).drop("_bucket")


def distinct_within(stream: DataFrame, keys: Sequence[str], time_col: str, delay: str) -> DataFrame:
    """Bounded-state form: repeats are dropped as long as they come within `delay` of each other."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))


TERMINAL = ("completed", "failed", "cancelled")


def job_progress(events: DataFrame, job: str = "job_id", time_col: str = "ts", status: str = "status",
                 records: str = "records", current: str = "current", total: str = "total") -> DataFrame:
    """Latest status, records and percent per job; works on a stream (update mode) and on a table.

    `max_by` on event time: a late event cannot overwrite a newer one."""
    at = F.col(time_col)
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at))
    rolled = events.groupBy(job).agg(
        latest(status).alias("status"), latest(records).alias("records"), latest(current).alias("current"),
        latest(total).alias("total"), F.max(at).alias("last_event_at"))
    percent = F.when(F.col("total") > 0, F.round(F.col("current") / F.col("total") * 100, 1)).otherwise(0.0)
    return rolled.withColumn("percent", percent).withColumn("is_terminal", F.col("status").isin(*TERMINAL))


def watch_changes(snapshots: DataFrame, snapshot_path: str, events_path: str, checkpoint: str,
                  keys: Sequence[str] | None, order_col: str = "record_index") -> StreamingQuery:
    """Each micro-batch is one snapshot: it is compared with the one before, counts are appended to the
    event table and the snapshot is stored under its batch id (so a replay overwrites itself)."""
    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{snapshot_path}/batch={batch_id}")
        new = _stored(spark, f"{snapshot_path}/batch={batch_id}", batch)      # the source is read once
        before = _stored(spark, f"{snapshot_path}/batch={batch_id - 1}", batch) if batch_id else None
        old = before if before is not None else new.limit(0)
        event = radar.change_events(old, new, keys, order_col).withColumn("batch_id", F.lit(batch_id))
        event.write.mode("overwrite").parquet(f"{events_path}/batch={batch_id}")
    return _once(snapshots, checkpoint, body)


def watch_snapshots(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] | None, snapshot: str = "snapshot_id",
                    ended: str = "ended", order_col: str = "record_index") -> StreamingQuery:
    """Change counts between snapshots that a column tells apart; rows of one may come in any number of micro-batches.

    A row with `ended` set marks the end of its snapshot and is no record.  A batch stores the fingerprints of its rows; the
    end of a snapshot closes it: the last record of each key becomes its state, which is compared with the state of the
    closed snapshot before it.  Work follows the batch, and on an end mark the two states.  Every write replaces what a
    replay of the batch would write.  Rows that come after the mark of their snapshot do not count.  Events lie in
    `path`/events, one row a snapshot."""
    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            fields = [c for c in batch.columns if c not in (snapshot, ended, order_col)]
            rows = radar.fingerprints(batch.where(~F.coalesce(ended, F.lit(False))), keys, fields, order_col, snapshot)
            rows.write.mode("overwrite").partitionBy("snapshot").parquet(f"{path}/rows/batch={batch_id}")
            marks = sorted(r[0] for r in batch.where(ended).select(F.col(snapshot).cast("long")).distinct().collect())      # control rows
        finally:
            batch.unpersist()
        for number in marks:
            _close_snapshot(spark, path, number, batch_id)
    return _once(stream, checkpoint, body)


_STATE = "key_id binary, n long, a long, b long, snapshot long"
_EVENTS = "total_old long, total_new long, added_count long, removed_count long, modified_count long, unchanged_count long, snapshot long"


def _close_snapshot(spark: SparkSession, path: str, number: int, batch_id: int) -> None:
    held = spark.read.schema("key_id binary, at decimal(38,9), a long, b long, batch long, snapshot long").parquet(f"{path}/rows")
    mine = held.where((F.col("snapshot") == number) & (F.col("batch") <= batch_id))
    last = lambda c: F.max_by(c, "at")
    state = mine.groupBy("key_id").agg(F.count("*").alias("n"), last("a").alias("a"), last("b").alias("b"))
    state.write.mode("overwrite").parquet(f"{path}/states/snapshot={number}")
    states = spark.read.schema(_STATE).parquet(f"{path}/states")
    before = states.where(F.col("snapshot") < number).agg(F.max("snapshot")).first()[0]
    side = lambda k, name: states.where(F.col("snapshot") == k).select("key_id", *[F.col(c).alias(f"{c}_{name}") for c in ("n", "a", "b")])
    both = side(-1 if before is None else before, "old").join(side(number, "new"), "key_id", "full")
    old, new = F.col("n_old").isNotNull(), F.col("n_new").isNotNull()
    same = (F.col("a_old") == F.col("a_new")) & (F.col("b_old") == F.col("b_new"))
    both.agg(F.coalesce(F.sum("n_old"), F.lit(0)).alias("total_old"), F.coalesce(F.sum("n_new"), F.lit(0)).alias("total_new"), F.count_if(~old).alias("added_count"),
             F.count_if(~new).alias("removed_count"), F.count_if(old & new & ~same).alias("modified_count"), F.count_if(old & new & same).alias("unchanged_count")
             ).write.mode("overwrite").parquet(f"{path}/events/snapshot={number}")


def snapshot_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_EVENTS).parquet(f"{path}/events")


def clean_stream(stream: DataFrame, fields: Sequence[str], rules: Iterable[CleanerRule | dict] | None = None) -> DataFrame:
    """Clean and fingerprint arriving records; stateless."""
    return clean(stream, rules).withColumn("content_hash", content_hash(fields))


def windowed_quality(records: DataFrame, fields: Sequence[str], time_col: str, width: str,
                     delay: str | None = None, exact_distinct: bool = False) -> DataFrame:
    """Cell counts per tumbling window.  Streams cannot count distinct values exactly, so they report
    an approximate number of unique records; a batch may ask for the exact one."""
    fields = sorted(fields)
    counts = quality._record_counts(records, fields, None, False)
    frame = records.withWatermark(time_col, delay) if delay else records
    counted = frame.select(F.window(time_col, width).alias("window"), content_hash(fields).alias("_id"), *counts)
    unique: Column = F.count_distinct("_id") if exact_distinct else F.approx_count_distinct("_id")
    rolled = counted.groupBy("window").agg(
        F.count("*").alias("records"), F.sum("filled").alias("filled"), F.sum("evaluated").alias("evaluated"),
        F.sum("valid").alias("valid"), unique.alias("unique_records"))
    return rolled.select(F.col("window.start").alias("window_start"), "records", "filled", "evaluated", "valid",
                         (F.col("records") * len(fields)).alias("cells"), "unique_records")
