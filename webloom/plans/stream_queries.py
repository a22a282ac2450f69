"""Streaming queries over the event table, run to completion with an available-now trigger."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.plans.registry import query, table
from webloom.session import scratch_path
from webloom.streaming import streams


def event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _finish(stream_query):
    stream_query.awaitTermination()


def _in_arrivals(spark, d, label, start):
    """Feed the events in three arrivals to one stream; some rows of the hours before a cut come late, with the next arrival.

    `start` gets the stream and starts a run that ends when all that is there has been read.
    """
    e, source = table(spark, d, "events"), scratch_path(spark, label)
    cuts = [F.lit(c).cast("timestamp_ntz") for c in ("2024-01-11", "2024-01-21")]
    late = lambda cut: (F.col("ts") >= cut - F.expr("interval 6 hours")) & (F.col("ts") < cut) & (F.col("event_id") % 3 == 0)
    number = F.when((F.col("ts") < cuts[0]) & ~late(cuts[0]), 0).when((F.col("ts") < cuts[1]) & ~late(cuts[1]), 1).otherwise(2)
    for k in range(3):
        e.where(number == k).write.mode("append").parquet(source)
        _finish(start(spark.readStream.schema(e.schema).parquet(source)))


def _latest(spark, path, key):
    """Per key the row of the last micro-batch that wrote it."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "batch").alias("_row")).select("_row.*")


_FIRST_SQL = "SELECT min(event_id) AS event_id, user_id AS job_id, event_type AS content_hash FROM events GROUP BY user_id, event_type"


def _ingested_twice(spark, d, buckets):
    path = scratch_path(spark, "sink")
    e = event_stream(spark, d).select("event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("content_hash"))
    for _ in range(2):      # a replay adds nothing
        _finish(streams.ingest_records(e, path, scratch_path(spark, "mark"), order_col="event_id", buckets=buckets))
    return streams.ingested(spark, path)


@query("s01_streamed_insert_or_ignore", _FIRST_SQL)
def s01(spark, d):
    return _ingested_twice(spark, d, None)


@query("s01_bucketed_insert_or_ignore", _FIRST_SQL)
def s01_buckets(spark, d):
    return _ingested_twice(spark, d, 16)


@query("s01_distinct_within_watermark", "SELECT user_id, event_type FROM events GROUP BY user_id, event_type")
def s01_bounded(spark, d):
    path = scratch_path(spark, "within")
    e = event_stream(spark, d).withColumn("at", F.col("ts").cast("timestamp")).select("user_id", "event_type", "at")
    once = streams.distinct_within(e, ["user_id", "event_type"], "at", "400 days")
    _finish(once.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "mark"))
            .trigger(availableNow=True).start())
    return spark.read.parquet(path).select("user_id", "event_type")


@query("s02_job_progress", """SELECT user_id AS job_id, arg_max(event_type, ts) AS status, arg_max(CAST(floor(value) AS BIGINT), ts) AS records, max(ts) AS last_event_at,
  round(arg_max(event_id % 100, ts) / 100 * 100, 1) AS percent FROM events GROUP BY user_id""")
def s02(spark, d):
    path, mark = scratch_path(spark, "progress"), scratch_path(spark, "mark")

    def start(events):
        e = events.select(F.col("user_id").alias("job_id"), "ts", F.col("event_type").alias("status"), F.floor("value").cast("bigint").alias("records"),
                          (F.col("event_id") % 100).alias("current"), F.lit(100).alias("total"))

        def upsert(batch, batch_id):        # the jobs that changed
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        return streams.job_progress(e).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", mark).trigger(availableNow=True).start()
    _in_arrivals(spark, d, "progress-events", start)
    return _latest(spark, path, "job_id").select("job_id", "status", "records", "last_event_at", "percent")


@query("s03_change_events", """SELECT 0 AS batch_id, 0 AS total_old, count(*) AS total_new, count(*) AS added_count, 0 AS removed_count, 0 AS modified_count, 0 AS unchanged_count FROM orders
  UNION ALL SELECT 1, count(*), count(*), 0, 0, count(*) FILTER (o_orderpriority = '5-LOW'), count(*) FILTER (o_orderpriority <> '5-LOW') FROM orders""")
def s03(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_index"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    source, snaps, events, mark = (scratch_path(spark, n) for n in ("feed", "snaps", "changes", "mark"))
    changed = o.withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "5-LOW", "X").otherwise(F.col("o_orderstatus")))
    for part in (o, changed):     # two arrivals, one snapshot each, in the same stream
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(o.schema).parquet(source)
        _finish(streams.watch_changes(stream, snaps, events, mark, ["o_orderkey"]))
    return spark.read.parquet(events).select("batch_id", "total_old", "total_new", "added_count", "removed_count", "modified_count", "unchanged_count")


_SNAPSHOTS_SQL = """WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_orderpriority = '5-LOW') AS low, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders)
  SELECT 1 AS snapshot, 0 AS total_old, n AS total_new, n AS added_count, 0 AS removed_count, 0 AS modified_count, 0 AS unchanged_count FROM c
  UNION ALL SELECT 2, n, n, 0, 0, low, n - low FROM c UNION ALL SELECT 3, n, n - urgent, 0, urgent, low, n - urgent - low FROM c"""


def _marked_snapshots(spark, d):
    """Three snapshots of the orders with their end marks; the third lacks the urgent ones and has the first's status again."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_index"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    changed = o.withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "5-LOW", "X").otherwise(F.col("o_orderstatus")))
    rows = [df.withColumns({"snapshot_id": F.lit(k), "ended": F.lit(False)}) for k, df in enumerate((o, changed, o.where("o_orderpriority <> '1-URGENT'")), 1)]
    marks = [spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in o.schema], F.lit(k).alias("snapshot_id"), F.lit(True).alias("ended")) for k in (1, 2, 3)]
    return rows, marks


def _watched(spark, arrivals):
    source, path, mark = (scratch_path(spark, n) for n in ("feed", "watched", "mark"))
    for arrival in arrivals:
        arrival.write.mode("append").parquet(source)
        _finish(streams.watch_snapshots(spark.readStream.schema(arrival.schema).parquet(source), path, mark, ["o_orderkey"]))
    return streams.snapshot_events(spark, path)


@query("s03_snapshots_in_one_arrival", _SNAPSHOTS_SQL)
def s03_one(spark, d):
    rows, marks = _marked_snapshots(spark, d)
    return _watched(spark, [reduce(DataFrame.unionByName, [*rows, *marks])])


@query("s03_snapshots_over_arrivals", _SNAPSHOTS_SQL)
def s03_many(spark, d):
    """The rows of the first two snapshots come mixed in two arrivals, the third's over three; marks come with the last rows."""
    (a, b, c), (end_a, end_b, end_c) = _marked_snapshots(spark, d)
    part = lambda df, k: df.where(F.col("o_orderkey") % 3 == k)
    both = lambda *frames: reduce(DataFrame.unionByName, frames)
    return _watched(spark, [both(part(a, 0), part(b, 0), part(c, 0)), both(part(a, 1), part(a, 2), end_a, part(c, 1)), both(part(b, 1), part(b, 2), end_b, part(c, 2), end_c)])


@query("s04_windowed_quality", """SELECT date_trunc('day', ts) AS window_start, count(*) AS records, CAST(sum(2 - (event_type = 'error')::INT) AS BIGINT) AS filled,
  CAST(sum((event_type <> 'error')::INT) AS BIGINT) AS valid, 2 * count(*) AS cells FROM events GROUP BY 1""")
def s04(spark, d):
    path, mark = scratch_path(spark, "quality"), scratch_path(spark, "mark")

    def start(events):
        e = events.select(F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") != "error", F.concat(F.lit(" "), F.col("event_type"))).alias("name"),
                          F.lit("no link").alias("url"))
        rolled = streams.windowed_quality(streams.clean_stream(e, ["name", "url"]), ["name", "url"], "at", "1 day", delay="1 day")

        def store(batch, batch_id):         # the windows that changed; those behind the watermark have left the state
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        return rolled.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", mark).trigger(availableNow=True).start()
    _in_arrivals(spark, d, "quality-events", start)
    last = _latest(spark, path, "window_start")
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "records", "filled", "valid", "cells")
