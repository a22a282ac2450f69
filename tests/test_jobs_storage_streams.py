import csv
import datetime
import glob
import io
import json

import pytest
from pyspark.sql import functions as F

from webloom import session as sess
from webloom.operators import admission, jobs as J
from webloom.plans import flows
from webloom.sources import readers, writers
from webloom.streaming import streams


def test_retry_advice(spark):
    rows = [("a", "failed", 0, "HTTP 403"), ("b", "failed", 0, "got 429"), ("c", "failed", 0, "ReadTimeout"), ("d", "completed", 0, None), ("e", "completed", 4, None),
            ("f", "running", 0, None), ("g", "failed", 2, "odd"), ("h", "failed", None, "")]
    got = {r.id: (r.primary_failure_reason, len(r.suggested_actions), r.recommended_mode_switch, r.can_retry)
           for r in J.retry_advice(spark.createDataFrame(rows, "id string, status string, records_count int, error_summary string")).collect()}
    assert got["a"] == ("Server returned 403 Forbidden.", 2, None, True)
    assert got["b"][0].startswith("Server returned HTTP 429") and got["c"][0] == "Network connection timed out."
    assert got["d"][2] == "browser" and got["e"][1] == 1 and got["f"] == ("Unknown error", 0, None, False)
    assert got["g"][:2] == ("odd", 0) and got["h"][0] == "Unknown error"


def test_due_schedules(spark):
    now = datetime.datetime(2026, 1, 1, 12)
    rows = [("null next", True, 15, None), ("due zero", True, 0, now), ("due null", True, None, now - datetime.timedelta(days=1)), ("later", True, 5, now + datetime.timedelta(minutes=1)),
            ("off", False, 5, None)]
    df = spark.createDataFrame(rows, "id string, is_active boolean, interval_minutes int, next_run_at timestamp_ntz")
    got = {r.id: r.next_run_at for r in J.due_schedules(df, F.lit(now).cast("timestamp_ntz")).collect()}
    assert got == {"null next": now + datetime.timedelta(minutes=15), "due zero": now + datetime.timedelta(hours=1), "due null": now + datetime.timedelta(hours=1)}


def test_job_outcomes_and_kpis(spark):
    rows = [("ok", True, False), ("ok", True, False), ("part", True, False), ("part", False, True), ("bad", False, True)]
    df = spark.createDataFrame(rows, "job string, has boolean, err boolean")
    got = {r.job: (r.pages_scraped, r.records_count, r.errors_count, r.legacy_status) for r in J.job_outcomes(df, "job", F.col("has"), F.col("err")).collect()}
    assert got == {"ok": (2, 2, 0, "Completed"), "part": (2, 1, 1, "Partially Completed"), "bad": (1, 0, 1, "Failed")}
    kpis = J.fleet_kpis(spark.createDataFrame([("completed", 3), ("failed", None), ("Running", 1)], "status string, records_count int")).first()
    assert (kpis.total_jobs, kpis.total_records, kpis.success_rate, kpis.active_jobs) == (3, 4, "33%", 1)


def test_request_violations(spark):
    many = {f"f{i}": ".a" for i in range(21)}
    rows = [(1, {"title": "h1"}, 10, 2, 1.0), (2, many, 501, 2, 1.0), (3, {" ": ".a", "b": ""}, 1, 11, 0.05)]
    df = spark.createDataFrame(rows, "id int, selectors map<string,string>, max_pages int, max_depth int, crawl_delay double")
    got = {r.id: r.violations for r in J.request_violations(df).collect()}
    assert got[1] == [] and len(got[2]) == 2 and len(got[3]) == 4


def test_pages_of_results_use_bounded_sorts(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey")
    assert "TakeOrderedAndProject" in J.page_of(orders, "o_orderkey", 3)._jdf.queryExecution().executedPlan().toString()
    deep = J.dense_page_of(orders, "o_orderkey", 1000)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey" in deep


def test_response_admission(spark):
    rows = [("a", "<p>ok</p>", 200, "text/html"), ("b", "<p>ok</p>", 404, "text/html"), ("c", "x" * 50, 200, "text/html"), ("d", "{}", 200, "application/json")]
    df = spark.createDataFrame(rows, "url string, html string, status_code int, content_type string")
    got = {r.url: (r.error, r.html) for r in admission.admit_response(df, 40, require_html=True).collect()}
    assert got["a"] == (None, "<p>ok</p>") and got["b"][0] == "HTTP status 404" and "exceeds" in got["c"][0] and "not HTML" in got["d"][0]
    assert got["d"][1] is None


RECORDS = [(0, "a, \"b\"", ["x", "y"], {"k": 1}, None), (1, "नमस्ते\nline", [], None, 2.5)]
RECORD_TYPE = "record_index int, title string, links array<string>, data struct<k:int>, score double"


def test_csv_exports_survive_a_round_trip(spark, tmp_path):
    df = spark.createDataFrame(RECORDS, RECORD_TYPE)
    assert df.transform(writers.csv_rows).orderBy("record_index").first().links == "x; y"
    writers.write_csv(df, str(tmp_path / "legacy"), legacy=True)
    back = readers.read_exported_csv(spark, str(tmp_path / "legacy"))
    rows = {r.record_index: r for r in back.collect()}
    assert back.columns == ["record_index", "title", "links", "data", "score"]
    assert json.loads(rows["0"].links) == ["x", "y"] and rows["0"].title == 'a, "b"' and rows["1"].title == "नमस्ते\nline"
    files = [open(f, encoding="utf-8").read() for f in glob.glob(str(tmp_path / "legacy" / "*.csv"))]
    assert all(t.startswith("﻿") for t in files)
    assert sum(len(list(csv.reader(io.StringIO(t)))) - 1 for t in files) == 2


def test_bom_csv_with_devanagari(spark, tmp_path):
    path = tmp_path / "notices.csv"
    path.write_text('﻿title,published_date,url,scraped_at\n"सूचना, एक","असोज १, २०८३",https://n.example/1/,2026-09-18 14:34:46\n', encoding="utf-8")
    from webloom.functions import cleaning as C
    row = readers.read_exported_csv(spark, str(path)).select(
        "title", C.to_date(F.col("published_date")).alias("d"), C.to_int(F.col("published_date")).alias("n"), C.to_date(F.col("scraped_at")).alias("s")).first()
    assert tuple(row) == ("सूचना, एक", "असोज १, २०८३", 1, "2026-09-18")


def test_json_files(spark, tmp_path):
    path = tmp_path / "page.json"
    path.write_text(json.dumps([{"title": "T", "url": "https://e.example", "links": ["https://i.example"]}], indent=2))
    row = readers.read_page_json(spark, str(path)).first()
    assert (row.title, row.links) == ("T", ["https://i.example"])
    df = spark.createDataFrame(RECORDS, RECORD_TYPE)
    writers.write_jsonl(writers.export_rows(df.withColumn("source_url", F.lit("u")), ["title", "score"]), str(tmp_path / "out"))
    lines = [json.loads(line) for f in glob.glob(str(tmp_path / "out" / "*.json")) for line in open(f, encoding="utf-8")]
    assert {"title": "a, \"b\"", "score": None, "_source_url": "u"} in lines
    array = json.loads(writers.json_arrays(df, "record_index").first().json)
    assert [r["record_index"] for r in array] == [0, 1] and array[0]["score"] is None


def test_whole_text_and_json_decoding(spark, tmp_path):
    (tmp_path / "robots.txt").write_text("User-agent: *\nDisallow: /x\n")
    assert readers.read_whole_text(spark, str(tmp_path / "robots.txt")).first().body.startswith("User-agent")
    df = readers.decode_json(spark.createDataFrame([('{"a": 1}',), ("{bad",)], "j string"), "j", "a int")
    assert [r.data.a if r.data else None for r in df.collect()] == [1, None]


def test_insert_or_ignore(spark):
    stored = spark.createDataFrame([("j1", "h1", "old")], "job_id string, content_hash string, v string")
    batch = spark.createDataFrame([("j1", "h1", "again"), ("j1", "h2", "first"), ("j1", "h2", "second"), ("j2", "h1", "other")], "job_id string, content_hash string, v string")
    got = {(r.job_id, r.content_hash, r.v) for r in writers.new_records(batch, stored, order_col="v").collect()}
    assert got == {("j1", "h2", "first"), ("j2", "h1", "other")}


def test_record_table_is_partitioned(spark, tmp_path):
    df = spark.createDataFrame([("d1", i, "u") for i in range(5)] + [("d2", 0, "u")], "dataset_id string, record_index long, source_url string")
    writers.write_records(df, str(tmp_path / "r"))
    table = spark.read.parquet(str(tmp_path / "r"))
    one = readers.read_records(table, "d1")
    assert [r.record_index for r in one.collect()] == [0, 1, 2, 3, 4]
    assert "PartitionFilters: [isnotnull(dataset_id" in one._jdf.queryExecution().executedPlan().toString()


def test_page_table_grows_columns(spark, tmp_path):
    page = spark.createDataFrame([("t", "u", "x", ["a", "b"], "now")], "title string, url string, text string, links array<string>, scraped_at string")
    page.drop("links").withColumn("links", F.lit("")).write.parquet(str(tmp_path / "p"))
    writers.write_pages(page, str(tmp_path / "p"))
    rows = spark.read.option("mergeSchema", "true").parquet(str(tmp_path / "p")).collect()
    assert {r.links for r in rows} == {"", "a | b"} and any(r.data and json.loads(r.data)["links"] == ["a", "b"] for r in rows)


def _feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)


def test_bucketed_ingestion_reads_the_buckets_of_the_batch(spark, tmp_path):
    schema = "job_id string, content_hash string, n int"
    src, sink, mark = (str(tmp_path / p) for p in ("src", "sink", "mark"))
    for rows in ([(f"j{i}", "1", i) for i in range(200)] + [("j1", "1", 900)], [("j7", "1", 901), ("j7", "2", 902), ("j7", "2", 903)]):
        _feed(spark, src, rows, schema)
        streams.ingest_records(spark.readStream.schema(schema).parquet(src), sink, mark, order_col="n", buckets=32).awaitTermination()
    streams.ingest_records(spark.readStream.schema(schema).parquet(src), sink, str(tmp_path / "mark2"), order_col="n", buckets=32).awaitTermination()
    want = [(f"j{i}", "1", i) for i in range(200)] + [("j7", "2", 902)]
    assert sorted(tuple(r) for r in streams.ingested(spark, sink).select("job_id", "content_hash", "n").collect()) == sorted(want)
    assert spark.read.parquet(sink).select("_bucket").distinct().count() == 32


def test_streamed_ingestion_is_exact_over_batches_and_replays(spark, tmp_path):
    schema = "job_id string, content_hash string, n int"
    src, sink, mark = (str(tmp_path / p) for p in ("src", "sink", "mark"))
    for rows in ([("a", "1", 1), ("a", "1", 2), ("b", "1", 3)], [("a", "1", 4), ("a", "2", 5)]):
        _feed(spark, src, rows, schema)
        streams.ingest_records(spark.readStream.schema(schema).parquet(src), sink, mark, order_col="n").awaitTermination()
    streams.ingest_records(spark.readStream.schema(schema).parquet(src), sink, str(tmp_path / "mark2"), order_col="n").awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(sink).collect()) == [("a", "1", 1), ("a", "2", 5), ("b", "1", 3)]


def test_progress_ignores_late_rows(spark):
    at = lambda m: datetime.datetime(2026, 1, 1, 10, m)
    rows = [("j", at(0), "running", 0, 1, 4), ("j", at(9), "completed", 3, 4, 4), ("j", at(5), "running", 1, 2, 4), ("j", at(9), "completed", 3, 4, 4), ("k", at(1), "running", None, None, 0)]
    df = spark.createDataFrame(rows, "job_id string, ts timestamp, status string, records int, current int, total int")
    got = {r.job_id: (r.status, r.records, r.percent, r.is_terminal) for r in streams.job_progress(df).collect()}
    assert got == {"j": ("completed", 3, 100.0, True), "k": ("running", None, 0.0, False)}


def test_change_watch_appends_one_event_per_snapshot(spark, tmp_path):
    schema = "record_index int, id string, v string"
    src, snaps, events, mark = (str(tmp_path / p) for p in ("src", "snaps", "events", "mark"))
    for rows in ([(0, "1", "a"), (1, "2", "b")], [(0, "2", "c"), (1, "3", "d")], [(0, "2", "c")]):
        _feed(spark, src, rows, schema)
        streams.watch_changes(spark.readStream.schema(schema).parquet(src), snaps, events, mark, ["id"]).awaitTermination()
    got = [(r.added_count, r.removed_count, r.modified_count, r.unchanged_count) for r in spark.read.parquet(events).orderBy("batch_id").collect()]
    assert got == [(2, 0, 0, 0), (1, 1, 1, 0), (0, 1, 0, 1)]


def test_windowed_quality_batch_equals_plain_counts(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    got = streams.windowed_quality(events, ["event_type", "props"], "at", "1 day", exact_distinct=True)
    want = events.groupBy(F.to_date("at").alias("d")).agg(F.count("*").alias("n"), F.count_distinct("event_type", "props").alias("u"))
    left = {r.window_start.date(): (r.records, r.filled, r.unique_records) for r in got.collect()}
    assert left == {r.d: (r.n, 2 * r.n, r.u) for r in want.collect()}


def test_pages_to_scored_records(spark):
    pages = spark.createDataFrame([("https://a.example/1", "<h1> One  two </h1><b class='p'>$ 3.50</b>"), ("https://a.example/2", "<h1>x</h1>")], "url string, html string")
    rows = flows.page_records(pages, [{"name": "title", "selector": "h1"}, {"name": "price", "selector": ".p"}], [{"field_name": "price", "action": "to_float"}]).orderBy("url").collect()
    assert [(r.title, r.price) for r in rows] == [("One  two", 3.5), ("x", None)] and rows[0].content_hash != rows[1].content_hash
    default = flows.page_records(pages, [{"name": "title", "selector": "h1"}]).orderBy("url").first()
    assert default.title == "One two"


def test_scratch_folder_comes_from_the_session(spark, tmp_path):
    class Stub:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.checkpoint.dir": "hdfs://shared/scratch"}.get(key, default)
    assert sess.scratch_root(Stub) == "hdfs://shared/scratch"

    class Cluster:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "yarn"
    with pytest.raises(RuntimeError):
        sess.scratch_root(Cluster)
