"""Reports over projects, jobs, records and schedules."""

from pyspark.sql import functions as F

from webloom.operators import jobs as J
from webloom.plans import derived
from webloom.plans.derived import JOBS_SQL
from webloom.plans.registry import query, table
from webloom.session import scratch_path
from webloom.sources import readers, writers


def _projects(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_mktsegment").alias("user_id"), F.col("c_name").alias("name"), "c_acctbal")


@query("j01_owned_jobs", f"SELECT job_id, project_id, status FROM {JOBS_SQL} JOIN customer ON project_id = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def j01(spark, d):
    return J.newest_first(J.owned(derived.jobs(spark, d), _projects(spark, d), "MACHINERY"), "created_at", "job_id").select("job_id", "project_id", "status")


@query("j01_owned_jobs_of_project", f"SELECT job_id, status FROM {JOBS_SQL} JOIN customer ON project_id = c_custkey WHERE c_mktsegment = (SELECT c_mktsegment FROM customer ORDER BY c_custkey LIMIT 1) AND project_id = (SELECT min(c_custkey) FROM customer)")
def j01_project(spark, d):
    first = _projects(spark, d).orderBy("project_id").first()
    return J.owned(derived.jobs(spark, d), _projects(spark, d), first["user_id"], project=first["project_id"]).select("job_id", "status")


@query("j02_parent_label", f"SELECT job_id, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, 'Ad-hoc Run') AS config_name FROM {JOBS_SQL} LEFT JOIN customer ON project_id = c_custkey")
def j02(spark, d):
    return J.with_parent_label(derived.jobs(spark, d), _projects(spark, d).where("c_acctbal > 0"), "project_id", "name").select("job_id", "config_name")


@query("j03_child_counts", f"""SELECT c_custkey AS project_id, (SELECT count(*) FROM {JOBS_SQL} AS a WHERE a.project_id = c_custkey) AS jobs,
  (SELECT count(*) FROM {JOBS_SQL} AS b WHERE b.project_id = c_custkey AND b.status = 'failed') AS failed FROM customer""")
def j03(spark, d):
    runs = derived.jobs(spark, d)
    return J.child_counts(_projects(spark, d).select("project_id"), "project_id", jobs=runs, failed=runs.where("status = 'failed'"))


@query("j04_lookup", "SELECT doc_id, lang FROM documents WHERE doc_id = 7 AND lang = (SELECT lang FROM documents WHERE doc_id = 7)")
def j04(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "lang")
    return J.lookup(J.lookup(doc, doc_id=7), doc_id=7)


@query("j05_search_records", """SELECT event_id FROM events WHERE contains(lower('{"event_type":"' || event_type || '","user_id":' || user_id || ',"props":' || props || '}'), 'purchase","user_id":1')""")
def j05(spark, d):
    e = table(spark, d, "events")
    return J.search_records(e, "  PURCHASE\",\"user_id\":1 ", J.record_json(["event_type", "user_id", "props"])).select("event_id")


@query("j05_blank_search", "SELECT event_id FROM events")
def j05_blank(spark, d):
    return J.search_records(table(spark, d, "events"), "  ", J.record_json(["event_type"])).select("event_id")


@query("j06_search_like", """SELECT event_id FROM events WHERE props ILIKE '%K": 1_}%'""")
def j06(spark, d):
    return J.search_records_like(table(spark, d, "events"), 'K": 1_}', F.col("props")).select("event_id")


@query("j07_page_of_results", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def j07(spark, d):
    return J.page_of(table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus"), "o_orderkey", page=3)


@query("j07_dense_page", "SELECT doc_id, lang FROM documents WHERE doc_id BETWEEN 100 AND 149")
def j07_dense(spark, d):
    return J.dense_page_of(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", page=3, per_page=50)


@query("j07_total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F'")
def j07_total(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").agg(F.count("*").alias("total"))


@query("j08_newest_jobs", f"SELECT job_id, status FROM {JOBS_SQL} ORDER BY job_id DESC LIMIT 100")
def j08(spark, d):
    return J.newest_first(derived.jobs(spark, d), "job_id", limit=100).select("job_id", "status")


@query("j09_job_outcomes", """WITH r AS (SELECT user_id AS job_id, count(*) AS pages_scraped, count(*) FILTER (event_type <> 'error') AS records_count, count(*) FILTER (event_type = 'error') AS errors_count,
    bool_or(event_type = 'signup' AND value > 40) AS stop, bool_or(event_type = 'error' AND value > 80) AS broke FROM events GROUP BY user_id)
  SELECT job_id, pages_scraped, records_count, errors_count, CASE WHEN broke THEN 'failed' WHEN stop THEN 'cancelled' ELSE 'completed' END AS status,
  CASE WHEN stop THEN 'Cancelled' WHEN records_count > 0 AND errors_count > 0 THEN 'Partially Completed' WHEN records_count > 0 THEN 'Completed' ELSE 'Failed' END AS legacy_status FROM r""")
def j09(spark, d):
    r = derived.job_results(spark, d)
    return J.job_outcomes(r, "job_id", ~F.col("is_error"), F.col("is_error"), F.col("is_stop") & (F.col("value") > 40), F.col("is_error") & (F.col("value") > 80))


@query("j07_page_after", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 300 ORDER BY o_orderkey LIMIT 25")
def j07_after(spark, d):
    return J.page_after(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 300)


@query("j10_fleet_kpis", f"""SELECT count(*) AS total_jobs, CAST(sum(coalesce(records_count, 0)) AS BIGINT) AS total_records,
  CAST(floor(100.0 * count(*) FILTER (status = 'completed') / count(*) + 0.5) AS BIGINT) || '%' AS success_rate, count(*) FILTER (status IN ('running', 'pending')) AS active_jobs FROM {JOBS_SQL}""")
def j10(spark, d):
    return J.fleet_kpis(derived.jobs(spark, d))


@query("j10_kpis_without_jobs", "SELECT count(*) AS total_jobs, 0 AS total_records, '100%' AS success_rate, 0 AS active_jobs FROM orders WHERE o_orderstatus = 'none'")
def j10_none(spark, d):
    return J.fleet_kpis(derived.jobs(spark, d).where("status = 'none'"))


@query("j11_retry_advice", f"""WITH c AS (SELECT *, coalesce(error_summary, 'Unknown error') AS e FROM {JOBS_SQL}), k AS (SELECT *, CASE WHEN status = 'completed' AND records_count = 0 THEN 0
    WHEN contains(e, '403') THEN 1 WHEN contains(e, '429') OR contains(e, 'Rate') THEN 2 WHEN contains(e, 'Timeout') THEN 3 WHEN status = 'completed' THEN 4 ELSE 5 END AS n FROM c)
  SELECT job_id, CASE n WHEN 0 THEN 'Crawl succeeded but no records or matching fields were extracted.' WHEN 1 THEN 'Server returned 403 Forbidden.' WHEN 2 THEN 'Server returned HTTP 429 Too Many Requests.'
    WHEN 3 THEN 'Network connection timed out.' WHEN 4 THEN 'Job completed successfully.' ELSE e END AS primary_failure_reason, CASE n WHEN 4 THEN 1 WHEN 5 THEN 0 ELSE 2 END AS n_actions,
  CASE WHEN n = 0 THEN 'browser' END AS recommended_mode_switch, status IN ('failed', 'cancelled', 'completed') AS can_retry FROM k""")
def j11(spark, d):
    a = J.retry_advice(derived.jobs(spark, d))
    return a.select("job_id", "primary_failure_reason", F.size("suggested_actions").alias("n_actions"), "recommended_mode_switch", "can_retry")


@query("j12_retry_rows", f"SELECT project_id, o_orderpriority, 'pending' AS status, 1 AS retry_count FROM {JOBS_SQL} WHERE status = 'failed'")
def j12(spark, d):
    failed = derived.jobs(spark, d).where("status = 'failed'").withColumn("retry_count", F.lit(None).cast("int"))
    return J.retry_rows(failed, ["project_id", "o_orderpriority"])


@query("j12_legacy_retry_rows", "SELECT c_name || ' (retry)' AS name, 'Pending' AS status, c_mktsegment FROM customer")
def j12_legacy(spark, d):
    return J.retry_rows(table(spark, d, "customer").withColumnRenamed("c_name", "name"), ["name", "c_mktsegment"], legacy=True)


@query("j13_due_schedules", """WITH s AS (SELECT o_orderkey, o_orderstatus <> 'P' AS is_active, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 15 END AS m,
    CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderdate END AS next_run_at FROM orders)
  SELECT o_orderkey, TIMESTAMP '1998-01-01 12:00:00' AS last_run_at, TIMESTAMP '1998-01-01 12:00:00' + to_minutes(CAST(CASE WHEN coalesce(m, 0) = 0 THEN 60 ELSE m END AS BIGINT)) AS next_run_at
  FROM s WHERE is_active AND (next_run_at IS NULL OR next_run_at <= TIMESTAMP '1998-01-01 12:00:00')""")
def j13(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    plan = o.select("o_orderkey", (F.col("o_orderstatus") != "P").alias("is_active"), F.when(k == 0, None).when(k == 1, 0).otherwise(15).alias("interval_minutes"),
                    F.when(F.col("o_orderpriority") == "1-URGENT", None).otherwise(F.col("o_orderdate")).alias("next_run_at"))
    return J.due_schedules(plan, F.expr("TIMESTAMP_NTZ '1998-01-01 12:00:00'")).select("o_orderkey", "last_run_at", "next_run_at")


@query("j14_job_logs", "SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS n FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def j14(spark, d):
    from pyspark.sql.window import Window
    e = table(spark, d, "events")
    first = e.agg(F.min("user_id").alias("u")).first()["u"]
    logs = J.time_ordered(e, "ts", "event_id", user_id=first)
    return logs.select("event_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))


@query("j15_cascade_delete", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def j15(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return J.without_children(table(spark, d, "lineitem"), gone, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("j16_fail_interrupted", f"SELECT job_id, CASE WHEN status IN ('running', 'pending') THEN 'Failed' ELSE status END AS status FROM {JOBS_SQL}")
def j16(spark, d):
    jobs = derived.jobs(spark, d).withColumn("status", F.when(F.col("status").isin("running", "pending"), F.initcap("status")).otherwise(F.col("status")))
    return J.fail_interrupted(jobs).select("job_id", "status")


@query("j17_rule_validation", """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 20 THEN 'at most 20 fields' END, CASE WHEN p_partkey % 3 = 0 THEN 'field names must be 1 to 100 characters' END,
  CASE WHEN p_partkey % 4 = 0 THEN 'selectors must be 1 to 500 characters' END, CASE WHEN p_retailprice > 500 THEN 'max_pages must be between 1 and 500' END], lambda x: x IS NOT NULL), '; ') AS violations FROM part""")
def j17(spark, d):
    p = table(spark, d, "part")
    names = F.transform(F.sequence(F.lit(1), F.greatest("p_size", F.lit(1))), lambda i: F.concat(F.lit("f"), i.cast("string")))
    names = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0))), F.array(F.repeat(F.lit("x"), 101)))).otherwise(names)
    selector = F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(".a")
    asked = p.select("p_partkey", F.map_from_arrays(names, F.array_repeat(selector, F.size(names))).alias("selectors"), F.ceil("p_retailprice").alias("max_pages"))
    return J.request_violations(asked).select("p_partkey", F.array_join("violations", "; ").alias("violations"))


@query("j18_result_grid", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def j18(spark, d):
    return J.grid_columns(table(spark, d, "lineitem"))


_VARIED = """'{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || CASE WHEN event_id % 2 = 0 THEN ',"even":' || event_id ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ',"list":["a",' || user_id || ']' ELSE '' END
  || CASE WHEN event_id % 5 = 0 THEN ',"deep":{"t":"' || event_type || '"}' ELSE '' END || ',"last":null}'"""


def _varied_records(spark, d):
    some = lambda k, *parts: F.when(F.col("event_id") % k == 0, F.concat(*[F.lit(p) if p[0] in ',"]}' else F.col(p).cast("string") for p in parts])).otherwise("")
    data = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), some(2, ',"even":', "event_id"), some(3, ',"list":["a",', "user_id", "]"),
                    some(5, ',"deep":{"t":"', "event_type", '"}'), F.lit(',"last":null}'))
    return table(spark, d, "events").select("event_id", data.alias("data"))


@query("j18_record_grid", """SELECT event_id, CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS k, CASE WHEN event_id % 2 = 0 THEN '' || event_id END AS even,
  CASE WHEN event_id % 3 = 0 THEN 'a; ' || user_id END AS list, CASE WHEN event_id % 5 = 0 THEN '{"t":"' || event_type || '"}' END AS deep, NULL::VARCHAR AS last FROM events""")
def j18_records(spark, d):
    return J.record_grid(_varied_records(spark, d), "data", "event_id")


@query("snk3_csv_of_records", """SELECT '' || event_id AS event_id, CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS k, CASE WHEN event_id % 2 = 0 THEN '' || event_id END AS even,
  CASE WHEN event_id % 3 = 0 THEN 'a; ' || user_id END AS list, CASE WHEN event_id % 5 = 0 THEN '{"t":"' || event_type || '"}' END AS deep, NULL::VARCHAR AS last FROM events""")
def snk3_records(spark, d):
    """The grid written as CSV, its header the union of the records' fields, and read again."""
    path = scratch_path(spark, "grid")
    writers.write_csv(J.record_grid(_varied_records(spark, d), "data", "event_id"), path)
    return readers.read_exported_csv(spark, path)
