"""Reports and state changes over projects, jobs, datasets, records and schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text
from webloom.operators import identity

# Limits of a job request.
MAX_FIELDS, MAX_NAME, MAX_SELECTOR = 20, 100, 500


def owned(children: DataFrame, projects: DataFrame, user: object, project_col: str = "project_id",
          user_col: str = "user_id", project: object = None) -> DataFrame:
    """Rows whose project belongs to `user`, optionally of one project only."""
    mine = projects.where(F.col(user_col) == F.lit(user)).select(project_col)
    kept = children if project is None else children.where(F.col(project_col) == F.lit(project))
    return kept.join(mine, project_col, "left_semi")


def newest_first(df: DataFrame, *order: str, limit: int | None = None) -> DataFrame:
    ordered = df.orderBy(*[F.desc(c) for c in order])
    return ordered if limit is None else ordered.limit(limit)


def with_parent_label(jobs: DataFrame, configs: DataFrame, key: str, label: str, default: str = "Ad-hoc Run",
                      alias: str = "config_name") -> DataFrame:
    named = configs.select(key, F.col(label).alias(alias))
    return jobs.join(named, key, "left").withColumn(alias, F.coalesce(alias, F.lit(default)))


def child_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Add one count column per child frame; children are counted before they are joined."""
    out = parents
    for name, child in children.items():
        counted = child.groupBy(key).agg(F.count("*").alias(name))
        out = out.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return out


def lookup(df: DataFrame, **equal: object) -> DataFrame:
    """First row with the given values, or none."""
    for name, value in equal.items():
        df = df.where(F.col(name) == F.lit(value))
    return df.limit(1)


def record_json(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})


def search_records(df: DataFrame, query: str | None, json: Column) -> DataFrame:
    """Records whose JSON text contains the query, any case; a blank query keeps all."""
    if not query or not query.strip():
        return df
    return df.where(F.lower(json).contains(query.lower().strip()))


def search_records_like(df: DataFrame, query: str, json: Column) -> DataFrame:
    """LIKE search: `%` and `_` are wildcards, any case."""
    return df.where(json.ilike(f"%{query}%"))


def _checked(page: int, per_page: int) -> None:
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")


def page_of(df: DataFrame, order_col: str, page: int = 1, per_page: int = 25) -> DataFrame:
    """One page of records in order: a top-k of the rows up to the page; `page_after` serves deep pages."""
    _checked(page, per_page)
    return df.orderBy(order_col).offset((page - 1) * per_page).limit(per_page)


def page_after(df: DataFrame, key: str, last=None, per_page: int = 25) -> DataFrame:
    """The page that follows the row with key `last` (the first without): a pushed-down filter and a top-k of one page."""
    _checked(1, per_page)
    rows = df if last is None else df.where(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(per_page)


def dense_page_of(df: DataFrame, index_col: str, page: int = 1, per_page: int = 25) -> DataFrame:
    """The same page when `index_col` numbers the records 0, 1, … without gaps (as stored records are): a pushed-down range
    filter, so deep pages cost no more than the first."""
    _checked(page, per_page)
    low = (page - 1) * per_page
    return df.where(F.col(index_col).between(low, low + per_page - 1)).orderBy(index_col)


def job_outcomes(results: DataFrame, job: str, data: Column, error: Column, cancelled: Column | None = None,
                 fatal: Column | None = None) -> DataFrame:
    """Per job: pages visited, valid records, errors and both status rules.  `fatal` marks rows of a job that broke off."""
    stop = F.bool_or(cancelled) if cancelled is not None else F.lit(False)
    broke = F.bool_or(fatal) if fatal is not None else F.lit(False)
    rolled = results.groupBy(job).agg(
        F.count("*").alias("pages_scraped"), F.count_if(data).alias("records_count"),
        F.count_if(error).alias("errors_count"), stop.alias("_stop"), broke.alias("_broke"))
    status = F.when(F.col("_broke"), "failed").when(F.col("_stop"), "cancelled").otherwise("completed")
    legacy = (F.when(F.col("_stop"), "Cancelled")
              .when((F.col("records_count") > 0) & (F.col("errors_count") > 0), "Partially Completed")
              .when(F.col("records_count") > 0, "Completed").otherwise("Failed"))
    return rolled.withColumn("status", status).withColumn("legacy_status", legacy).drop("_stop", "_broke")


def fleet_kpis(jobs: DataFrame, status: str = "status", records: str = "records_count") -> DataFrame:
    """One row: total jobs, records, success rate in percent (100 when there are no jobs), active."""
    done = F.count_if(F.col(status) == "completed")
    rate = F.when(F.count("*") > 0, F.floor(done / F.count("*") * 100 + 0.5)).otherwise(100)
    return jobs.agg(F.count("*").alias("total_jobs"),
                    F.coalesce(F.sum(F.coalesce(records, F.lit(0))), F.lit(0)).cast("bigint").alias("total_records"),
                    F.concat(rate.cast("bigint").cast("string"), F.lit("%")).alias("success_rate"),
                    F.count_if(F.lower(status).isin("running", "pending")).alias("active_jobs"))


# Advice texts, in order of trial.
ADVICE = {
    "empty": ("Crawl succeeded but no records or matching fields were extracted.",
              ["The target website may require JavaScript hydration. Switch Extraction Mode from 'HTTP' to 'Browser' (Playwright).",
               "Inspect the CSS/XPath selectors using the Visual Selector Builder to ensure the classes match."]),
    "forbidden": ("Server returned 403 Forbidden.",
                  ["Check the site's robots.txt to ensure your path is allowed.",
                   "Increase crawl delay to respect rate limits."]),
    "limited": ("Server returned HTTP 429 Too Many Requests.",
                ["Increase crawl delay to at least 3.0 - 5.0 seconds.", "Lower max concurrent pages."]),
    "timeout": ("Network connection timed out.",
                ["Increase request timeout setting.", "Verify target host DNS availability."]),
    "fine": ("Job completed successfully.",
             ["No errors detected. Dataset is ready for export or RAG indexing."]),
}


def retry_advice(jobs: DataFrame) -> DataFrame:
    """Diagnosis per job from status, records_count and error_summary."""
    summary = F.coalesce(F.nullif("error_summary", F.lit("")), F.lit("Unknown error"))
    done = F.col("status") == "completed"
    case = (F.when(done & (F.col("records_count") == 0), "empty")
            .when(summary.contains("403") | summary.contains("Forbidden"), "forbidden")
            .when(summary.contains("429") | summary.contains("Rate"), "limited")
            .when(summary.contains("Timeout"), "timeout").when(done, "fine"))
    reason, actions = summary, F.array().cast("array<string>")
    for key, (words, steps) in ADVICE.items():
        hit = F.col("_case").eqNullSafe(key)
        reason = F.when(hit, F.lit(words)).otherwise(reason)
        actions = F.when(hit, F.array(*[F.lit(s) for s in steps])).otherwise(actions)
    return (jobs.withColumn("_case", case)
            .withColumn("primary_failure_reason", reason).withColumn("suggested_actions", actions)
            .withColumn("recommended_mode_switch", F.when(F.col("_case") == "empty", "browser"))
            .withColumn("can_retry", F.col("status").isin("failed", "cancelled", "completed")).drop("_case"))


def retry_rows(jobs: DataFrame, keep: Sequence[str], legacy: bool = False) -> DataFrame:
    """New pending jobs copied from old ones."""
    if legacy:
        return jobs.select(F.concat("name", F.lit(" (retry)")).alias("name"), F.lit("Pending").alias("status"),
                           *[c for c in keep if c != "name"])
    return jobs.select(*keep, F.lit("pending").alias("status"), (F.coalesce("retry_count", F.lit(0)) + 1).alias("retry_count"))


def due_schedules(schedules: DataFrame, now: Column) -> DataFrame:
    """Active schedules that are due, with last_run_at and the next run."""
    due = schedules.where(F.col("is_active") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= now)))
    minutes = F.coalesce(F.nullif("interval_minutes", F.lit(0)), F.lit(60))
    return due.withColumn("last_run_at", now).withColumn("next_run_at", F.timestamp_add("MINUTE", minutes, now))


def time_ordered(logs: DataFrame, *order: str, **equal: object) -> DataFrame:
    """Log rows of one job in time order."""
    for name, value in equal.items():
        logs = logs.where(F.col(name) == F.lit(value))
    return logs.orderBy(*order)


def without_children(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children that stay after their parents in `deleted` are removed."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def fail_interrupted(jobs: DataFrame, status: str = "status") -> DataFrame:
    return jobs.withColumn(status, F.when(F.col(status).isin("Pending", "Running"), "Failed").otherwise(F.col(status)))


def request_violations(requests: DataFrame, fields: str = "selectors") -> DataFrame:
    """`violations` of job requests: `selectors` MAP<name, selector>, max_pages, max_depth, crawl_delay."""
    names, values = F.map_keys(fields), F.map_values(fields)
    checks = [
        (F.size(names) > MAX_FIELDS, "at most 20 fields"),
        (F.exists(names, lambda n: (text.strip(n) == "") | (F.length(n) > MAX_NAME)), "field names must be 1 to 100 characters"),
        (F.exists(values, lambda v: (text.strip(v) == "") | (F.length(v) > MAX_SELECTOR)), "selectors must be 1 to 500 characters"),
    ]
    limits = {"max_pages": (1, 500), "max_depth": (0, 10), "crawl_delay": (0.1, 30.0)}
    for name, (low, high) in limits.items():
        if name in requests.columns:
            checks.append((~F.col(name).between(low, high), f"{name} must be between {low} and {high}"))
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(words)) for bad, words in checks])
    return requests.withColumn("violations", F.filter(found, lambda v: v.isNotNull()))


def grid_columns(df: DataFrame, most: int = 6) -> DataFrame:
    """The first columns of a result page."""
    return df.select(*df.columns[:most])


def _cell(value: Column) -> Column:
    """A VARIANT as the text of a table cell: lists joined with `; `, objects as JSON, nulls as nulls."""
    kind = F.schema_of_variant(value)
    plain = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT") | F.schema_of_variant(v).startswith("ARRAY"), F.to_json(v)).otherwise(
        F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("None")))
    items = F.array_join(F.transform(F.try_variant_get(value, "$", "array<variant>"), plain), "; ")
    return F.when(value.isNull() | F.is_variant_null(value), F.lit(None).cast("string")).when(kind.startswith("ARRAY"), items).otherwise(plain(value))


def record_grid(records: DataFrame, json_col: str, order_col: str, most: int | None = None) -> DataFrame:
    """JSON records as a table: order_col and one text column per field that any record has, in the order first seen.

    A first pass finds the names (one row per name reaches the driver, as many as the table has columns), a second one lays
    out every record; `most` keeps the first columns only."""
    names = identity.json_keys(records, json_col, order_col).orderBy("first_record", "first_place", "field").select("field")
    names = [r["field"] for r in (names if most is None else names.limit(most)).collect()]
    held = records.select(F.col(order_col), F.try_parse_json(json_col).try_cast("map<string,variant>").alias("_r"))
    return held.select(order_col, *[_cell(F.element_at("_r", F.lit(n))).alias(n) for n in names])


def dataset_label(name: Column, at: Column) -> Column:
    return F.concat(F.lit("Dataset - "), F.coalesce(name, F.lit("Ad-hoc")), F.lit(" ("),
                    F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit(")"))


def field_label(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def duration_seconds(start: Column, end: Column) -> Column:
    return F.round(F.timestamp_diff("MICROSECOND", start, end) / 1e6, 2)
