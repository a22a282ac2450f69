"""Data quality report: completeness, validity, uniqueness.

Row counts are taken per record first and records with equal fingerprints are merged in the map
tasks; only (scope, 32-byte fingerprint, five integers) is shuffled, whatever the record width.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.cleaning import to_date
from webloom.functions.hashing import compact_hash

# Metric weights, grade limits and the field-name hints, in order of precedence.
WEIGHTS = {"Completeness": 0.40, "Validity": 0.35, "Uniqueness": 0.25}
GRADES = [("A", 90), ("B", 80), ("C", 70), ("D", 60)]
DESCRIPTIONS = {
    "Completeness": "Percentage of populated non-null fields across all records.",
    "Validity": "Data conformity to expected semantic types (dates, URLs, numbers).",
    "Uniqueness": "Ratio of distinct records to total extracted records.",
}
URL_HINTS = ("url", "link", "href")
DATE_HINTS = ("date", "time")
NUMBER_HINTS = ("price", "count", "rating", "amount")

_COUNTS = ("filled", "evaluated", "valid", "missing")


def field_hint(name: str) -> str:
    """Expected kind of a field, read off its name: url, date, number or text."""
    low = name.lower()
    for kind, hints in (("url", URL_HINTS), ("date", DATE_HINTS), ("number", NUMBER_HINTS)):
        if any(h in low for h in hints):
            return kind
    return "text"


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [t.cast("int") for t in terms], F.lit(0))


def _filled(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def _evaluated(c: Column, dtype: T.DataType) -> Column:
    return F.coalesce(c != "", F.lit(False)) if isinstance(dtype, T.StringType) else c.isNotNull()


def _valid(c: Column, dtype: T.DataType, name: str, strict_dates: bool) -> Column:
    """Validity of an evaluated cell, the test chosen from the field name."""
    kind = field_hint(name)
    if kind == "url":
        if not isinstance(dtype, T.StringType):
            return F.lit(False)
        return c.startswith("http://") | c.startswith("https://") | c.startswith("/")
    if kind == "number":
        if isinstance(dtype, T.BooleanType):
            return F.lit(False)
        plain = isinstance(dtype, (T.StringType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
        return (c.cast("string") if plain else F.to_json(c)).rlike(r"\p{Nd}")
    if kind == "date" and strict_dates and isinstance(dtype, T.StringType):
        return to_date(c, strict=True).isNotNull()
    return F.lit(True)


def _record_counts(df: DataFrame, fields: Sequence[str], required: Sequence[str] | None, strict_dates: bool) -> list[Column]:
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = set(required) if required else set(fields)
    cells = [(F.col(f"`{n}`"), types[n], n) for n in fields]
    return [
        _total([_filled(c, t) for c, t, _ in cells]).alias("filled"),
        _total([_evaluated(c, t) for c, t, _ in cells]).alias("evaluated"),
        _total([_evaluated(c, t) & F.coalesce(_valid(c, t, n, strict_dates), F.lit(False)) for c, t, n in cells]).alias("valid"),
        _total([~_filled(c, t) for c, t, n in cells if n in wanted]).alias("missing"),
    ]


def grade_of(score: Column) -> Column:
    return reduce(lambda acc, g: F.when(score >= g[1], g[0]).otherwise(acc), reversed(GRADES), F.lit("F"))


def _merge_equal_records(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals per scope from rows (by…, _id, counts): equal records share their counts."""
    merged = counted.groupBy(*by, "_id").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in _COUNTS])
    return merged.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.count("*").alias("unique_records"),
        *[F.coalesce(F.sum(F.col(c) * F.col("n")), F.lit(0)).alias(c) for c in _COUNTS])


def _ratio(part: Column, whole: Column, when_none: float) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(when_none))


def _report(totals: DataFrame, by: Sequence[str], n_fields: Column, fields: Column) -> DataFrame:
    rows = F.col("total_records")
    cells = (rows * n_fields).cast("bigint")
    duplicates = rows - F.col("unique_records")
    completeness = _ratio(F.col("filled"), cells, 0.0)
    validity = _ratio(F.col("valid"), F.col("evaluated"), 1.0)
    uniqueness = _ratio(F.col("unique_records"), rows, 0.0)
    score = F.round((completeness * WEIGHTS["Completeness"] + validity * WEIGHTS["Validity"]
                     + uniqueness * WEIGHTS["Uniqueness"]) * 100, 1)

    def metric(name: str, ratio: Column, details: dict[str, Column]) -> Column:
        pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("bigint"))]
        return F.struct(F.lit(name).alias("metric_name"), F.round(ratio * 100, 1).alias("score"),
                        F.lit(WEIGHTS[name]).alias("weight"), F.lit(DESCRIPTIONS[name]).alias("description"),
                        F.create_map(*pairs).alias("details"))
    metrics = F.array(
        metric("Completeness", completeness, {"filled_cells": F.col("filled"), "total_cells": cells,
                                              "missing_required": F.col("missing")}),
        metric("Validity", validity, {"valid_cells": F.col("valid"), "evaluated_cells": F.col("evaluated")}),
        metric("Uniqueness", uniqueness, {"unique_records": F.col("unique_records"), "duplicate_records": duplicates}))
    some = rows > 0
    empty = F.slice(metrics, 1, 0)
    scored = totals.select(
        *by, F.when(some, score).otherwise(0.0).alias("overall_score"),
        F.when(some, metrics).otherwise(empty).alias("metrics"), rows.alias("total_records"),
        F.when(some, duplicates).otherwise(0).alias("duplicate_records_count"),
        F.when(some, F.col("missing")).otherwise(0).alias("missing_required_count"),
        F.when(some, fields).otherwise(F.array().cast("array<string>")).alias("fields_evaluated"))
    return scored.withColumn("grade", F.when(F.col("total_records") > 0, grade_of(F.col("overall_score"))).otherwise("F"))


def quality_report(df: DataFrame, required: Sequence[str] | None = None, by: Sequence[str] = (),
                   fields: Sequence[str] | None = None, strict_dates: bool = False) -> DataFrame:
    """Report of a typed record frame: one row, or one per value of `by`."""
    fields = sorted(c for c in (fields or df.columns) if c not in by)
    counted = df.select(*by, compact_hash(fields).alias("_id"), *_record_counts(df, fields, required, strict_dates))
    names = F.array(*[F.lit(f) for f in fields])
    return _report(_merge_equal_records(counted, by), by, F.lit(len(fields)), names)


def metric_rows(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The report's metrics as rows (metric_name, score, weight, description, details)."""
    return report.select(*by, F.inline("metrics"))


def _json_cell_tests() -> tuple[Callable[[Column], Column], ...]:
    """Tests over an entry STRUCT(key, value VARIANT) of a JSON record."""
    def as_text(e: Column) -> Column:
        return F.to_json(e["value"])

    def is_kind(e: Column, kind: str) -> Column:
        return F.schema_of_variant(e["value"]).startswith(kind)

    def present(e: Column) -> Column:
        return ~F.is_variant_null(e["value"]) & (as_text(e) != '""')

    def filled(e: Column) -> Column:
        return present(e) & (as_text(e) != "[]")

    def hinted(e: Column, hints: Sequence[str]) -> Column:
        return F.lower(e["key"]).rlike("|".join(hints))

    def valid(e: Column) -> Column:
        s = F.try_variant_get(e["value"], "$", "string")
        url = is_kind(e, "STRING") & (s.startswith("http://") | s.startswith("https://") | s.startswith("/"))
        return (F.when(hinted(e, URL_HINTS), url).when(hinted(e, DATE_HINTS), F.lit(True))
                .when(hinted(e, NUMBER_HINTS), as_text(e).rlike(r"\p{Nd}")).otherwise(F.lit(True)))
    return present, filled, valid


def quality_report_json(df: DataFrame, json_col: str, by: Sequence[str] = (),
                        required: Sequence[str] | None = None) -> DataFrame:
    """Report of records held as JSON text, whose fields are the union of keys in each scope.

    An absent key counts as missing, so totals follow from the number of distinct keys per scope.
    """
    present, filled, valid = _json_cell_tests()
    record = F.try_parse_json(json_col)
    entries = F.map_entries(record.try_cast("map<string,variant>"))
    wanted = (lambda e: e["key"].isin(*required)) if required else (lambda e: F.lit(True))
    parsed = df.select(*by, F.unhex(F.sha2(F.to_json(record), 256)).alias("_id"), entries.alias("_e"))
    count = lambda test: F.size(F.filter("_e", test))
    counted = parsed.select(
        *by, "_id", count(filled).alias("filled"), count(present).alias("evaluated"),
        count(lambda e: present(e) & F.coalesce(valid(e), F.lit(False))).alias("valid"),
        count(lambda e: filled(e) & wanted(e)).alias("missing"))   # present here, subtracted below
    totals = _merge_equal_records(counted, by)

    named = df.select(*by, F.explode(F.json_object_keys(json_col)).alias("_f")).distinct()
    scope = list(by)
    fields = named.groupBy(*scope).agg(
        F.sort_array(F.collect_list("_f")).alias("_fields"),
        F.count_if(F.col("_f").isin(*required) if required else F.lit(True)).alias("_wanted"))
    if scope:
        matched = reduce(lambda a, b: a & b, [totals[c].eqNullSafe(fields[c]) for c in scope])
        joined = totals.join(fields, matched, "left").drop(*[fields[c] for c in scope])
    else:
        joined = totals.withColumns({c: fields.select(c).scalar() for c in ("_fields", "_wanted")})      # one row: a scalar subquery
    joined = joined.withColumn("missing", F.col("total_records") * F.coalesce("_wanted", F.lit(0)) - F.col("missing"))
    names = F.coalesce("_fields", F.array().cast("array<string>"))
    return _report(joined, by, F.size(names), names)
