"""Cleaning of whole records: rules fold into one projection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.cleaning import apply_action
from webloom.functions.hashing import content_hash
from webloom.model import CleanerRule, as_rules
from webloom.operators import quality

_RESULT_TYPE = {"to_int": T.LongType(), "to_float": T.DoubleType(), "to_date": T.StringType()}


def _result_type(dtype: T.DataType, action: str) -> T.DataType:
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_result_type(dtype.elementType, action))
    if action == "to_int" and isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return dtype
    return _RESULT_TYPE.get(action, dtype)


def clean(df: DataFrame, rules: Iterable[CleanerRule | dict] | None = None) -> DataFrame:
    """Apply rules in order, several per field compose; rules for absent fields are skipped.

    Without rules every top-level string is trimmed and its inner white space collapsed.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    rules = as_rules(CleanerRule, rules or [])
    if not rules:
        rules = [CleanerRule(name, "trim") for name, dtype in types.items() if isinstance(dtype, T.StringType)]
    changed = {}
    for rule in rules:
        name = rule.field_name
        if name not in types or not rule.action:
            continue
        current = changed.get(name, F.col(f"`{name}`"))
        changed[name] = apply_action(current, types[name], rule.action, rule.params)
        types[name] = _result_type(types[name], rule.action)
    return df.withColumns(changed) if changed else df


def clean_and_fingerprint(df: DataFrame, fields: Sequence[str], rules: Iterable[CleanerRule | dict] | None = None,
                          keys: Sequence[str] | None = None) -> DataFrame:
    """Re-clean the record fields from their raw form and add `content_hash`.  Every row stays:
    keys only choose what is fingerprinted."""
    if not rules:
        rules = [CleanerRule(f.name, "trim") for f in df.schema.fields
                 if f.name in fields and isinstance(f.dataType, T.StringType)]
        if not rules:
            return df.withColumn("content_hash", content_hash(fields, keys))
    return clean(df, rules).withColumn("content_hash", content_hash(fields, keys))


def reclean_datasets(records: DataFrame, fields: Sequence[str], rules: Iterable[CleanerRule | dict] | None = None,
                     keys: Sequence[str] | None = None, dataset_col: str = "dataset_id") -> tuple[DataFrame, DataFrame]:
    """Records cleaned and fingerprinted anew, and the refreshed header of each dataset: records, quality_score, grade."""
    cleaned = clean_and_fingerprint(records, fields, rules, keys)
    report = quality.quality_report(cleaned, by=[dataset_col], fields=fields)
    return cleaned, report.select(dataset_col, F.col("total_records").alias("records"), F.col("overall_score").alias("quality_score"), "grade")
