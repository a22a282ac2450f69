"""Distinct, de-duplication and key-set operators.

Groups of equal records may be huge (a third of a crawl can be copies of one page), so each operator
reduces its groups inside the map tasks before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.hashing import compact_hash


def require_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"column {name!r} is needed to order the records")


def deduplicate(df: DataFrame, keys: Sequence[str] | None = None, order_col: str = "record_index",
                fields: Sequence[str] | None = None, identity: Column | None = None) -> DataFrame:
    """One row per distinct record (or key subset, or given `identity` such as a JSON fingerprint), the
    first by `order_col`.

    `min_by` keeps at most one row per fingerprint and map task, so a hot group costs one row per
    task in the shuffle.
    """
    require_column(df, order_col)
    fields = [c for c in (fields or df.columns) if c != order_col]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    if identity is None:
        identity = compact_hash([k for k in keys if k in df.columns] if keys else fields)
    first = df.groupBy(identity.alias("_id")).agg(F.min_by(row, F.col(order_col)).alias("_row"))
    return first.select("_row.*")


def duplicate_count(df: DataFrame, keys: Sequence[str] | None = None, order_col: str | None = None) -> DataFrame:
    """One row: total, unique and duplicate records."""
    fields = [c for c in df.columns if c != order_col]
    identity = compact_hash([k for k in keys if k in df.columns] if keys else fields)
    per_id = df.groupBy(identity.alias("_id")).agg(F.count("*").alias("n"))
    return per_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
                      F.count("*").alias("unique_records"),
                      F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_records"))


def distinct_values(values: Column) -> Column:
    """Array without repeats, first occurrences in place."""
    return F.array_distinct(values)


def json_keys(df: DataFrame, json_col: str, order_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Field names over all JSON records with the record and place where each was first seen.

    Order by `field` for the sorted union, by (`first_record`, `first_place`) for header order.
    """
    require_column(df, order_col)
    named = df.select(*by, F.col(order_col).alias("_r"), F.posexplode(F.json_object_keys(json_col)).alias("_p", "field"))
    seen = named.groupBy(*by, "field").agg(F.min(F.struct("_r", "_p")).alias("_at"))
    return seen.select(*by, "field", F.col("_at._r").alias("first_record"), F.col("_at._p").alias("first_place"))


def key_sets(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key of either side with `key_status`: added, removed or matched."""
    marked = old.select(*keys, F.lit(1).alias("_old"), F.lit(0).alias("_new")).unionByName(
        new.select(*keys, F.lit(0).alias("_old"), F.lit(1).alias("_new")))
    sides = marked.groupBy(*keys).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    status = F.when(F.col("_old") == 0, "added").when(F.col("_new") == 0, "removed").otherwise("matched")
    return sides.select(*keys, status.alias("key_status"))


def union_distinct(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, each once."""
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()
