"""Snapshot comparison.

Both snapshots are stacked and grouped once by key fingerprint: one shuffle, no join, and repeated
keys collapse in the map tasks (`max_by`: the last record of a key wins).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from webloom.functions.hashing import canonical_json, compact_hash
from webloom.operators.identity import require_column
from webloom.session import materialize

PREVIEW_ROWS = 50


def _as_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(c)
    return c.cast("string")


def _fields(old: DataFrame, new: DataFrame, order_col: str) -> list[str]:
    require_column(old, order_col)
    require_column(new, order_col)
    return [c for c in dict.fromkeys(old.columns + new.columns) if c != order_col]


def _side(df: DataFrame, keys: Sequence[str] | None, order_col: str, is_new: bool) -> DataFrame:
    own = [c for c in df.columns if c != order_col]
    identity = compact_hash([k for k in keys if k in own] if keys else own)
    return df.select(identity.alias("key_id"), F.col(order_col).alias("_at"), F.lit(is_new).alias("_is_new"),
                     *[F.col(f"`{c}`") for c in own])


def _stack(old: DataFrame, new: DataFrame, keys: Sequence[str] | None, order_col: str) -> DataFrame:
    return _side(old, keys, order_col, False).unionByName(
        _side(new, keys, order_col, True), allowMissingColumns=True)


def _last(value: Column, is_new: bool) -> Column:
    mine = F.col("_is_new") if is_new else ~F.col("_is_new")
    return F.max_by(F.when(mine, value), F.when(mine, F.col("_at")))


def _differences(fields: Sequence[str], types: dict[str, T.DataType]) -> Column:
    """MAP field -> (old, new) of the fields in which `old` and `new` differ."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("field"), (~F.col("old")[c].eqNullSafe(F.col("new")[c])).alias("differs"),
                 F.struct(_as_text(F.col("old")[c], types[c]).alias("old"),
                          _as_text(F.col("new")[c], types[c]).alias("new")).alias("change"))
        for c in fields])
    return F.map_from_entries(F.transform(F.filter(cells, lambda x: x["differs"]),
                                            lambda x: F.struct(x["field"], x["change"])))


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str] | None = None,
            order_col: str = "record_index") -> DataFrame:
    """Every key with change_type (added, removed, modified, unchanged), both records and, for
    modified ones, a map field -> (old, new).  `position` is the place of the key's first record."""
    fields = _fields(old, new, order_col)
    stacked = _stack(old, new, keys, order_col)
    types = {f.name: f.dataType for f in stacked.schema.fields}
    record = F.struct(*[F.col(f"`{c}`") for c in fields])
    first = lambda mine: F.min(F.when(mine, F.col("_at")))
    paired = stacked.groupBy("key_id").agg(
        _last(record, False).alias("old"), _last(record, True).alias("new"),
        first(~F.col("_is_new")).alias("_old_at"), first(F.col("_is_new")).alias("_new_at"))
    diffs = _differences(fields, types)
    both = F.col("_old_at").isNotNull() & F.col("_new_at").isNotNull()
    kind = (F.when(F.col("_old_at").isNull(), "added").when(F.col("_new_at").isNull(), "removed")
            .when(F.size("changes") > 0, "modified").otherwise("unchanged"))
    return (paired.withColumn("changes", F.when(both, diffs))
            .select(F.lower(F.hex("key_id")).alias("key_id"), kind.alias("change_type"),
                    F.coalesce("_new_at", "_old_at").alias("position"), "old", "new", "changes"))


def _prints(stacked: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A record as two numbers of 64 bits, so that an aggregate holds it in place."""
    whole = F.sha2(canonical_json(fields), 256)
    return stacked.select("key_id", "_at", "_is_new", F.xxhash64(whole).alias("_a"), F.xxhash64(F.lit("second"), whole).alias("_b"))


def fingerprints(rows: DataFrame, keys: Sequence[str] | None, fields: Sequence[str], order_col: str, snapshot: str) -> DataFrame:
    """(key_id, at, a, b, snapshot): what a comparison needs of records of several snapshots; the order is a number or a time."""
    made = _prints(rows.select(compact_hash([k for k in keys if k in fields] if keys else fields).alias("key_id"), F.col(order_col).alias("_at"),
                               F.col(snapshot).cast("long").alias("_is_new"), *[F.col(f"`{c}`") for c in fields]), fields)
    return made.select("key_id", F.col("_at").cast("decimal(38,9)").alias("at"), F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_is_new").alias("snapshot"))


def change_kinds(old: DataFrame, new: DataFrame, keys: Sequence[str] | None = None, order_col: str = "record_index") -> DataFrame:
    """Every key (key_id) with change_type, the order of its last record on either side (old_at, new_at) and `position`.

    Only fingerprints and orders are grouped, in a hash aggregate."""
    rows = _prints(_stack(old, new, keys, order_col), _fields(old, new, order_col))
    at = lambda mine, pick: pick(F.when(mine, F.col("_at")))
    is_new, is_old = F.col("_is_new"), ~F.col("_is_new")
    paired = rows.groupBy("key_id").agg(
        *[_last(F.col(c), side).alias(f"{c}_{side}") for c in ("_a", "_b") for side in (False, True)],
        at(is_old, F.max).alias("old_at"), at(is_new, F.max).alias("new_at"), at(is_old, F.min).alias("_old_first"), at(is_new, F.min).alias("_new_first"))
    same = (F.col("_a_False") == F.col("_a_True")) & (F.col("_b_False") == F.col("_b_True"))
    kind = (F.when(F.col("old_at").isNull(), "added").when(F.col("new_at").isNull(), "removed")
            .when(same, "unchanged").otherwise("modified"))
    return paired.select("key_id", kind.alias("change_type"), "old_at", "new_at", F.coalesce("_new_first", "_old_first").alias("position"))


def changed(old: DataFrame, new: DataFrame, keys: Sequence[str] | None = None, order_col: str = "record_index") -> DataFrame:
    """`changes` without the unchanged keys, whose records are not moved.

    The changed keys are stored first, so their size is known when the records are fetched: few of them travel to the
    records, and only where there are many the records are shuffled."""
    fields = _fields(old, new, order_col)
    kinds = materialize(change_kinds(old, new, keys, order_col).where(F.col("change_type") != "unchanged"), "changed-keys")
    stacked = _stack(old, new, keys, order_col)
    types = {f.name: f.dataType for f in stacked.schema.fields}

    def records(is_new: bool) -> DataFrame:
        name, at = ("new", "new_at") if is_new else ("old", "old_at")
        own = stacked.where(F.col("_is_new") == is_new).select("key_id", F.col("_at").alias(at), F.struct(*[F.col(f"`{c}`") for c in fields]).alias(name))
        found = own.join(kinds.where(F.col(at).isNotNull()).select("key_id", at), ["key_id", at])
        place = F.row_number().over(Window.partitionBy("key_id").orderBy(F.lit(0)))     # of records at one place, one
        return found.withColumn("_n", place).where(F.col("_n") == 1).select("key_id", name)
    both = kinds.join(records(False), "key_id", "left").join(records(True), "key_id", "left")
    diffs = F.when(F.col("change_type") == "modified", _differences(fields, types))
    return both.select(F.lower(F.hex("key_id")).alias("key_id"), "change_type", "position", "old", "new", diffs.alias("changes"))


def compare_datasets(stored: DataFrame, old_id: object, new_id: object, json_col: str = "cleaned_data", keys: Sequence[str] | None = None,
                     rows: int = PREVIEW_ROWS) -> tuple[DataFrame, DataFrame]:
    """Two datasets of a record table: their counts in one row, and the first changed records of each class with their fields."""
    side = lambda name: stored.where(F.col("dataset_id") == F.lit(name)).select("record_index", json_col)
    kinds = changes_json(side(old_id), side(new_id), json_col, keys)
    count = lambda kind: F.count_if(F.col("change_type") == kind).alias(f"{kind}_count")
    n = lambda name: F.count_if(F.col("dataset_id") == F.lit(name))
    totals = stored.where(F.col("dataset_id").isin(old_id, new_id)).agg(n(old_id).alias("total_old"), n(new_id).alias("total_new"))
    counts = totals.crossJoin(kinds.agg(*map(count, ("added", "removed", "modified", "unchanged"))))      # one row and one row
    return counts, preview(kinds, rows)


def _json_fields(json: Column) -> Column:
    """MAP field -> canonical JSON text of the value, from record JSON; JSON nulls are nulls."""
    values = F.try_parse_json(json).try_cast("map<string,variant>")
    return F.transform_values(values, lambda k, v: F.nullif(F.to_json(v), F.lit("null")))


def changes_json(old: DataFrame, new: DataFrame, json_col: str, keys: Sequence[str] | None = None,
                 order_col: str = "record_index") -> DataFrame:
    """`changes` for records held as JSON text, whose fields may differ from record to record.

    Keys a record lacks are left out of its fingerprint; a missing field equals null; numbers compare
    by value.  `old` and `new` are the JSON texts."""
    require_column(old, order_col)
    require_column(new, order_col)

    def side(df: DataFrame, is_new: bool) -> DataFrame:
        named = F.try_parse_json(json_col).try_cast("map<string,variant>")
        kept = F.map_filter(named, lambda k, v: k.isin(*keys)) if keys else named
        return df.select(F.unhex(F.sha2(F.to_json(kept), 256)).alias("key_id"), F.col(order_col).alias("_at"),
                         F.lit(is_new).alias("_is_new"), F.col(json_col).alias("_json"))
    first = lambda mine: F.min(F.when(mine, F.col("_at")))
    paired = side(old, False).unionByName(side(new, True)).groupBy("key_id").agg(
        _last(F.col("_json"), False).alias("old"), _last(F.col("_json"), True).alias("new"),
        first(~F.col("_is_new")).alias("_old_at"), first(F.col("_is_new")).alias("_new_at"))
    fields = paired.withColumns({"_o": _json_fields(F.col("old")), "_n": _json_fields(F.col("new"))})
    value = lambda m, k: F.element_at(m, k)
    names = F.array_union(F.map_keys("_o"), F.map_keys("_n"))
    changed = F.filter(names, lambda k: ~value(F.col("_o"), k).eqNullSafe(value(F.col("_n"), k)))
    diffs = F.map_from_entries(F.transform(changed, lambda k: F.struct(k, F.struct(
        value(F.col("_o"), k).alias("old"), value(F.col("_n"), k).alias("new")))))
    kind = (F.when(F.col("_old_at").isNull(), "added").when(F.col("_new_at").isNull(), "removed")
            .when(F.size("changes") > 0, "modified").otherwise("unchanged"))
    return (fields.withColumn("changes", diffs)
            .select(F.lower(F.hex("key_id")).alias("key_id"), kind.alias("change_type"),
                    F.coalesce("_new_at", "_old_at").alias("position"), "old", "new", "changes"))


def field_changes(changed: DataFrame, columns: Sequence[str | Column] = ("key_id",)) -> DataFrame:
    """Long form of the modified records: one row per changed field (field, old, new)."""
    modified = changed.where(F.col("change_type") == "modified")
    return (modified.select(*columns, F.explode("changes").alias("field", "_c"))
            .select("*", F.col("_c.old").alias("old_value"), F.col("_c.new").alias("new_value")).drop("_c"))


def change_summary(old: DataFrame, new: DataFrame, keys: Sequence[str] | None = None,
                   order_col: str = "record_index") -> DataFrame:
    """Counts only: the shuffle carries two 32-byte fingerprints per record instead of the record."""
    fields = _fields(old, new, order_col)
    stacked = _stack(old, new, keys, order_col)
    whole = F.unhex(F.sha2(canonical_json(fields), 256))
    narrow = stacked.select("key_id", "_at", "_is_new", whole.alias("_whole"))
    per_key = narrow.groupBy("key_id").agg(
        _last(F.col("_whole"), False).alias("_old"), _last(F.col("_whole"), True).alias("_new"),
        F.count_if(~F.col("_is_new")).alias("_n_old"), F.count_if("_is_new").alias("_n_new"))
    both = (F.col("_n_old") > 0) & (F.col("_n_new") > 0)
    return per_key.agg(
        F.coalesce(F.sum("_n_old"), F.lit(0)).alias("total_old"), F.coalesce(F.sum("_n_new"), F.lit(0)).alias("total_new"),
        F.count_if(F.col("_n_old") == 0).alias("added_count"), F.count_if(F.col("_n_new") == 0).alias("removed_count"),
        F.count_if(both & (F.col("_old") != F.col("_new"))).alias("modified_count"),
        F.count_if(both & (F.col("_old") == F.col("_new"))).alias("unchanged_count"))


def preview(changed: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first `rows` added, removed and modified records, by position.  Spark limits each class
    inside the map tasks (WindowGroupLimit) before it brings the classes together."""
    place = F.row_number().over(Window.partitionBy("change_type").orderBy("position", "key_id"))
    return (changed.where(F.col("change_type") != "unchanged").withColumn("preview_rank", place)
            .where(F.col("preview_rank") <= rows))


def change_events(old: DataFrame, new: DataFrame, keys: Sequence[str] | None, order_col: str, **labels: str) -> DataFrame:
    """The summary as one event row with constant label columns (snapshot ids and the like)."""
    summary = change_summary(old, new, keys, order_col)
    return summary.select(*[F.lit(v).alias(k) for k, v in labels.items()], "*")

