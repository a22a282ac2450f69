"""Exports and table writes.  Projections are separate from the writes so they can be checked."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.session import number_rows
from webloom.sources.splits import ranges

_KEEP_NULLS = {"ignoreNullFields": "false"}


def _complex(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def export_rows(df: DataFrame, fields: Sequence[str], source_url: str = "source_url") -> DataFrame:
    """Record fields with `_source_url` appended."""
    return df.select(*fields, F.col(source_url).alias("_source_url"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def json_arrays(df: DataFrame, order_col: str, per_array: int = 1000) -> DataFrame:
    """All rows as JSON array texts (array_no, json) of `per_array` rows each, in order."""
    rows = number_rows(df, [order_col], "_n")
    body = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct(*[f"`{c}`" for c in df.columns]).alias("_row")))), lambda x: x["_row"])
    return rows.groupBy(F.floor(F.col("_n") / per_array).alias("array_no")).agg(F.to_json(body, _KEEP_NULLS).alias("json"))


def write_json_arrays(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON array file per task, of any size: rows are streamed, with a comma before all but the first of a task."""
    rows = df.select(F.to_json(F.struct(*[f"`{c}`" for c in df.columns]), _KEEP_NULLS).alias("value"))

    def bracketed(batches):
        last, before = None, "["
        for values in (batch.column(0).slice(a, b - a) for batch in batches for a, b in ranges(batch.column(0))):
            ready = []
            for value in values.to_pylist():
                if last is not None:
                    ready.append(before + last)
                    before = ","
                last = value
            yield pa.RecordBatch.from_pydict({"value": pa.array(ready, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["[]" if last is None else before + last + "]"]})
    rows.mapInArrow(bracketed, "value string").write.mode(mode).text(path)


def csv_rows(df: DataFrame, legacy: bool = False) -> DataFrame:
    """Flat text columns: lists joined with `; ` and objects as JSON; the legacy layout writes both as
    JSON text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and not legacy:
            item = f.dataType.elementType
            plain = F.transform(c, lambda x: F.coalesce(F.to_json(x) if _complex(item) else x.cast("string"), F.lit("None")))
            c = F.array_join(plain, "; ")
        elif _complex(f.dataType):
            c = F.to_json(c, _KEEP_NULLS)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, legacy: bool = False, mode: str = "errorifexists") -> None:
    """CSV with header.  The legacy layout starts each file with a byte-order mark (in the header)."""
    flat = csv_rows(df, legacy)
    if legacy and flat.columns:
        flat = flat.withColumnRenamed(flat.columns[0], "﻿" + flat.columns[0])
    flat.write.mode(mode).csv(path, header=True, quote='"', escape='"', encoding="UTF-8", emptyValue="", nullValue="")


def chunk_documents(chunks: DataFrame) -> DataFrame:
    """{id, text, metadata{source_url, chunk_index, pipeline_id, content_hash}} rows."""
    return chunks.select(
        F.col("chunk_id").alias("id"), F.col("text_content").alias("text"),
        F.struct("source_url", "chunk_index", F.col("set_id").alias("pipeline_id"), "content_hash").alias("metadata"))


def new_records(batch: DataFrame, stored: DataFrame | None, keys: Sequence[str] = ("job_id", "content_hash"),
                order_col: str | None = None) -> DataFrame:
    """Rows of the batch whose key is not stored yet, one per key (the first by `order_col`).

    Repeats collapse in the map tasks; the stored side of the anti join contributes only its keys."""
    row = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
    pick = F.min_by(row, F.col(order_col)) if order_col else F.any_value(row)
    once = batch.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(pick.alias("_row")).select("_row.*")
    return once if stored is None else once.join(stored.select(*keys), list(keys), "left_anti").select(*batch.columns)


def write_records(df: DataFrame, path: str, mode: str = "append") -> None:
    """Record table, one partition per dataset; rows sorted by index so range filters skip row groups.

    A dataset may hold a third of all rows, so rows are rebalanced: AQE splits a hot dataset over many
    tasks by its bytes and puts small ones together."""
    (df.hint("rebalance", "dataset_id").sortWithinPartitions("dataset_id", "record_index")
     .write.mode(mode).partitionBy("dataset_id").parquet(path))


def page_rows(pages: DataFrame) -> DataFrame:
    """Stored page layout: links as one text joined with ` | `, the whole page as JSON in `data`."""
    return pages.select("title", "url", "text", F.array_join("links", " | ").alias("links"), "scraped_at",
                        F.to_json(F.struct(*pages.columns), _KEEP_NULLS).alias("data"))


def write_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    page_rows(pages).write.mode(mode).parquet(path)
