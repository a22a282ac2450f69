"""Records to text, text to overlapping word windows with provenance.  No shuffle anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions import text
from webloom.functions.hashing import text_hash

CHUNK_SIZE = 500
CHUNK_OVERLAP = 50


def record_text(df: DataFrame, fields: Sequence[str] | None = None) -> Column:
    """`name: value` lines of the non-empty strings and `name: a, b` lines of the lists, in column
    order; other types are left out."""
    lines = []
    for f in df.schema.fields:
        if fields is not None and f.name not in fields:
            continue
        c, head = F.col(f"`{f.name}`"), F.lit(f"{f.name}: ")
        if isinstance(f.dataType, T.StringType):
            lines.append(F.when(c != "", F.concat(head, c)))
        elif isinstance(f.dataType, T.ArrayType):
            items = F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("None")))
            lines.append(F.when(c.isNotNull(), F.concat(head, F.array_join(items, ", "))))
    return F.concat_ws("\n", *lines)


def word_windows(body: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping windows of `size` words; the last is the first that reaches the end of the text."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    step = max(1, size - overlap)

    def cut(ws: Column) -> Column:
        count = F.size(ws)
        last = F.greatest(F.ceil((count - size) / step), F.lit(0)).cast("int")
        starts = F.sequence(F.lit(0), last)
        return F.when(count > 0, F.transform(
            starts, lambda i: F.array_join(F.slice(ws, i * step + 1, F.lit(size)), " "))).otherwise(
            F.array().cast("array<string>"))
    return text.let(text.words(body), cut)


def chunk(df: DataFrame, body: Column, record_id: Column, source_url: Column | None = None,
          size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, set_id: str = "default") -> DataFrame:
    """Chunk rows with their provenance.  `chunk_id` derives from set, record and index, so a rerun
    gives the same ids."""
    url = source_url if source_url is not None else F.lit(None).cast("string")
    windows = df.select(record_id.cast("string").alias("record_id"), url.alias("source_url"),
                        word_windows(body, size, overlap).alias("_w"))
    # An outer generator: the inner one would add a size filter that cuts the windows twice.
    rows = windows.select("record_id", "source_url", F.size("_w").alias("total_chunks"),
                          F.posexplode_outer("_w").alias("chunk_index", "text_content"))
    rows = rows.where(F.col("text_content").isNotNull())
    chunk_id = F.sha2(F.concat_ws("/", F.lit(set_id), "record_id", "chunk_index"), 256)
    return rows.select(chunk_id.alias("chunk_id"), F.lit(set_id).alias("set_id"), "record_id", "source_url",
                       "chunk_index", "total_chunks", "text_content", text_hash(F.col("text_content")).alias("content_hash"))


def chunk_records(df: DataFrame, record_id: str, source_url: str | None = None, fields: Sequence[str] | None = None,
                  size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, set_id: str = "default") -> DataFrame:
    """Typed records straight to chunks: `record_text` over the record fields, then `chunk`."""
    skip = {record_id, source_url}
    fields = [c for c in (fields or df.columns) if fields or c not in skip]
    url = F.col(source_url) if source_url else None
    return chunk(df, record_text(df, fields), F.col(record_id), url, size, overlap, set_id)
