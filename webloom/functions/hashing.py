"""Record fingerprints: SHA-256 over canonical JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEEP_NULLS = {"ignoreNullFields": "false"}


def canonical_json(columns: Sequence[str]) -> Column:
    """JSON text of the named columns, keys sorted, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), _KEEP_NULLS)


def content_hash(columns: Sequence[str], keys: Sequence[str] | None = None) -> Column:
    """Fingerprint of a typed record; with `keys` only of those that the record has."""
    chosen = [k for k in keys if k in columns] if keys else list(columns)
    if not chosen:
        return F.sha2(F.lit("{}"), 256)
    return F.sha2(canonical_json(chosen), 256)


def json_hash(json_text: Column) -> Column:
    """Fingerprint of a record held as JSON text; object keys are sorted at every level."""
    return F.sha2(F.to_json(F.try_parse_json(json_text)), 256)


def page_hash(url: Column, page_json: Column) -> Column:
    return F.sha2(F.concat(url, page_json), 256)


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def compact_hash(columns: Sequence[str]) -> Column:
    """The record fingerprint as 32 raw bytes: half the shuffle volume of the hex form."""
    return F.unhex(content_hash(columns))
