"""Rules and record layouts handed to the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import types as T


class RuleError(ValueError):
    """A rule that cannot be turned into an expression (unknown action, bad selector)."""


@dataclass(frozen=True)
class SelectorRule:
    name: str
    selector: str = ""
    selector_type: str = "css"        # css | xpath | jsonld
    extract_type: str = "text"        # text | html | attr
    attribute_name: str | None = None
    is_multiple: bool = False
    is_required: bool = False
    regex_pattern: str | None = None
    default_value: str | None = None


@dataclass(frozen=True)
class CleanerRule:
    field_name: str
    action: str
    params: Mapping[str, Any] = field(default_factory=dict)


def as_rules(kind: type, items: Iterable[Any]) -> list[Any]:
    """Accept rule objects or plain dicts; keys a rule does not know are ignored."""
    known = {f.name for f in fields(kind)}
    return [item if isinstance(item, kind) else
            kind(**{k: v for k, v in dict(item).items() if k in known and v is not None})
            for item in items]


# A captured page: what a fetcher would have returned for one url.
PAGE_SCHEMA = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("html", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("elapsed_seconds", T.DoubleType()),
    T.StructField("redirected_url", T.StringType()),
])

# A stored record: one extracted page of one dataset, raw and cleaned form as JSON text.
RECORD_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.StringType(), False),
    T.StructField("record_index", T.LongType(), False),
    T.StructField("source_url", T.StringType()),
    T.StructField("raw_data", T.StringType()),
    T.StructField("cleaned_data", T.StringType()),
    T.StructField("content_hash", T.StringType()),
])
