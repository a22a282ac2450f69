"""Cleaning actions: Column -> Column, no Python at run time."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions import text, urls

INT_PATTERN = rf"([-+]?{text.DIGIT}+)"
FLOAT_PATTERN = rf"([-+]?{text.DIGIT}*\.?{text.DIGIT}+)"

# Accepted date layouts in order of trial, each with the shape a text must have
# before the (slow, exception-based) date parser is asked at all.
DATE_LAYOUTS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[Tt]\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[Tt]\d{1,2}:\d{1,2}:\d{1,2}[Zz]$", "yyyy-M-d'T'H:m:s'Z'"),
]
ISO_IN_TEXT = rf"(?<!{text.WORD})({text.DIGIT}{{4}}-{text.DIGIT}{{2}}-{text.DIGIT}{{2}})(?!{text.WORD})"

Action = Callable[[Column, T.DataType, Mapping[str, Any]], Column]


def trim(c: Column) -> Column:
    return text.squeeze(c)


def strip_html(c: Column) -> Column:
    return text.squeeze(F.regexp_replace(c, "<[^>]+>", ""))


def _first_number(c: Column, pattern: str, target: str) -> Column:
    found = F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), pattern, 1)
    return text.ascii_digits(F.nullif(found, F.lit(""))).try_cast(target)


def to_int(c: Column) -> Column:
    """First integer in the text, commas ignored.  Values beyond 64 bits become null."""
    return _first_number(c, INT_PATTERN, "bigint")


def to_float(c: Column) -> Column:
    return _first_number(c, FLOAT_PATTERN, "double")


def parse_date(c: Column) -> Column:
    """The text as a DATE when one of the known layouts fits it as a whole, else null."""
    tidy = text.squeeze(c)
    shaped = F.upper(tidy)
    tries = [F.when(tidy.rlike(shape), F.try_to_date(shaped if "T" in layout else tidy, layout))
             for shape, layout in DATE_LAYOUTS]
    return F.coalesce(*tries)


def to_date(c: Column, strict: bool = False) -> Column:
    """ISO date text; an ISO date inside other text; else the stripped text itself.

    `strict` yields null instead of that last fallback.
    """
    stripped = text.strip(c)
    embedded = F.nullif(F.regexp_extract(stripped, ISO_IN_TEXT, 1), F.lit(""))
    last = F.lit(None).cast("string") if strict else stripped
    return F.when(c != "", F.coalesce(F.date_format(parse_date(c), "yyyy-MM-dd"), embedded, last))


def regex_replace(c: Column, pattern: str, replacement: str = "") -> Column:
    if not pattern:
        return c
    return F.regexp_replace(c, F.lit(text.java_pattern(pattern)), F.lit(text.java_replacement(replacement)))


def _strings_only(fn: Callable[[Column], Column]) -> Action:
    return lambda c, dtype, params: fn(c) if isinstance(dtype, T.StringType) else c


def _int_action(c: Column, dtype: T.DataType, params: Mapping[str, Any]) -> Column:
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return c
    if isinstance(dtype, T.NumericType):    # the fraction goes; null outside 64 bits
        return F.when((c >= -(2.0 ** 63)) & (c < 2.0 ** 63), c).try_cast("bigint")
    return to_int(c.cast("string"))


def _float_action(c: Column, dtype: T.DataType, params: Mapping[str, Any]) -> Column:
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    return to_float(c.cast("string"))


def _date_action(c: Column, dtype: T.DataType, params: Mapping[str, Any]) -> Column:
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("string")
    return to_date(c, bool(params.get("strict", False)))


_ACTIONS: dict[str, Action] = {
    "trim": _strings_only(trim),
    "strip_html": _strings_only(strip_html),
    "to_lower": _strings_only(F.lower),
    "to_upper": _strings_only(F.upper),
    "to_int": _int_action,
    "to_float": _float_action,
    "to_date": _date_action,
    "normalize_url": _strings_only(urls.normalize_url),
    "regex_replace": lambda c, dtype, params: regex_replace(
        c, params.get("pattern", ""), params.get("replacement", "")) if isinstance(dtype, T.StringType) else c,
}


def register_action(name: str, fn: Callable[[Column], Column]) -> None:
    """Add a cleaning action; `fn` builds a native expression from the field's Column."""
    _ACTIONS[name] = lambda c, dtype, params: fn(c)


def apply_action(c: Column, dtype: T.DataType, action: str, params: Mapping[str, Any] | None = None) -> Column:
    """Apply one action; arrays are mapped item by item, unknown actions change nothing."""
    fn = _ACTIONS.get(action)
    if fn is None:
        return c
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda item: apply_action(item, dtype.elementType, action, params))
    return fn(c, dtype, params or {})
