"""Registered queries: a Spark callable per name and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The space and word sets of `functions.text` in RE2 spelling.
RE2_SPACE = (r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
RE2_TOKEN = r"[\p{L}\p{N}_]{2,}"


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{RE2_SPACE}+', ' ', 'g'))"


def sql_normalize_url(c: str) -> str:
    """Lower scheme and authority, no fragment, no trailing slashes (urls with a scheme and host)."""
    return (f"lower(regexp_extract({c}, '^([^:]+://[^/?#]*)', 1)) || "
            f"(CASE WHEN regexp_extract({c}, '^[^:]+://[^/?#]*([^?#]*)', 1) = '/' THEN '/' "
            f"ELSE rtrim(regexp_extract({c}, '^[^:]+://[^/?#]*([^?#]*)', 1), '/') END) || "
            f"regexp_extract({c}, '^[^#?]*([?][^#]+)', 1)")


def sql_origin(c: str) -> str:
    return f"regexp_extract({c}, '^([^:]+://[^/?#]*)', 1)"


def sql_unescape(c: str) -> str:
    return f"replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"
