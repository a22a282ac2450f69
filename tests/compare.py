"""Compare a Spark result with its DuckDB counterpart: same columns, same rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def differences(spark_df, con, sql: str, limit: int = 3) -> list[str]:
    names = sorted(spark_df.columns)
    got = Counter(tuple(plain(v) for v in row) for row in spark_df.select(*[f"`{n}`" for n in names]).collect())
    cursor = con.execute(sql)
    theirs = [c[0] for c in cursor.description]
    if sorted(theirs) != names:
        return [f"columns differ: {names} / {sorted(theirs)}"]
    order = [theirs.index(n) for n in names]
    want = Counter(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
    out = []
    if sum(got.values()) != sum(want.values()):
        out.append(f"row counts {sum(got.values())} / {sum(want.values())}")
    for label, rest in (("only Spark", got - want), ("only SQL", want - got)):
        out += [f"{label}: {str(row)[:600]}" for row in list(rest)[:limit]]
    return out
