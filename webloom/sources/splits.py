"""Records of quoted CSV and of JSON arrays, cut out of files by many tasks.

A split of a large file may begin inside a quoted value or a nested object.  A first pass over the splits reports what each
does to the state in either case (begun outside or inside a quote): whether the quotes are odd, and how the brackets change.
A running sum over the splits of a file (one row a split) gives the state at the begin of each.  In a second pass every
split cuts its own records; the ends of records that reach over a split are put together by their order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN_BYTES = 4_000_000           # of pieces that are looked at together, whatever the size of an Arrow batch

_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[ord("{"), ord("[")]] = True
_CLOSE[[ord("}"), ord("]")]] = True


class _Json:
    """Pieces end with a closing brace; brackets count outside of strings, and a backslash hides the character after it."""
    separator = "}"

    @staticmethod
    def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of quotes that begin or end a string, places of brackets, in strings or not, and their change of depth."""
        quotes, slashes = np.flatnonzero(data == _QUOTE), np.flatnonzero(data == _BACKSLASH)
        if len(slashes):
            # how many backslashes stand right before each quote
            first = np.ones(len(slashes), bool)
            first[1:] = np.diff(slashes) != 1
            begun = slashes[first][np.cumsum(first) - 1]
            last = np.searchsorted(slashes, quotes) - 1
            before = np.where((last >= 0) & (slashes[last] == quotes - 1), quotes - begun[last], 0)
            quotes = quotes[before % 2 == 0]
        places = np.flatnonzero(_OPEN[data] | _CLOSE[data])
        return quotes, places, np.where(_OPEN[data[places]], 1, -1)


class _Csv:
    """Pieces are lines; a doubled quote inside a value leaves the state as it was."""
    separator = "\n"

    @staticmethod
    def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of quotes and of line ends, which change no depth."""
        places = np.flatnonzero(data == ord("\n"))
        return np.flatnonzero(data == _QUOTE), places, np.zeros(len(places), np.int64)


def _inside(quotes: np.ndarray, places: np.ndarray, begun: int) -> np.ndarray:
    """Per place whether it lies in a quoted value."""
    return (np.searchsorted(quotes, places) + begun) % 2 == 1


def ranges(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of an Arrow array of strings with at most `most` bytes each, one string at least."""
    total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(total, total[low] + most, "right")) - 1)
        yield low, high
        low = high


def _bytes(batch: pa.RecordBatch, low: int, high: int, separator: str) -> bytes:
    return "".join([v + separator for v in batch.column("value").slice(low, high - low).to_pylist()]).encode()


def _runs(batches: Iterator[pa.RecordBatch], separator: str):
    """((file, start), whether it begins the split, a row of it, bytes) in the order of the rows, at most `RUN_BYTES` or one piece at a time."""
    now = None
    for batch in batches:
        keys = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True))
        low = 0
        while low < len(keys):
            high = low + 1
            while high < len(keys) and keys[high] == keys[low]:
                high += 1
            for a, b in ranges(batch.column("value").slice(low, high - low)):
                yield keys[low], keys[low] != now, batch.slice(low, 1), _bytes(batch, low + a, low + b, separator)
                now = keys[low]
            low = high


def _effects(kind):
    """Per split: are its quotes odd, and the bracket change if it begins outside or inside a quote; its first character."""
    def run(batches):
        done: list[list] = []
        for key, new, _, raw in _runs(batches, kind.separator):
            if new:
                done.append([*key, 0, 0, 0, ""])
            data = np.frombuffer(raw, np.uint8)
            quotes, places, change = kind.marks(data)
            own = done[-1]
            inside = _inside(quotes, places, 0)
            outer, inner = int(change[~inside].sum()), int(change[inside].sum())
            if own[2]:
                outer, inner = inner, outer
            own[2], own[3], own[4] = (own[2] + len(quotes)) % 2, own[3] + outer, own[4] + inner
            own[5] = own[5] or raw.decode().lstrip("\ufeff \t\r\n")[:1]
        names = ("file", "start", "odd", "outer", "inner", "first")
        columns = list(zip(*done, strict=True)) or [()] * 6
        types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))
    return run


def _cut(kind):
    """Records that end in a split, and the open rest of its last one.

    `part` is "whole", "end" (of a record begun before), "begin" or "middle" (a split inside one record)."""
    def run(batches):
        state: dict = {}

        def rest() -> Iterator[pa.RecordBatch]:
            if state and (state["held"] if state["open"] else state["held"].strip()):
                yield row([(state["key"], state["n"], "middle" if state["open"] else "begin", state["held"])])

        def row(found: list[tuple]) -> pa.RecordBatch:
            keys, numbers, parts, texts = zip(*found, strict=True)
            return pa.RecordBatch.from_pydict({
                "file": [k[0] for k in keys], "start": pa.array([k[1] for k in keys], pa.int64()), "n": pa.array(numbers, pa.int64()), "part": list(parts),
                "record": [t.decode() for t in texts]})

        for key, new, facts, raw in _runs(batches, kind.separator):
            if new:
                yield from rest()
                inside, depth, base = (facts.column(c)[0].as_py() for c in ("inside", "depth", "base"))
                state = {"key": key, "n": 0, "inside": inside, "depth": depth, "base": base, "held": b"", "open": bool(inside) if kind is _Csv else depth > base}
            data = np.frombuffer(raw, np.uint8)
            quotes, places, change = kind.marks(data)
            outside = ~_inside(quotes, places, state["inside"])
            places, change = places[outside], change[outside]
            if kind is _Csv:
                ends = places
                begins = np.concatenate([[0], ends + 1]) if len(ends) else np.zeros(1, np.int64)
            else:
                depth = np.cumsum(change) + state["depth"]
                ends = places[(change < 0) & (depth == state["base"])]
                begins = places[(change > 0) & (depth == state["base"] + 1)]
                state["depth"] = int(depth[-1]) if len(depth) else state["depth"]
            state["inside"] = (state["inside"] + len(quotes)) % 2
            # a record held from the batch before, or from the split before, goes on at the first byte
            going = kind is _Csv or bool(state["held"]) or state["open"]
            starts = begins if kind is _Csv else np.concatenate([[0], begins]) if going else begins
            found = []
            for low, high in zip(starts, ends, strict=False):
                part, state["open"] = ("end" if state["open"] else "whole"), False
                text = state["held"] + raw[low:high + (kind is _Json)]
                state["held"] = b""
                if text.strip() or part == "end":
                    found.append((state["key"], state["n"], part, text))
                    state["n"] += 1
            if len(starts) > len(ends):
                state["held"] += raw[int(starts[len(ends)]):]
            if found:
                yield row(found)
        yield from rest()
    return run


def _records(spark: SparkSession, path: str, kind) -> DataFrame:
    """(file, start, n, record): records in the order of the files' bytes."""
    pieces = spark.read.text(path, lineSep=kind.separator).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    effects = pieces.mapInArrow(_effects(kind), "file string, start long, odd int, outer long, inner long, first string")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    entered = effects.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    change = F.when(F.col("inside") == 0, F.col("outer")).otherwise(F.col("inner"))
    first = F.first(F.nullif("first", F.lit("")), ignorenulls=True).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    states = entered.select("file", "start", F.col("inside").cast("int").alias("inside"), F.coalesce(F.sum(change).over(before), F.lit(0)).alias("depth"),
                            F.when(first == "[", 1).otherwise(0).alias("base"))
    # one short row per split of 128 MB: a million of them stand for 128 TB
    known = pieces.join(F.broadcast(states), ["file", "start"])
    cut = known.mapInArrow(_cut(kind), "file string, start long, n long, part string, record string")
    whole = cut.where(F.col("part") == "whole").select("file", "start", "n", "record")
    # at most two parts a split; a record's parts follow each other from its "begin" on
    parts = cut.where(F.col("part") != "whole")
    begun = F.count_if(F.col("part") == "begin").over(Window.partitionBy("file").orderBy("start", "n"))
    joined = parts.withColumn("_of", begun).groupBy("file", "_of").agg(F.array_sort(F.collect_list(F.struct("start", "n", "record"))).alias("p"))
    return whole.unionByName(joined.select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["n"].alias("n"), F.array_join("p.record", "").alias("record")))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """The objects of JSON array files (or of files of objects one after the other), as texts without line breaks."""
    return _records(spark, path, _Json).withColumn("record", F.regexp_replace("record", r"[\r\n]+", " "))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files; line breaks inside quotes belong to the record, header lines are records too."""
    return _records(spark, path, _Csv).withColumn("record", F.regexp_replace("record", "\r$", ""))
