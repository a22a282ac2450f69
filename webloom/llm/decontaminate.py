"""Benchmark decontamination by one Aho-Corasick automaton over normalised test items.

A text is normalised to its lower-cased words with single spaces between them.  The automaton's patterns are the
windows of `WINDOW` consecutive words of the items (an item of fewer words is one window), with a space at either end so
that only whole words match.  Each document is scanned once; hits are mapped back to offsets of the original text.

The items travel to the tasks in blocks whose size is bounded by `BLOCK_BYTES`; a benchmark beyond that takes more than
one block, and each block scans the documents.

Edge cases: null and wordless texts have no words and are clean; null and wordless items match nothing; items with
equal windows are all counted; item_ids are strings of any form, and an item without one is matched but not listed;
repeated rows are documents of their own; an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.tokens import forget
from webloom.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 13
BLOCK_BYTES = 4_000_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")         # before upper-case letters are lowered
# Letters to lower case, digits and all bytes of other characters as they are, the rest to a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[str]:
    return text.encode("utf-8", "replace").translate(_NORMAL).decode("utf-8").split(" ") if text else []


def normal(text: str | None) -> tuple[str, int]:
    """Words joined by single spaces, with a space at either end, and their number."""
    words = [w for w in words_of(text) if w]
    return f" {' '.join(words)} ", len(words)


class Scanner:
    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        import ahocorasick
        self.items: dict[str, set[str]] = defaultdict(set)
        for name, text in items:
            words = [w for w in words_of(text) if w]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                self.items[f" {' '.join(words[i:i + window])} "].update([] if name is None else [name])
        self.automaton = ahocorasick.Automaton()
        for pattern in self.items:
            self.automaton.add_word(pattern, pattern)
        if self.items:
            self.automaton.make_automaton()

    def hits(self, plain: str) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges [first, last) of a normalised text that windows cover, joined where they overlap; their items."""
        spans, found = [], set()
        if self.items:
            seen, at = 0, 0         # words before position `at`
            for end, pattern in self.automaton.iter(plain):
                start = end - len(pattern) + 1
                if start >= at:
                    seen += plain.count(" ", at, start)
                    at = start
                    first = seen
                else:
                    first = seen - plain.count(" ", start, at)
                last = first + pattern.count(" ") - 1
                found |= self.items[pattern]
                spans.append((first, last))
        joined: list[tuple[int, int]] = []
        for first, last in sorted(spans):
            if joined and first <= joined[-1][1]:
                joined[-1] = joined[-1][0], max(last, joined[-1][1])
            else:
                joined.append((first, last))
        return joined, found


_SCHEMA = "row long, doc_id long, n_words long, spans array<struct<first:long,last:long,start:long,end:long>>, items array<string>"


def _scan(items: list[tuple[str | None, str]], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scanner = Scanner(items, window)
        kinds = (pa.int64(), pa.int64(), pa.int64(),
                 pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")])), pa.list_(pa.string()))
        for batch in batches:
            out = []
            for row, name, cell in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = cell.as_py()
                plain, n = normal(text)
                spans, found = scanner.hits(plain) if n else ([], set())
                if spans:           # only a hit document is read again for its offsets
                    places = [m.span() for m in _WORD.finditer(text)]
                    spans = [{"first": a, "last": b, "start": places[a][0], "end": places[b - 1][1]} for a, b in spans]
                out.append((row, name, n, spans, sorted(found)))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["row", "doc_id", "n_words", "spans", "items"])
    return run


def _n_hit():
    return F.aggregate(F.col("spans"), F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def _merge(batches):
    """Word ranges of several blocks, joined where they overlap."""
    for pdf in batches:
        merged = []
        for spans in pdf["spans"]:
            own: list[dict] = []
            for s in sorted((dict(s) for s in spans), key=lambda s: (s["first"], s["last"])):
                if own and s["first"] <= own[-1]["last"]:
                    if s["last"] > own[-1]["last"]:
                        own[-1].update(last=s["last"], end=s["end"])
                else:
                    own.append(s)
            merged.append(own)
        yield pdf.assign(spans=merged)


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items, cut by a hash into blocks of about `block_bytes`."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).dropna(subset=["text"])
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items for b in range(blocks)]


def _scan_blocks(texts: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """`texts` (row, doc_id, text) scanned for each block of items; with several blocks, `row` tells rows apart."""
    scans = [texts.mapInArrow(_scan([tuple(r) for r in own.collect()], window), _SCHEMA) for own in blocks]
    if len(scans) == 1:
        return scans[0]
    return (reduce(DataFrame.unionByName, scans).groupBy("row", "doc_id", "n_words")
            .agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
            .mapInPandas(_merge, _SCHEMA))


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (word and character ranges that windows cover) and items (ids as sorted strings) per document."""
    blocks = _item_blocks(benchmark, block_bytes)
    number = F.monotonically_increasing_id() if len(blocks) > 1 else F.lit(0).cast("long")
    texts = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scan_blocks(materialize(texts, "texts") if len(blocks) > 1 else texts, blocks, window).drop("row")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a twentieth of the words or more is hit."""
    scan = scan_documents(docs, benchmark, window, block_bytes).withColumn("n_hit", _n_hit())
    return scan.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                       ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` whose text is not contaminated; all columns stay.  With one block of items nothing is shuffled."""
    blocks = _item_blocks(benchmark, block_bytes)
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("own"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    if len(blocks) == 1:
        return rows.where(~F.pandas_udf(_verdict([tuple(r) for r in blocks[0].collect()], window), "boolean")("text")).select("own.*")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
    hit = _scan_blocks(rows.select("row", "doc_id", "text"), blocks, window).withColumn("n_hit", _n_hit())
    return rows.join(hit.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select("row"), "row", "left_anti").select("own.*")


def _verdict(known: list[tuple[str | None, str]], window: int):
    made: list[Scanner] = []        # by the first batch of a task

    def run(texts):
        if not made:
            forget()
            made.append(Scanner(known, window))

        def contaminated(text: str | None) -> bool:
            plain, n = normal(text)
            hit = sum(b - a for a, b in made[0].hits(plain)[0]) if n else 0
            return hit > 0 and 20 * hit >= n
        return texts.map(contaminated).astype(bool)
    return run
