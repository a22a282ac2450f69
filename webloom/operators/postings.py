"""Posting lists of chunks, and many queries at once over them.

Chunks are dealt by ranges of their id and numbered in that order in segments of `SEGMENT` chunks.  A task turns a segment
around in place: per term one block with the gaps between the numbers of its chunks, the term's counts, the chunks' squared
lengths, and the greatest weight in the block.  A frequent term so has one block per segment, never one long list.

Queries meet the blocks by a join on the term; no query text passes the driver.  A task takes the segments of a group of
`GROUP` queries in order and keeps the best k of each query: a segment whose greatest weights cannot bring a query above
its k-th score is passed over without opening its blocks.  At most k rows per query and task are shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.operators.retrieval import MIN_SCORE, TOP_K, term_counts, vector_norm
from webloom.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEGMENT = 2048          # chunks of a segment; gaps fit 16 bits
GROUP = 512             # queries whose scores a task holds beside a segment
SPAN = 16               # segments that go to one task together, so that its best scores so far save work
SALTS = 8               # parts of a frequent term's blocks in the join
BUCKETS = 256
HOT = 10_000            # chunks times queries of a block from which it goes into the matrix product
CATALOGUE = -1          # the bucket of the rows that name the chunks of a segment

_NARROW = np.dtype([("gap", "<u2"), ("n", "<u2"), ("square", "<u4")])
_WIDE = np.dtype([("gap", "<u2"), ("n", "<u4"), ("square", "<u8")])


def _invert(segment: int, terms: pa.Array, counts: np.ndarray, chunk: np.ndarray, n_chunks: int) -> pa.RecordBatch:
    """One row per term of a segment, in order of the terms' first places."""
    squares = np.zeros(n_chunks, np.int64)
    np.add.at(squares, chunk, counts * counts)
    coded = terms.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")            # chunks ascend within a term
    codes, chunk, counts = codes[order], chunk[order], counts[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    wide = bool(counts.max() >= 2**16 or squares.max() >= 2**32)
    posts = np.empty(len(codes), _WIDE if wide else _NARROW)
    gaps = np.diff(chunk, prepend=0)
    gaps[starts] = chunk[starts]
    posts["gap"], posts["n"], posts["square"] = gaps, counts, squares[chunk]
    top = np.maximum.reduceat(counts / np.sqrt(squares[chunk]), starts)
    offsets = np.append(starts, len(codes)).astype(np.int32) * posts.dtype.itemsize
    m = len(starts)
    return pa.RecordBatch.from_pydict({
        "segment": pa.array(np.full(m, segment)), "term": coded.dictionary.take(pa.array(codes[starts])), "top": top, "wide": pa.array([wide] * m),
        "postings": pa.BinaryArray.from_buffers(pa.binary(), m, [None, pa.py_buffer(offsets), pa.py_buffer(posts)])})


def _build(ids_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        segment, held, n = TaskContext.get().partitionId() << 32, [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, terms, counts = (whole.column(i).chunk(0) for i in range(3))
            name = pa.RecordBatch.from_pydict({"segment": pa.array([segment]), "term": pa.nulls(1, pa.string()), "top": pa.nulls(1, pa.float64()),
                                               "wide": pa.nulls(1, pa.bool_()), "postings": pa.nulls(1, pa.binary()), "ids": pa.array([ids.to_pylist()], pa.list_(ids_type))})
            yield name
            if len(flat := terms.flatten()):
                made = _invert(segment, flat, counts.flatten().to_numpy().astype(np.int64), pc.list_parent_indices(terms).to_numpy(), len(ids))
                yield pa.RecordBatch.from_arrays([*made.columns, pa.nulls(made.num_rows, pa.list_(ids_type))], names=[*made.schema.names, "ids"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, SEGMENT - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == SEGMENT:
                    yield from rows()
                    segment, held, n = segment + 1, [], 0
        if n:
            yield from rows()
    return run


def posting_blocks(chunks: DataFrame, id_col: str = "chunk_id", body: str = "text_content") -> DataFrame:
    """(segment, term, top, wide, postings, ids): blocks of terms, and per segment one row without a term that lists its ids.

    The term counts of the chunks move once, by ranges of the id, so numbers follow the order of the ids.
    """
    counted = chunks.select(F.col(id_col).alias("id"), term_counts(F.col(body)).alias("_t"))
    dealt = (counted.select("id", F.col("_t.term").alias("terms"), F.col("_t.n").alias("counts"))
             .repartitionByRange("id").sortWithinPartitions("id"))
    kind = chunks.schema[id_col].dataType.simpleString()
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    return dealt.mapInArrow(_build(types[kind]), f"segment long, term string, top double, wide boolean, postings binary, ids array<{kind}>")


def _bucket(term: Column) -> Column:
    return F.when(term.isNull(), CATALOGUE).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int"))


def write_index(chunks: DataFrame, path: str, id_col: str = "chunk_id", body: str = "text_content", mode: str = "errorifexists") -> None:
    """Store the blocks by bucket of the term; a bucket's blocks are split over tasks by segment."""
    laid = posting_blocks(chunks, id_col, body).withColumn("term_bucket", _bucket(F.col("term")))
    (laid.repartition("term_bucket", F.pmod("segment", F.lit(SPAN))).sortWithinPartitions("term_bucket", "term", "segment")
     .write.mode(mode).partitionBy("term_bucket").parquet(path))


def read_index(spark: SparkSession, path: str, id_kind: str = "string") -> DataFrame:
    return spark.read.schema(f"segment long, term string, top double, wide boolean, postings binary, ids array<{id_kind}>, term_bucket int").parquet(path)


def _score(k: int):
    """Sorted rows (g, segment, top, wide, postings, slots, weights) to the best k rows per query of the task."""
    class Best:
        def __init__(self) -> None:
            self.scores = [np.zeros(0)] * GROUP
            self.places = [np.zeros((2, 0), np.int64)] * GROUP
            self.floor = np.full(GROUP, MIN_SCORE)      # a score has to lie above this
            self.full = np.zeros(GROUP, bool)

        def offer(self, slot: int, segment: int, chunks: np.ndarray, scores: np.ndarray) -> None:
            # what comes later has larger numbers, so a stable sort keeps the order of equal scores
            every = np.concatenate([self.scores[slot], scores])
            places = np.concatenate([self.places[slot], [np.full(len(chunks), segment), chunks]], axis=1)
            kept = np.argsort(-every, kind="stable")[:k]
            self.scores[slot], self.places[slot] = every[kept], places[:, kept]
            if len(kept) == k:
                self.full[slot], self.floor[slot] = True, every[kept[-1]]

        def rows(self, g: int) -> pa.RecordBatch:
            slots = np.repeat(np.arange(GROUP), [len(s) for s in self.scores])
            places = np.concatenate(self.places, axis=1)
            return pa.RecordBatch.from_pydict({"qno": pa.array(g * GROUP + slots, pa.int64()), "segment": places[0], "chunk": places[1].astype(np.int32),
                                               "similarity_score": np.concatenate(self.scores)})

    def rounded(scores: np.ndarray) -> np.ndarray:
        return np.floor(np.minimum(1.0, scores) * 1e4 + 0.5) / 1e4

    def score(best: Best, segment: int, blocks: list[tuple]) -> None:
        limit = np.zeros(GROUP)
        for top, _, _, slots, weights in blocks:
            limit[slots] += top * weights
        open_slots = np.where(best.full, rounded(limit + 1e-9) > best.floor, limit + 1e-9 > MIN_SCORE)
        if not open_slots.any():
            return
        column = np.cumsum(open_slots) - 1
        scores = np.zeros((SEGMENT, int(open_slots.sum())))
        hot: list[tuple] = []
        for _, wide, postings, slots, weights in blocks:
            alive = open_slots[slots]
            if alive.any():
                posts = np.frombuffer(postings, _WIDE if wide else _NARROW)
                own = posts["n"] / np.sqrt(posts["square"].astype(np.float64))
                chunks, mine = np.cumsum(posts["gap"].astype(np.int64)), column[slots[alive]]
                if len(chunks) * len(mine) < HOT:
                    scores[np.ix_(chunks, mine)] += own[:, None] * weights[alive]
                else:
                    hot.append((chunks, own, mine, weights[alive]))
        for first in range(0, len(hot), 256):       # terms of many chunks and many queries: one matrix product
            part = hot[first:first + 256]
            left, right = np.zeros((SEGMENT, len(part))), np.zeros((len(part), scores.shape[1]))
            for i, (chunks, own, mine, weights) in enumerate(part):
                left[chunks, i], right[i, mine] = own, weights
            scores += left @ right
        for slot in np.flatnonzero(open_slots):
            mine = scores[:, column[slot]]
            good = np.flatnonzero(mine > MIN_SCORE)
            if len(good):
                best.offer(slot, segment, good, rounded(mine[good]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks, best = None, [], Best()
        for batch in batches:
            columns = [batch.column(n) for n in ("top", "wide", "postings", "slots", "weights")]
            for i, now in enumerate(zip(batch.column("g").to_pylist(), batch.column("segment").to_pylist(), strict=True)):
                if key is not None and now != key:
                    score(best, key[1], blocks)
                    blocks = []
                    if now[0] != key[0]:
                        yield best.rows(key[0])
                        best = Best()
                key = now
                top, wide, postings, slots, weights = (c[i] for c in columns)
                blocks.append((top.as_py(), wide.as_py(), postings.as_buffer(), slots.values.to_numpy(), weights.values.to_numpy()))
        if key is not None:
            score(best, key[1], blocks)
            yield best.rows(key[0])
    return run


def search_blocks(index: DataFrame, queries: DataFrame, k: int = TOP_K, query_id: str = "query_id", query_text: str = "query_text") -> DataFrame:
    """Best k chunks for every query row: (query_id, chunk_id, similarity_score, rank), ranked by the rounded score, then the id.

    `index` is a stored table of blocks (`write_index`, or `posting_blocks` written as it is).
    """
    asked = queries.select(F.col(query_id).alias("query_id"), term_counts(F.col(query_text)).alias("_t"))
    # numbers of stored rows: those of a group of GROUP lie in one partition
    asked = materialize(asked.withColumn("qno", F.monotonically_increasing_id()), "queries")
    terms = asked.select("qno", vector_norm(F.col("_t")).alias("_norm"), F.inline("_t"))
    groups = terms.groupBy("term", F.floor(F.col("qno") / GROUP).alias("g")).agg(
        F.collect_list(F.struct((F.col("qno") % GROUP).cast("int").alias("slot"), (F.col("n") / F.col("_norm")).alias("weight"))).alias("asked"))
    groups = groups.select("term", "g", F.col("asked.slot").alias("slots"), F.col("asked.weight").alias("weights"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    blocks, keys = index.where(F.col("term").isNotNull()), ["term", "salt"]
    if "term_bucket" in index.columns:      # a stored index is read by the buckets of the queries' terms
        groups, keys = groups.withColumn("term_bucket", _bucket(F.col("term"))), [*keys, "term_bucket"]
    met = blocks.withColumn("salt", F.pmod(F.xxhash64("segment"), F.lit(SALTS)).cast("int")).join(groups, keys)
    dealt = (met.select("g", "segment", "top", "wide", "postings", "slots", "weights")
             .repartition("g", F.floor(F.col("segment") / SPAN)).sortWithinPartitions("g", "segment"))
    found = dealt.mapInArrow(_score(k), "qno long, segment long, chunk int, similarity_score double")
    place = F.row_number().over(Window.partitionBy("qno").orderBy(F.desc("similarity_score"), "segment", "chunk"))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    names = index.where(F.col("term").isNull()).select("segment", "ids")
    if "term_bucket" in index.columns:
        names = index.where(F.col("term_bucket") == CATALOGUE).select("segment", "ids")
    return (best.join(names, "segment").join(asked.select("qno", "query_id"), "qno")
            .select("query_id", F.element_at("ids", F.col("chunk") + 1).alias("chunk_id"), "similarity_score", "rank"))


def search_batch(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "chunk_id", body: str = "text_content",
                 query_id: str = "query_id", query_text: str = "query_text") -> DataFrame:
    """Best k chunks for every query over chunks without an index: their blocks are stored once, in the order they are made."""
    return search_blocks(materialize(posting_blocks(chunks, id_col, body), "postings"), queries, k, query_id, query_text)


def search_index(spark: SparkSession, path: str, query: str, k: int = TOP_K, id_kind: str = "string") -> DataFrame:
    """(chunk_id, similarity_score) of one query text against a stored index; only the buckets of its terms are read."""
    index = read_index(spark, path, id_kind)
    one = spark.createDataFrame([(0, query)], "query_id int, query_text string")
    wanted = one.select(F.explode(term_counts(F.col("query_text"))).alias("t")).select(_bucket(F.col("t.term")))
    buckets = [CATALOGUE, *sorted({r[0] for r in wanted.collect()})]      # one per term of the query
    found = search_blocks(index.where(F.col("term_bucket").isin(*buckets)), one, k)
    return found.orderBy("rank").select("chunk_id", "similarity_score")
