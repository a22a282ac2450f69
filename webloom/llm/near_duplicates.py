"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A document's set is its distinct five-word shingles.  Its signature has 40 values of 16 bits, in ten chunks of four.
Two signatures that differ in at most 19 values agree in at least three values of some chunk (ten chunks with two errors each
would need 20), so an index over each chunk with each one of its values left out - every allowed error - meets all pairs
within that distance.  At a similarity of 0.85 a pair differs in 6 values on average; beyond 19 lie fewer than one
pair in a million.  Every link is confirmed on the full sets.

Work per bucket of an index stays linear in its rows.  Equal sets are one class from the start.  Then each class
meets one leader of its bucket; classes already in one component need no further comparison.  One more round
compares what is still apart with another leader of the largest component.  At the end the classes outside a bucket's largest
component meet the classes of other components, so no link between components is lost; classes with too many shingles
that no other class here has are left out, and pairs are met by the rarest shingles they share (see `_across`).

Edge cases: null, empty and wordless texts have empty sets, link with nothing and are kept; a text of fewer than five words is one
shingle; null doc_ids come after all others as representatives; of rows with equal doc_id and equal sets one is kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.tokens import forget, slices
from webloom.llm.wordhash import constants, hash_words, mix
from webloom.session import materialize, release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
CHUNKS, VALUES = 10, 4          # chunks of a signature and 16-bit values in a chunk (one long)
DISTANCE = 2 * CHUNKS - 1
LEADER_ROUNDS = 1


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and the size of each set."""
    lowered = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    words, counts, _, _ = hash_words(lowered)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    factors, last = constants(SHINGLE, 5), np.cumsum(counts)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    spot = np.arange(len(words)) - np.repeat(last - counts, counts)
    size = np.repeat(counts, counts)
    grams = np.zeros(len(words), np.uint64)
    for j in range(SHINGLE):        # a text of fewer words is one shingle of all of them
        grams += np.where(spot + j < size, padded[j:j + len(words)] * factors[j], np.uint64(0))
    grams = mix(grams, 11) + np.where(size < SHINGLE, size, 0).astype(np.uint64)
    valid = spot <= np.maximum(size - SHINGLE, 0)
    owner = np.repeat(np.arange(len(texts)), counts)[valid]
    order = np.lexsort((grams[valid], owner))
    grams, owner = grams[valid][order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[fresh], np.bincount(owner[fresh], minlength=len(texts))


def signatures(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each non-empty set two order-free 64-bit sums, and its signature as CHUNKS longs."""
    some = sizes > 0
    first = (np.cumsum(sizes) - sizes)[some]
    sums = np.stack([np.add.reduceat(mix(grams, salt), first) for salt in (21, 22)], 1) if len(first) else np.zeros((0, 2), np.uint64)
    values = np.zeros((len(first), CHUNKS * VALUES), np.uint64)
    for k, (a, b) in enumerate(zip(constants(CHUNKS * VALUES, 31), constants(CHUNKS * VALUES, 32), strict=True)):
        if len(first):
            values[:, k] = mix(np.minimum.reduceat(grams * a + b, first)) & np.uint64(0xFFFF)
    shifts = np.arange(VALUES, dtype=np.uint64) * np.uint64(16)
    return sums, (values.reshape(-1, CHUNKS, VALUES) << shifts).sum(2, dtype=np.uint64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    forget()
    uid = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            grams, sizes = shingle_sets(texts[a:b])
            sums, chunks = signatures(grams, sizes)
            full = np.zeros((b - a, 2 + CHUNKS), np.uint64)
            full[sizes > 0] = np.concatenate([sums, chunks], 1)
            full = full.astype(np.int64)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_pydict({
                "uid": pa.array(np.arange(uid, uid + b - a)), "doc_id": part.column("doc_id"), "text_key": part.column("text_key"),
                "n": pa.array(sizes), "s1": pa.array(full[:, 0]), "s2": pa.array(full[:, 1]),
                "chunks": pa.array(list(full[:, 2:]), pa.list_(pa.int64()))})
            uid += b - a


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            grams, sizes = shingle_sets(texts[a:b])
            yield pa.RecordBatch.from_pydict({
                "node": batch.column("node").slice(a, b - a),
                "items": pa.array(np.split(grams.astype(np.int64), np.cumsum(sizes)[:-1]), pa.list_(pa.int64()))})


def _distance(a: Column, b: Column) -> Column:
    """In how many of their 16-bit values two signatures differ."""
    def lanes(i: int) -> Column:
        x = a[i].bitwiseXOR(b[i])
        for by in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        return F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
    return reduce(lambda x, y: x + y, [lanes(i) for i in range(CHUNKS)])


def _index_keys() -> Column:
    """Each chunk with each of its values left out."""
    keys = []
    for c in range(CHUNKS):
        for v in range(VALUES):
            mask = ~(0xFFFF << (16 * v)) & 0xFFFFFFFFFFFFFFFF
            mask = mask - 2**64 if mask >= 2**63 else mask
            keys.append(F.xxhash64(F.lit(c), F.lit(v), F.col("chunks")[c].bitwiseAND(F.lit(mask))))
    return F.explode(F.array(*keys))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of `links` (a, b): label is the smallest node of the component.

    Labels fall to the smallest label next door and then to their label's label, so the number of rounds grows with the
    logarithm of the longest path.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("theirs")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs")))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "theirs").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("label").alias("beyond"))
        moved = materialize(lower.join(jump, "lower").select("node", "label", F.least("lower", "beyond").alias("new")), "labels")
        still = moved.where("new <> label").isEmpty()
        release(labels)
        labels = moved.select("node", F.col("new").alias("label"))
        labels.scratch = moved.scratch
        if still:
            release(both)
            return labels


class _Join:
    """The state of one near-duplicate search: index rows, full sets and links so far."""

    def __init__(self, docs: DataFrame, percent: int):
        self.percent = percent
        text = F.col("text").cast("string")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
        self.signed = materialize(rows.mapInArrow(_sign, "uid long, doc_id long, text_key long, n long, s1 long, s2 long, chunks array<long>"), "signed")
        full = self.signed.where("n > 0")
        self.classes = materialize(full.groupBy("n", "s1", "s2").agg(F.min("uid").alias("node"), F.count("*").alias("copies")), "classes")
        own = self.classes.select(F.col("node").alias("uid"), "copies")
        self.nodes = materialize(full.join(own, "uid").select(F.col("uid").alias("node"), "doc_id", "text_key", "n", "copies", "chunks"), "nodes")
        index = self.nodes.select("node", "copies", _index_keys().alias("key"))
        # the class with most copies leads: variants of a text lie closer to it than to each other
        shared = (index.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max_by("node", F.struct("copies", "node")).alias("leader"))
                  .where("low < high").select("key", "leader"))
        self.shared = materialize(shared, "shared")
        self.index = materialize(index.select("key", "node").join(self.shared, "key"), "index")
        needed = self.index.select("node").distinct().join(self.nodes.select("node", "doc_id", "text_key"), "node")
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))
        texts = rows.join(needed.select("node", F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")), same).select("node", "text")
        self.sets = materialize(texts.mapInArrow(_sets, "node long, items array<long>").dropDuplicates(["node"]), "sets")
        self.links: list[DataFrame] = []

    def near(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) those within the signature distance whose sizes allow a link."""
        small = self.nodes.select("node", "n", "chunks")
        for side in ("a", "b"):
            pairs = pairs.join(small.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("chunks").alias(f"c_{side}")), side)
        return pairs.where(self._possible("n_a", "n_b")).where(_distance(F.col("c_a"), F.col("c_b")) <= DISTANCE).select("a", "b", "n_a", "n_b")

    def _possible(self, n: str, m: str) -> Column:
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def confirm(self, pairs: DataFrame) -> None:
        """Adds the pairs (a, b, n_a, n_b) that are links on their full sets."""
        pairs = materialize(pairs, "pairs")
        sets = self.sets
        both = (pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("i_b")), "b")
                .join(sets.select(F.col("node").alias("a"), F.col("items").alias("i_a")), "a"))
        common = both.select("a", "b", F.size(F.array_intersect("i_a", "i_b")).cast("long").alias("k"), "n_a", "n_b")
        linked = common.where(100 * F.col("k") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("k"))).select("a", "b")
        self.links.append(materialize(linked, "found"))

    def labels(self) -> DataFrame:
        return connected_components(reduce(DataFrame.unionByName, self.links))

    def apart(self, labels: DataFrame) -> DataFrame:
        """Index rows with their component, of those keys whose rows are in several; `main` is the key's largest."""
        known = self.index.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        sizes = known.groupBy("key", "label").count()
        mixed = (sizes.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("parts"))
                 .where("parts > 1").select("key", "main"))
        return materialize(known.join(materialize(mixed, "mixed"), "key"), "apart")

    def _linkable(self, rows: DataFrame) -> DataFrame:
        """`rows` of classes that can still have a link, with n, chunks and `lone`: the shingles that no other class here has.

        A pair shares at most the shingles of either side that are not lone, which bounds its similarity from above.
        """
        items = self.sets.join(rows.select("node").distinct(), "node").select("node", F.explode("items").alias("item"))
        single = items.groupBy("item").agg(F.count("*").alias("k"), F.first("node").alias("node")).where("k = 1")
        lone = materialize(single.groupBy("node").agg(F.count("*").alias("lone")), "lone")
        known = rows.join(self.nodes.select("node", "n", "chunks"), "node").join(lone, "node", "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
        return materialize(known.where(100 * (F.col("n") - F.col("lone")) >= self.percent * F.col("n")), "linkable")

    def run(self) -> DataFrame:
        pairs = self.index.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
        self.confirm(self.near(pairs))
        for number in range(LEADER_ROUNDS):
            rows = self.apart(self.labels())
            leads = (rows.where("label = main").groupBy("key")
                     .agg(F.min_by("node", F.xxhash64("node", F.lit(number))).alias("a")))
            pairs = rows.where("label <> main").join(leads, "key").select("a", F.col("node").alias("b")).distinct()
            self.confirm(self.near(pairs))
        rows = self._linkable(self.apart(self.labels()))
        self.confirm(self._across(rows))
        return self.labels()

    def _across(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b, n_a, n_b) of classes of different components within the signature distance, at least one of them outside
        the largest component of a bucket.

        Buckets of a large group hold classes that are all near and mostly no links, so pairs are met by rare shingles: two
        linked classes share one of their rarest (100 - percent) in a hundred, and at the first that they share, what follows
        must still be enough on either side.  Both are necessary conditions, so no link is lost.
        """
        nodes = rows.groupBy("node").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.first("chunks").alias("chunks"),
                                         F.max(F.col("label") != F.col("main")).alias("minor"))
        nodes = materialize(nodes, "apart-nodes")
        items = materialize(self.sets.join(nodes.select("node", "n"), "node").select("node", "n", F.explode("items").alias("item")), "items")
        often = items.groupBy("item").agg(F.count("*").alias("k")).where("k > 1")
        # lone shingles come first in everybody's order and meet nobody, so only their number matters
        met = items.join(materialize(often, "often"), "item")
        order = Window.partitionBy("node").orderBy("k", "item")
        lone = F.col("n") - F.count("*").over(Window.partitionBy("node"))
        placed = met.withColumn("at", F.row_number().over(order) - 1 + lone)
        first = placed.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * self.percent / 100)).select("node", "item", "at")
        first = materialize(first.join(nodes, "node"), "rarest")
        minor = first.where("minor").select("item", *[F.col(c).alias(f"{c}_a") for c in ("node", "label", "n", "chunks", "at")])
        every = first.select("item", *[F.col(c).alias(f"{c}_b") for c in ("node", "label", "n", "chunks", "at", "minor")])
        # two minor classes meet once, from the smaller one
        once = ~F.col("minor_b") | (F.col("node_a") < F.col("node_b"))
        most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
        possible = 100 * most >= self.percent * (F.col("n_a") + F.col("n_b") - most)
        pairs = minor.join(every, (minor["item"] == every["item"]) & (F.col("label_a") != F.col("label_b")) & once & possible
                           & (_distance(F.col("chunks_a"), F.col("chunks_b")) <= DISTANCE))
        return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept per row of `docs`, and `text_key`, the hash of its text."""
    search = _Join(docs, percent)
    labels = search.run()
    member = (search.signed.join(search.classes.select("n", "s1", "s2", "node"), ["n", "s1", "s2"], "left")
              .join(labels, "node", "left").select("uid", "doc_id", "text_key", "n", F.coalesce("label", "node", "uid").alias("part")))
    member = materialize(member, "members")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("uid"))
    first = member.groupBy("part").agg(F.min(order).alias("first"))
    first = materialize(first.select("part", F.col("first.doc_id").alias("component_id"), F.col("first.uid").alias("first_uid")), "firsts")
    return member.join(first, "part").select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                             (F.col("uid") == F.col("first_uid")).alias("kept"), "text_key")


def keep_first(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of `docs`, with all columns, that are first in their component."""
    rows = materialize(near_duplicates(docs, percent), "kept")
    keys = materialize(rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.max("kept").alias("stays")).where("stays"), "keys")
    text = F.col("text").cast("string")
    named = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_key"))

    def chosen(own: DataFrame) -> DataFrame:
        own = own.select(F.col("doc_id").alias("_own_id"), F.col("text_key").alias("_own_key"))
        return named.join(own, F.col("_id").eqNullSafe(F.col("_own_id")) & (F.col("_key") == F.col("_own_key")), "left_semi")
    kept = chosen(keys.where("n = 1"))
    if not keys.where("n > 1").isEmpty():       # rows repeated in doc_id and text: one of each
        kept = kept.unionByName(chosen(keys.where("n > 1")).dropDuplicates(["_id", "_key"]))
    return kept.select("row.*")
