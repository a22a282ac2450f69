"""Shards by a hierarchical weighted hash tree.

A tree has regions, racks and shards; a shard has a weight.  For a document every shard makes a weighted draw
-ln(u) / weight, with u a hash of doc_id and the shard's name; the draw of a rack is the smallest of its shards, that
of a region the smallest of its racks.  (The smallest of such draws is distributed like one draw by the sum of the
weights, so a subtree receives its weighted share.)  The document descends into the child with the smallest draw at each level.
A changed weight or a new shard alters only the draws of its own rack and region, and a new shard can only lower
them, so documents move into that shard and nowhere else: the law is "key".

Edge cases: null doc_id is a key like any other; rows with one doc_id lie in one shard, their slots differ; a null
text has 16 bytes and the checksum of the empty text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import materialize

# region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

REGIONS, RACKS = 4, 2
ROWS_PER_BLOCK = 1_000_000


def even_tree(shards: int, regions: int = REGIONS, racks: int = RACKS) -> Tree:
    """Shards dealt in turn to regions and, within them, to racks: one more shard leaves all others in place."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for shard in range(shards):
        rack = f"rack{shard // regions % racks}"
        tree.setdefault(f"region{shard % regions}", {}).setdefault(rack, {})[shard] = 1.0
    return tree


def _draw(key: Column, shard: int, weight: float) -> Column:
    # 52 bits of the hash as a number in (0, 1)
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"shard-{shard}")), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(float(weight))


def _least(draws: list[Column]) -> Column:
    return draws[0] if len(draws) == 1 else F.least(*draws)


def _descend(children: list[tuple[Column, Column]]) -> Column:
    """`children` are (draw, value below): the value of the smallest draw, the first on ties."""
    low = _least([draw for draw, _ in children])
    return reduce(lambda rest, child: F.when(child[0] == low, child[1]).otherwise(rest), reversed(children[:-1]), children[-1][1])


def place(df: DataFrame, key: str, tree: Tree, output: str = "shard") -> DataFrame:
    """`df` with the shard that each row's key descends to.  Draws are computed once, level by level."""
    names = {(r, k, s): f"_draw_{s}" for r, racks in tree.items() for k, shards in racks.items() for s in shards}
    kept = df.columns
    out = df.select("*", *[_draw(F.col(key), s, tree[r][k][s]).alias(n) for (r, k, s), n in names.items() if tree[r][k][s] > 0])
    racks = [(r, k, f"_rack_{i}") for i, (r, k) in enumerate((r, k) for r in tree for k in tree[r])]
    racks = [(r, k, n) for r, k, n in racks if any(w > 0 for w in tree[r][k].values())]
    out = out.select("*", *[_least([F.col(names[r, k, s]) for s, w in tree[r][k].items() if w > 0]).alias(n) for r, k, n in racks])
    regions = [(r, f"_region_{i}") for i, r in enumerate(dict.fromkeys(r for r, _, _ in racks))]
    out = out.select("*", *[_least([F.col(n) for q, _, n in racks if q == r]).alias(name) for r, name in regions])
    chosen = _descend([(F.col(name), _descend([
        (F.col(n), _descend([(F.col(names[r, k, s]), F.lit(s)) for s, w in tree[r][k].items() if w > 0]))
        for q, k, n in racks if q == r])) for r, name in regions])
    return out.select(*[f"`{c}`" for c in kept], chosen.alias(output))


def number_slots(placed: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """`placed` (shard, doc_id, text_crc32, …, stored) with `slot`: 0, 1, … within each shard.

    A shard is cut by a hash into blocks of about `rows_per_block` rows; a block is numbered by one task and starts where
    the blocks before it end.
    """
    largest = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    blocks = -(-largest // rows_per_block) or 1
    cut = placed.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)))
    sizes = cut.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32")) - 1
    return (cut.withColumn("_own", own).join(sizes, ["shard", "_block"])
            .withColumn("slot", (F.col("_base") + F.col("_own")).cast("long")).drop("_block", "_own", "_base"))


def shard_documents(docs: DataFrame, shards: int = 40, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (the shard if there were one more)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = place(place(rows, "doc_id", even_tree(shards)), "doc_id", even_tree(shards + 1), "grown_shard")
    return number_slots(materialize(placed, "placed"), rows_per_block).withColumn("law", F.lit("key"))


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """`row` (all columns of `docs`) below `path`, one folder `in_shard=…` per shard; no shuffle."""
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col("doc_id").alias("_key"))
    place(rows, "_key", even_tree(shards), "in_shard").select("row", "in_shard").write.partitionBy("in_shard").parquet(path)
