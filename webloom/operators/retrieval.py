"""Term-frequency cosine retrieval over chunks.

A chunk's term counts come from sorting its tokens inside the row, so building vectors needs no
shuffle.  One query is a projection plus top-k.  Many queries, or queries over a stored index, take the
posting lists of `operators.postings`.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text

MIN_SCORE = 0.01
TOP_K = 5


def term_counts(body: Column) -> Column:
    """ARRAY<STRUCT<term, n>> in term order: run lengths of the sorted tokens."""
    def runs(sorted_tokens: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(sorted_tokens) - 1)
        first = F.filter(places, lambda i: (i == 0) | (F.get(sorted_tokens, i) != F.get(sorted_tokens, i - 1)))
        return text.let(first, lambda starts: F.transform(starts, lambda p, j: F.struct(
            F.get(sorted_tokens, p).alias("term"),
            (F.coalesce(F.get(starts, j + 1), F.size(sorted_tokens)) - p).alias("n"))))
    none = F.array().cast("array<struct<term:string,n:int>>")
    return text.let(F.sort_array(text.tokens(body)), lambda t: F.when(F.size(t) > 0, runs(t)).otherwise(none))


def vector_norm(counts: Column) -> Column:
    squares = F.aggregate(counts, F.lit(0.0), lambda acc, t: acc + t["n"] * t["n"])
    return F.sqrt(squares)


def term_vectors(df: DataFrame, id_col: str, body: str) -> DataFrame:
    """Long form (id, term, weight) of the L2-normalised term frequencies; empty texts have no rows."""
    counted = df.select(id_col, term_counts(F.col(body)).alias("_t"))
    normed = counted.select(id_col, "_t", vector_norm(F.col("_t")).alias("_norm"))
    rows = normed.select(id_col, "_norm", F.inline_outer("_t")).where(F.col("term").isNotNull())
    return rows.select(id_col, "term", (F.col("n") / F.col("_norm")).alias("weight"))


def cosine(left: Column, right: Column) -> Column:
    """Similarity of two MAP<term, weight> vectors, kept within [0, 1]; 0 when one is empty."""
    dot = F.aggregate(F.map_entries(left), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(
        F.element_at(right, e["key"]), F.lit(0.0)))
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot)), F.lit(0.0))


def term_map(body: Column) -> Column:
    """The normalised vector of a text as MAP<term, weight>."""
    return text.let(term_counts(body), lambda t: text.let(vector_norm(t), lambda norm: F.map_from_entries(
        F.transform(t, lambda x: F.struct(x["term"], x["n"] / norm)))))


def search(chunks: DataFrame, query: str, k: int = TOP_K, id_col: str = "chunk_id",
           body: str = "text_content") -> DataFrame:
    """Best k chunks for one query: scored while scanning, then TakeOrdered."""
    counts = Counter(text.tokenize(query))
    norm = math.sqrt(sum(n * n for n in counts.values()))
    if not counts:
        return chunks.limit(0).withColumn("similarity_score", F.lit(None).cast("double"))
    weights = F.create_map(*[F.lit(x) for term, n in sorted(counts.items()) for x in (term, n / norm)])

    def score(t: Column) -> Column:
        hits = F.filter(t, lambda x: x["term"].isin(*sorted(counts)))
        dot = F.aggregate(hits, F.lit(0.0), lambda acc, x: acc + x["n"] * F.element_at(weights, x["term"]))
        cos = F.when(F.size(t) > 0, F.least(F.lit(1.0), dot / vector_norm(t)))
        return text.let(cos, lambda s: F.when(s > MIN_SCORE, F.round(s, 4)))
    # Too weak scores are null and sort last; a filter before the limit would score every row twice.
    scored = chunks.withColumn("similarity_score", text.let(term_counts(F.col(body)), score))
    best = scored.orderBy(F.desc_nulls_last("similarity_score"), id_col).limit(k)
    return best.where(F.col("similarity_score").isNotNull())
