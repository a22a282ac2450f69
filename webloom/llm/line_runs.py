"""Deletes later copies of repeated line runs, found by a suffix array over line ids, all in DataFrame operations.

A document is its sequence of lines with a word.  A place (document, line) is one number whose order is that of doc_id, then
of lines.  The suffix array is built by prefix doubling: at level k all suffixes with equal first 2^k lines
share a rank, and the rank is the first place of the class; level k + 1 ranks the pairs of ranks at a place and 2^k
lines on.  A class of two or more suffixes is an interval of the suffix array whose longest common prefix has 2^k
lines at least; suffixes alone in their class have left all longer intervals and are not carried on, so the levels
end with the longest repeated run.  A suffix whose rank lies before its own place repeats an earlier run: its
lines are a later copy.  A run counts from `min_lines` lines on, or with fewer lines (1, 2, 4, …) if they have
`min_words` words together, so a long line or a footer line counts by itself and a brace or a short heading does not.

A place has 31 bits for the line, more than the lines any string can hold.

Edge cases: lines without a word are never counted nor deleted; null and empty texts have no lines and stay as they are
(kept text: empty); rows equal in doc_id and text are one document; null doc_ids come last in the order of copies; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import materialize, release

MIN_LINES, MIN_WORDS = 3, 5
_PLACE = "decimal(38,0)"
_LINE_BITS = 31         # a string has fewer than 2^31 bytes
_WORD = "[^\\x20\\x09-\\x0D]"


# A unit is a line with a word and the lines without one that follow it; the first unit may hold leading ones alone.
_UNIT = "\\n(?=[\\x20\\x09\\x0B-\\x0D]*[^\\x20\\x09-\\x0D])"


def _has_word(line: Column) -> Column:
    return line.rlike(_WORD)


def _text(of: str = "") -> Column:
    return F.coalesce(F.col(f"{of}text").cast("string"), F.lit(""))


def _document(of: str = "") -> Column:
    """The place before a document's first line."""
    order = F.coalesce(F.col(f"{of}doc_id").cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)"))
    tie = (F.crc32(_text(of).cast("binary")) * F.lit(1 << _LINE_BITS)).cast("decimal(19,0)")
    return (order * F.lit(str(1 << (32 + _LINE_BITS))).cast("decimal(19,0)") + tie).cast(_PLACE)


def _units(rows: DataFrame, of: str = "") -> DataFrame:
    """`rows` with `_units` and `_lead` (units before the first word)."""
    units = rows.withColumn("_units", F.split(_text(of), _UNIT))
    return units.withColumn("_lead", F.when(_has_word(F.col("_units")[0]), 0).otherwise(1))


def _places(docs: DataFrame) -> DataFrame:
    """place, line id (128 bits) and number of words of every line with a word."""
    lines = F.transform(F.expr("slice(_units, _lead + 1, size(_units))"), lambda u: F.substring_index(u, "\n", 1))
    rows = _units(docs.select("doc_id", "text", _document().alias("_document"))).select("_document", F.posexplode(lines).alias("at", "line"))
    return rows.select((F.col("_document") + F.col("at")).cast(_PLACE).alias("place"), F.xxhash64("line").alias("a"),
                       F.xxhash64(F.lit(17), "line").alias("b"), F.regexp_count("line", F.lit(f"{_WORD}+")).alias("words"))


def _ranked(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """(place, rank, words) of the rows of `keyed` (place, words, *keys) whose keys occur more than once.

    The classes are counted with partial aggregates and stored, so the join back has a plain table on either side and can
    split a class that holds a large part of all rows.
    """
    classes = materialize(keyed.groupBy(*keys).agg(F.min("place").alias("rank"), F.max("place").alias("last")).where("rank < last").drop("last"), "classes")
    found = materialize(keyed.join(classes, keys).select("place", "rank", "words"), "ranks")
    release(classes)
    return found


def _pairs(ranks: DataFrame, step: int) -> DataFrame:
    """Ranks at a place and `step` lines on, where both are repeated, with the words of both."""
    later = ranks.select((F.col("place") - step).cast(_PLACE).alias("place"), F.col("rank").alias("rank_b"), F.col("words").alias("words_b"))
    own = ranks.select("place", F.col("rank").alias("rank_a"), F.col("words").alias("words_a"))
    return own.join(later, "place").select("place", "rank_a", "rank_b", (F.col("words_a") + F.col("words_b")).alias("words"))


def repeated_suffixes(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(place, length): a run of `length` lines at `place` has a copy that starts at an earlier place.

    Each place comes once per level that it reaches: 1, 2, 4, … lines with `min_words` words below `min_lines`,
    `min_lines` itself, and the powers of two above it.
    """
    lines = materialize(_places(docs), "lines")
    ranks = _ranked(lines, ["a", "b"])
    release(lines)
    length, levels, done = 1, [], False
    while not done:
        if length < min_lines:
            levels.append(ranks.where("rank < place").where(F.col("words") >= min_words).select("place", F.lit(length).alias("length")))
        if length <= min_lines < 2 * length:
            # a run of min_lines lines is two runs of 2^k lines that may overlap
            shift = min_lines - length
            own = ranks
            if shift:
                pairs = materialize(_pairs(ranks, shift), "pairs")
                own = _ranked(pairs, ["rank_a", "rank_b"])
                release(pairs)
            levels.append(own.where("rank < place").select("place", F.lit(min_lines).alias("length")))
        elif length > min_lines:
            levels.append(ranks.where("rank < place").select("place", F.lit(length).alias("length")))
        pairs = materialize(_pairs(ranks, length), "pairs")
        done = pairs.isEmpty() and length >= min_lines
        if not done:
            ranks = _ranked(pairs, ["rank_a", "rank_b"])
            length *= 2
        release(pairs)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def delete_later_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """`row` (all columns of `docs`, as a struct), `kept_text`, `n_lines`, `n_removed` and `run_scale`.

    `run_scale` is the longest level (see `repeated_suffixes`) at which a run of this document copies an earlier one; 0 if
    none does.
    """
    one = F.lit(1 << _LINE_BITS).cast("decimal(17,0)")
    runs = repeated_suffixes(docs, min_lines, min_words).withColumn("at", F.pmod("place", one).cast("int"))
    runs = runs.withColumn("_document", (F.col("place") - F.col("at")).cast(_PLACE)).drop("place")
    # Overlapping runs become one stretch.  What a document gathers is bounded by its own lines.
    along = Window.partitionBy("_document").orderBy("at", "length")
    opens = F.when(F.col("at") <= F.max(F.col("at") + F.col("length")).over(along.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    stretches = (runs.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(along))
                 .groupBy("_document", "stretch").agg(F.min("at").alias("a"), F.max(F.col("at") + F.col("length")).alias("b"), F.max("length").alias("scale"))
                 .groupBy("_document").agg(F.collect_list(F.struct("a", "b")).alias("_gone"), F.max("scale").alias("_scale")))
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row")).select("row", _document("row.").alias("_document"))
    # The stretches grow with the corpus, so they are never broadcast; each text moves once.
    joined = _units(rows.join(materialize(stretches, "stretches").hint("merge"), "_document", "left"), "row.")
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    joined = joined.withColumn("_gone", F.coalesce("_gone", none))
    kept = F.filter("_units", lambda u, i: ~F.exists("_gone", lambda g: (i - F.col("_lead") >= g["a"]) & (i - F.col("_lead") < g["b"])))
    removed = F.aggregate("_gone", F.lit(0), lambda n, g: n + g["b"] - g["a"]).cast("long")
    return joined.select("row", F.array_join(kept, "\n").alias("kept_text"),
                         (F.size("_units") - F.col("_lead")).cast("long").alias("n_lines"), removed.alias("n_removed"),
                         F.coalesce("_scale", F.lit(0)).alias("run_scale"))
