"""Whole flows, composed from the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.hashing import content_hash
from webloom.model import CleanerRule, SelectorRule
from webloom.operators import chunks, extraction, quality
from webloom.operators.clean import clean
from webloom.plans.registry import table


def page_records(pages: DataFrame, rules: Iterable[SelectorRule | dict],
                 cleaners: Iterable[CleanerRule | dict] | None = None) -> DataFrame:
    """Pages to cleaned, fingerprinted records: url, one column per rule, content_hash.  Pages without
    data (failed ones) give no record."""
    rules = list(rules)
    found = extraction.extract(pages, rules).where(F.col("data").isNotNull())
    fields = found.schema["data"].dataType.fieldNames()
    cleaned = clean(found.select("url", "data.*"), cleaners) if cleaners else _trim(found.select("url", "data.*"), fields)
    return cleaned.withColumn("content_hash", content_hash(fields))


def _trim(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return clean(df, [CleanerRule(f, "trim") for f in fields if kinds[f] == "string"])


def score_page_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Titles by plain pattern, normalised urls, default cleaning, fingerprints, quality report."""
    pages = table(spark, folder, "pages")
    title = F.nullif(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.lit(""))
    records = clean(pages.select(urls.normalize_url(F.col("url")).alias("url"), title.alias("title")))
    return quality.quality_report(records)


def corpus_to_chunks(pages: DataFrame, size: int = chunks.CHUNK_SIZE, overlap: int = chunks.CHUNK_OVERLAP,
                     set_id: str = "default") -> DataFrame:
    """Pages to retrieval chunks: title and main text of each page, cut into windows."""
    read = extraction.with_nodes(pages).select(
        F.col("url"), extraction.page_title(F.col("url")).alias("title"), extraction.main_text().alias("text"))
    return chunks.chunk_records(read, "url", "url", ["title", "text"], size, overlap, set_id)
