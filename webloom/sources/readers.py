"""Readers: page corpora, record tables, exported CSV/JSON files, sitemaps and robots files."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions import text
from webloom.session import scratch_path
from webloom.sources import splits


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages: url, html and whatever else was stored."""
    return spark.read.parquet(path)


def read_records(records: DataFrame, dataset_id: object, ordered: bool = True) -> DataFrame:
    """Records of one dataset (a partition filter on a table written by `write_records`)."""
    mine = records.where(F.col("dataset_id") == F.lit(dataset_id))
    return mine.orderBy("record_index") if ordered else mine


def decode_json(df: DataFrame, json_col: str, schema: T.StructType | str | None = None, alias: str = "data") -> DataFrame:
    """Add the decoded record: typed when a schema is given, VARIANT otherwise; bad JSON gives null."""
    value = F.from_json(json_col, schema) if schema is not None else F.try_parse_json(json_col)
    return df.withColumn(alias, value)


def read_exported_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header, quoted commas and line breaks; a byte-order mark is no part of the header.

    Large files are cut into records by many tasks (`sources.splits`).  The header is that of the first file by name; other
    files start with the same header, which is left out.
    """
    records = splits.csv_records(spark, path)
    head = records.where((F.col("start") == 0) & (F.col("n") == 0)).orderBy("file").limit(1).select("record").collect()
    if not head:
        return spark.createDataFrame([], T.StructType())
    names = next(csv.reader(io.StringIO(head[0]["record"].lstrip("\ufeff"))))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    body = records.where((F.col("start") > 0) | (F.col("n") > 0))
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    return body.select(F.from_csv("record", ", ".join(f"`{n.replace('`', '``')}` string" for n in schema.names), options).alias("r")).select("r.*")


def read_page_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Objects of JSON array files (or one object a file), typed by a schema or by what the objects hold.

    One array of any size is cut into its objects by many tasks (`sources.splits`); they are stored as lines once if the
    schema has to be found.
    """
    records = splits.json_records(spark, path).select("record")
    if schema is not None:
        return records.select(F.from_json("record", schema).alias("r")).select("r.*")
    lines = scratch_path(spark, "json-lines")
    records.write.text(lines)
    return spark.read.json(lines)


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path and body."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def sitemap_urls(candidates: DataFrame, site: str = "site", seq: str = "seq", most: int | None = None) -> DataFrame:
    """(site, position, url) from fetched sitemap candidates (site, seq, status, content_type, body).

    A candidate counts when its status is 200, it looks like XML and parses; those of a site (the first
    `most`, if given) are tried in order and the first that counts is read.  Namespaces are ignored.
    """
    looks = (F.lower("content_type").contains("xml") | F.col("body").contains("<urlset") | F.col("body").contains("<sitemapindex"))
    tried = candidates if most is None else candidates.where(F.col(seq) < most)
    good = tried.where((F.col("status") == 200) & looks
                            & _well_formed(F.col("body")))
    first = good.groupBy(site).agg(F.min_by("body", seq).alias("body"))
    read = F.regexp_replace("body", r"(?s)<!--.*?-->", "")
    locs = F.regexp_extract_all(read, F.lit(r"(?s)<(?:[\w.-]+:)?[\w.-]*loc(?:\s[^>]*)?>([^<]*)<"), F.lit(1))
    unescaped = lambda u: F.replace(F.replace(F.replace(u, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    kept = F.filter(F.transform(locs, lambda u: unescaped(text.strip(u))), lambda u: u.startswith("http"))
    rows = first.select(site, F.posexplode_outer(kept).alias("position", "url"))
    return rows.where(F.col("url").isNotNull())


def _well_formed(body: Column) -> Column:
    """Every element of the document is closed in turn, and all lie in a single root: a stack of names over the tags."""
    plain = F.regexp_replace(body, r"(?s)<\?.*?\?>|<!--.*?-->|<!\[CDATA\[.*?\]\]>|<![^>]*>", "")
    tags = F.regexp_extract_all(plain, F.lit(r"<(/?[A-Za-z_][^\s<>/]*(?:[^<>]*?/(?=>))?)[^<>]*>"), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(True).alias("fine"), F.lit(0).alias("roots"))

    def step(a: Column, tag: Column) -> Column:
        above = F.size(a["open"])
        closes, alone = tag.startswith("/"), tag.endswith("/")
        roots = a["roots"] + F.when(~closes & (above == 0), 1).otherwise(0)
        fits = (above > 0) & F.coalesce(F.get(a["open"], above - 1) == F.substring(tag, 2, 2**31 - 1), F.lit(False))
        left = F.when(closes, F.slice(a["open"], F.lit(1), F.greatest(above - 1, F.lit(0)))).when(alone, a["open"]).otherwise(F.array_append(a["open"], tag))
        return F.struct(left.alias("open"), (a["fine"] & (~closes | fits)).alias("fine"), roots.cast("int").alias("roots"))
    seen = F.aggregate(tags, start, step)
    return text.let(seen, lambda s: s["fine"] & (F.size(s["open"]) == 0) & (s["roots"] == 1)) & text.strip(plain).rlike(r"(?s)^<.*>$")
