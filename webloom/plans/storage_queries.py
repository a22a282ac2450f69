"""Reading and writing queries: each writes into the scratch folder and reads the result back."""

from pyspark.sql import functions as F

from webloom.operators import chunks as G
from webloom.plans.dataset_queries import _CHUNKS_SQL
from webloom.plans.registry import query, table
from webloom.session import scratch_path
from webloom.sources import readers, writers


@query("src2_read_records", "SELECT o_orderkey AS record_index, o_custkey FROM orders WHERE o_orderstatus = 'P'")
def src2(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("dataset_id"), F.col("o_orderkey").alias("record_index"), "o_custkey")
    return readers.read_records(o, "P").select("record_index", "o_custkey")


@query("src3_decode_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, true AS same FROM events")
def src3(spark, d):
    typed = readers.decode_json(table(spark, d, "events"), "props", "k bigint")
    both = readers.decode_json(typed, "props", alias="free")
    return both.select("event_id", "data.k", (F.try_variant_get("free", "$.k", "bigint") == F.col("data.k")).alias("same"))


_LINES = "regexp_replace(text, '[.] ', chr(10), 'g')"


@query("src6_exported_csv", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256({_LINES}) AS text_sha256, lang FROM documents")
def src6(spark, d):
    """Texts with line breaks, commas and quotes inside the quotes."""
    path = scratch_path(spark, "csv")
    doc = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[.] ", "\n").alias("text"), "lang")
    writers.write_csv(doc, path, legacy=True)
    back = readers.read_exported_csv(spark, path)
    return back.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "lang")


@query("src7_json_array_file", "SELECT doc_id, sha256(text) AS text_sha256, lang, n_chars FROM documents")
def src7(spark, d):
    """Each task's rows become one array file; the arrays are cut again by splits of the files."""
    doc, path = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars"), scratch_path(spark, "arrays")
    writers.write_json_arrays(doc, path)
    back = readers.read_page_json(spark, path, doc.schema)
    return back.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "lang", "n_chars")


@query("snk1_jsonl_export", "SELECT doc_id, lang, text, source AS _source_url FROM documents")
def snk1(spark, d):
    path = scratch_path(spark, "jsonl")
    rows = writers.export_rows(table(spark, d, "documents"), ["doc_id", "lang", "text"], "source")
    writers.write_jsonl(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("snk2_json_array", """SELECT c_custkey, c_name, (row_number() OVER (ORDER BY c_custkey) - 1) // 400 AS array_no FROM customer""")
def snk2(spark, d):
    arrays = writers.json_arrays(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", per_array=400)
    return arrays.select("array_no", F.inline(F.from_json("json", "array<struct<c_custkey:bigint,c_name:string>>")))


@query("snk3_csv_rows", """SELECT event_id, event_type || '; ' || user_id AS tags, '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS data FROM events""")
def snk3(spark, d):
    e = table(spark, d, "events").select("event_id", F.array("event_type", F.col("user_id").cast("string")).alias("tags"), F.from_json("props", "k bigint").alias("data"))
    return writers.csv_rows(e)


@query("snk4_legacy_csv_rows", """SELECT event_id, '["' || event_type || '","' || user_id || '"]' AS tags, '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS data FROM events""")
def snk4(spark, d):
    e = table(spark, d, "events").select("event_id", F.array("event_type", F.col("user_id").cast("string")).alias("tags"), F.from_json("props", "k bigint").alias("data"))
    return writers.csv_rows(e, legacy=True)


def _written_chunks(spark, d):
    made = G.chunk(table(spark, d, "documents"), F.col("text"), F.col("doc_id"), F.col("source"), set_id="docs")
    path = scratch_path(spark, "chunks")
    rows = writers.chunk_documents(made)
    writers.write_jsonl(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("snk5_all_chunks", f"""WITH {_CHUNKS_SQL} SELECT sha256('docs/' || chunk_id) AS id, chunk_index, source AS source_url, 'docs' AS pipeline_id,
  sha256(text_content) AS content_hash, sha256(text_content) AS text_sha256 FROM c""")
def snk5_all(spark, d):
    return _written_chunks(spark, d).select("id", "metadata.chunk_index", "metadata.source_url", "metadata.pipeline_id", "metadata.content_hash",
                                            F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("snk6_insert_or_ignore", """WITH o AS (SELECT DISTINCT user_id, event_type FROM events WHERE value < 20)
  SELECT min(event_id) AS event_id, user_id, event_type FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM o) GROUP BY user_id, event_type""")
def snk6(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    stored = writers.new_records(e.where("value < 20"), None, ["user_id", "event_type"], "event_id")
    return writers.new_records(e, stored, ["user_id", "event_type"], "event_id").select("event_id", "user_id", "event_type")


@query("snk7_record_table", "SELECT o_orderstatus AS dataset_id, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY o_orderstatus")
def snk7(spark, d):
    path = scratch_path(spark, "records")
    o = table(spark, d, "orders")
    writers.write_records(o.select(F.col("o_orderstatus").alias("dataset_id"), F.col("o_orderkey").alias("record_index"),
                                   F.lit("u").alias("source_url"), F.to_json(F.struct("o_custkey")).alias("raw_data")), path)
    return spark.read.parquet(path).groupBy("dataset_id").agg(F.count("*").alias("n"), F.min("record_index").alias("first"), F.max("record_index").alias("last"))


@query("snk8_page_rows", """SELECT lang AS title, source AS url, text, lang || ' | ' || source AS links, CAST(doc_id AS VARCHAR) AS scraped_at FROM documents""")
def snk8(spark, d):
    doc = table(spark, d, "documents").select(F.col("lang").alias("title"), F.col("source").alias("url"), "text", F.array("lang", "source").alias("links"),
                                              F.col("doc_id").cast("string").alias("scraped_at"))
    path = scratch_path(spark, "pages")
    writers.write_pages(doc, path)
    return spark.read.option("mergeSchema", "true").parquet(path).drop("data")
