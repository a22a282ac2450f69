"""Quality, change radar, chunking and retrieval queries."""

from pyspark.sql import functions as F

from webloom.operators import chunks as G
from webloom.operators import clean as clean_ops
from webloom.operators import postings
from webloom.operators import quality as Q
from webloom.operators import radar as R
from webloom.operators import retrieval as S
from webloom.plans import derived
from webloom.plans.registry import RE2_SPACE, RE2_TOKEN, query, table
from webloom.session import scratch_path
from webloom.sources.writers import write_records


# Customers under field names that carry hints, with gaps: some urls relative, some names empty.
_HINTED_SQL = """(SELECT CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE 'https://x.example/' || c_name END AS home_url, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 6 = 0 THEN 'n/a' WHEN c_custkey % 6 = 1 THEN NULL ELSE '$ ' || c_nationkey END AS price, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'soon' END AS order_date,
  c_nationkey AS account, c_nationkey FROM customer)"""


def _hinted(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.when(k % 4 == 0, F.col("c_name")).otherwise(F.concat(F.lit("https://x.example/"), F.col("c_name"))).alias("home_url"),
        F.when(k % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(k % 6 == 0, "n/a").when(k % 6 == 1, None).otherwise(F.concat(F.lit("$ "), F.col("c_nationkey").cast("string"))).alias("price"),
        F.when(k % 7 == 0, None).otherwise("soon").alias("order_date"), F.col("c_nationkey").alias("account"), "c_nationkey")


_FIELDS = ["home_url", "segment", "price", "order_date", "account"]


def _quality_sql(source: str, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""WITH t AS (SELECT {head}count(*) AS n, 5 * count(*) AS cells,
  sum((coalesce(home_url, '') <> '')::INT + (coalesce(segment, '') <> '')::INT + (coalesce(price, '') <> '')::INT + (coalesce(order_date, '') <> '')::INT + (account IS NOT NULL)::INT) AS filled,
  sum((coalesce(home_url, '') LIKE 'http%')::INT + (coalesce(segment, '') <> '')::INT + (regexp_matches(coalesce(price, ''), '[0-9]'))::INT + (coalesce(order_date, '') <> '')::INT + (account IS NOT NULL)::INT) AS valid,
  count(DISTINCT (home_url, segment, price, order_date, account)) AS uniq FROM {source} {group})
  SELECT {head}round((0.40 * filled / cells + 0.35 * valid / filled + 0.25 * uniq / n) * 100, 1) AS overall_score, CAST(n AS BIGINT) AS total_records,
  CAST(n - uniq AS BIGINT) AS duplicate_records_count, CAST(cells - filled AS BIGINT) AS missing_required_count,
  round(100.0 * filled / cells, 1) AS completeness, round(100.0 * valid / filled, 1) AS validity, round(100.0 * uniq / n, 1) AS uniqueness, CAST(valid AS BIGINT) AS valid_cells FROM t"""


def _flat(report, *by):
    m = F.col("metrics")
    return report.select(*by, "overall_score", "total_records", "duplicate_records_count", "missing_required_count",
                         m[0]["score"].alias("completeness"), m[1]["score"].alias("validity"), m[2]["score"].alias("uniqueness"),
                         F.element_at(m[1]["details"], F.lit("valid_cells")).alias("valid_cells"))


_GRADED = "SELECT *, CASE WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 80 THEN 'B' WHEN overall_score >= 70 THEN 'C' WHEN overall_score >= 60 THEN 'D' ELSE 'F' END AS grade FROM ({})"


@query("q01_completeness", """SELECT CAST(sum((lang <> '')::INT + (source <> '')::INT + (text <> '')::INT + (n_chars IS NOT NULL)::INT) AS BIGINT) AS filled_cells, 4 * count(*) AS total_cells FROM documents""")
def q01(spark, d):
    rows = Q.metric_rows(Q.quality_report(table(spark, d, "documents").drop("doc_id")))
    get = lambda k: F.element_at("details", F.lit(k)).alias(k)
    return rows.where("metric_name = 'Completeness'").select(get("filled_cells"), get("total_cells"))


@query("q02_missing_required", f"SELECT CAST(sum((coalesce(segment, '') = '')::INT + (coalesce(price, '') = '')::INT) AS BIGINT) AS missing FROM {_HINTED_SQL}")
def q02(spark, d):
    report = Q.quality_report(_hinted(spark, d), ["segment", "price", "never_seen"], fields=_FIELDS)
    return report.select(F.col("missing_required_count").alias("missing"))


@query("q03_uniqueness", "SELECT count(*) AS total, count(DISTINCT (text, lang, source, n_chars)) AS uniq, count(*) - count(DISTINCT (text, lang, source, n_chars)) AS dup FROM documents")
def q03(spark, d):
    r = Q.quality_report(table(spark, d, "documents").drop("doc_id"))
    return r.select(F.col("total_records").alias("total"), (F.col("total_records") - F.col("duplicate_records_count")).alias("uniq"),
                    F.col("duplicate_records_count").alias("dup"))


@query("q04_validity", f"SELECT valid_cells, validity FROM ({_quality_sql(_HINTED_SQL)})")
def q04(spark, d):
    return _flat(Q.quality_report(_hinted(spark, d), fields=_FIELDS)).select("valid_cells", "validity")


@query("q05_overall_and_grade", _GRADED.format(_quality_sql(_HINTED_SQL)))
def q05(spark, d):
    report = Q.quality_report(_hinted(spark, d), fields=_FIELDS)
    return _flat(report).withColumn("grade", Q.grade_of(F.col("overall_score")))


@query("q06_metric_rows", """WITH t AS (SELECT count(*) AS n, count(DISTINCT (lang, source)) AS u FROM documents)
  SELECT 'Completeness' AS metric_name, 100.0 AS score, 0.4 AS weight, 2 * n AS a, 2 * n AS b FROM t UNION ALL SELECT 'Validity', 100.0, 0.35, 2 * n, 2 * n FROM t
  UNION ALL SELECT 'Uniqueness', round(100.0 * u / n, 1), 0.25, u, n - u FROM t""")
def q06(spark, d):
    rows = Q.metric_rows(Q.quality_report(table(spark, d, "documents").select("lang", "source")))
    pick = lambda *ks: F.coalesce(*[F.element_at("details", F.lit(k)) for k in ks])
    return rows.select("metric_name", "score", "weight", pick("filled_cells", "valid_cells", "unique_records").alias("a"),
                       pick("total_cells", "evaluated_cells", "duplicate_records").alias("b"))


@query("q07_empty_dataset", "SELECT 0.0 AS overall_score, 'F' AS grade, count(*) AS total_records, 0 AS n_metrics, 0 AS n_fields FROM documents WHERE lang = 'none'")
def q07(spark, d):
    r = Q.quality_report(table(spark, d, "documents").where("lang = 'none'"))
    return r.select("overall_score", "grade", "total_records", F.size("metrics").alias("n_metrics"), F.size("fields_evaluated").alias("n_fields"))


@query("q08_score_per_dataset", _GRADED.format(_quality_sql(_HINTED_SQL, "c_nationkey")))
def q08(spark, d):
    report = Q.quality_report(_hinted(spark, d), by=["c_nationkey"], fields=_FIELDS)
    return _flat(report, "c_nationkey").withColumn("grade", Q.grade_of(F.col("overall_score")))


@query("c11_recleaned_headers", "SELECT c_nationkey, total_records AS records, overall_score AS quality_score, grade FROM (" + _GRADED.format(_quality_sql(_HINTED_SQL, "c_nationkey")) + ")")
def c11_headers(spark, d):
    """Texts with blanks around them, cleaned, hashed and scored again per dataset."""
    raw = _hinted(spark, d).withColumns({c: F.concat(F.lit("  "), F.col(c), F.lit(" \t")) for c in ("home_url", "segment", "price", "order_date")})
    _, headers = clean_ops.reclean_datasets(raw, _FIELDS, keys=["home_url"], dataset_col="c_nationkey")
    return headers.withColumn("grade", Q.grade_of(F.col("quality_score")))


@query("q08_score_of_json_records", """WITH t AS (SELECT event_type, count(*) AS n, count(DISTINCT props) AS u FROM events GROUP BY event_type)
  SELECT event_type, round((0.4 * 0.5 + 0.35 + 0.25 * u / n) * 100, 1) AS overall_score, n AS missing, 'k,tags' AS fields FROM t""")
def q08_json(spark, d):
    data = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "tags": []}'))
    report = Q.quality_report_json(table(spark, d, "events").withColumn("data", data), "data", ["event_type"])
    return report.select("event_type", "overall_score", F.col("missing_required_count").alias("missing"), F.array_join("fields_evaluated", ",").alias("fields"))


_COMPARE = f"""WITH {derived.SNAPSHOTS_SQL}, j AS (SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, o.o_orderstatus AS old_status, n.o_orderstatus AS new_status,
  CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' WHEN o.o_orderstatus <> n.o_orderstatus THEN 'modified' ELSE 'unchanged' END AS change_type
  FROM old_s o FULL JOIN new_s n ON o.o_orderkey = n.o_orderkey)"""


def _changes(spark, d):
    old, new = derived.order_snapshots(spark, d)
    both = R.changes(old, new, ["o_orderkey"])
    return both.withColumn("o_orderkey", F.coalesce("new.o_orderkey", "old.o_orderkey"))


@query("r01_last_record_wins", """WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, min(event_id) AS position FROM events GROUP BY user_id)
  SELECT user_id, event_type, value, position, 'unchanged' AS change_type FROM l""")
def r01(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    c = R.changes(e, e, ["user_id"], "event_id")
    return c.select("new.user_id", "new.event_type", "new.value", "position", "change_type")


@query("r02_added_removed", _COMPARE + " SELECT o_orderkey, change_type FROM j WHERE change_type IN ('added', 'removed')")
def r02(spark, d):
    return _changes(spark, d).where("change_type IN ('added', 'removed')").select("o_orderkey", "change_type")


@query("r03_field_changes", _COMPARE + " SELECT o_orderkey, 'o_orderstatus' AS field, old_status AS old_value, new_status AS new_value FROM j WHERE change_type = 'modified'")
def r03(spark, d):
    return R.field_changes(_changes(spark, d), ["o_orderkey"])


@query("r03_json_record_changes", _COMPARE + """ SELECT o_orderkey, change_type, CASE WHEN change_type = 'modified' THEN '"' || old_status || '">"' || new_status || '"' END AS status_change,
  CASE change_type WHEN 'modified' THEN 'o_orderstatus' WHEN 'unchanged' THEN '' END AS fields FROM j""")
def r03_json(spark, d):
    old, new = derived.order_snapshots(spark, d)
    cols = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    as_json = lambda df, names: df.select("record_index", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("data"))
    c = R.changes_json(as_json(old.withColumn("gone", F.lit(None).cast("string")), cols + ["gone"]), as_json(new, cols), "data", ["o_orderkey"])
    status = F.element_at("changes", F.lit("o_orderstatus"))
    both = F.col("change_type").isin("modified", "unchanged")
    return c.select(F.get_json_object(F.coalesce("new", "old"), "$.o_orderkey").cast("bigint").alias("o_orderkey"), "change_type",
                    F.when(F.col("change_type") == "modified", F.concat(status["old"], F.lit(">"), status["new"])).alias("status_change"),
                    F.when(both, F.array_join(F.map_keys("changes"), ",")).alias("fields"))


@query("r04_change_summary", _COMPARE + """ SELECT (SELECT count(*) FROM old_s) AS total_old, (SELECT count(*) FROM new_s) AS total_new, count(*) FILTER (change_type = 'added') AS added_count,
  count(*) FILTER (change_type = 'removed') AS removed_count, count(*) FILTER (change_type = 'modified') AS modified_count, count(*) FILTER (change_type = 'unchanged') AS unchanged_count FROM j""")
def r04(spark, d):
    old, new = derived.order_snapshots(spark, d)
    return R.change_summary(old, new, ["o_orderkey"])


@query("r04_summary_without_keys", f"""WITH {derived.SNAPSHOTS_SQL}, o AS (SELECT DISTINCT * FROM old_s), n AS (SELECT DISTINCT * FROM new_s)
  SELECT (SELECT count(*) FROM old_s) AS total_old, (SELECT count(*) FROM new_s) AS total_new, (SELECT count(*) FROM (SELECT * FROM n EXCEPT SELECT * FROM o)) AS added_count,
  (SELECT count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM n)) AS removed_count, 0 AS modified_count, (SELECT count(*) FROM (SELECT * FROM o INTERSECT SELECT * FROM n)) AS unchanged_count""")
def r04_keyless(spark, d):
    return R.change_summary(*derived.order_snapshots(spark, d))


@query("r05_previews", _COMPARE + """, r AS (SELECT *, row_number() OVER (PARTITION BY change_type ORDER BY o_orderkey) AS preview_rank FROM j WHERE change_type <> 'unchanged')
  SELECT o_orderkey, change_type, preview_rank FROM r WHERE preview_rank <= 50""")
def r05(spark, d):
    shown = R.preview(R.changed(*derived.order_snapshots(spark, d), ["o_orderkey"]))
    return shown.select(F.coalesce("new.o_orderkey", "old.o_orderkey").alias("o_orderkey"), "change_type", "preview_rank")


@query("r03_changed_records", _COMPARE + """ SELECT o_orderkey, change_type, CASE WHEN change_type = 'modified' THEN old_status || '>' || new_status END AS status_change,
  old_status, new_status FROM j WHERE change_type <> 'unchanged'""")
def r03_changed(spark, d):
    c = R.changed(*derived.order_snapshots(spark, d), ["o_orderkey"])
    status = F.element_at("changes", F.lit("o_orderstatus"))
    return c.select(F.coalesce("new.o_orderkey", "old.o_orderkey").alias("o_orderkey"), "change_type", F.concat(status["old"], F.lit(">"), status["new"]).alias("status_change"),
                    F.col("old.o_orderstatus").alias("old_status"), F.col("new.o_orderstatus").alias("new_status"))


def _snapshot_records(spark, d):
    """Both snapshots in one record table."""
    old, new = derived.order_snapshots(spark, d)
    rows = lambda df, name: df.select(F.lit(name).alias("dataset_id"), "record_index", F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("cleaned_data"))
    path = scratch_path(spark, "records")
    write_records(rows(old, "old").unionByName(rows(new, "new")), path)
    return spark.read.parquet(path)


@query("r06_compare_stored_datasets", _COMPARE + """ SELECT (SELECT count(*) FROM old_s) AS total_old, (SELECT count(*) FROM new_s) AS total_new, count(*) FILTER (change_type = 'added') AS added_count,
  count(*) FILTER (change_type = 'removed') AS removed_count, count(*) FILTER (change_type = 'modified') AS modified_count, count(*) FILTER (change_type = 'unchanged') AS unchanged_count FROM j""")
def r06(spark, d):
    return R.compare_datasets(_snapshot_records(spark, d), "old", "new", keys=["o_orderkey"])[0]


@query("r06_stored_previews", _COMPARE + """, r AS (SELECT *, row_number() OVER (PARTITION BY change_type ORDER BY o_orderkey) AS preview_rank FROM j WHERE change_type <> 'unchanged')
  SELECT o_orderkey, change_type, preview_rank, CASE WHEN change_type = 'modified' THEN 'o_orderstatus: "' || old_status || '" > "' || new_status || '"' ELSE '' END AS fields FROM r WHERE preview_rank <= 50""")
def r06_previews(spark, d):
    shown = R.compare_datasets(_snapshot_records(spark, d), "old", "new", keys=["o_orderkey"])[1]
    said = F.transform(F.map_entries("changes"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]["old"], F.lit(" > "), e["value"]["new"]))
    return shown.select(F.get_json_object(F.coalesce("new", "old"), "$.o_orderkey").cast("bigint").alias("o_orderkey"), "change_type", "preview_rank",
                        F.when(F.col("change_type") == "modified", F.array_join(said, ", ")).otherwise("").alias("fields"))


_CHUNKS_SQL = f"""w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '{RE2_SPACE}+'), lambda x: x <> '') AS ws FROM documents),
  n AS (SELECT *, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 500 THEN 1 ELSE CAST(ceil((len(ws) - 500) / 450.0) AS BIGINT) + 1 END AS total_chunks FROM w),
  i AS (SELECT doc_id, source, ws, total_chunks, unnest(range(total_chunks)) AS chunk_index FROM n),
  c AS (SELECT doc_id || '/' || chunk_index AS chunk_id, doc_id, source, CAST(total_chunks AS INTEGER) AS total_chunks, CAST(chunk_index AS INTEGER) AS chunk_index,
    array_to_string(ws[chunk_index * 450 + 1 : chunk_index * 450 + 500], ' ') AS text_content FROM i)"""


def _chunks(spark, d):
    doc = table(spark, d, "documents")
    made = G.chunk(doc, F.col("text"), F.col("doc_id"), F.col("source"))
    return made.withColumn("chunk_id", F.concat_ws("/", "record_id", "chunk_index"))


@query("g01_record_text", "SELECT doc_id, 'text: ' || text || chr(10) || 'lang: ' || lang || chr(10) || 'tags: ' || lang || ', ' || source AS v FROM documents")
def g01(spark, d):
    doc = table(spark, d, "documents").withColumns({"blank": F.lit(""), "tags": F.array("lang", "source")})
    return doc.select("doc_id", G.record_text(doc, ["doc_id", "text", "lang", "n_chars", "blank", "tags"]).alias("v"))


@query("g02_word_windows", f"WITH {_CHUNKS_SQL} SELECT CAST(doc_id AS VARCHAR) AS record_id, chunk_index, text_content FROM c")
def g02(spark, d):
    return _chunks(spark, d).select("record_id", "chunk_index", "text_content")


@query("g03_chunk_provenance", f"WITH {_CHUNKS_SQL} SELECT CAST(doc_id AS VARCHAR) AS record_id, source AS source_url, chunk_index, total_chunks, sha256(text_content) AS content_hash FROM c")
def g03(spark, d):
    return _chunks(spark, d).select("record_id", "source_url", "chunk_index", "total_chunks", "content_hash")


@query("g04_chunk_set_totals", f"""WITH {_CHUNKS_SQL} SELECT source AS source_url, count(*) AS total_chunks, count(DISTINCT doc_id) AS records FROM c GROUP BY source""")
def g04(spark, d):
    return _chunks(spark, d).groupBy("source_url").agg(F.count("*").alias("total_chunks"), F.count_distinct("record_id").alias("records"))


@query("g05_tokens", f"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '{RE2_TOKEN}'), ' ') AS v FROM documents")
def g05(spark, d):
    from webloom.functions.text import tokens
    return table(spark, d, "documents").select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("v"))


_VECTORS_SQL = f"""t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{RE2_TOKEN}')) AS term FROM documents), k AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY doc_id, term)"""


@query("g06_term_vectors", f"WITH {_VECTORS_SQL} SELECT doc_id, term, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM k")
def g06(spark, d):
    v = S.term_vectors(table(spark, d, "documents"), "doc_id", "text")
    return v.select("doc_id", "term", F.round("weight", 6).alias("weight"))


_SCORES_SQL = f"""ct AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text_content), '{RE2_TOKEN}')) AS term FROM c), ck AS (SELECT chunk_id, term, count(*) AS n FROM ct GROUP BY chunk_id, term),
  cv AS (SELECT chunk_id, term, n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS w FROM ck),
  qt AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{RE2_TOKEN}')) AS term FROM benchmark), qk AS (SELECT item_id, term, count(*) AS n FROM qt GROUP BY item_id, term),
  qv AS (SELECT item_id, term, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS w FROM qk),
  s AS (SELECT item_id, chunk_id, sum(cv.w * qv.w) AS score FROM cv JOIN qv USING (term) GROUP BY item_id, chunk_id HAVING sum(cv.w * qv.w) > 0.01)"""


@query("g07_cosine_of_pairs", f"""WITH {_VECTORS_SQL}, v AS (SELECT doc_id, term, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS w FROM k)
  SELECT a.doc_id, round(greatest(0.0, least(1.0, coalesce((SELECT sum(x.w * y.w) FROM v x JOIN v y USING (term) WHERE x.doc_id = a.doc_id AND y.doc_id = b.doc_id), 0.0))), 4) AS v
  FROM labels a JOIN labels b ON b.doc_id = a.doc_id + 1""")
def g07(spark, d):
    vectors = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", S.term_map(F.col("text")).alias("a"))
    after = vectors.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return vectors.join(after, "doc_id").select("doc_id", F.round(S.cosine(F.col("a"), F.col("b")), 4).alias("v"))


_QUESTION = "The hand and the table are in the tether, nach der Zeit und élan"


@query("g08_search", f"""WITH {_CHUNKS_SQL}, ct AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text_content), '{RE2_TOKEN}')) AS term FROM c),
  ck AS (SELECT chunk_id, term, count(*) AS n FROM ct GROUP BY chunk_id, term), cv AS (SELECT chunk_id, term, n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS w FROM ck),
  qt AS (SELECT unnest(regexp_extract_all(lower('{_QUESTION}'), '{RE2_TOKEN}')) AS term), qk AS (SELECT term, count(*) AS n FROM qt GROUP BY term), qv AS (SELECT term, n / sqrt(sum(n * n) OVER ()) AS w FROM qk)
  SELECT chunk_id, round(sum(cv.w * qv.w), 4) AS similarity_score FROM cv JOIN qv USING (term) GROUP BY chunk_id HAVING sum(cv.w * qv.w) > 0.01 ORDER BY 2 DESC, 1 LIMIT 5""")
def g08(spark, d):
    return S.search(_chunks(spark, d), _QUESTION).select("chunk_id", "similarity_score")


@query("g08_search_stored_terms", f"""WITH {_VECTORS_SQL}, v AS (SELECT doc_id, term, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS w FROM k),
  qt AS (SELECT unnest(regexp_extract_all(lower('{_QUESTION}'), '{RE2_TOKEN}')) AS term), qk AS (SELECT term, count(*) AS n FROM qt GROUP BY term), qv AS (SELECT term, n / sqrt(sum(n * n) OVER ()) AS w FROM qk)
  SELECT doc_id, round(sum(v.w * qv.w), 4) AS similarity_score FROM v JOIN qv USING (term) GROUP BY doc_id HAVING sum(v.w * qv.w) > 0.01 ORDER BY 2 DESC, 1 LIMIT 5""")
def g08_terms(spark, d):
    path = scratch_path(spark, "terms")
    postings.write_index(table(spark, d, "documents"), path, id_col="doc_id", body="text")
    return postings.search_index(spark, path, _QUESTION, id_kind="bigint").withColumnRenamed("chunk_id", "doc_id")


@query("g09_search_batch", f"""WITH {_CHUNKS_SQL}, {_SCORES_SQL}, r AS (SELECT item_id AS query_id, chunk_id, round(score, 4) AS similarity_score,
  row_number() OVER (PARTITION BY item_id ORDER BY round(score, 4) DESC, chunk_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def g09(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return postings.search_batch(_chunks(spark, d), asked)
