"""Cleaning, scalar, hashing and set queries."""

from pyspark.sql import functions as F

from webloom.functions import cleaning as C
from webloom.functions import hashing as H
from webloom.operators import clean as clean_ops
from webloom.operators import identity
from webloom.operators.jobs import dataset_label, duration_seconds, field_label
from webloom.plans.registry import query, sql_normalize_url, sql_squeeze, table


@query("c01_trim", f"SELECT doc_id, {sql_squeeze('text')} AS v FROM documents")
def c01(spark, d):
    return table(spark, d, "documents").select("doc_id", C.trim(F.col("text")).alias("v"))


@query("c02_strip_html", "SELECT page_id, " + sql_squeeze("regexp_replace(html, '<[^>]+>', '', 'g')") + " AS v FROM pages")
def c02(spark, d):
    return table(spark, d, "pages").select("page_id", C.strip_html(F.col("html")).alias("v"))


@query("c03_to_lower", "SELECT doc_id, lower(text) AS v FROM documents")
def c03(spark, d):
    out = clean_ops.clean(table(spark, d, "documents"), [{"field_name": "text", "action": "to_lower"}])
    return out.select("doc_id", F.col("text").alias("v"))


@query("c04_to_upper", "SELECT p_partkey, upper(p_name) AS v FROM part")
def c04(spark, d):
    out = clean_ops.clean(table(spark, d, "part"), [{"field_name": "p_name", "action": "to_upper"}])
    return out.select("p_partkey", F.col("p_name").alias("v"))


@query("c05_to_int", """SELECT event_id, TRY_CAST(NULLIF(regexp_extract(replace(props, ',', ''), '([-+]?[0-9]+)', 1), '') AS BIGINT) AS from_json,
  TRY_CAST(NULLIF(regexp_extract(replace('USD -' || CAST(event_id AS VARCHAR) || ',000 each', ',', ''), '([-+]?[0-9]+)', 1), '') AS BIGINT) AS from_text,
  CAST(NULL AS BIGINT) AS from_words FROM events""")
def c05(spark, d):
    e = table(spark, d, "events")
    told = F.concat(F.lit("USD -"), F.col("event_id").cast("string"), F.lit(",000 each"))
    return e.select("event_id", C.to_int(F.col("props")).alias("from_json"), C.to_int(told).alias("from_text"),
                    C.to_int(F.col("event_type")).alias("from_words"))


@query("c06_to_float", """SELECT event_id, TRY_CAST(regexp_extract(replace('$ 1,' || CAST(value AS VARCHAR) || ' USD', ',', ''),
  '([-+]?[0-9]*\\.?[0-9]+)', 1) AS DOUBLE) AS v, value AS passed FROM events""")
def c06(spark, d):
    e = table(spark, d, "events")
    told = F.concat(F.lit("$ 1,"), F.col("value").cast("string"), F.lit(" USD"))
    out = clean_ops.clean(e.withColumn("passed", F.col("value")), [{"field_name": "passed", "action": "to_float"}])
    return out.select("event_id", C.to_float(told).alias("v"), "passed")


@query("c07_to_date", """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 8
    WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d')
    WHEN 3 THEN strftime(o_orderdate, '%B %d, %Y') WHEN 4 THEN strftime(o_orderdate, '%b %d, %Y') WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')
    WHEN 6 THEN 'on ' || strftime(o_orderdate, '%Y-%m-%d') || ' or so' ELSE ' ' || o_orderpriority || ' ' END AS raw, o_orderdate, o_orderpriority FROM orders)
  SELECT o_orderkey, raw, CASE WHEN o_orderkey % 8 = 7 THEN o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%d') END AS v FROM t""")
def c07(spark, d):
    o = table(spark, d, "orders")
    at, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    raw = (F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "dd/MM/yyyy"))
           .when(k == 2, F.date_format(at, "yyyy/MM/dd")).when(k == 3, F.date_format(at, "MMMM dd, yyyy"))
           .when(k == 4, F.date_format(at, "MMM dd, yyyy")).when(k == 5, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
           .when(k == 6, F.concat(F.lit("on "), F.date_format(at, "yyyy-MM-dd"), F.lit(" or so")))
           .otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" "))))
    return o.select("o_orderkey", raw.alias("raw")).select("o_orderkey", "raw", C.to_date(F.col("raw")).alias("v"))


@query("c08_normalize_url", f"SELECT page_id, {sql_normalize_url('url')} AS v FROM pages")
def c08(spark, d):
    out = clean_ops.clean(table(spark, d, "pages"), [{"field_name": "url", "action": "normalize_url"}])
    return out.select("page_id", F.col("url").alias("v"))


@query("c09_regex_replace", "SELECT p_partkey, regexp_replace(p_brand, '([A-Za-z]+)#([0-9]+)', '\\2-\\1$', 'g') AS v FROM part")
def c09(spark, d):
    rule = {"field_name": "p_brand", "action": "regex_replace", "params": {"pattern": r"(\w+)#(\d+)", "replacement": r"\2-\1$"}}
    return clean_ops.clean(table(spark, d, "part"), [rule]).select("p_partkey", F.col("p_brand").alias("v"))


@query("c10_clean_record", f"SELECT c_custkey, {sql_squeeze('c_name')} AS c_name, c_acctbal, c_nationkey, lower({sql_squeeze('c_mktsegment')}) AS c_mktsegment FROM customer")
def c10(spark, d):
    c = table(spark, d, "customer").withColumn("c_name", F.concat(F.lit("  "), F.col("c_name"), F.lit("\t ")))
    default = clean_ops.clean(c)
    ruled = clean_ops.clean(default, [{"field_name": "c_mktsegment", "action": "trim"},
                                      {"field_name": "c_mktsegment", "action": "to_lower"},
                                      {"field_name": "absent", "action": "to_int"}])
    return ruled.select("c_custkey", "c_name", "c_acctbal", "c_nationkey", "c_mktsegment")


@query("c11_reclean_dataset", f"""SELECT doc_id, {sql_squeeze('text')} AS text,
  sha256('{{"lang":"' || lang || '","source":"' || source || '"}}') AS content_hash FROM documents""")
def c11(spark, d):
    out = clean_ops.clean_and_fingerprint(table(spark, d, "documents"), ["lang", "source", "text"], None, ["source", "lang"])
    return out.select("doc_id", "text", "content_hash")


@query("f01_node_text", "SELECT doc_id, NULLIF(trim(lang || ' ' || source), '') AS v FROM documents")
def f01(spark, d):
    from webloom.functions.html import parse_html
    from webloom.functions.selectors import css, node_text
    doc = table(spark, d, "documents")
    html = F.concat(F.lit("<div> <b> "), F.col("lang"), F.lit(" </b><i></i>"), F.col("source"), F.lit("\n</div>"))
    nodes = doc.select("doc_id", parse_html(html).alias("n"))
    first = F.get(css("div", F.col("n")), F.lit(0))
    return nodes.select("doc_id", F.nullif(node_text(F.col("n"), first), F.lit("")).alias("v"))


@query("f02_truncate", "SELECT doc_id, substr(text, 1, 500) AS err, substr(text, 1, 120) AS name, substr(text, 1, 15000) AS preview FROM documents")
def f02(spark, d):
    cut = lambda n: F.substring("text", 1, n)
    return table(spark, d, "documents").select("doc_id", cut(500).alias("err"), cut(120).alias("name"), cut(15000).alias("preview"))


@query("f03_round", "SELECT l_returnflag, round(avg(l_quantity), 1) AS q1, round(sum(l_quantity) / count(*), 4) AS q4 FROM lineitem GROUP BY l_returnflag")
def f03(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.avg("l_quantity"), 1).alias("q1"), F.round(F.sum("l_quantity") / F.count("*"), 4).alias("q4"))


@query("f04_norm_and_clamp", "SELECT label, round(sqrt(sum(label * label)), 6) AS norm, greatest(0.0, least(1.0, round(avg(label) / 10, 6))) AS clamped FROM embeddings GROUP BY label")
def f04(spark, d):
    e = table(spark, d, "embeddings")
    return e.groupBy("label").agg(
        F.round(F.sqrt(F.sum(F.col("label") * F.col("label"))), 6).alias("norm"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.avg("label") / 10, 6))).alias("clamped"))


@query("f05_format_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso_z FROM events")
def f05(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso_z"))


@query("f06_duration", "SELECT user_id, round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 2) AS seconds FROM events GROUP BY user_id")
def f06(spark, d):
    spans = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select("user_id", duration_seconds(F.col("a"), F.col("b")).alias("seconds"))


@query("f07_add_minutes", "SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 90 AS BIGINT)) AS v FROM orders")
def f07(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.timestamp_add(
        "MINUTE", (F.col("o_orderkey") % 90).cast("int"), F.col("o_orderdate")).alias("v"))


@query("f08_arrays", """WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)
  SELECT doc_id, array_to_string(ws[1:5], '; ') AS head, CAST(len(ws) AS INTEGER) AS n, CAST(len(list_distinct(ws)) AS INTEGER) AS n_distinct,
  list_sort(ws)[1] AS smallest, CAST(len(flatten([ws, ws])) AS INTEGER) AS n_flat FROM w""")
def f08(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("ws"))
    return w.select("doc_id", F.array_join(F.slice("ws", 1, 5), "; ").alias("head"), F.size("ws").alias("n"),
                    F.size(identity.distinct_values(F.col("ws"))).alias("n_distinct"), F.get(F.sort_array("ws"), F.lit(0)).alias("smallest"),
                    F.size(F.flatten(F.array("ws", "ws"))).alias("n_flat"))


@query("f09_maps", "SELECT event_id, event_type AS kept, CAST(user_id AS VARCHAR) AS merged, 'none' AS missing, 1 AS n FROM events")
def f09(spark, d):
    e = table(spark, d, "events").select("event_id", F.create_map(F.lit("type"), F.col("event_type")).alias("a"),
                                         F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("b"))
    m = e.select("event_id", F.map_concat("a", "b").alias("m"))
    return m.select("event_id", F.element_at("m", F.lit("type")).alias("kept"), F.element_at("m", F.lit("user")).alias("merged"),
                    F.coalesce(F.element_at("m", F.lit("nope")), F.lit("none")).alias("missing"),
                    F.size(F.map_filter("m", lambda k, v: k != "type")).alias("n"))


@query("f10_json", """SELECT event_id, '{"props":' || replace(props, ' ', '') || ',"user":' || CAST(user_id AS VARCHAR) || '}' AS encoded,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def f10(spark, d):
    e = table(spark, d, "events")
    row = F.struct(F.from_json("props", "k bigint").alias("props"), F.col("user_id").alias("user"))
    return e.select("event_id", F.to_json(row).alias("encoded"), F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("f11_string_tests", "SELECT page_id, contains(url, 'utm_') AS has, starts_with(url, 'https') AS pre, ends_with(url, '.html') AS post FROM pages")
def f11(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", u.contains("utm_").alias("has"), u.startswith("https").alias("pre"), u.endswith(".html").alias("post"))


@query("f12_labels", """SELECT o_orderkey, 'Dataset - ' || o_orderpriority || ' (' || strftime(o_orderdate, '%Y-%m-%d %H:%M') || ')' AS label,
  replace(lower(o_orderpriority), ' ', '_') AS field FROM orders""")
def f12(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", dataset_label(F.col("o_orderpriority"), F.col("o_orderdate")).alias("label"), field_label(F.col("o_orderpriority")).alias("field"))


@query("h01_content_hash", """SELECT c_custkey, sha256('{"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') AS whole,
  sha256('{"c_name":"' || c_name || '"}') AS by_key FROM customer""")
def h01(spark, d):
    cols = ["c_name", "c_custkey", "c_mktsegment"]
    return table(spark, d, "customer").select("c_custkey", H.content_hash(cols).alias("whole"), H.content_hash(cols, ["c_name", "absent"]).alias("by_key"))


@query("h01_json_hash", """SELECT event_id, sha256('{"a":{"x":1,"y":' || CAST(user_id AS VARCHAR) || '},"b":"' || event_type || '"}') AS v FROM events""")
def h01_json(spark, d):
    raw = F.concat(F.lit('{"b": "'), F.col("event_type"), F.lit('", "a": {"y": '), F.col("user_id").cast("string"), F.lit(', "x": 1}}'))
    return table(spark, d, "events").select("event_id", H.json_hash(raw).alias("v"))


@query("h02_page_hash", """SELECT page_id, sha256(url || '{"page_id":' || CAST(page_id AS VARCHAR) || ',"url":"' || url || '"}') AS v FROM pages""")
def h02(spark, d):
    return table(spark, d, "pages").select("page_id", H.page_hash(F.col("url"), H.canonical_json(["url", "page_id"])).alias("v"))


@query("h03_text_hash", "SELECT doc_id, sha256(text) AS v FROM documents")
def h03(spark, d):
    return table(spark, d, "documents").select("doc_id", H.text_hash(F.col("text")).alias("v"))


@query("h04_deduplicate", "SELECT min(doc_id) AS doc_id, text, lang, source FROM documents GROUP BY text, lang, source")
def h04(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return identity.deduplicate(docs, order_col="doc_id")


@query("h04_deduplicate_by_key", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def h04_key(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return identity.deduplicate(e, ["event_type", "user_id"], "event_id").select("event_id", "user_id", "event_type")


@query("h04_deduplicate_json", "SELECT min(event_id) AS event_id, props FROM events GROUP BY props")
def h04_json(spark, d):
    e = table(spark, d, "events").select("event_id", "props")
    return identity.deduplicate(e, order_col="event_id", identity=H.json_hash(F.col("props")))


@query("h04_duplicate_count", "SELECT count(*) AS total_records, count(DISTINCT text) AS unique_records, count(*) - count(DISTINCT text) AS duplicate_records FROM documents")
def h04_count(spark, d):
    return identity.duplicate_count(table(spark, d, "documents"), ["text"])


@query("h05_ordered_distinct", """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS v, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents),
  f AS (SELECT doc_id, v, min(p) AS p FROM w GROUP BY doc_id, v)
  SELECT doc_id, string_agg(v, ' ' ORDER BY p) AS v FROM f GROUP BY doc_id""")
def h05(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(identity.distinct_values(F.split("text", " ")), " ").alias("v"))


@query("h06_key_union", """WITH k AS (SELECT event_id, unnest(CASE WHEN event_id % 3 = 0 THEN ['k', 'late_' || (event_id % 2)] ELSE ['k'] END) AS field,
    unnest(CASE WHEN event_id % 3 = 0 THEN [0, 1] ELSE [0] END) AS p FROM events)
  SELECT field, min(event_id) AS first_record, CAST(arg_min(p, event_id) AS INTEGER) AS first_place FROM k GROUP BY field""")
def h06(spark, d):
    e = table(spark, d, "events")
    more = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "late_'), (F.col("event_id") % 2).cast("string"), F.lit('": null}'))
    return identity.json_keys(e.withColumn("data", F.when(F.col("event_id") % 3 == 0, more).otherwise(F.col("props"))), "data", "event_id")


@query("h07_key_sets", """WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
  SELECT coalesce(o.k, n.k) AS o_custkey, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'matched' END AS key_status FROM o FULL JOIN n ON o.k = n.k""")
def h07(spark, d):
    o = table(spark, d, "orders")
    return identity.key_sets(o.where("o_orderstatus = 'F'"), o.where("o_orderpriority = '1-URGENT'"), ["o_custkey"])


@query("h08_union_distinct", "SELECT lang AS v FROM documents UNION SELECT source FROM documents UNION SELECT event_type FROM events")
def h08(spark, d):
    docs, e = table(spark, d, "documents"), table(spark, d, "events")
    return identity.union_distinct(docs.select(F.col("lang").alias("v")), docs.select(F.col("source").alias("v")), e.select(F.col("event_type").alias("v")))


@query("ud4_registered_action", "SELECT p_partkey, reverse(p_name) AS v FROM part")
def ud4(spark, d):
    C.register_action("mirror", F.reverse)
    return clean_ops.clean(table(spark, d, "part"), [{"field_name": "p_name", "action": "mirror"}]).select("p_partkey", F.col("p_name").alias("v"))




@query("c05_to_int_of_large_doubles", "SELECT o_orderkey, CAST(trunc(o_totalprice * 100000) AS BIGINT) AS whole FROM orders")
def c05_doubles(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 100000).alias("v"))
    return o.select("o_orderkey", C.apply_action(F.col("v"), o.schema["v"].dataType, "to_int").alias("whole"))
