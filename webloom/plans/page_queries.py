"""Page extraction queries: on the page corpus and on product pages derived from the parts."""

from pyspark.sql import functions as F

from webloom.model import SelectorRule
from webloom.operators import admission
from webloom.operators import extraction as X
from webloom.plans import derived
from webloom.plans.registry import query, sql_origin, sql_unescape, table

_TITLE = sql_unescape("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
_H1 = sql_unescape("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")
_HREFS = "list_transform(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), lambda h: " + sql_origin("url") + " || " + sql_unescape("h") + ")"
_PRODUCT = "'https://shop.example.com/p/' || p_partkey"


def _pages(spark, d):
    return table(spark, d, "pages")


def _products(spark, d):
    return X.with_nodes(derived.product_pages(spark, d))


@query("src1_read_pages", "SELECT page_id, url, length(html) AS n FROM pages")
def src1(spark, d):
    from webloom.sources.readers import read_pages
    return read_pages(spark, f"{d}/pages.parquet").select("page_id", "url", F.length("html").alias("n"))


@query("x01_meta_tags", """SELECT p_partkey, trim(p_name) || ' ' || p_partkey AS title, p_name || ' by ' || p_brand AS description, p_name AS og_title, p_brand AS author, 6 AS n FROM part""")
def x01(spark, d):
    m = _products(spark, d).select("p_partkey", X.meta_tags().alias("m"))
    get = lambda k: F.element_at("m", F.lit(k))
    return m.select("p_partkey", get("title").alias("title"), get("description").alias("description"), get("og:title").alias("og_title"),
                    get("author").alias("author"), F.size("m").alias("n"))


@query("x01_corpus_titles", f"SELECT page_id, trim({_TITLE}) AS title, 1 AS n FROM pages")
def x01_corpus(spark, d):
    m = X.with_nodes(_pages(spark, d)).select("page_id", X.meta_tags().alias("m"))
    return m.select("page_id", F.element_at("m", F.lit("title")).alias("title"), F.size("m").alias("n"))


@query("x02_page_title", f"SELECT page_id, coalesce(nullif(trim({_TITLE}), ''), nullif(trim({_H1}), ''), url) AS title FROM pages")
def x02(spark, d):
    return X.with_nodes(_pages(spark, d)).select("page_id", X.page_title(F.col("url")).alias("title"))


@query("x03_main_text", """SELECT p_partkey, p_name || chr(10) || 'Made by ' || p_brand || chr(10) || 'Brand' ||
  CASE WHEN p_brand = 'Brand' THEN '' ELSE chr(10) || p_brand END || chr(10) || 'Size' || chr(10) || CASE WHEN p_size > 9 THEN p_size || chr(10) ELSE '' END ||
  'Seller ' || (p_partkey % 7) || ' ' || (p_size * 3) || ' pieces' || chr(10) || 'Seller ' || (p_partkey % 5) || ' none' AS v FROM part""")
def x03(spark, d):
    return _products(spark, d).select("p_partkey", X.main_text().alias("v"))


@query("x03_corpus_text")
def x03_corpus(spark, d):
    return X.with_nodes(_pages(spark, d)).select("page_id", X.main_text().alias("v"))


@query("x04_json_ld", """SELECT p_partkey, '{"@type":"Product","name":"' || p_name || '","sku":' || p_partkey || '}' AS first, '{"brand":"' || p_brand || '"}' AS second,
  '{"size":' || p_size || '}' AS third, 3 AS n FROM part""")
def x04(spark, d):
    j = _products(spark, d).select("p_partkey", X.json_ld().alias("j"))
    return j.select("p_partkey", F.get("j", F.lit(0)).alias("first"), F.get("j", F.lit(1)).alias("second"), F.get("j", F.lit(2)).alias("third"), F.size("j").alias("n"))


@query("x05_links_all", f"WITH l AS (SELECT page_id, list_sort(list_distinct({_HREFS})) AS u FROM pages) SELECT page_id, unnest(u) AS link, unnest(range(len(u))) AS position FROM l")
def x05(spark, d):
    return X.link_rows(_pages(spark, d), "page_id")


@query("x06_links_clean", f"""WITH l AS (SELECT page_id, list_transform({_HREFS}, lambda x: string_split(x, '#')[1]) AS u FROM pages), e AS (SELECT page_id, unnest(u) AS link, generate_subscripts(u, 1) AS p FROM l),
  f AS (SELECT page_id, link, min(p) AS p FROM e GROUP BY page_id, link) SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS position FROM f""")
def x06(spark, d):
    return X.link_rows(_pages(spark, d), "page_id", legacy=True)


@query("x07_link_details", f"""SELECT p_partkey, 'Seller ' || (p_partkey % 7) AS text, 'https://shop.example.com/s/' || (p_partkey % 7) || '?p=1' AS url FROM part
  UNION ALL SELECT p_partkey, 'Seller ' || (p_partkey % 5), 'https://shop.example.com/p/s/' || (p_partkey % 5) FROM part
  UNION ALL SELECT p_partkey, 'more', {_PRODUCT} || '?page=' || (p_size + 1) FROM part""")
def x07(spark, d):
    return _products(spark, d).select("p_partkey", F.inline_outer(X.link_details(F.col("url"))))


@query("x08_images", """SELECT p_partkey, 'https://shop.example.com/img/' || p_partkey || '.png' AS url, trim(p_name) AS alt FROM part
  UNION ALL SELECT p_partkey, 'https://cdn.example.com/logo.gif', '' FROM part""")
def x08(spark, d):
    return _products(spark, d).select("p_partkey", F.inline_outer(X.images(F.col("url"))))


@query("x09_table_cells", """SELECT p_partkey, 0 AS table_index, CAST(r AS INTEGER) AS row_index, CAST(c AS INTEGER) AS cell_index,
  CASE WHEN r = 0 AND c = 0 THEN 'Brand' WHEN r = 0 THEN p_brand WHEN c = 0 THEN 'Size' ELSE CAST(p_size AS VARCHAR) END AS cell_text FROM part, range(2) AS a(r), range(2) AS b(c)""")
def x09(spark, d):
    return X.table_cells(_products(spark, d), "p_partkey")


@query("x10_headings", f"SELECT page_id, trim({_H1}) AS v FROM pages")
def x10(spark, d):
    return X.with_nodes(_pages(spark, d)).select("page_id", F.array_join(X.headings(), "|").alias("v"))


@query("x11_page_metadata", "SELECT p_partkey, p_name || ' by ' || p_brand AS description, p_type || ',' || p_size AS keywords, 'https://shop.example.com/p/' || p_partkey AS canonical FROM part")
def x11(spark, d):
    m = _products(spark, d).select("p_partkey", X.page_metadata(F.col("url")).alias("m"))
    return m.select("p_partkey", "m.description", "m.keywords", "m.canonical")


@query("x12_open_graph", "SELECT p_partkey, p_name AS title, p_type AS type, 2 AS n FROM part")
def x12(spark, d):
    g = _products(spark, d).select("p_partkey", X.page_metadata(F.col("url"))["open_graph"].alias("g"))
    return g.select("p_partkey", F.element_at("g", F.lit("title")).alias("title"), F.element_at("g", F.lit("type")).alias("type"), F.size("g").alias("n"))


@query("x13_structured_data", """SELECT p_partkey, '{"name":"' || p_name || '","sku":' || p_partkey || ',"@type":"Product"}' AS first, '{broken' AS last, 3 AS n FROM part""")
def x13(spark, d):
    s = _products(spark, d).select("p_partkey", X.structured_data().alias("s"))
    return s.select("p_partkey", F.get("s", F.lit(0)).alias("first"), F.get("s", F.lit(2)).alias("last"), F.size("s").alias("n"))


def _rule(rule, spark, d):
    value = X.rule_value(rule)
    return _products(spark, d).select("p_partkey", (F.array_join(value, "|") if rule.is_multiple else value).alias("v"))


@query("x14_css_single", "SELECT p_partkey, p_name AS v FROM part")
def x14(spark, d):
    return _rule(SelectorRule("v", "main > h1.name.big"), spark, d)


@query("x14_corpus_heading", f"SELECT page_id, trim({_H1}) AS v FROM pages")
def x14_corpus(spark, d):
    return X.extract(_pages(spark, d), [SelectorRule("v", "article h1")], ["page_id"]).select("page_id", "data.v")


@query("x15_css_multiple", "SELECT p_partkey, 'Seller ' || (p_partkey % 7) || ' ' || (p_size * 3) || ' pieces|Seller ' || (p_partkey % 5) || ' none' AS v FROM part")
def x15(spark, d):
    return _rule(SelectorRule("v", "ul li.offer", is_multiple=True), spark, d)


@query("x15_multiple_default", "SELECT p_partkey, 'n/a' AS v FROM part")
def x15_default(spark, d):
    return _rule(SelectorRule("v", ".absent", is_multiple=True, default_value="n/a"), spark, d)


@query("x16_xpath", "SELECT p_partkey, p_brand || '|' || p_size AS v FROM part")
def x16(spark, d):
    return _rule(SelectorRule("v", "//table//tr/td[1]", "xpath", is_multiple=True), spark, d)


@query("x16_xpath_attribute", "SELECT p_partkey, 'https://shop.example.com/s/' || (p_partkey % 7) || '?p=1' AS v FROM part")
def x16_attr(spark, d):
    return _rule(SelectorRule("v", "//li[@class='offer'][1]/a/@href", "xpath", attribute_name="href"), spark, d)


_DEEP = {"after": "//h1/following-sibling::p[1]/b/text()", "above": "//b/ancestor::*[2]/@id", "back": "//table/preceding::time[1]/@datetime", "cells": "count(//tr/*)",
         "joined": "concat(//b, ' / ', //tr[2]/td)", "last_offer": "//li[last()]/a", "second_back": "//li[2]/preceding-sibling::li/i", "none": "//li[3] | //ul/parent::nav",
         "many": "//li[number(substring-before(i, ' ')) > 60 and not(a[contains(@href, 'zzz')])]/i", "brand": "normalize-space(//tr[th = 'Brand' or th[text()='Make']]/td[position() = last()])",
         "is_new": "boolean(//span[@class='new'])", "wide": "string-length(//h1) > 20", "after_table": "name(//table[1]/following::*[. = 'more'])"}
_DEEP_SQL = """SELECT p_partkey, p_brand AS after, 'content' AS above, '2024-01-05' AS back, '4.0' AS cells, p_brand || ' / ' || p_size AS joined,
  'Seller ' || (p_partkey % 5) AS last_offer, (p_size * 3) || ' pieces' AS second_back, NULL::VARCHAR AS none, CASE WHEN p_size * 3 > 60 THEN (p_size * 3) || ' pieces' END AS many,
  trim(p_brand) AS brand, 'False' AS is_new, CASE WHEN length(p_name) > 20 THEN 'True' ELSE 'False' END AS wide, 'a' AS after_table FROM part"""


@query("x16_xpath_axes_and_scalars", _DEEP_SQL)
def x16_axes(spark, d):
    return _products(spark, d).select("p_partkey", *[X.rule_value(SelectorRule(name, path, "xpath")).alias(name) for name, path in _DEEP.items()])


@query("x16_xpath_unions", """SELECT p_partkey, p_brand || '|' || p_size AS cells,
  'https://shop.example.com/img/' || p_partkey || '.png|https://cdn.example.com/logo.gif|https://shop.example.com/s/' || (p_partkey % 7) || '?p=1|https://shop.example.com/p/s/' || (p_partkey % 5) AS addresses,
  p_name || '|' || p_brand || '|more' AS texts FROM part""")
def x16_unions(spark, d):
    rules = [SelectorRule("cells", "//th[.='Size']/following-sibling::td | //th[text()='Brand']/../td", "xpath", is_multiple=True),
             SelectorRule("addresses", "//li/a/@href | //img/@src", "xpath", attribute_name="href", is_multiple=True),
             SelectorRule("texts", "//a[@rel]/text() | //h1 | (//b)[1]", "xpath", is_multiple=True)]
    return _products(spark, d).select("p_partkey", *[F.array_join(X.rule_value(r), "|").alias(r.name) for r in rules])


@query("x16_corpus_xpath", f"""SELECT page_id, trim(regexp_replace({_H1}, '[ \t\r\n]+', ' ', 'g')) AS heading, len(regexp_extract_all(html, '<a href=')) || '.0' AS links,
  {sql_unescape("regexp_extract(html, '<nav><ul><li><a href=.([^>]*).>', 1)")} AS first_link, 'nav' AS first_before FROM pages""")
def x16_corpus(spark, d):
    rules = [SelectorRule("heading", "normalize-space(//article/h1)", "xpath"), SelectorRule("links", "count(//a[@href])", "xpath"),
             SelectorRule("first_link", "(//nav//a)[1]/@href", "xpath"), SelectorRule("first_before", "name((//article)[1]/preceding-sibling::*[last()])", "xpath")]
    return X.with_nodes(_pages(spark, d)).select("page_id", *[X.rule_value(r).alias(r.name) for r in rules])


_CSS = {"has": "ul:has(> li > a.go) li:has(i) a", "has_next": "p:has(+ span.price) b", "has_later": "h1:has(~ ul li)", "some": "main > :is(h1, .price, ul:has(b))", "where": ":where(table, ul) :where(td, i)",
        "no_link": "li:not(:has(a[rel], b)) i", "odd": "tr:nth-child(2n+1) td", "from": "li:nth-child(n+2) a", "until": "li:nth-child(-n+1) a", "back": "li:nth-last-child(2) a", "last_type": "main > p:last-of-type",
        "back_type": "main > p:nth-last-of-type(2) b", "only": "main > h1:only-of-type", "vacant": "table:empty ~ ul li:first-of-type a", "says": "a:-soup-contains('mor')", "top": ":root > body nav a"}
_CSS_SQL = """SELECT p_partkey, 'Seller ' || (p_partkey % 7) || '|Seller ' || (p_partkey % 5) AS has, p_brand AS has_next, p_name AS has_later, p_name || '|$ ' || p_retailprice || ' USD' AS some,
  p_brand || '|' || p_size || '|' || (p_size * 3) || ' pieces|none' AS "where", (p_size * 3) || ' pieces|none' AS no_link, p_brand AS odd, 'Seller ' || (p_partkey % 5) AS "from", 'Seller ' || (p_partkey % 7) AS until,
  'Seller ' || (p_partkey % 7) AS back, 'x' AS last_type, p_brand AS back_type, p_name AS only, 'Seller ' || (p_partkey % 7) AS vacant, 'more' AS says, 'top' AS top FROM part"""


@query("x14_css_relative_and_counted", _CSS_SQL)
def x14_relative(spark, d):
    return _products(spark, d).select("p_partkey", *[F.array_join(X.rule_value(SelectorRule(name, css, is_multiple=True)), "|").alias(name) for name, css in _CSS.items()])


_ITEMS = "len(regexp_extract_all(html, '<li><a href='))"


@query("x14_corpus_css", f"SELECT page_id, trim({_H1}) AS heading, CAST(greatest({_ITEMS} - 1, 0) AS INTEGER) AS but_last, CAST(ceil({_ITEMS} / 2.0) AS INTEGER) AS odd FROM pages")
def x14_corpus_css(spark, d):
    count = lambda css: F.size(X.rule_value(SelectorRule("v", css, is_multiple=True)))
    return X.with_nodes(_pages(spark, d)).select("page_id", X.rule_value(SelectorRule("v", "body:has(nav) > article > h1:is(:first-child)")).alias("heading"),
                                                 count("nav li:not(:nth-last-child(1)) > a").alias("but_last"), count("nav li:nth-child(odd):has(> a)").alias("odd"))


@query("x17_json_ld_field", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS v FROM part")
def x17(spark, d):
    return _rule(SelectorRule("v", "size", "jsonld"), spark, d)


@query("x18_value_kinds", """SELECT p_partkey, 'Made by' || p_brand AS joined, '<p class="maker">Made by <b>' || p_brand || '</b></p>' AS markup, 'name big' AS classes,
  'https://shop.example.com/s/' || (p_partkey % 7) || '?p=1' AS link, '2024-01-05' AS stamp FROM part""")
def x18(spark, d):
    rules = [SelectorRule("joined", ".maker", extract_type="plain"), SelectorRule("markup", ".maker", extract_type="html"),
             SelectorRule("classes", "h1", extract_type="attr", attribute_name="class"), SelectorRule("link", "a.go", extract_type="attr"),
             SelectorRule("stamp", "time", extract_type="attr", attribute_name="datetime")]
    return _products(spark, d).select("p_partkey", *[X.rule_value(r).alias(r.name) for r in rules])


@query("x19_regex_filter", "SELECT p_partkey, CAST(p_size * 3 AS VARCHAR) AS v FROM part")
def x19(spark, d):
    return _rule(SelectorRule("v", "li i", regex_pattern=r"(\d+) pieces", is_multiple=True), spark, d)


@query("x20_default_fill", "SELECT p_partkey, 'fallback' AS v FROM part")
def x20(spark, d):
    return _rule(SelectorRule("v", ".price", regex_pattern="EUR", default_value="fallback"), spark, d)


@query("x21_record_list", """SELECT p_partkey, 0 AS record_index, 'Seller ' || (p_partkey % 7) AS seller, CAST(p_size * 3 AS VARCHAR) AS pieces, 'https://shop.example.com/s/' || (p_partkey % 7) || '?p=1' AS link FROM part
  UNION ALL SELECT p_partkey, 1, 'Seller ' || (p_partkey % 5), NULL, 'https://shop.example.com/p/s/' || (p_partkey % 5) FROM part""")
def x21(spark, d):
    fields = [SelectorRule("seller", "a"), SelectorRule("pieces", "i", regex_pattern=r"\d+"), SelectorRule("link", "a", extract_type="attr")]
    return X.extract_records(_products(spark, d), "li.offer", fields, ["p_partkey"])


@query("x22_custom_fields", """SELECT p_partkey, p_name AS name, '["Seller ' || (p_partkey % 7) || '","Seller ' || (p_partkey % 5) || '"]' AS sellers, '[]' AS none FROM part""")
def x22(spark, d):
    found = X.custom_fields(_products(spark, d), {"name": "h1", "sellers": ".offer a", "none": ".absent"}, ["p_partkey"])
    return found.select("p_partkey", *[X.single_or_list(F.col(c)).alias(c) for c in ("name", "sellers", "none")])


_TRIED = [SelectorRule("name", "h1"), SelectorRule("offers", ".offer", is_multiple=True), SelectorRule("count", "i", regex_pattern=r"(\d+)", is_multiple=True),
          SelectorRule("bad", "li[", is_multiple=True)]


@query("x23_try_rules", """SELECT 'name' AS field_name, 'h1' AS selector, count(*) AS match_count, count(*) AS pages_hit, true AS is_valid, 1.0 AS hit_rate FROM part
  UNION ALL SELECT 'offers', '.offer', 2 * count(*), count(*), true, 1.0 FROM part UNION ALL SELECT 'count', 'i', count(*), count(*), true, 1.0 FROM part
  UNION ALL SELECT 'bad', 'li[', 0, 0, false, 0.0 FROM part HAVING count(*) > 0""")
def x23(spark, d):
    tried = X.try_rules(derived.product_pages(spark, d), _TRIED)
    return X.rule_coverage(tried).select("field_name", "selector", "match_count", "pages_hit", "is_valid", "hit_rate")


@query("x24_inspect", f"""SELECT url, 200 AS status_code, trim({_TITLE}) AS title, sha256(html) AS preview_sha256,
  array_to_string(list_sort(list_distinct({_HREFS})), ' ') AS links, len(regexp_extract_all(html, '<meta (name|property)=')) AS n_meta,
  len(regexp_extract_all(html, 'application/ld.json')) AS n_json, true AS robots_allowed FROM pages""")
def x24(spark, d):
    seen = X.inspect_pages(_pages(spark, d))
    return seen.select("url", "status_code", "title", F.sha2(F.col("html_preview").cast("binary"), 256).alias("preview_sha256"),
                       F.array_join(F.array_sort("discovered_links"), " ").alias("links"), F.size("meta_tags").alias("n_meta"),
                       F.size("json_ld_schemas").alias("n_json"), "robots_allowed")


# Product pages at supplier hosts, so that the robots files and sitemaps of these hosts apply.
_HOST = "'s' || (p_partkey % 20) || '.example.com'"
_SEEN_SQL = f"""SELECT url, CASE WHEN p_partkey % 50 = 0 THEN 404 ELSE 200 END AS status_code, trim(p_name) || ' ' || p_partkey AS title, p_name || ' by ' || p_brand AS description,
  array_to_string(list_sort(list_distinct(['https://' || host || '/s/' || (p_partkey % 7) || '?p=1', 'https://' || host || '/p/s/' || (p_partkey % 5), url || '?page=' || (p_size + 1)])), ' ') AS links, 3 AS n_json,
  s_suppkey IS NULL OR s_suppkey % 3 = 0 OR NOT starts_with('' || p_partkey, '' || s_suppkey) AS robots_allowed,
  CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_nationkey AS INTEGER) END AS robots_crawl_delay,
  CASE WHEN s_suppkey % 3 <> 0 THEN 'https://' || host || '/a.xml' ELSE 'https://' || host || '/sitemap.xml' END AS sitemaps
  FROM (SELECT *, {_HOST} AS host, 'https://' || {_HOST} || '/p/' || p_partkey AS url FROM part) LEFT JOIN supplier ON s_suppkey = p_partkey % 20"""


@query("x24_inspect_with_robots", _SEEN_SQL)
def x24_robots(spark, d):
    pages = derived.product_pages(spark, d).withColumn("url", F.concat(F.lit("https://s"), F.col("p_partkey") % 20, F.lit(".example.com/p/"), "p_partkey"))
    files = derived.robots_files(spark, d)
    seen = X.inspect_pages(pages, robots=admission.robots_rules(files, "WebLoom/1.0"), robots_files=files)
    return seen.select("url", "status_code", "title", F.element_at("meta_tags", F.lit("description")).alias("description"), F.array_join(F.array_sort("discovered_links"), " ").alias("links"),
                       F.size("json_ld_schemas").alias("n_json"), "robots_allowed", "robots_crawl_delay", F.array_join("sitemaps_found", " ").alias("sitemaps"))


_WANTED = "Get the title, author, date, price and link"


@query("x25_suggest_schema", """SELECT 'title' AS field_name, 'h1' AS selector, 'text' AS data_type, 0.92 AS confidence, count(*) AS pages_hit, 1.0 AS hit_rate FROM part
  UNION ALL SELECT 'author', 'meta[name=''author'']', 'text', 0.88, count(*), 1.0 FROM part UNION ALL SELECT 'publication_date', 'time', 'date', 0.9, count(*), 1.0 FROM part
  UNION ALL SELECT 'url', 'link[rel=''canonical'']', 'url', 0.95, count(*), 1.0 FROM part UNION ALL SELECT 'price', '.price', 'number', 0.85, count(*), 1.0 FROM part""")
def x25(spark, d):
    return X.schema_consensus(X.suggest_schema(derived.product_pages(spark, d), _WANTED))


@query("x25_page_proposals", """SELECT p_partkey, x.* FROM part, LATERAL (
  SELECT 'title' AS field_name, 'h1' AS selector, substr(p_name, 1, 120) AS sample_value, 'Detected primary header matching <h1>' AS reasoning UNION ALL
  SELECT 'author', 'meta[name=''author'']', substr(p_brand, 1, 100), 'Matched author metadata or class selector ''meta[name=''author'']''' UNION ALL
  SELECT 'publication_date', 'time', '2024-01-05', 'Matched semantic date element ''time''' UNION ALL
  SELECT 'url', 'link[rel=''canonical'']', 'https://shop.example.com/p/' || p_partkey, 'Extracted canonical page URL reference' UNION ALL
  SELECT 'price', '.price', substr('$ ' || p_retailprice || ' USD', 1, 50), 'Found price indicator ''.price''') AS x""")
def x25_proposals(spark, d):
    found = X.suggest_schema(derived.product_pages(spark, d), _WANTED, "p_partkey")
    return found.select("p_partkey", F.inline("proposed_fields")).select("p_partkey", "field_name", "selector", "sample_value", "reasoning")


@query("x26_entity_type", """SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'price|product|sku') THEN 'E-commerce Product' WHEN regexp_matches(lower(text), 'job|salary|role') THEN 'Job Listing'
  ELSE 'Article / Post' END AS v FROM documents""")
def x26(spark, d):
    return table(spark, d, "documents").select("doc_id", X.entity_type(F.col("text")).alias("v"))


@query("x27_extract", """SELECT 'https://shop.example.com/p/' || p_partkey AS url, CASE WHEN p_partkey % 50 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 50 <> 0 THEN '$ ' || p_retailprice || ' USD' END AS price,
  CASE WHEN p_partkey % 50 = 0 THEN 404 ELSE 200 END AS status_code, CASE WHEN p_partkey % 50 = 0 THEN 'HTTP status 404' END AS error FROM part""")
def x27(spark, d):
    out = X.extract(derived.product_pages(spark, d), [SelectorRule("name", "h1"), SelectorRule("price", ".price")])
    return out.select("url", "data.name", "data.price", "status_code", "error")


@query("x28_next_page", f"SELECT p_partkey, {_PRODUCT} || '?page=' || (p_size + 1) AS v FROM part")
def x28(spark, d):
    return _products(spark, d).select("p_partkey", X.next_page_url(F.col("url")).alias("v"))


@query("ud1_describe_pages")
def ud1(spark, d):
    return X.describe_pages(_pages(spark, d).select("page_id", "url", "html")).drop("metadata")


@query("ud1_parse_html_in_sql", "SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS anchors FROM pages")
def ud1_sql(spark, d):
    from webloom.functions.html import register_sql
    register_sql(spark)
    _pages(spark, d).createOrReplaceTempView("webloom_pages")
    return spark.sql("SELECT page_id, count_if(n.tag = 'a') AS anchors FROM webloom_pages LATERAL VIEW OUTER inline(parse_html(html)) n GROUP BY page_id")
