"""URL, admission and robots queries."""

from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators import admission
from webloom.plans import derived
from webloom.plans.registry import query, sql_origin, table

_BARE = "regexp_extract(url, '^([^?#]*)', 1)"
_NO_FRAGMENT = "regexp_extract(url, '^([^#]*)', 1)"
_HOST = "lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1)"


@query("u01_resolve_url", f"""SELECT page_id, {sql_origin('url')} || '/a/b?x=1' AS rooted,
  CASE WHEN starts_with(url, 'https') THEN 'https' ELSE 'HTTPS' END || '://Q.example/z#k' AS absolute, {_BARE} || '?q=1' AS query_only, {_NO_FRAGMENT} || '#f' AS fragment_only,
  regexp_extract(url, '^([^:]+:)', 1) || '//cdn.example/x' AS other_host, 'mailto:a@b.c' AS mail,
  {sql_origin('url')} || regexp_extract({_PATH}, '^(.*/)', 1) || 'leaf' AS sibling,
  {sql_origin('url')} || '/leaf' AS above FROM pages""")
def u01(spark, d):
    base = F.col("url")
    hrefs = {"rooted": "/a/./c/../b?x=1", "absolute": "HTTPS://Q.example/z#k", "query_only": "?q=1", "fragment_only": "#f",
             "other_host": "//cdn.example/x", "mail": "mailto:a@b.c", "sibling": "leaf", "above": "../../../../leaf"}
    return table(spark, d, "pages").select(
        "page_id", *[U.resolve_url(base, F.lit(h)).alias(n) for n, h in hrefs.items()])


@query("u02_clean_url", f"""SELECT page_id, {_NO_FRAGMENT} || CASE WHEN contains(url, '?') THEN '&z=1' ELSE '?z=1' END AS with_query,
  CAST(NULL AS VARCHAR) AS blank, CAST(NULL AS VARCHAR) AS anchor, CAST(NULL AS VARCHAR) AS mail, {sql_origin('url')} || '/k' AS rooted FROM pages""")
def u02(spark, d):
    base = F.col("url")
    more = F.concat(F.regexp_extract("url", "^([^#]*)", 1), F.when(base.contains("?"), "&z=1#cut").otherwise("?z=1#cut"))
    fixed = {"blank": "  ", "anchor": "#top", "mail": "mailto:a@b.c", "rooted": " /k#x "}
    return table(spark, d, "pages").select("page_id", U.clean_url(base, more).alias("with_query"),
                                           *[U.clean_url(base, F.lit(h)).alias(n) for n, h in fixed.items()])


@query("u03_authority_and_origin", f"SELECT page_id, {_HOST} AS site, {sql_origin('url')} AS origin FROM pages")
def u03(spark, d):
    return table(spark, d, "pages").select("page_id", U.authority(F.col("url")).alias("site"), U.origin(F.col("url")).alias("origin"))


@query("u04_redact_url", "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS v FROM pages")
def u04(spark, d):
    return table(spark, d, "pages").select("page_id", U.redact_url(F.col("url")).alias("v"))


_VARIANTS_SQL = """(SELECT page_id, CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http', 'ftp') WHEN 2 THEN 'https://localhost/' || page_id
  WHEN 3 THEN 'http://db.internal/' || page_id WHEN 4 THEN 'https://user:pw@example.com/' || page_id WHEN 5 THEN 'http:///' || page_id
  WHEN 6 THEN 'http://10.0.' || (page_id % 250) || '.7/x' WHEN 7 THEN 'https://[fe80::' || (page_id % 9) || ']:80/' ELSE 'http://93.184.216.' || (page_id % 250) || '/' END AS url FROM pages)"""


def _variants(spark, d):
    k, u = F.col("page_id"), F.col("url")
    text = k.cast("string")
    small = (k % 250).cast("string")
    made = (F.when(k % 9 == 0, u).when(k % 9 == 1, F.replace(u, F.lit("http"), F.lit("ftp"))).when(k % 9 == 2, F.concat(F.lit("https://localhost/"), text))
            .when(k % 9 == 3, F.concat(F.lit("http://db.internal/"), text)).when(k % 9 == 4, F.concat(F.lit("https://user:pw@example.com/"), text))
            .when(k % 9 == 5, F.concat(F.lit("http:///"), text)).when(k % 9 == 6, F.concat(F.lit("http://10.0."), small, F.lit(".7/x")))
            .when(k % 9 == 7, F.concat(F.lit("https://[fe80::"), (k % 9).cast("string"), F.lit("]:80/")))
            .otherwise(F.concat(F.lit("http://93.184.216."), small, F.lit("/"))))
    return table(spark, d, "pages").select("page_id", made.alias("url"))


@query("u05_url_safety", f"""SELECT page_id, CASE page_id % 9 WHEN 1 THEN 'Unsupported scheme ''' || regexp_extract(url, '^([^:]*):', 1) || '''. Only ''http'' and ''https'' are allowed.'
   WHEN 2 THEN 'Hostname ''localhost'' is not permitted.' WHEN 3 THEN 'Hostname ''db.internal'' is not permitted.'
   WHEN 4 THEN 'Embedded credentials in URLs are rejected.' WHEN 5 THEN 'URL is missing a valid hostname.' END AS reason FROM {_VARIANTS_SQL}""")
def u05(spark, d):
    return _variants(spark, d).select("page_id", U.refusal_reason(F.col("url")).alias("reason"))


@query("u05_screen_urls", f"SELECT page_id, page_id % 9 IN (0, 8) AS ok FROM {_VARIANTS_SQL}")
def u05_screen(spark, d):
    return admission.screen_urls(_variants(spark, d)).select("page_id", "ok")


_IP_SQL = """(SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey * 7919) % 256 ELSE 192 END AS a, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey * 31) % 256 ELSE 168 - c_custkey % 5 END AS b,
   c_custkey % 256 AS c, (c_custkey * 3) % 256 AS d FROM customer)"""


@query("u06_blocked_ipv4", f"""SELECT c_custkey, a || '.' || b || '.' || c || '.' || d AS ip,
   (a IN (0, 10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
    OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224) AS blocked FROM {_IP_SQL}""")
def u06(spark, d):
    k = F.col("c_custkey")
    a = F.when(k % 2 == 0, (k * 7919) % 256).otherwise(192)
    b = F.when(k % 2 == 0, (k * 31) % 256).otherwise(168 - k % 5)
    ip = F.concat_ws(".", a.cast("string"), b.cast("string"), (k % 256).cast("string"), ((k * 3) % 256).cast("string"))
    return table(spark, d, "customer").select("c_custkey", ip.alias("ip")).withColumn("blocked", U.is_blocked_ip(F.col("ip")))


@query("u06_blocked_ipv6", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE NULL END AS blocked FROM customer""")
def u06_v6(spark, d):
    k = F.col("c_custkey")
    tail = F.lower(F.hex(k % 65536))
    ip = (F.when(k % 5 == 0, F.concat(F.lit("fd00::"), tail)).when(k % 5 == 1, F.concat(F.lit("FE80:0:0:0::"), tail, F.lit("%eth0")))
          .when(k % 5 == 2, F.concat(F.lit("2606:4700::"), tail)).when(k % 5 == 3, F.concat(F.lit("2001:db8::"), tail, F.lit(":1")))
          .otherwise(F.concat(F.lit("g::"), tail)))
    return table(spark, d, "customer").select("c_custkey", U.is_blocked_ip(ip).alias("blocked"))


@query("u06_screen_hosts", """SELECT 'n' || c_nationkey || '.example' AS host, bool_or(c_custkey % 97 = 0) AS blocked,
   min(CASE WHEN c_custkey % 97 = 0 THEN '10.0.0.' || (c_custkey % 200) END) AS blocked_ip FROM customer GROUP BY c_nationkey""")
def u06_hosts(spark, d):
    k = F.col("c_custkey")
    last = (k % 200).cast("string")
    ip = F.when(k % 97 == 0, F.concat(F.lit("10.0.0."), last)).otherwise(F.concat(F.lit("93.184.216."), last))
    seen = table(spark, d, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit(".example")).alias("host"), ip.alias("ip"))
    return admission.screen_hosts(seen)


@query("u07_same_domain", f"SELECT page_id, url FROM pages WHERE {_HOST} IN (SELECT {_HOST} FROM pages WHERE starts_with(url, 'https'))")
def u07(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return admission.same_domain(p, p.where(F.col("url").startswith("https")))


@query("u08_asset_filter", """SELECT page_id, page_id % 3 = 0 AS asset FROM pages""")
def u08(spark, d):
    bare = U.redact_url(F.col("url"))
    ending = F.when(F.col("page_id") % 3 == 0, F.element_at(F.array(*[F.lit(e) for e in (".PDF", ".jpg?v=1", ".tar#x")]), (F.col("page_id") % 9 / 3 + 1).cast("int"))
                    ).otherwise(".pdf.html")
    return table(spark, d, "pages").select("page_id", U.is_asset(F.concat(bare, ending)).alias("asset"))


_RULES_SQL = """SELECT s_suppkey, 's' || s_suppkey || '.example.com' AS host, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END AS delay, s_nationkey FROM supplier"""


@query("src5_robots_rules", f"""SELECT host, CAST(delay AS INTEGER) AS crawl_delay,
   CASE WHEN s_suppkey % 3 = 0 THEN 'false /all' || s_nationkey || '; true /' ELSE 'true /p/' || s_suppkey || '/open; false /p/' || s_suppkey END AS rules FROM ({_RULES_SQL})""")
def src5(spark, d):
    found = admission.robots_rules(derived.robots_files(spark, d), "WebLoom/1.0")
    told = F.array_join(F.transform("rules", lambda r: F.concat_ws(" ", r["allow"].cast("string"), r["prefix"])), "; ")
    return found.select("host", "crawl_delay", told.alias("rules"))


@query("src5_robots_sitemaps", "SELECT 's' || s_suppkey || '.example.com' AS host, 0 AS seq, 'https://s' || s_suppkey || '.example.com/a.xml' AS sitemap FROM supplier WHERE s_suppkey % 3 <> 0")
def src5_maps(spark, d):
    return admission.robots_sitemaps(derived.robots_files(spark, d))


_LINKS_SQL = """(SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, 'https://s' || l_suppkey || '.example.com' ||
   CASE l_linenumber % 4 WHEN 0 THEN '/p/' || l_suppkey || '/open?x' WHEN 1 THEN '/p/' || l_suppkey || '/' || l_partkey WHEN 2 THEN '/all' || l_partkey ELSE '' END AS url FROM lineitem)"""


def _links(spark, d):
    s, p = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
    tail = (F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("/p/"), s, F.lit("/open?x"))).when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("/p/"), s, F.lit("/"), p))
            .when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit("/all"), p)).otherwise(""))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("https://s"), s, F.lit(".example.com"), tail).alias("url"))


@query("u09_robots_verdict", f"""SELECT l_orderkey, l_linenumber, url, CAST(delay AS INTEGER) AS crawl_delay,
   CASE WHEN s_suppkey % 3 = 0 THEN NOT (l_linenumber % 4 = 2 AND starts_with('' || l_partkey, '' || s_nationkey)) ELSE l_linenumber % 4 <> 1 END AS robots_allowed
   FROM {_LINKS_SQL} JOIN ({_RULES_SQL}) ON l_suppkey = s_suppkey""")
def u09(spark, d):
    rules = admission.robots_rules(derived.robots_files(spark, d), "WebLoom/1.0")
    return admission.robots_verdict(_links(spark, d), rules)


@query("u10_next_numbered_page", """SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=[0-9]+')
   THEN regexp_extract(url, '^(.*[?&]page=)[0-9]+', 1) || (CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS BIGINT) + 1) || regexp_extract(url, '[?&]page=[0-9]+(.*)$', 1) END AS v,
   regexp_extract(url, '^([^?#]*)', 1) || '/page/' || (page_id + 1) || '/' AS by_path FROM pages""")
def u10(spark, d):
    counted = F.concat(U.redact_url(F.col("url")), F.lit("/page/"), F.col("page_id").cast("string"), F.lit("/"))
    return table(spark, d, "pages").select("page_id", U.next_numbered_page(F.col("url")).alias("v"), U.next_numbered_page(counted).alias("by_path"))


@query("u11_host_label", f"SELECT page_id, {_HOST} AS v, 'Scrape job' AS fallback FROM pages")
def u11(spark, d):
    return table(spark, d, "pages").select("page_id", U.host_label(F.col("url")).alias("v"), U.host_label(F.concat(F.lit("x"), F.col("page_id").cast("string"))).alias("fallback"))


@query("u12_redirect_chains", """WITH h AS (SELECT l_orderkey AS request_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS hop, l_partkey, l_suppkey FROM lineitem),
   g AS (SELECT request_id, count(*) AS requests, arg_max('https://h' || l_suppkey || '.example.com/' || l_partkey, hop) AS final_url FROM h GROUP BY request_id)
   SELECT request_id, requests, requests <= 5 AS admitted, CASE WHEN requests > 5 THEN 'Too many redirects' END AS reason FROM g""")
def u12(spark, d):
    from pyspark.sql.window import Window
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    url = F.concat(F.lit("https://h"), F.col("l_suppkey").cast("string"), F.lit(".example.com/"), F.col("l_partkey").cast("string"))
    hops = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), place.alias("hop"), url.alias("url"))
    return admission.redirect_chains(hops).select("request_id", "requests", "admitted", "reason")


@query("u13_accept_links", f"""WITH seeds AS (SELECT DISTINCT 's' || s_suppkey || '.example.com' AS host FROM supplier WHERE s_acctbal > 0),
   v AS (SELECT DISTINCT 'https://s' || s_suppkey || '.example.com' AS url FROM supplier)
   SELECT l_orderkey, l_linenumber, url, CASE WHEN url IN (SELECT url FROM v) THEN 'visited' WHEN {_HOST} NOT IN (SELECT host FROM seeds) THEN 'other domain'
     WHEN NOT (CASE WHEN s_suppkey % 3 = 0 THEN NOT (l_linenumber % 4 = 2 AND starts_with('' || l_partkey, '' || s_nationkey)) ELSE l_linenumber % 4 <> 1 END) THEN 'robots' END AS reject_reason
   FROM {_LINKS_SQL} JOIN supplier ON l_suppkey = s_suppkey""")
def u13(spark, d):
    s = table(spark, d, "supplier")
    home = F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example.com"))
    rules = admission.robots_rules(derived.robots_files(spark, d), "WebLoom/1.0")
    return admission.accept_links(_links(spark, d), s.where("s_acctbal > 0").select(home.alias("url")), rules, s.select(home.alias("url")))


@query("src8_admit_response", """SELECT page_id, CASE WHEN octet_length(encode(html)) > 10485760 THEN 'Response size exceeds 10485760 bytes' WHEN page_id % 10 = 0 THEN 'HTTP status 503'
   WHEN page_id % 10 = 1 THEN 'The server response is not HTML' END AS error, CASE WHEN octet_length(encode(html)) <= 10485760 AND page_id % 10 > 1 THEN html END AS html FROM pages""")
def src8(spark, d):
    k = F.col("page_id") % 10
    p = table(spark, d, "pages").withColumns({"status_code": F.when(k == 0, 503).otherwise(200),
                                              "content_type": F.when(k == 1, "application/pdf").otherwise("text/HTML; charset=utf-8")})
    return admission.admit_response(p, require_html=True).select("page_id", "error", "html")


@query("src4_sitemap_candidates", """SELECT 's' || s_suppkey || '.example.com' AS host, 0 AS seq, 'https://s' || s_suppkey || '.example.com/' || CASE WHEN s_suppkey % 3 = 0 THEN 'sitemap.xml' ELSE 'a.xml' END AS url FROM supplier
  UNION ALL SELECT 's' || s_suppkey || '.example.com', 1, 'https://s' || s_suppkey || '.example.com/sitemap.xml' FROM supplier WHERE s_suppkey % 3 <> 0""")
def src4_candidates(spark, d):
    return admission.sitemap_candidates(derived.robots_files(spark, d))
