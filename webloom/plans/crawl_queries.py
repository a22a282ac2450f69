"""Link graph, crawl order and pacing queries."""

from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators import crawl as K
from webloom.plans import derived
from webloom.plans.page_queries import _HREFS
from webloom.plans.registry import query, table
from webloom.sources.readers import sitemap_urls


@query("k01_link_graph", f"WITH l AS (SELECT url, unnest(list_distinct({_HREFS})) AS dst FROM pages) SELECT url AS src, count(*) AS links FROM l GROUP BY url")
def k01(spark, d):
    return K.link_graph(table(spark, d, "pages")).groupBy("src").agg(F.count("*").alias("links"))


@query("k01_accepted_link_graph", f"""WITH l AS (SELECT url, unnest(list_distinct({_HREFS})) AS dst FROM pages)
  SELECT url AS src, dst FROM l WHERE NOT regexp_matches(lower(regexp_extract(dst, '^([^?#]*)', 1)), '[.](jpg|jpeg|png|gif|webp|pdf|zip|tar|mp4|mp3|exe)$') AND NOT contains(dst, '//spam-farm.')""")
def k01_accepted(spark, d):
    from webloom.operators.admission import accept_links
    pages = table(spark, d, "pages")
    seeds = pages.where(~F.col("url").contains("//spam-farm.")).select("url")
    keep = lambda links: accept_links(links, seeds).where("reject_reason IS NULL")
    return K.link_graph(pages, keep)


# A graph read off the line items: supplier pages name parts, part pages name suppliers.
_EDGES_SQL = """edges AS (SELECT DISTINCT 'http://g/s' || l_suppkey AS src, 'http://g/p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'http://g/p' || l_partkey, 'http://g/s' || l_suppkey FROM lineitem)"""


def _edges(spark, d):
    li = table(spark, d, "lineitem")
    s, p = F.concat(F.lit("http://g/s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("http://g/p"), F.col("l_partkey").cast("string"))
    return li.select(s.alias("src"), p.alias("dst")).union(li.select(p, s)).distinct()


def _seeds(spark, d):
    first = table(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(2)
    return first.select(F.concat(F.lit("http://g/s"), F.col("s_suppkey").cast("string")).alias("url"), F.lit(0).alias("depth"),
                        F.when(F.col("s_suppkey") > 0, F.col("s_suppkey")).alias("seq"))


_WAVES_SQL = f"""WITH {_EDGES_SQL}, seed AS (SELECT 'http://g/s' || s_suppkey AS url, row_number() OVER (ORDER BY s_suppkey) AS visit_order FROM (SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 2)),
  c1 AS (SELECT dst AS url, min(visit_order) AS k FROM edges JOIN seed ON src = url WHERE dst NOT IN (SELECT url FROM seed) GROUP BY dst),
  w1 AS (SELECT url, 2 + row_number() OVER (ORDER BY k, url) AS visit_order FROM c1),
  v1 AS (SELECT * FROM seed UNION ALL SELECT * FROM w1 WHERE visit_order <= {{limit}}),
  c2 AS (SELECT dst AS url, min(visit_order) AS k FROM edges JOIN v1 ON src = url WHERE visit_order > 2 AND dst NOT IN (SELECT url FROM v1) GROUP BY dst),
  w2 AS (SELECT url, (SELECT count(*) FROM v1) + row_number() OVER (ORDER BY k, url) AS visit_order FROM c2)
  SELECT url, 0 AS depth, visit_order FROM seed UNION ALL SELECT url, 1, visit_order FROM w1 WHERE visit_order <= {{limit}}
  UNION ALL SELECT url, 2, visit_order FROM w2 WHERE visit_order <= {{limit}}"""


@query("k02_bfs", _WAVES_SQL.format(limit=900))
def k02(spark, d):
    return K.bfs(_edges(spark, d), _seeds(spark, d), max_depth=2, max_pages=900)


@query("k02_bfs_default_budget", _WAVES_SQL.format(limit=10))
def k02_small(spark, d):
    return K.bfs(_edges(spark, d), _seeds(spark, d))


@query("src4_sitemap_urls", """SELECT 's' || s_suppkey AS site, 0 AS position, CASE WHEN s_suppkey % 4 = 0 THEN 'https://s' || s_suppkey || '.example.com/late.xml' ELSE 'https://s' || s_suppkey || '.example.com/one?a=1&b=2' END AS url FROM supplier
  UNION ALL SELECT 's' || s_suppkey, 1, 'http://s' || s_suppkey || '.example.com/two' FROM supplier WHERE s_suppkey % 4 <> 0""")
def src4(spark, d):
    return sitemap_urls(derived.sitemap_candidates(spark, d))


@query("k03_sitemap_seeds", """WITH p AS (SELECT url, page_id FROM pages ORDER BY page_id LIMIT 6), s AS (SELECT url FROM p ORDER BY page_id LIMIT 1)
  SELECT url, 0 AS depth, 0 AS seq FROM s UNION ALL SELECT url, 1, row_number() OVER (ORDER BY page_id) FROM p WHERE url NOT IN (SELECT url FROM s)""")
def k03(spark, d):
    p = table(spark, d, "pages").select("url", F.col("page_id").alias("seq"))
    start = p.orderBy("seq").limit(1)
    return K.with_sitemap_seeds(start, p, max_pages=6)


@query("k04_pagination_chain", """WITH RECURSIVE n AS (SELECT l_suppkey AS a, max(l_partkey) % (SELECT count(*) FROM supplier) + 1 AS b FROM lineitem GROUP BY l_suppkey),
  c(a, visit_order) AS (SELECT min(s_suppkey), 1 FROM supplier UNION ALL SELECT b, visit_order + 1 FROM c JOIN n USING (a) WHERE visit_order < 60)
  SELECT 'http://g/' || a AS url, min(visit_order) AS visit_order FROM c GROUP BY a HAVING min(visit_order) <= 60""")
def k04(spark, d):
    supplier = table(spark, d, "supplier")
    nxt = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_partkey").alias("m"))
    link = lambda c: F.concat(F.lit("http://g/"), c.cast("string"))
    edges = nxt.select(link(F.col("l_suppkey")).alias("src"), link(F.col("m") % supplier.agg(F.count("*")).scalar() + 1).alias("dst"))
    start = f"http://g/{supplier.agg(F.min('s_suppkey')).first()[0]}"
    return K.pagination_chain(edges, start, max_pages=60)


@query("k04_next_page_edges", "SELECT 'https://shop.example.com/p/' || p_partkey AS src, 'https://shop.example.com/p/' || p_partkey || '?page=' || (p_size + 1) AS dst FROM part")
def k04_edges(spark, d):
    return K.next_page_edges(derived.product_pages(spark, d))


@query("k05_fetch_slots", """WITH a AS (SELECT event_id, user_id % 5 AS domain, epoch_us(ts) / 1e6 AS arrival FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY arrival, event_id) - 1 AS k FROM a)
  SELECT event_id, domain, k AS request_rank, round(k * 1300.0 + max(arrival - k * 1300.0) OVER (PARTITION BY domain ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING), 3) AS slot FROM r""")
def k05(spark, d):
    e = table(spark, d, "events")
    asked = e.select("event_id", (F.col("user_id") % 5).alias("domain"), (F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01'"), F.col("ts")) / 1e6).alias("arrival"))
    slots = K.fetch_slots(asked, 1300.0, tie="event_id")
    return slots.select("event_id", "domain", "request_rank", F.round("slot", 3).alias("slot"))


@query("k06_crawl_progress", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS current FROM events)
  SELECT user_id, event_id, current, round(current / 40 * 100, 1) AS percent FROM r WHERE current <= 40""")
def k06(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return K.crawl_progress(e, "user_id", "at", 40).select("user_id", "event_id", "current", "percent")


@query("k05_polite_slots_per_site", """SELECT page_id, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS domain, row_number() OVER (PARTITION BY lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) ORDER BY page_id) - 1.0 AS slot FROM pages""")
def k05_sites(spark, d):
    asked = table(spark, d, "pages").select("page_id", U.authority(F.col("url")).alias("domain"), F.lit(0.0).alias("arrival"))
    return K.fetch_slots(asked, 1.0, tie="page_id").select("page_id", "domain", "slot")


@query("k05_request_activity", """WITH e AS (SELECT user_id % 5 AS domain, date_trunc('hour', ts) AS hour, ts, event_type = 'error' AS failed,
    lag(ts) OVER (PARTITION BY user_id % 5, date_trunc('hour', ts) ORDER BY ts) AS before FROM events),
  r AS (SELECT domain, hour, count(*) AS requests, count(*) FILTER (failed) AS failures, max(epoch_us(ts) - epoch_us(before)) / 1e6 AS longest_pause, min(ts) AS a, max(ts) AS b FROM e GROUP BY domain, hour)
  SELECT domain, CAST(hour AS TIMESTAMP) AS hour, requests, failures, longest_pause, (epoch_us(a) - epoch_us(lag(b) OVER (PARTITION BY domain ORDER BY hour))) / 1e6 AS pause_before FROM r""")
def k05_activity(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("domain"), "ts", (F.col("event_type") == "error").alias("failed"))
    return K.request_activity(e, at="ts").withColumn("hour", F.col("hour").cast("timestamp_ntz"))
