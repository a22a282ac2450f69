"""Frames that queries derive from the given tables: product pages, robots files, sitemaps, job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.plans.registry import table
from webloom.session import spread


def _page(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def product_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One shop page per part, with metadata, JSON-LD, a table, images, offers and a next link.

    A part is a short row and its page takes long, so the parts are dealt out before they become pages.
    """
    p = spread(table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))
    key, name, brand, kind, size = (F.col(c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    html = _page(
        '<!DOCTYPE html><html><head><title> ', name, ' ', key, ' </title><meta name="description" content="', name, ' by ',
        brand, '"><meta name="keywords" content="', kind, ',', size, '"><meta property="og:title" content="old">',
        '<meta property="og:title" content="', name, '"><meta property="og:type" content="', kind, '">',
        '<meta name="author" content="', brand, '"><link rel="canonical" href="/p/', key, '#x">',
        '<script type="application/ld+json">{"name":"', name, '","sku":', key, ',"@type":"Product"}</script>',
        '<script type="application/ld+json">[{"brand":"', brand, '"},{"size":', size, '}]</script>',
        '<script type="application/ld+json">{broken</script></head><body><nav><a href="#top">top</a></nav>',
        '<main id="content"><h1 class="name big">', name, '</h1><p class="maker">Made by <b>', brand, '</b></p>',
        '<span class="price">$ ', F.col("p_retailprice"), ' USD</span><p>x</p><time datetime="2024-01-05">Jan 5</time>',
        '<img src="/img/', key, '.png" alt=" ', name, ' "><img src="//cdn.example.com/logo.gif">',
        '<table><tr><th>Brand</th><td>', brand, '</td></tr><tr><th>Size</th><td>', size, '</td></tr></table><table></table>',
        '<ul><li class="offer"><a class="go" href="/s/', key % 7, '?p=1">Seller ', key % 7, '</a><i>', size * 3, ' pieces</i></li>',
        '<li class="offer"><a class="go" href="s/', key % 5, '">Seller ', key % 5, '</a><i>none</i></li></ul>',
        '<a rel="nofollow next" href="?page=', size + 1, '">more</a></main></body></html>')
    url = _page("https://shop.example.com/p/", key)
    status = F.when(key % 50 == 0, 404).otherwise(200).cast("int")
    return p.select("p_partkey", url.alias("url"), html.alias("html"), status.alias("status_code"))


def robots_files(spark: SparkSession, folder: str) -> DataFrame:
    """One robots file per supplier host."""
    s = table(spark, folder, "supplier")
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    body = _page("# robots of ", key, "\nUser-agent: *\nDisallow: /all", nation, "\n\nUser-agent: OtherBot\nUser-Agent: webloom\n",
                 "Allow: /p/", key, "/open # inline\nDisallow: /p/", key, "\nCrawl-delay: ", nation, "\nsitemap: https://s", key,
                 ".example.com/a.xml\n\nUser-agent: webloom\nDisallow: /\n")
    plain = _page("User-agent: *\nDisallow: /all", nation, "\nAllow: /\n")
    return s.select("s_suppkey", "s_nationkey", _page("s", key, ".example.com").alias("host"),
                    F.when(key % 3 == 0, plain).otherwise(body).alias("body"))


def sitemap_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Four sitemap candidates per supplier site: an error page, broken XML, a good one, a late one."""
    s = table(spark, folder, "supplier")
    key = F.col("s_suppkey")
    good = _page('<?xml version="1.0"?><x:urlset xmlns:x="http://www.sitemaps.org/schemas/sitemap/0.9"><!-- <loc>http://no</loc> -->',
                 '<x:url><x:loc> https://s', key, '.example.com/one?a=1&amp;b=2 </x:loc></x:url><x:url><x:loc>ftp://no</x:loc></x:url>',
                 '<x:url><x:loc>http://s', key, '.example.com/two</x:loc></x:url></x:urlset>')
    index = _page('<sitemapindex><sitemap><loc>https://s', key, '.example.com/late.xml</loc></sitemap></sitemapindex>')
    def candidate(seq: int, status: Column, content_type: str, body: Column) -> Column:
        return F.struct(F.lit(seq).alias("seq"), status.alias("status"), F.lit(content_type).alias("content_type"), body.alias("body"))
    fine = F.lit(200)
    broken = F.when(key % 4 == 0, index).otherwise("<urlset><url><loc>http://bad</loc>")
    rows = F.array(candidate(0, F.when(key % 2 == 0, 404).otherwise(200), "text/html", F.lit("<html></html>")),
                   candidate(1, fine, "application/xml", broken), candidate(2, fine, "text/XML; charset=utf-8", good),
                   candidate(3, fine, "text/xml", index))
    return s.select("s_suppkey", _page("s", key).alias("site"), F.inline(rows))


def job_results(spark: SparkSession, folder: str) -> DataFrame:
    """Crawl results read off the event log: a job per user, an error per `error` event."""
    e = table(spark, folder, "events")
    return e.select(F.col("event_id"), F.col("user_id").alias("job_id"), F.col("ts"),
                    (F.col("event_type") == "error").alias("is_error"), (F.col("event_type") == "signup").alias("is_stop"), "value")


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Job table read off the orders: status, record count and error text per order."""
    o = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    status = (F.when(key % 7 == 0, "failed").when(key % 7 == 1, "cancelled").when(key % 7 == 2, "running")
              .when(key % 7 == 3, "pending").otherwise("completed"))
    error = (F.when(key % 11 == 0, "HTTP 403 Forbidden").when(key % 11 == 1, "429 Too many").when(key % 11 == 2, "Timeout after 15s")
             .when(key % 11 == 3, "Rate exceeded").when(key % 11 == 4, "odd failure"))
    return o.select(key.alias("job_id"), F.col("o_custkey").alias("project_id"), status.alias("status"),
                    F.when(key % 13 == 0, None).otherwise(key % 5).cast("bigint").alias("records_count"),
                    error.alias("error_summary"), F.col("o_orderdate").alias("created_at"), "o_orderpriority")


JOBS_SQL = """(SELECT o_orderkey AS job_id, o_custkey AS project_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'running' WHEN 3 THEN 'pending' ELSE 'completed' END AS status,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 5 END AS records_count,
  CASE o_orderkey % 11 WHEN 0 THEN 'HTTP 403 Forbidden' WHEN 1 THEN '429 Too many' WHEN 2 THEN 'Timeout after 15s'
    WHEN 3 THEN 'Rate exceeded' WHEN 4 THEN 'odd failure' END AS error_summary,
  o_orderdate AS created_at, o_orderpriority FROM orders)"""


def order_snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the orders: the new one lacks the low-priority orders, changes the status of
    the medium ones, and has the urgent ones again under new keys."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    old = o.withColumn("record_index", F.col("o_orderkey"))
    kept = o.where(F.col("o_orderpriority") != "5-LOW").withColumn(
        "o_orderstatus", F.when(F.col("o_orderpriority") == "3-MEDIUM", "X").otherwise(F.col("o_orderstatus")))
    added = o.where(F.col("o_orderpriority") == "1-URGENT").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000)
    new = kept.unionByName(added).withColumn("record_index", F.col("o_orderkey"))
    return old, new


SNAPSHOTS_SQL = """old_s AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders),
new_s AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority
  FROM orders WHERE o_orderpriority <> '5-LOW'
  UNION ALL SELECT o_orderkey + 1000000000, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT')"""
