"""Link graph and crawl order over stored pages (no network)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import text, urls
from webloom.operators.extraction import BASE, link_rows, next_page_url, with_nodes
from webloom.session import materialize, number_rows

MAX_PAGES = 10
MAX_DEPTH = 2

AcceptLinks = Callable[[DataFrame], DataFrame]


def link_graph(pages: DataFrame, accept: AcceptLinks | None = None) -> DataFrame:
    """Edges (src, dst) of the pages' links; `accept` filters a frame with a `url` column."""
    edges = link_rows(pages).select(F.col("url").alias("src"), F.col("link").alias("url"))
    if accept:
        edges = accept(edges)
    return edges.select("src", F.col("url").alias("dst"))


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, max_pages: int = MAX_PAGES,
        known: DataFrame | None = None) -> DataFrame:
    """Visit order of a crawl: (url, depth, visit_order).

    `seeds` has url, depth (0 for start urls, 1 for sitemap urls) and seq.  Links of a page are taken
    in sorted order, pages first come first served.  `known` limits expansion to pages that were
    captured without error.  The caller's depth and page budget hold as given.

    Edges are stored once; each depth joins them with its frontier, and the frontier is numbered over all tasks.
    """
    edges = materialize(edges.select("src", "dst"), "edges")
    if known is not None:
        edges = edges.join(known.select(F.col("url").alias("src")).distinct(), "src", "left_semi")
    frontier = seeds.groupBy("url").agg(F.min(F.struct("seq", "depth")).alias("_f")).select(
        "url", F.col("_f.depth").alias("depth"), F.col("_f.seq").cast("bigint").alias("_k"))
    visited, count = None, 0
    while True:
        wave = number_rows(frontier, ["_k", "url"], "_n").where(F.col("_n") < max_pages - count)
        wave = materialize(wave.select("url", "depth", (F.col("_n") + count + 1).alias("visit_order")), "wave")
        found = wave.count()
        visited = wave if visited is None else visited.unionByName(wave)
        count += found
        if found == 0 or count >= max_pages:
            return visited
        parents = wave.where(F.col("depth") < max_depth)
        step = edges.join(parents.withColumnRenamed("url", "src"), "src")
        # A link is visited for the first parent that names it.
        first = step.groupBy("dst").agg(F.min(F.struct("visit_order", "depth")).alias("_f"))
        fresh = first.join(visited.select(F.col("url").alias("dst")), "dst", "left_anti")
        frontier = fresh.select(F.col("dst").alias("url"), (F.col("_f.depth") + 1).alias("depth"), F.col("_f.visit_order").alias("_k"))


def with_sitemap_seeds(seeds: DataFrame, sitemap_urls: DataFrame, max_pages: int = MAX_PAGES, accept: AcceptLinks | None = None) -> DataFrame:
    """With one start url and room for more, add the first `max_pages` sitemap urls at depth 1; start urls keep coming first.

    `sitemap_urls` has url and seq; `accept` screens them like other links, start urls are not screened."""
    start = seeds.select("url", F.lit(0).alias("depth"), F.col("seq").cast("bigint").alias("seq"))
    if max_pages <= 1:
        return start
    extra = sitemap_urls.select("url", "seq").orderBy("seq").limit(max_pages).join(start.select("url"), "url", "left_anti")
    extra = accept(extra) if accept else extra
    lone = seeds.agg((F.count("*") == 1).alias("_lone")).where("_lone").select(F.lit(1).alias("_one"))
    extra = extra.withColumn("_one", F.lit(1)).join(lone, "_one", "left_semi")
    both = start.unionByName(extra.select("url", F.lit(1).alias("depth"), F.col("seq").cast("bigint").alias("seq")))
    return number_rows(both, ["depth", "seq", "url"], "_n").select("url", "depth", F.col("_n").alias("seq"))


def next_page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): each page's following page, kept when it stays on the page's host."""
    host = lambda parts: F.lower(parts["netloc"])
    stays = lambda dst: F.when(host(urls.url_parts(dst)) == host(F.col(BASE)), dst)
    nxt = with_nodes(pages).select(F.col("url").alias("src"), text.let(next_page_url(F.col("url")), stays).alias("dst"))
    return nxt.where(F.col("dst").isNotNull())


def pagination_chain(next_edges: DataFrame, start_url: str, max_pages: int = MAX_PAGES) -> DataFrame:
    """Follow next-page edges from `start_url` until none, a repeat, another host or `max_pages`."""
    home = urls.authority(F.lit(start_url))
    seed = next_edges.sparkSession.range(1).select(F.lit(start_url).alias("url"), F.lit(1).cast("bigint").alias("visit_order"))
    chain = materialize(seed, "chain")
    # Each hop looks up one page; doubling (pages 2^k apart) keeps the rounds logarithmic.
    inside = (urls.authority(F.col("src")) == home) & (urls.authority(F.col("dst")) == home)
    jump = materialize(next_edges.where(inside).groupBy("src").agg(F.min("dst").alias("dst")), "jump")
    reach, found = 1, 1
    while reach < max_pages:
        ahead = jump.join(chain.withColumnRenamed("url", "src"), "src").select(
            F.col("dst").alias("url"), (F.col("visit_order") + reach).alias("visit_order"))
        both = chain.unionByName(ahead).groupBy("url").agg(F.min("visit_order").alias("visit_order"))
        chain = materialize(both.where(F.col("visit_order") <= max_pages), "chain")
        now = chain.count()
        if now == found:
            break
        reach, found = 2 * reach, now
        far = jump.withColumnsRenamed({"src": "_a", "dst": "_b"})
        jump = materialize(jump.join(far, F.col("dst") == F.col("_a")).select("src", F.col("_b").alias("dst")), "jump")
    return chain


def fetch_slots(requests: DataFrame, delay: float, domain: str = "domain", at: str = "arrival",
                tie: str = "request_id", span: float = 3600.0) -> DataFrame:
    """Earliest polite start of every request: two requests to a domain at least `delay` seconds apart.

    With requests numbered k = 0, 1, … per domain by arrival a_k, slot_k = k*d + max(a_j - j*d, j <= k).
    A domain may hold a large share of all requests, so its timeline is cut into spans of `span`
    seconds: numbering and running maximum are local to a span, and spans are chained by their
    (small) totals.
    """
    d = F.lit(float(delay))
    cut = requests.withColumn("_span", F.floor(F.col(at) / span))
    local = Window.partitionBy(domain, "_span").orderBy(at, tie)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = cut.withColumn("_k", F.row_number().over(local) - 1)
    ranked = ranked.withColumn("_m", F.max(F.col(at) - F.col("_k") * d).over(upto))
    # Totals straight from the cut rows would need the local rank again, so they reuse it.
    totals = ranked.groupBy(domain, "_span").agg(F.count("*").alias("_n"), F.max("_m").alias("_top"))
    before = Window.partitionBy(domain).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = totals.withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    spans = spans.withColumn("_prior", F.max(F.col("_top") - F.col("_skip") * d).over(before))
    keyed = spans.select(F.col(domain).alias("_d"), F.col("_span").alias("_s"), "_skip", "_prior")
    joined = ranked.join(keyed, F.col(domain).eqNullSafe(F.col("_d")) & (F.col("_span") == F.col("_s")))
    rank = F.col("_k") + F.col("_skip")
    start = rank * d + F.greatest(F.col("_m") - F.col("_skip") * d, F.coalesce("_prior", F.lit(float("-inf"))))
    return joined.select(*requests.columns, rank.alias("request_rank"), start.alias("slot"))


def crawl_progress(visits: DataFrame, job: str, order_col: str, max_pages: int) -> DataFrame:
    """Percent done after each visited page of a job, up to the job's own page budget (Spark drops later rows before the
    shuffle)."""
    place = F.row_number().over(Window.partitionBy(job).orderBy(order_col))
    numbered = visits.withColumn("current", place).where(F.col("current") <= max_pages)
    return numbered.withColumn("total", F.lit(max_pages)).withColumn(
        "percent", F.round(F.col("current") / max_pages * 100, 1))


def request_activity(requests: DataFrame, domain: str = "domain", at: str = "at", failed: str = "failed") -> DataFrame:
    """Requests, failures and pauses (in seconds) per domain and hour of a whole request log.

    `longest_pause` is between requests of the hour, `pause_before` since the last request before it.  Order is local to an
    hour of a domain; hours are chained by their first and last request, one row each.
    """
    hour = Window.partitionBy(domain, "hour")
    seconds = lambda a, b: F.timestamp_diff("MICROSECOND", a, b) / 1e6
    own = requests.select(domain, F.date_trunc("HOUR", at).alias("hour"), F.col(at).alias("_at"), F.col(failed).alias("_failed"))
    paused = own.withColumn("_pause", seconds(F.lag("_at").over(hour.orderBy("_at")), F.col("_at")))
    rolled = paused.groupBy(domain, "hour").agg(
        F.count("*").alias("requests"), F.count_if("_failed").alias("failures"), F.max("_pause").alias("longest_pause"),
        F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(domain).orderBy("hour"))
    return rolled.withColumn("pause_before", seconds(before, F.col("_first"))).drop("_first", "_last")
