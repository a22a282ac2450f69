import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import crawl as K
from webloom.sources.readers import sitemap_urls

EDGES = [("a", "b"), ("a", "c"), ("a", "b"), ("b", "d"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("c", "z"), ("z", "y")]


def fifo(edges, seeds, max_depth, max_pages, known=None):
    """The crawl loop in plain Python: sorted links, first come first served."""
    links = {}
    for s, d in edges:
        links.setdefault(s, set()).add(d)
    queue, seen = list(seeds), []
    while queue and len(seen) < max_pages:
        url, depth = queue.pop(0)
        if url in [u for u, _ in seen]:
            continue
        seen.append((url, depth))
        if depth < max_depth and (known is None or url in known):
            queue += [(d, depth + 1) for d in sorted(links.get(url, ()))]
    return seen


def run(spark, edges, seeds, max_depth, max_pages, known=None):
    e = spark.createDataFrame(edges, "src string, dst string")
    s = spark.createDataFrame([(u, d, i) for i, (u, d) in enumerate(seeds)], "url string, depth int, seq int")
    k = None if known is None else spark.createDataFrame([(u,) for u in known], "url string")
    return [(r.url, r.depth) for r in K.bfs(e, s, max_depth, max_pages, k).orderBy("visit_order").collect()]


@pytest.mark.parametrize("depth,pages", [(2, 10), (3, 4), (0, 5), (5, 100), (1, 2)])
def test_bfs_follows_the_queue(spark, depth, pages):
    assert run(spark, EDGES, [("a", 0)], depth, pages) == fifo(EDGES, [("a", 0)], depth, pages)


def test_bfs_with_sitemap_seeds_and_failed_pages(spark):
    seeds = [("a", 0), ("d", 1), ("e", 1)]
    assert run(spark, EDGES, seeds, 2, 20) == fifo(EDGES, seeds, 2, 20)
    known = ["a", "b", "d"]
    assert run(spark, EDGES, seeds, 3, 20, known) == fifo(EDGES, seeds, 3, 20, known)


def test_bfs_on_random_graphs_with_a_hub(spark):
    rng = random.Random(5)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = [("n00", n) for n in nodes] + [(rng.choice(nodes), rng.choice(nodes)) for _ in range(80)]
    seeds = [("n07", 0), ("n00", 0)]
    for pages in (9, 30):
        assert run(spark, edges, seeds, 3, pages) == fifo(edges, seeds, 3, pages)


def test_the_callers_budget_holds(spark):
    edges = [("s", f"p{i:04d}") for i in range(900)]
    assert len(run(spark, edges, [("s", 0)], 2, 10_000)) == 901
    assert len(run(spark, edges, [("s", 0)], 2, 800)) == 800
    chain = [(f"n{i}", f"n{i + 1}") for i in range(14)]
    assert len(run(spark, chain, [("n0", 0)], 12, 100)) == 13


def test_start_urls_come_before_sitemap_urls(spark):
    maps = spark.createDataFrame([("x", 0), ("y", 2)], "url string, seq int")
    late = spark.createDataFrame([("s", 5_000_000)], "url string, seq int")
    order = K.with_sitemap_seeds(late, maps, 3, lambda links: links.where("url <> 'y'")).orderBy("seq").collect()
    assert [r.url for r in order] == ["s", "x"]


def test_sitemap_seeds_only_join_a_lone_start(spark):
    maps = spark.createDataFrame([("x", 0), ("s", 1), ("y", 2)], "url string, seq int")
    one = spark.createDataFrame([("s", 0)], "url string, seq int")
    two = spark.createDataFrame([("s", 0), ("t", 1)], "url string, seq int")
    assert sorted((r.url, r.depth) for r in K.with_sitemap_seeds(one, maps, 3).collect()) == [("s", 0), ("x", 1), ("y", 1)]
    assert sorted(r.url for r in K.with_sitemap_seeds(two, maps, 3).collect()) == ["s", "t"]
    assert sorted(r.url for r in K.with_sitemap_seeds(one, maps, 1).collect()) == ["s"]


def test_sitemaps(spark):
    good = '<?xml version="1.0"?><urlset xmlns="http://x"><url><loc> https://a.example/1?x=1&amp;y=2 </loc></url><url><loc>ftp://no</loc></url><url><loc>http://a.example/2</loc></url></urlset>'
    index = '<m:sitemapindex xmlns:m="http://x"><m:sitemap><m:loc>https://b.example/s.xml</m:loc></m:sitemap></m:sitemapindex>'
    rows = [("a", 0, 404, "text/xml", good), ("a", 1, 200, "text/xml", "<urlset><loc>http://bad"), ("a", 2, 200, "text/plain", good),
            ("b", 0, 200, "application/xml", index), ("b", 1, 200, "text/xml", good), ("c", 0, 200, "text/html", "<html></html>"), ("d", 3, 200, "text/xml", good)]
    got = sitemap_urls(spark.createDataFrame(rows, "site string, seq int, status int, content_type string, body string"), most=3)
    assert [(r.site, r.url) for r in got.orderBy("site", "position").collect()] == [
        ("a", "https://a.example/1?x=1&y=2"), ("a", "http://a.example/2"), ("b", "https://b.example/s.xml")]


def test_pagination_chain(spark):
    link = lambda i: f"https://h.example/p{i}"
    edges = [(link(i), link(i + 1)) for i in range(1, 30)] + [(link(30), link(4)), ("https://o.example/1", link(1))]
    df = spark.createDataFrame(edges, "src string, dst string")
    chain = [r.url for r in K.pagination_chain(df, link(1), 100).orderBy("visit_order").collect()]
    assert chain == [link(i) for i in range(1, 31)]
    assert [r.url for r in K.pagination_chain(df, link(28), 5).orderBy("visit_order").collect()] == [link(i) for i in (28, 29, 30, 4, 5)]
    assert [r.url for r in K.pagination_chain(df, "https://o.example/1", 5).collect()] == ["https://o.example/1"]


def test_next_page_edges_stay_on_the_host(spark):
    rows = [("https://a.example/1", '<a rel="next" href="/2">x</a>', "https://a.example/2"),
            ("https://a.example/2", '<a rel="next" href="https://b.example/3">x</a>', None),
            ("https://a.example/list?page=2", '<a href="https://b.example/3">Next</a>', None),      # no counted page instead
            ("https://a.example/list?page=3", "<p>", "https://a.example/list?page=4"),
            ("https://b.a.example/4", '<a class="next" href="https://a.example/5">x</a>', None),
            ("https://a.example/5", '<a rel="next" href="https://a.example:444/6">x</a>', None),
            (" https://A.example/6\n", '<a rel="next" href="http://a.EXAMPLE/7">x</a>', "http://a.EXAMPLE/7"),
            ("https://a.example/7", "<p>", None)]
    pages = spark.createDataFrame([r[:2] for r in rows], "url string, html string")
    got = {(r.src, r.dst) for r in K.next_page_edges(pages).collect()}
    assert got == {(url, dst) for url, _, dst in rows if dst}


def test_fetch_slots_equal_the_loop(spark):
    rng = random.Random(2)
    asks = [(i, rng.choice("aaab"), rng.uniform(0, 400)) for i in range(300)]
    want, last = {}, {}
    for i, d, at in sorted(asks, key=lambda x: (x[2], x[0])):
        last[d] = max(at, last.get(d, float("-inf")) + 1.5)
        want[i] = last[d]
    df = spark.createDataFrame(asks, "request_id int, domain string, arrival double")
    for span in (10.0, 10_000.0):
        got = {r.request_id: r.slot for r in K.fetch_slots(df, 1.5, span=span).collect()}
        assert got == pytest.approx(want)


def test_progress_stops_at_the_limit(spark):
    df = spark.createDataFrame([("j", i) for i in range(20)], "job string, n int")
    rows = K.crawl_progress(df, "job", "n", 8).orderBy("current").collect()
    assert [r.percent for r in rows] == [12.5, 25.0, 37.5, 50.0, 62.5, 75.0, 87.5, 100.0]


def test_link_graph_filters(spark):
    from webloom.operators.admission import accept_links
    pages = spark.createDataFrame([("https://a.example/", '<a href="/x">x</a><a href="/y.pdf">y</a><a href="https://b.example/">b</a><a href="#t">t</a>')], "url string, html string")
    seeds = pages.select("url")
    got = K.link_graph(pages, lambda links: accept_links(links, seeds).where("reject_reason IS NULL")).collect()
    assert [tuple(r) for r in got] == [("https://a.example/", "https://a.example/x")]
