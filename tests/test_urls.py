import ipaddress
import itertools
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators import admission as A

BASES = ["http://a.com", "https://a.com/x/y?q=1#f", "http://a.com/x/y/", "HTTP://A.com/x;p/y;z?k", "http://a.com//x//y"]
HREFS = ["", "x", "./x", "../x", "../../../x", "/x", "//b.com/z", "http://c.com", "HTTPS://C.com/a?", "https://c.com/a/../b", "?z=1", "#top", "x?y#z",
         ";p", "a;b/c", "mailto:a@b", "javascript:void(0)", "a//b", "..", ".", "/a/../b/", "x/..", "/..", "ftp://h/x", "a b", "/x?", "é/ü", "http:x",
         "tel:123", "./", "../", "x/./y/../z"]


def test_resolve_url_equals_urljoin(spark):
    rows = [(b, h, urljoin(b, h)) for b, h in itertools.product(BASES, HREFS)]
    df = spark.createDataFrame(rows, "b string, h string, want string").withColumn("got", U.resolve_url(F.col("b"), F.col("h")))
    assert df.where("NOT (got <=> want)").collect() == []


@pytest.mark.parametrize("url,want", [
    ("HTTP://Shop.Example/Bag/", "http://shop.example/Bag"), ("https://h.example", "https://h.example"), ("https://h.example/", "https://h.example/"),
    (" ftp://H.example/x//?k=V#part ", "ftp://h.example/x?k=V"), ("MAILTO:Me@Host", "mailto:Me@Host"), ("a/b/", "a/b"), ("//Cdn.example/a/", "//cdn.example/a"),
    ("plain words", "plain words"), ("http://u:P@H.example:81/;p=1", "http://u:p@h.example:81/;p=1")])
def test_normalize_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(U.normalize_url(F.col("u")).alias("v")).first().v == want


def test_addresses_of_private_networks_are_refused(spark):
    rows = []
    for network in (ipaddress.ip_network(n) for n in ("10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "0.0.0.0/8", "fc00::/7", "fe80::/10")):
        for address in (network[1], network[network.num_addresses // 2], network[-1]):
            rows.append((f"http://{f'[{address}]' if address.version == 6 else address}/page", False))
        after = network[-1] + 1
        if after.version == 4 and after.is_global:
            rows.append((f"http://{f'[{after}]' if after.version == 6 else after}/page", True))
    rows += [(f"{scheme}://host.example/", scheme in ("http", "https")) for scheme in ("http", "https", "ftp", "file", "gopher", "data")]
    rows += [("http://name:key@host.example/", False), (None, False), ("", False)]
    df = A.screen_urls(spark.createDataFrame(rows, "url string, want boolean"))
    assert [r.url for r in df.where("ok != want").collect()] == []


def test_resolved_hosts(spark):
    df = spark.createDataFrame([("Mixed.example", "192.168.7.7"), ("mixed.example", "8.8.4.4"), ("open.example", "1.1.1.1")], "host string, ip string")
    got = {r.host: (r.blocked, r.blocked_ip) for r in A.screen_hosts(df).collect()}
    assert got == {"mixed.example": (True, "192.168.7.7"), "open.example": (False, None)}


def test_two_robots_files_of_a_host_give_one_verdict(spark):
    files = spark.createDataFrame([("Twice.example", "User-agent: *\nDisallow: /a", 1), ("twice.example", "User-agent: *\nAllow: /", 2)], "host string, body string, seq int")
    links = spark.createDataFrame([("http://twice.example/a",)], "url string")
    for order in ("seq", None):
        got = A.robots_verdict(links, A.robots_rules(files, "x", order_col=order)).collect()
        assert len(got) == 1
    assert A.robots_verdict(links, A.robots_rules(files, "x", order_col="seq")).first().robots_allowed is False


def test_ip_numbers_equal_the_standard_library(spark):
    texts = ["127.0.0.1", "8.8.8.8", "256.1.1.1", "01.2.3.4", "::1", "2001:db8::1", "::ffff:1.2.3.4", "1::2::3", "1:2:3:4:5:6:7", "::", "1:", ":1",
             "2606:4700:0:0:0:0:0:1", "example.com", "fe80::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "g::1"]

    def number(s):
        try:
            ip = ipaddress.ip_address(s)
            return f"{int(ip):032x}" if ip.version == 6 else str(int(ip))
        except ValueError:
            return None
    got = F.coalesce(U.ipv4_number(F.col("t")).cast("string"), U.ipv6_hex(F.col("t")))
    df = spark.createDataFrame([(t, number(t)) for t in texts], "t string, want string").withColumn("got", got)
    assert df.where("NOT (got <=> want)").collect() == []


@pytest.mark.parametrize("url,want", [
    ("http://shop.example/all?sort=up&page=19", "http://shop.example/all?sort=up&page=20"), ("http://shop.example/page/99", "http://shop.example/page/100"),
    ("https://example.org/none", None), ("http://x/a?P=9#t", "http://x/a?P=10#t"), ("http://x/?page=a&p=2", "http://x/?page=a&p=3")])
def test_next_numbered_page(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(U.next_numbered_page(F.col("u")).alias("v")).first().v == want


ROBOTS = """# comment
User-agent: webloom
User-agent: friend
Allow: /a/open
Disallow: /a
Crawl-delay: 3
Sitemap: https://h.example/one.xml

Disallow: /ignored

User-agent: *
Disallow:
SITEMAP:https://h.example/two.xml
User-agent: last
Disallow: /%7Ejoe/
"""


def test_robots_rules_equal_the_standard_library(spark):
    from urllib.robotparser import RobotFileParser
    files = spark.createDataFrame([("h.example", ROBOTS), ("empty.example", "")], "host string, body string")
    paths = ["/", "/a", "/a/open/1", "/a?x=1", "/b", "/ignored", "/~joe/x", "", "/A"]
    parser = RobotFileParser()
    parser.parse(ROBOTS.splitlines())
    for agent in ("WebLoom/1.0", "myfriend", "Other/2", "last"):
        rules = A.robots_rules(files, agent)
        links = spark.createDataFrame([(f"https://h.example{p}",) for p in paths] + [("https://empty.example/a",), ("https://absent.example/a",)], "url string")
        got = {r.url: r.robots_allowed for r in A.robots_verdict(links, rules).collect()}
        for p in paths:
            assert got[f"https://h.example{p}"] == parser.can_fetch(agent, f"https://h.example{p}"), (agent, p)
        assert got["https://empty.example/a"] and got["https://absent.example/a"]
        delay = rules.where("host = 'h.example'").first().crawl_delay
        assert delay == parser.crawl_delay(agent)
    maps = [r.sitemap for r in A.robots_sitemaps(files).orderBy("seq").collect()]
    assert maps == ["https://h.example/one.xml", "https://h.example/two.xml"]


def test_accept_links_gives_the_first_reason(spark):
    links = spark.createDataFrame([("https://h.example/a/x",), ("https://h.example/pic.PNG",), ("https://o.example/",), ("ftp://h.example/",), ("https://h.example/seen",),
                                   ("https://h.example/ok",), ("http://127.0.0.1/",)], "url string")
    seeds, seen = spark.createDataFrame([("https://H.example/",)], "url string"), spark.createDataFrame([("https://h.example/seen",)], "url string")
    rules = A.robots_rules(spark.createDataFrame([("h.example", ROBOTS)], "host string, body string"), "webloom")
    got = {r.url: r.reject_reason for r in A.accept_links(links, seeds, rules, seen).collect()}
    assert got == {"https://h.example/a/x": "robots", "https://h.example/pic.PNG": "asset", "https://o.example/": "other domain", "ftp://h.example/": "unsafe",
                   "https://h.example/seen": "visited", "https://h.example/ok": None, "http://127.0.0.1/": "unsafe"}


def test_redirect_chains(spark):
    hops = [("r1", i, f"https://a.example/{i}") for i in range(5)] + [("r2", i, f"https://a.example/{i}") for i in range(6)] + [("r3", 0, "https://a.example/"), ("r3", 1, "http://10.0.0.1/")]
    got = {r.request_id: (r.requests, r.admitted, r.final_url) for r in A.redirect_chains(spark.createDataFrame(hops, "request_id string, hop int, url string")).collect()}
    assert got == {"r1": (5, True, "https://a.example/4"), "r2": (6, False, "https://a.example/5"), "r3": (2, False, "http://10.0.0.1/")}
