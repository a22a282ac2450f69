import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.functions import selectors as S
from webloom.functions.html import parse_html
from webloom.functions.xpath import xpath
from webloom.model import RuleError, SelectorRule
from webloom.operators import extraction as X

FERRY = """<html lang="en"><head><title> Ferry   times </title><meta name="keywords" content="boats, tides"><meta property="og:site_name" content="Harbour">
<script type="application/ld+json">{"@type":"BoatTrip","provider":"Quay Lines","seats":42,"cancelled":false}</script></head>
<body><section id="board"><h3>Departures</h3><dl data-quay="north"><dt>Isle of Rum</dt><dd><time>06:40</time> berth <b>4</b></dd><dt>Eigg</dt><dd><time>09:15</time> berth <b>11</b></dd></dl>
<dl data-quay="south"><dt>Muck</dt><dd><time>12:05</time> berth <b>2</b></dd></dl></section>
<nav><a rel="home" href="../start?from=board">start</a><a href="tickets/day.html#fares">day tickets</a></nav><h1>Sailing today</h1></body></html>"""
MUSEUM = """<title>Room 5</title><link rel="canonical" href="/rooms/5/"><meta name="description" content="Coins and seals"><h1>Coins</h1><h2>Silver</h2>
<div itemprop="price">EUR 7,50</div><img src="plan.gif" alt=" floor plan "><img alt="no source">
<table><tr><td>obol<table><tr><td>Attic</td></tr></table></td><td>430 BC</td></tr></table>
<script type="application/ld+json">[{"room":5},{"floor":2}]</script><script type="application/ld+json">{"open":</script>
<main><p>Owls</p><li>a</li><p>and bees</p></main><a class="fwd" rel="next" href="/rooms/6/">on</a>"""
BROKEN = """<div><p>one<b>two<p>three</i></div><!-- <p>no</p> --><script>var a = "</p>";</script><br/><ul><li>a<li>b</ul>"""


HOME = "https://ferry.example/today/board"
ROOM = "https://museum.example/rooms/5"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(HOME, FERRY, 200), (ROOM, MUSEUM, 200), ("https://example.net/broken", BROKEN, 200),
            ("https://example.net/gone", "<p>gone</p>", 404), ("https://example.net/null", None, 200)]
    return spark.createDataFrame(rows, "url string, html string, status_code int").repartition(2)


def values(pages, url, expression):
    return X.with_nodes(pages).where(F.col("url") == url).select(expression.alias("v")).first().v


@pytest.mark.parametrize("selector,want", [
    ("dt", ["Isle of Rum", "Eigg", "Muck"]), ("#board > h3", ["Departures"]), ("dl[data-quay] > dd b", ["4", "11", "2"]), ("[data-quay^=sou] time", ["12:05"]),
    ("dl[data-quay*='ORT' i] dt", ["Isle of Rum", "Eigg"]), ("h3, nav a, h1", ["Departures", "start", "day tickets", "Sailing today"]),
    ("dl:last-child dt", ["Muck"]), ("a:not([rel])", ["day tickets"]), ("dt + dd b", ["4", "11", "2"]), ("dt ~ dt", ["Eigg"]), ("dl:nth-child(2) time", ["06:40", "09:15"]),
    ("dt:first-of-type", ["Isle of Rum", "Muck"]), ("section * time", ["06:40", "09:15", "12:05"]), ("a[rel~=home]", ["start"]), ("dl:only-child", [])])
def test_css(pages, selector, want):
    got = values(pages, HOME, F.transform(S.css(selector, F.col("_nodes")), lambda n: S.node_text(F.col("_nodes"), n)))
    assert got == want


@pytest.mark.parametrize("path,want", [
    ("//dl[@data-quay='south']/dt", ["Muck"]), ("//dl/dt[2]", ["Eigg"]), ("/html/body/section/dl[1]/dd/b", ["4", "11"]), ("//h3/text()", ["Departures"]),
    ("//nav/a/@href", ["https://ferry.example/start?from=board", "https://ferry.example/today/tickets/day.html#fares"]),
    ("//a[starts-with(@rel,'ho')]", ["start"]), ("//section[@id]//time", ["06:40", "09:15", "12:05"])])
def test_xpath(pages, path, want):
    attribute = "href" if path.endswith("@href") else None
    rule = SelectorRule("v", path, "xpath", attribute_name=attribute, is_multiple=True)
    assert values(pages, HOME, X.rule_value(rule)) == want



LEDGER = """<html><body><div id="a" class="x"><p>one</p><p lang="en">two <b>bold</b></p><!-- note --><p>three</p><ul><li>1</li><li>2</li><li>3</li><li>4</li><li>5</li></ul></div>
<div id="b"><p> four  4 </p><span>s</span><ul><li>10</li><li>20</li></ul><i></i><i> </i></div><a href="/k" title="T(a,b)">L</a></body></html>"""


def on_ledger(spark, kind, selectors):
    page = X.with_nodes(spark.createDataFrame([("http://h.example/x", LEDGER)], "url string, html string"))
    row = page.select(*[X.rule_value(SelectorRule("v", s, kind, is_multiple=True)).alias(f"v{i}") for i, s in enumerate(selectors)]).first()
    return dict(zip(selectors, row, strict=True))


XPATHS = {
    "//p/following-sibling::p": ["two bold", "three"], "//li/ancestor::div/@id": ["a", "b"], "//div[@id='b']/preceding-sibling::div/p[1]": ["one"], "//b/..": ["two bold"],
    "//p[last()]": ["three", "four  4"], "//p[position()<3]": ["one", "two bold", "four  4"], "//ul/li[position()=last()-1]": ["4", "10"], "//p[contains(text(),'t')]": ["two bold", "three"],
    "//p[text()='one' or @lang='en']": ["one", "two bold"], "//p[text()='one' and @lang]": [], "//span | //b | //a": ["bold", "s", "L"], "//li[.>4]": ["5", "10", "20"],
    "//li[number(.)*2=20]": ["10"], "(//li)[6]": ["10"], "(//li)[last()]": ["20"], "//div[ul/li='20']/@id": ["b"], "//div[count(ul/li)>2]/@id": ["a"], "//a/@*": ["/k", "T(a,b)"],
    "//div[@id='b']//text()": ["four  4", "s", "10", "20", ""], "//li[preceding-sibling::li[1]='2']": ["3"], "//span/following::li": ["10", "20"], "//span/preceding::p[1]": ["four  4"],
    "//b/ancestor::*[1]": ["two bold"], "//b/ancestor-or-self::*[2]": ["two bold"], "//div/descendant::li[2]": ["2", "20"], "/html/body/div[2]/ul/li[2]": ["20"], "body/div/span": ["s"],
    "//li[position() mod 2 = 0]": ["2", "4", "20"], "//a/@href | //div/@id": ["a", "b", "/k"], "//p[@lang='en']/node()": ["two", "bold"], "//div[.//b]/@class": ["x"], "//comment()": ["note"],
    "//li[not(following-sibling::*)]": ["5", "20"], "//a[@href='/k']/self::a": ["L"], "//li[3][.='3']": ["3"], "//li[.='3'][1]": ["3"], "//p[2]/preceding-sibling::*": ["one"]}
SCALARS = {
    "count(//li)": ["7.0"], "string(//p[2])": ["two bold"], "normalize-space(//div[@id='b']/p)": ["four 4"], "name(//*[@title])": ["a"], "sum(//li)": ["45.0"], "concat('a','-',//b)": ["a-bold"],
    "substring('12345',2,3)": ["234"], "substring('12345', 1.5, 2.6)": ["234"], "substring-before('a=b','=')": ["a"], "substring-after('a=b=c','=')": ["b=c"], "translate('bar','abc','AB')": ["BAr"],
    "boolean(//zzz)": ["False"], "count(//li) > 4": ["True"], "7 div 2": ["3.5"], "-(1) + 2 * 3": ["5.0"], "string-length(//b)": ["4.0"], "round(2.5)": ["3.0"], "//zzz = 'a'": ["False"],
    "not(//b)": ["False"], "starts-with(//span, 's')": ["True"]}


def test_xpath_axes_predicates_and_unions(spark):
    assert on_ledger(spark, "xpath", list(XPATHS)) == XPATHS


def test_xpath_scalars_are_one_item_lists(spark):
    assert on_ledger(spark, "xpath", list(SCALARS)) == SCALARS


@pytest.mark.parametrize("path", ["//p[", "//p/@x/y", "id('a')", "//p[position(]", "", "//", "count()", "//p[foo::a]", "count('a')", "position()", "'a' | //b", "//p)", "//@x[1]"])
def test_bad_xpaths_are_reported(path):
    with pytest.raises(RuleError):
        xpath(path, F.col("n"))


CSS_MORE = {
    "li:nth-child(2n+1)": ["1", "3", "5", "10"], "li:nth-child(even)": ["2", "4", "20"], "li:nth-child(-n+2)": ["1", "2", "10", "20"], "li:nth-child(n+4)": ["4", "5"], "li:nth-child(3n - 1)": ["2", "5", "20"],
    "li:nth-child(-2)": [], "li:nth-of-type(0n+3)": ["3"], "li:nth-last-child(-n+2)": ["4", "5", "10", "20"], "p:last-of-type": ["three", "four  4"], "p:nth-last-of-type(2)": ["two bold"],
    "span:only-of-type": ["s"], "div:has(> b) p": [], "div:has(> p > b) b": ["bold"], "div:has(span, b) > p:first-child": ["one", "four  4"], "p:has(+ p)": ["one", "two bold"], "p:has(~ span)": ["four  4"],
    "div:has(li:nth-child(3)) > p": ["one", "two bold", "three"], "p:is(:first-child, [lang])": ["one", "two bold", "four  4"], "p:not(div#a p)": ["four  4"], "p:not([lang], :first-child)": ["three"],
    "p:not(:has(b))": ["one", "three", "four  4"], "i:empty": ["", ""], ":root > body > div:first-child p[lang]": ["two bold"], "p:-soup-contains('bold')": ["two bold"], "a:is([title='T(a,b)'])": ["L"],
    "li:where(#b li)": ["10", "20"], "p:is(div > p + p)": ["two bold", "three"], "body:has(a, zzz) > a": ["L"]}


def test_css_relative_counted_and_listed(spark):
    assert on_ledger(spark, "css", list(CSS_MORE)) == CSS_MORE


@pytest.mark.parametrize("selector", ["[", "a[href=", "a >", "", "a,,b", "a::before", "a:hover", "p:has()", "p:nth-child(x)", "p:not(", "li:nth-child(1 of p)", "p:is(a,,b)"])
def test_bad_selectors_are_reported(selector):
    with pytest.raises(RuleError):
        S.css(selector, F.col("n"))


def test_rules(pages):
    rules = [SelectorRule("head", "section h3"), SelectorRule("ports", "dt", is_multiple=True), SelectorRule("start", "a[rel]", extract_type="attr", attribute_name="href"),
             SelectorRule("line", "provider", "jsonld"), SelectorRule("off", "cancelled", "jsonld"), SelectorRule("seats", "seats", "jsonld"),
             SelectorRule("berths", "dd", regex_pattern=r"berth (\d+)", is_multiple=True), SelectorRule("gap", "aside", default_value="-"),
             SelectorRule("gaps", "aside", is_multiple=True, default_value="-"), SelectorRule("nothing", "aside", is_multiple=True),
             SelectorRule("bad", "[", default_value="?"), SelectorRule("kind", "x", "regex", default_value="k")]
    got = {r.url: r for r in X.extract(pages, rules).collect()}
    d = got[HOME].data
    assert (d.head, d.ports, d.start) == ("Departures", ["Isle of Rum", "Eigg", "Muck"], "https://ferry.example/start?from=board")
    assert (d.line, d.off, d.seats, d.berths) == ("Quay Lines", "False", "42", ["4", "11", "2"])
    assert (d.gap, d.gaps, d.nothing, d.bad, d.kind) == ("-", ["-"], [], "?", "k")
    assert got["https://example.net/gone"].data is None and got["https://example.net/gone"].error == "HTTP status 404"
    assert got["https://example.net/null"].data.head is None


def test_record_list_then_clean(pages):
    from webloom.operators.clean import clean
    records = X.extract_records(pages, "dl", [SelectorRule("port", "dt"), SelectorRule("berth", "dd b")])
    rows = clean(records, [{"field_name": "berth", "action": "to_int"}]).orderBy("record_index").collect()
    assert [(r.port, r.berth) for r in rows] == [("Isle of Rum", 4), ("Muck", 2)]


def test_generic_fields(pages):
    got = {r.url: r for r in X.describe_pages(pages).collect()}
    m = got[ROOM]
    assert (m.title, m.headings, m.links) == ("Room 5", ["Coins", "Silver"], ["https://museum.example/rooms/6/"])
    assert [(i.url, i.alt) for i in m.images] == [("https://museum.example/rooms/plan.gif", "floor plan")]
    assert m.tables == [[["obol Attic", "Attic", "430 BC"], ["Attic"]], [["Attic"]]]
    assert (m.metadata.description, m.metadata.canonical) == ("Coins and seals", "https://museum.example/rooms/5/")
    assert m.structured_data == ['[{"room":5},{"floor":2}]', '{"open":']
    assert got[HOME].metadata.open_graph == {"site_name": "Harbour"} and got[HOME].metadata.keywords == "boats, tides"
    assert got["https://example.net/null"].title == "https://example.net/null"


def test_json_ld_is_flattened_and_bad_scripts_skipped(pages):
    assert values(pages, ROOM, X.json_ld()) == ['{"room":5}', '{"floor":2}']


def test_tree_rules_for_broken_markup(pages):
    url = "https://example.net/broken"
    text = lambda s: values(pages, url, F.transform(S.css(s, F.col("_nodes")), lambda n: S.node_text(F.col("_nodes"), n)))
    assert text("div") == ["one two three"] and text("p") == ["one two three", "three"] and text("li") == ["a b", "b"]
    assert text("script") == ['var a = "</p>";']
    markup = values(pages, url, F.transform(S.css("div, ul", F.col("_nodes")), lambda n: S.outer_html(F.col("_nodes"), n)))
    assert markup == ["<div><p>one<b>two<p>three</p></b></p></div>", "<ul><li>a<li>b</li></li></ul>"]


def test_broken_declarations_lose_nothing(spark):
    rows = [("https://a.example/", "<p>1</p><![>a<p>2</p><!doctype html><h1>3</h1>"), ("https://b.example/", "<![if x]><p>4</p><![endif]><!-- <p>5</p> --><p>6</p>")]
    found = X.with_nodes(spark.createDataFrame(rows, "url string, html string")).select(
        "url", F.transform(S.css("p, h1", F.col("_nodes")), lambda n: S.node_text(F.col("_nodes"), n)).alias("v"))
    assert {r.url[8]: r.v for r in found.collect()} == {"a": ["1", "2", "3"], "b": ["4", "6"]}


def test_custom_fields(pages):
    got = X.custom_fields(pages, {"Fee": "[itemprop]", "Ports": "dt"}).where(F.col("url") == ROOM)
    row = got.select(X.single_or_list(F.col("Fee")).alias("Fee"), X.single_or_list(F.col("Ports")).alias("Ports")).first()
    assert (row.Fee, row.Ports) == ("EUR 7,50", "[]")
    with pytest.raises(RuleError):
        X.custom_fields(pages, {"Fee": "["})


def test_next_page(pages, spark):
    assert values(pages, ROOM, X.next_page_url(F.col("url"))) == "https://museum.example/rooms/6/"
    more = spark.createDataFrame([("https://a.example/x", '<a href="/q">q</a><a href="/n#z"> Next page </a>'), ("https://a.example/list?page=4", "<p>"),
                                  ("https://a.example/none", "<p>")], "url string, html string")
    got = {r.url: r.v for r in X.with_nodes(more).select("url", X.next_page_url(F.col("url")).alias("v")).collect()}
    assert got == {"https://a.example/x": "https://a.example/n", "https://a.example/list?page=4": "https://a.example/list?page=5", "https://a.example/none": None}


def test_rule_trial_and_schema_suggestions(pages):
    tried = X.try_rules(pages, [SelectorRule("port", "dt", is_multiple=True), SelectorRule("bad", "[", is_multiple=True)])
    got = {r.field_name: r for r in X.rule_coverage(tried, top=2).collect()}
    assert (got["port"].match_count, got["port"].pages_hit, got["port"].sample_values, got["port"].is_valid) == (3, 1, ["Isle of Rum", "Eigg"], True)
    assert got["bad"].is_valid is False and got["bad"].error_message
    suggested = {r.url: r.proposed_fields for r in X.suggest_schema(pages, "name, time and cost").collect()}
    assert [(p.field_name, p.selector) for p in suggested[HOME]] == [("title", "h1")]
    assert [(p.field_name, p.sample_value) for p in suggested[ROOM]] == [("title", "Coins"), ("price", "EUR 7,50")]
    guessed = X.suggest_schema(pages, "Extract berths, tides. from the harbour page and every single island").where(F.col("url") == HOME).first()
    assert [p.field_name for p in guessed.proposed_fields] == ["berths", "tides", "harbour", "every", "single", "island"]
    few = X.suggest_schema(pages, "berths tides harbour", guesses=2).first().proposed_fields
    assert [(p.selector, p.confidence) for p in few] == [(".berths", 0.6), (".tides", 0.6)]


def test_one_parse_per_page(pages):
    plan = X.describe_pages(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    listed = X.table_cells(pages)._jdf.queryExecution().executedPlan().toString()
    assert listed.count("ArrowEvalPython") == 1


def test_parse_agrees_across_partitions(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    digest = lambda df: df.select(F.xxhash64(F.to_json(parse_html(F.col("html")))).alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)"))).first()[0]
    assert digest(pages.repartition(1)) == digest(pages.repartition(8))


def test_product_pages_are_made_by_many_tasks(spark, folder):
    """The parts lie in one row group, which one task reads; the pages are parsed by many."""
    from webloom.plans import derived
    pages = derived.product_pages(spark, folder)
    counts = pages.groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) >= spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in counts) <= 2 * min(r["count"] for r in counts)


def test_filters_do_not_repeat_the_parse(spark, folder):
    """What is read off the nodes and filtered, or exploded, is parsed once, and behind the exchange that deals the rows."""
    from webloom.plans.catalog import QUERIES
    for name in ("k04_next_page_edges", "x25_page_proposals", "x21_record_list"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython ") == 1, name
        assert plan.index("ArrowEvalPython ") < plan.index("Exchange RoundRobinPartitioning"), name

def test_plain_markup_is_read_without_the_library(spark, folder, monkeypatch):
    """What the library costs per tag was most of the parse; it is left to odd places."""
    from webloom.functions import html
    from webloom.plans import derived
    pages = derived.product_pages(spark, folder).select("html").limit(50).union(spark.read.parquet(f"{folder}/pages.parquet").select("html").limit(50))
    texts = [r["html"] for r in pages.collect()]

    def refuse(*_):
        raise RuntimeError("the library was asked")
    monkeypatch.setattr(html._Flattener, "feed", refuse)
    assert len(html._parse_batch(pa.array(texts))) == 100


_ODD = ["<", ">", '"', "'", "=", "/", " ", "a", "&amp;", "&", "<p", "<p>", "</p>", "<br/>", "<br />", "<script>", "</SCRIPT >", "<style>x</style>", "<!--", "-->", "-- >",
        "<!doctype html>", "<!x>", "<![if]>", "<?pi>", "<a href=x/>", '<a href="x" b>', "<A HREF='q&amp;'>", '<td headers=" x  y">', "\x00", "\xa0", "é", "<textarea>",
        "</textarea>", "<p/x>", '<p x=y"z>', "<a a=1 a=2>", "</ p>", "</p x>", "</>", "<3", "<p\x0b>", "<p a= b>", "<p a==b>", "<p é=1>", '<img src="a>b" alt>', "<template>",
        '<x-y:z.w_1 q.w:e-r="1">', "<script/>", '<a b="c"d="e">', "<p =x>", "\r\n", "<p a=\xa0b>"]


def test_plain_markup_is_read_as_the_library_reads_it(monkeypatch):
    from webloom.functions import html
    rng = random.Random(7)
    docs = pa.array(["".join(rng.choices(_ODD, k=rng.randint(1, 14))) for _ in range(3000)])
    found = html._parse_batch(docs)

    def library(self, doc):
        self.feed(doc)
        self.close()
    monkeypatch.setattr(html._Flattener, "read", library)
    assert found.equals(html._parse_batch(docs))


_PARSED_ONCE = [
    "x22_custom_fields",
    "x19_regex_filter",
    "k04_next_page_edges",
    "x09_table_cells",
    "x16_xpath",
    "x13_structured_data",
    "x23_try_rules",
    "x12_open_graph",
    "x21_record_list",
    "x25_suggest_schema",
    "x07_link_details",
    "x14_css_single",
    "x16_xpath_unions",
    "x27_extract",
    "x15_css_multiple",
    "x17_json_ld_field",
    "x01_meta_tags",
]


@pytest.mark.parametrize("name", _PARSED_ONCE)
def test_product_pages_are_parsed_once_behind_the_exchange(spark, folder, name):
    from webloom.plans.catalog import QUERIES
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython ") == 1
    assert plan.index("ArrowEvalPython ") < plan.rindex("Exchange RoundRobinPartitioning")


def test_plain_markup_takes_no_call_per_node(spark, folder):
    """What is called per node, in Python, is most of what a parse costs."""
    import sys

    from webloom.functions import html
    from webloom.plans import derived
    texts = pa.array([r["html"] for r in derived.product_pages(spark, folder).select("html").limit(50).collect()])
    calls = 0

    def count(frame, event, _):
        nonlocal calls
        calls += event == "call"
    html._parse_batch(texts)
    sys.setprofile(count)
    try:
        nodes = html._parse_batch(texts)
    finally:
        sys.setprofile(None)
    assert calls < len(nodes.flatten())


def test_a_document_that_stops_the_library_half_way_leaves_no_nodes_behind():
    from webloom.functions import html
    good, bad = "<p class=' a  b '>1<br></p>", "<p>x<b y=1>z</b><![if"
    alone = html._parse_batch(pa.array([good]))
    for docs in ([bad, good], [good, bad]):
        found = html._parse_batch(pa.array(docs))
        assert found.slice(docs.index(good), 1).equals(alone)
        assert found.slice(docs.index(bad), 1).equals(html._parse_batch(pa.array([bad])))
