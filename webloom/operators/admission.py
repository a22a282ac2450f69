"""Which urls may be requested: safety, domain, asset, robots and redirect rules as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text, urls

MAX_REQUESTS = 5          # a chain of requests, redirects included


def _with_url_parts(df: DataFrame, url_col: str) -> DataFrame:
    """Scheme, host and authority as columns: every later test reads them instead of the url."""
    u = text.strip(F.col(url_col))
    return df.withColumns({"_scheme": urls.scheme_of(u), "_host": urls.hostname(u), "_site": urls.authority(u)})


def screen_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add `ok` and `reason` from the url text alone (scheme, host, user-info, literal address)."""
    host = F.col("_host")
    literal = F.when(urls.is_blocked_ip(host), F.concat(
        F.lit("Host '"), host, F.lit("' resolved to blocked/private address '"), host, F.lit("'.")))
    parts = df if "_host" in df.columns else _with_url_parts(df, url_col)
    reason = F.coalesce(urls.refusal_of(F.col(url_col), F.col("_scheme"), host, F.col("_site")), literal)
    return parts.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).select(*df.columns, "ok", "reason")


def screen_hosts(resolved: DataFrame, host_col: str = "host", ip_col: str = "ip") -> DataFrame:
    """Per host of a (host, ip) resolution table: whether any address is refused, and the first such.

    `min` combines in the map tasks, so a host with very many addresses is no hot group."""
    bad = F.coalesce(urls.is_blocked_ip(F.split_part(ip_col, F.lit("%"), F.lit(1))), F.lit(True))
    return resolved.groupBy(F.lower(host_col).alias(host_col)).agg(
        F.bool_or(bad).alias("blocked"), F.min(F.when(bad, F.col(ip_col))).alias("blocked_ip"))


def same_domain(links: DataFrame, seeds: DataFrame, url_col: str = "url", seed_col: str = "url") -> DataFrame:
    """Links whose authority is one of the seeds' authorities."""
    allowed = seeds.select(urls.authority(F.col(seed_col)).alias("_site")).where(F.col("_site") != "").distinct()
    return links.withColumn("_site", urls.authority(F.col(url_col))).join(allowed, "_site", "left_semi").drop("_site")


def robots_rules(files: DataFrame, agent: str, host_col: str = "host", body_col: str = "body", order_col: str | None = None) -> DataFrame:
    """The rules that bind `agent`, one row per host: rules ARRAY<STRUCT<allow, prefix>> in file
    order (null when no group applies), crawl_delay.  Of several files of a host the first by `order_col` counts (by its text
    without one).

    A robots file is bounded by the size a reader accepts, so its lines are numbered and carried
    forward inside the row; nothing is shuffled.
    """
    name = agent.split("/")[0].lower()

    def parse(line: Column) -> Column:
        bare = text.strip(F.regexp_replace(line, "#.*$", ""))
        key = F.when(bare.contains(":"), F.lower(text.strip(F.split_part(bare, F.lit(":"), F.lit(1))))).otherwise("")
        value = urls.percent_decode(text.strip(F.regexp_replace(bare, "^[^:]*:", "")))
        kind = (F.when(line == "", "blank").when(key == "user-agent", "agent")
                .when(key.isin("allow", "disallow", "crawl-delay", "request-rate"), key))
        return F.struct(kind.alias("kind"), value.alias("value"))
    lines = F.split(F.regexp_replace(F.col(body_col), "\r\n?", "\n"), "\n", -1)
    marks = F.filter(F.transform(lines, parse), lambda m: m["kind"].isNotNull())

    # Fold lines into groups; `open` is 0 before a group, 1 in its agent lines, 2 in its rules.
    rule_type = "array<struct<allow:boolean,prefix:string>>"
    group = f"struct<agents:array<string>,rules:{rule_type},delay:int>"
    none = F.lit(None).cast(group)
    start = F.struct(F.lit(0).alias("open"), none.alias("cur"), F.array().cast(f"array<{group}>").alias("done"))

    def state(open_: Column, cur: Column, done: Column) -> Column:
        return F.struct(open_.alias("open"), cur.alias("cur"), done.alias("done"))

    def flush(a: Column) -> Column:
        return F.when(a["open"] == 2, F.array_append(a["done"], a["cur"])).otherwise(a["done"])

    def step(a: Column, m: Column) -> Column:
        fresh = F.struct(F.array(m["value"]).alias("agents"), F.array().cast(rule_type).alias("rules"),
                         F.lit(None).cast("int").alias("delay"))
        more = F.struct(F.array_append(a["cur"]["agents"], m["value"]).alias("agents"),
                        a["cur"]["rules"].alias("rules"), a["cur"]["delay"].alias("delay"))
        rule = F.struct((m["kind"].eqNullSafe("allow") | (m["value"] == "")).alias("allow"), m["value"].alias("prefix"))
        ruled = F.struct(a["cur"]["agents"].alias("agents"), F.array_append(a["cur"]["rules"], rule).alias("rules"),
                         a["cur"]["delay"].alias("delay"))
        delayed = F.struct(a["cur"]["agents"].alias("agents"), a["cur"]["rules"].alias("rules"),
                           F.coalesce(m["value"].try_cast("int"), a["cur"]["delay"]).alias("delay"))
        return (F.when(m["kind"] == "blank", state(F.lit(0), none, flush(a)))
                .when((m["kind"] == "agent") & (a["open"] == 1), state(F.lit(1), more, a["done"]))
                .when(m["kind"] == "agent", state(F.lit(1), fresh, flush(a)))
                .when(a["open"] == 0, a)
                .when(m["kind"].isin("allow", "disallow"), state(F.lit(2), ruled, a["done"]))
                .when(m["kind"] == "crawl-delay", state(F.lit(2), delayed, a["done"]))
                .otherwise(state(F.lit(2), a["cur"], a["done"])))
    groups = F.aggregate(marks, start, step, flush)

    def star(g: Column) -> Column:
        return F.array_contains(g["agents"], "*")

    def mine(g: Column) -> Column:
        return F.exists(g["agents"], lambda a: F.lit(name).contains(F.lower(a)))
    chosen = text.let(groups, lambda gs: F.coalesce(
        F.get(F.filter(gs, lambda g: ~star(g) & mine(g)), F.lit(0)), F.get(F.filter(gs, star), F.lit(0))))
    files = files.groupBy(F.lower(host_col).alias(host_col)).agg(F.min_by(body_col, F.col(order_col or body_col)).alias(body_col))
    picked = files.select(host_col, chosen.alias("_g"))
    return picked.select(host_col, F.col("_g.rules").alias("rules"), F.col("_g.delay").alias("crawl_delay"))


def _sitemap_lines(body: Column) -> Column:
    lines = F.split(F.regexp_replace(F.coalesce(body, F.lit("")), "\r\n?", "\n"), "\n", -1)
    named = F.filter(lines, lambda l: F.lower(text.strip(l)).startswith("sitemap:"))
    return F.filter(F.transform(named, lambda l: text.strip(F.regexp_replace(l, "^[^:]*:", ""))), lambda v: v != "")


def robots_sitemaps(files: DataFrame, host_col: str = "host", body_col: str = "body") -> DataFrame:
    """`Sitemap:` lines of robots files: (host, seq, sitemap)."""
    rows = files.select(host_col, F.posexplode_outer(_sitemap_lines(F.col(body_col))).alias("seq", "sitemap"))
    return rows.where(F.col("sitemap").isNotNull())


def sitemap_candidates(files: DataFrame, scheme: str = "https", host_col: str = "host", body_col: str = "body",
                       most: int | None = None) -> DataFrame:
    """Sitemap urls to try per host, in order: those its robots file names, then the default place; the first `most` if given."""
    default = F.concat(F.lit(f"{scheme}://"), F.col(host_col), F.lit("/sitemap.xml"))
    listed = _sitemap_lines(F.col(body_col))
    tries = F.when(F.array_contains(listed, default), listed).otherwise(F.array_append(listed, default))
    return files.select(host_col, F.posexplode_outer(tries if most is None else F.slice(tries, 1, most)).alias("seq", "url"))


def _robots_path(url: Column) -> Column:
    path = F.regexp_replace(urls.percent_decode(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    return F.when(path == "", "/").otherwise(path)


def _first_rule_allows(url: Column, rules: Column) -> Column:
    fits = lambda p: F.get(F.filter(rules, lambda r: (r["prefix"] == "*") | p.startswith(r["prefix"])), F.lit(0))
    return F.coalesce(F.when(rules.isNotNull(), text.let(_robots_path(url), lambda p: fits(p)["allow"])), F.lit(True))


def robots_verdict(links: DataFrame, rules: DataFrame, url_col: str = "url", host_col: str = "host") -> DataFrame:
    """Add robots_allowed and crawl_delay: the first rule in file order whose prefix fits decides.

    One row per host joins the links, rules travel as an array, so links are never multiplied; AQE
    broadcasts small rule tables and splits hosts that hold a large share of the links.
    """
    keyed = links.withColumn("_host", urls.authority(F.col(url_col)))
    joined = keyed.join(rules.withColumnRenamed(host_col, "_host"), "_host", "left")
    verdict = _first_rule_allows(F.col(url_col), F.col("rules"))
    return joined.withColumn("robots_allowed", verdict).drop("_host", "rules")


def redirect_chains(hops: DataFrame, request_id: str = "request_id", hop: str = "hop", url_col: str = "url",
                    limit: int = MAX_REQUESTS) -> DataFrame:
    """Per request over its hop table: requests made, final url, and whether the chain is admitted."""
    reason = F.coalesce(urls.refusal_reason(F.col(url_col)), F.when(
        F.coalesce(urls.is_blocked_ip(urls.hostname(F.col(url_col))), F.lit(False)), F.lit("blocked address")))
    seen = hops.groupBy(request_id).agg(
        F.count("*").alias("requests"), F.max_by(url_col, hop).alias("final_url"),
        F.min_by(F.when(reason.isNotNull(), reason), F.when(reason.isNotNull(), F.col(hop))).alias("_bad"))
    why = F.when(F.col("_bad").isNotNull(), F.col("_bad")).when(F.col("requests") > limit, "Too many redirects")
    return seen.select(request_id, "requests", "final_url", why.isNull().alias("admitted"), why.alias("reason"))


def accept_links(links: DataFrame, seeds: DataFrame, rules: DataFrame | None = None, visited: DataFrame | None = None,
                 url_col: str = "url", resolved: DataFrame | None = None) -> DataFrame:
    """Every link with `reject_reason` (null when it may be crawled): visited, safety, blocked address,
    domain, asset, robots - in this order."""
    u = F.col(url_col)
    out = screen_urls(_with_url_parts(links, url_col), url_col)
    allowed = seeds.select(urls.authority(F.col(url_col)).alias("_site"), F.lit(True).alias("_home")).distinct()
    out = out.join(allowed, "_site", "left")
    if visited is not None:
        done = visited.select(F.col(url_col), F.lit(True).alias("_seen")).distinct()
        out = out.join(done, url_col, "left")
    else:
        out = out.withColumn("_seen", F.lit(None).cast("boolean"))
    if resolved is not None:
        hosts = screen_hosts(resolved).select(F.col("host").alias("_host"), F.col("blocked").alias("_blocked"))
        out = out.join(hosts, "_host", "left")
    else:
        out = out.withColumn("_blocked", F.lit(None).cast("boolean"))
    allowed_here = F.lit(True)
    if rules is not None:
        out = out.join(rules.select(F.col("host").alias("_site"), "rules"), "_site", "left")
        allowed_here = _first_rule_allows(u, F.col("rules"))
    reason = (F.when(F.col("_seen"), "visited").when(~F.col("ok"), "unsafe").when(F.col("_blocked"), "blocked address")
              .when(F.col("_home").isNull(), "other domain").when(urls.is_asset(u), "asset")
              .when(~allowed_here, "robots"))
    return out.withColumn("reject_reason", reason).select(*links.columns, "reject_reason")


def admit_response(pages: DataFrame, max_bytes: int = 10_485_760, require_html: bool = False,
                   html_col: str = "html") -> DataFrame:
    """Route responses: `error` is set for oversize, non-HTML or failed ones and their html emptied."""
    columns = pages.columns
    status = F.col("status_code") if "status_code" in columns else F.lit(200)
    kind = F.lower("content_type") if "content_type" in columns else F.lit("text/html")
    size = F.octet_length(html_col)
    error = F.when(size > max_bytes, F.concat(F.lit("Response size exceeds "), F.lit(max_bytes).cast("string"), F.lit(" bytes")))
    error = error.when(status >= 400, F.concat(F.lit("HTTP status "), status.cast("string")))
    if require_html:
        error = error.when(~F.coalesce(kind, F.lit("")).contains("html"), "The server response is not HTML")
    return (pages.withColumn("error", error)
            .withColumn(html_col, F.when(F.col("error").isNull(), F.col(html_col))))

