"""URL expressions.  Splitting and joining follow RFC 3986 with plain regular expressions, so no
row ever leaves the JVM."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import text

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_SPLIT = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Schemes with relative references, asset endings, refused host names and networks.
RELATIVE_SCHEMES = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
                    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss"]
ASSET_ENDINGS = ["jpg", "jpeg", "png", "gif", "webp", "pdf", "zip", "tar", "mp4", "mp3", "exe"]
REFUSED_HOSTS = ["localhost", "metadata.google.internal", "instance-data"]
REFUSED_HOST_ENDINGS = [".local", ".internal"]
REFUSED_NETWORKS = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32",
    "::1/128", "fc00::/7", "fe80::/10", "ff00::/8",
]
# IPv6 blocks that are private or reserved by their registry entry (IANA).
RESERVED_V6_NETWORKS = [
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3",
    "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9", "2001::/23", "2001:db8::/32",
    "2002::/16", "3fff::/20",
]


def _tidy(url: Column) -> Column:
    """Outer white space and embedded tabs or line breaks are no part of a url."""
    return F.regexp_replace(text.strip(url), r"[\t\r\n]", "")


def url_parts(url: Column) -> Column:
    """STRUCT(scheme, netloc, path, params, query, fragment); parts that are absent are ''."""
    def split(u: Column) -> Column:
        part = lambda group: F.regexp_extract(u, _SPLIT, group)
        return text.let(part(2), lambda path: F.struct(
            F.lower(F.regexp_extract(u, _SCHEME, 1)).alias("scheme"),
            part(1).alias("netloc"),
            F.regexp_replace(path, r";[^/]*$", "").alias("path"),
            F.regexp_extract(path, r";([^/]*)$", 1).alias("params"),
            part(3).alias("query"),
            part(4).alias("fragment")))
    return text.let(_tidy(url), split)


def _prefixed(mark: str, c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")


def unsplit(p: Column) -> Column:
    """Text of a url from its parts (`url_parts`)."""
    def build(local: Column) -> Column:
        rooted = local.startswith("/") | (local == "")
        bare_root = local.startswith("//") | (p["scheme"].isin([s for s in RELATIVE_SCHEMES if s]) & rooted)
        slashes = F.when((p["netloc"] != "") | bare_root, "//").otherwise("")
        joint = F.when((p["netloc"] != "") & ~rooted, "/").otherwise("")
        return F.concat(F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(""),
                        slashes, p["netloc"], joint, local, _prefixed("?", p["query"]), _prefixed("#", p["fragment"]))
    return text.let(F.concat(p["path"], _prefixed(";", p["params"])), build)


def _parts(scheme: Column, netloc: Column, path: Column, params: Column, query: Column, fragment: Column) -> Column:
    return F.struct(scheme.alias("scheme"), netloc.alias("netloc"), path.alias("path"), params.alias("params"),
                    query.alias("query"), fragment.alias("fragment"))


def normalize_url(url: Column) -> Column:
    """Lower scheme and authority, cut the fragment and trailing slashes (a lone `/` stays)."""
    def build(p: Column) -> Column:
        path = F.when(p["path"] == "/", F.lit("/")).otherwise(F.regexp_replace(p["path"], "/+$", ""))
        tidy = _parts(p["scheme"], F.lower(p["netloc"]), path, p["params"], p["query"], F.lit(""))
        return text.let(tidy, unsplit)
    return F.when(url == "", url).otherwise(text.let(url_parts(url), build))


def _resolve_path(base_path: Column, path: Column) -> Column:
    """Merge a relative path with its base and drop `.` and `..` steps."""
    # Merging drops empty steps inside the path; a rooted path is kept as it is.
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    merged = F.when(path.startswith("/"), path).otherwise(F.regexp_replace(F.concat(folder, path), "/{2,}", "/"))

    def fold(steps: Column) -> Column:
        kept = F.aggregate(
            steps, F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc).otherwise(F.array_append(acc, s)))
        tail = F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise("")
        return F.concat(F.array_join(kept, "/"), tail)

    def tidy(m: Column) -> Column:
        joined = F.when(m.rlike(r"(?:^|/)\.\.?(?:/|$)"), text.let(F.split(m, "/", -1), fold)).otherwise(m)
        return joined
    return F.coalesce(F.nullif(text.let(merged, tidy), F.lit("")), F.lit("/"))


def resolve_with(base: Column, base_parts: Column, href: Column) -> Column:
    """`resolve_url` with the base already split: use it when many hrefs share one base."""
    b = base_parts

    def join(p: Column) -> Column:
        own_place = p["netloc"] != ""
        same_document = ~own_place & (p["path"] == "") & (p["params"] == "")
        target = _parts(
            F.when(p["scheme"] == "", b["scheme"]).otherwise(p["scheme"]),
            F.when(own_place, p["netloc"]).otherwise(b["netloc"]),
            F.when(own_place, p["path"]).when(same_document, b["path"]).otherwise(_resolve_path(b["path"], p["path"])),
            F.when(same_document, b["params"]).otherwise(p["params"]),
            F.when(same_document & (p["query"] == ""), b["query"]).otherwise(p["query"]),
            p["fragment"])
        foreign = lambda t: (t["scheme"] != b["scheme"]) | ~t["scheme"].isin(RELATIVE_SCHEMES)
        return text.let(target, lambda t: F.when(foreign(t), href).otherwise(unsplit(t)))
    return (F.when(F.coalesce(base, F.lit("")) == "", href).when(href == "", base)
            .otherwise(text.let(url_parts(href), join)))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of `href` as seen from the page `base`."""
    return text.let(url_parts(base), lambda parts: resolve_with(base, parts, href))


def clean_url_with(page_url: Column, page_parts: Column, href: Column) -> Column:
    def check(full: Column) -> Column:
        return F.when(full.rlike(r"^(?i:https?)://[^/?#]"), full)
    def build(h: Column) -> Column:
        full = F.split_part(resolve_with(page_url, page_parts, h), F.lit("#"), F.lit(1))
        return F.when((h != "") & ~h.startswith("#"), text.let(full, check))
    return text.let(text.strip(href), build)


def clean_url(page_url: Column, href: Column) -> Column:
    """Absolute http(s) link without fragment; null for blank, `#…` or unusable hrefs."""
    return text.let(url_parts(page_url), lambda parts: clean_url_with(page_url, parts, href))


def redact_url(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)[?#].*$", "")


def authority(url: Column) -> Column:
    """Lower-case host[:port] (with user-info, when present); '' when there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def hostname(url: Column) -> Column:
    """Lower-case host without user-info, port and brackets; null when there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[]*)(?::[^/?#@]*)?(?:[/?#]|$)", 1)
    return F.nullif(F.btrim(F.lower(host), F.lit("[]")), F.lit(""))


def host_label(url: Column, default: str = "Scrape job") -> Column:
    return F.coalesce(hostname(url), F.lit(default))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 2)


def is_asset(url: Column) -> Column:
    return F.lower(path_of(url)).rlike(r"\.(?:" + "|".join(ASSET_ENDINGS) + r")$")


def next_numbered_page(url: Column) -> Column:
    """The url of the following page: first of the query keys page/p/pg that holds a number, else a
    `/page/N` path ending; null when neither is there."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda kv: kv != "")
    is_page = lambda kv: kv.rlike(r"(?i)^(?:page|p|pg)=[0-9]+$")

    def bump(kv: Column) -> Column:
        number = F.regexp_extract(kv, "=([0-9]+)$", 1).try_cast("decimal(38,0)") + F.lit(1)
        return F.concat(F.regexp_extract(kv, "^([^=]+=)", 1), number.cast("string"))

    def by_query(items: Column) -> Column:
        at = F.array_position(F.transform(items, is_page), F.lit(True))
        changed = F.transform(items, lambda kv, i: F.when(i + 1 == at, bump(kv)).otherwise(
            F.when(kv.contains("="), kv).otherwise(F.concat(kv, F.lit("=")))))
        fragment = F.regexp_extract(url, "(#.*)$", 1)
        return F.when(at > 0, F.concat(F.regexp_extract(url, r"^([^?#]*\?)", 1),
                                       F.array_join(changed, "&"), fragment))
    digits = F.regexp_extract(url, r"(?i)^[^?#]*/page/([0-9]+)/?(?:[?#].*)?$", 1)
    bumped = (digits.try_cast("decimal(38,0)") + F.lit(1)).cast("string")
    by_path = F.when(digits != "", F.concat(
        F.regexp_extract(url, r"(?i)^([^?#]*/page/)[0-9]+/?(?:[?#].*)?$", 1), bumped,
        F.regexp_extract(url, r"(?i)^[^?#]*/page/[0-9]+(/?(?:[?#].*)?)$", 1)))
    return F.coalesce(text.let(pairs, by_query), by_path)


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def refusal_of(url: Column, scheme: Column, host: Column, site: Column) -> Column:
    """`refusal_reason` over parts that are already columns (keeps the whole test in generated code)."""
    refused = host.isin(REFUSED_HOSTS) | reduce(lambda a, b: a | b, [host.endswith(e) for e in REFUSED_HOST_ENDINGS])
    return (F.when(F.coalesce(url, F.lit("")) == "", "URL must be a non-empty string.")
            .when(~scheme.isin("http", "https"), F.concat(
                F.lit("Unsupported scheme '"), scheme, F.lit("'. Only 'http' and 'https' are allowed.")))
            .when(host.isNull(), "URL is missing a valid hostname.")
            .when(refused, F.concat(F.lit("Hostname '"), host, F.lit("' is not permitted.")))
            .when(site.contains("@") & site.rlike("[^:@][^@]*@|@.*@"), "Embedded credentials in URLs are rejected."))


def refusal_reason(url: Column) -> Column:
    """Why a url must not be requested, judged from its text alone; null when nothing is wrong."""
    u = text.strip(url)
    return refusal_of(url, scheme_of(u), hostname(u), authority(u))


def ipv4_number(host: Column) -> Column:
    """Dotted quad as BIGINT, else null."""
    octet = r"(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    quad = F.split(F.when(host.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), host), r"\.")
    return F.aggregate(quad, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o.cast("bigint"))


def ipv6_hex(host: Column) -> Column:
    """IPv6 text as 32 hex digits (orders like the number), else null."""
    h = F.lower(F.split_part(host, F.lit("%"), F.lit(1)))
    tail = ipv4_number(F.regexp_extract(h, r"([0-9.]+)$", 1))
    dotted = F.lpad(F.lower(F.hex(tail)), 8, "0")
    plain = F.when(h.contains(".") & tail.isNotNull(), F.concat(
        F.regexp_replace(h, r"[0-9.]+$", ""), F.substring(dotted, 1, 4), F.lit(":"), F.substring(dotted, 5, 4))).otherwise(h)

    def expand(p: Column) -> Column:
        groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
        left = groups(F.split_part(p, F.lit("::"), F.lit(1)))
        right = F.when(p.contains("::"), groups(F.split_part(p, F.lit("::"), F.lit(2)))).otherwise(
            F.array().cast("array<string>"))
        used = F.size(left) + F.size(right)
        fill = F.array_repeat(F.lit("0000"), F.greatest(F.lit(8) - used, F.lit(0)))
        wide = lambda gs: F.transform(gs, lambda g: F.lpad(g, 4, "0"))
        shape = p.rlike(r"^(?:[0-9a-f]{1,4}:)*:?(?::?[0-9a-f]{1,4})*:?$") & p.contains(":") & ~p.contains(":::")
        fits = F.when(p.contains("::"), (used <= 7) & (F.size(F.split(p, "::")) == 2)).otherwise(
            (used == 8) & ~p.startswith(":") & ~p.endswith(":"))
        return F.when(shape & fits, F.concat(F.array_join(wide(left), ""), F.array_join(fill, ""),
                                             F.array_join(wide(right), "")))
    return text.let(plain, expand)


def _within(ip4: Column, ip6: Column, networks: list[str]) -> Column:
    tests = []
    for name in networks:
        net = ipaddress.ip_network(name)
        low, high = int(net.network_address), int(net.broadcast_address)
        if net.version == 4:
            tests.append(ip4.between(F.lit(low).cast("bigint"), F.lit(high).cast("bigint")))
        else:
            tests.append(ip6.between(F.lit(f"{low:032x}"), F.lit(f"{high:032x}")))
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def is_blocked_ip(ip: Column) -> Column:
    """True/false for an IP literal inside/outside the refused networks; null for other text.

    The list is a fixed, small set of intervals, so it is part of the expression: no join.
    """
    def judge(nums: Column) -> Column:
        return F.when(nums["v4"].isNotNull() | nums["v6"].isNotNull(),
                      _within(nums["v4"], nums["v6"], REFUSED_NETWORKS + RESERVED_V6_NETWORKS))
    numbers = F.struct(ipv4_number(ip).alias("v4"), ipv6_hex(ip).alias("v6"))
    return F.when(ip.rlike(r"^[0-9.]+$|:"), text.let(numbers, judge))    # names need no arithmetic


def percent_decode(c: Column) -> Column:
    plus_kept = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.when(c.contains("%"), F.coalesce(plus_kept, c)).otherwise(c)
