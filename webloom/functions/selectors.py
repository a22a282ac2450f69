"""CSS selectors compiled to Column expressions over a node array (`functions.html`), and what is read from a match.

A selector becomes one `filter` per compound; the nodes matched on the left of a combinator are
bound once with `let`.  Nothing here runs on executors.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import text
from webloom.functions.html import OWN_TEXT, VOID
from webloom.functions.urls import resolve_with
from webloom.model import RuleError

Test = Callable[[Column], Column]

_IDENT = r"-?[\w -￿][\w -￿-]*"
_PIECE = re.compile(
    rf"(?P<tag>\*|{_IDENT})|\#(?P<id>{_IDENT})|\.(?P<cls>{_IDENT})"
    rf"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*!]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\s\]]+)\s*(?P<flag>[iIsS])?\s*)?\]"
    rf"|:(?P<pseudo>-?[a-z][a-z-]*)(?P<open>\()?")
_AN_B = re.compile(r"(?P<word>odd|even)|(?P<step>[+-]?\d*)n(?:\s*(?P<sign>[+-])\s*(?P<rest>\d+))?|(?P<only>[+-]?\d+)", re.IGNORECASE)


def attr(node: Column, name: str) -> Column:
    return F.element_at(node["attrs"], F.lit(name))


def _is_element(n: Column) -> Column:
    return n["nth"].isNotNull()


def _attr_test(name: str, op: str | None, raw: str | None, flag: str | None) -> Test:
    if op is None:
        return lambda n: attr(n, name).isNotNull()
    value = raw[1:-1] if raw[:1] in "\"'" else raw
    fold = (flag or "").lower() == "i" or (name == "type" and (flag or "").lower() != "s")
    want = value.lower() if fold else value

    def test(n: Column) -> Column:
        have = F.lower(attr(n, name)) if fold else attr(n, name)
        if op == "!=":
            return have.isNull() | (have != want)
        if op == "=":
            hit = have == want
        elif op == "|=":
            hit = (have == want) | have.startswith(want + "-")
        elif not want or (op == "~=" and re.search(r"\s", want)):
            hit = F.lit(False)
        elif op == "~=":
            hit = F.concat(F.lit(" "), F.regexp_replace(have, r"\s+", " "), F.lit(" ")).contains(f" {want} ")
        else:
            hit = {"^=": have.startswith, "$=": have.endswith, "*=": have.contains}[op](want)
        return F.coalesce(hit, F.lit(False))
    return test


def _counted(argument: str) -> Callable[[Column], Column]:
    """`an+b`, `odd`, `even` or a number as a test of a place that counts from 1."""
    m = _AN_B.fullmatch(argument.strip())
    if not m:
        raise RuleError(f"unsupported selector argument {argument!r}")
    if m["only"]:
        return lambda place: place == int(m["only"])
    if m["word"]:
        step, first = 2, int(m["word"].lower() == "odd")
    else:
        step = int(m["step"] + "1") if m["step"] in ("", "+", "-") else int(m["step"])
        first = int((m["sign"] or "+") + (m["rest"] or "0"))
    if step == 0:
        return lambda place: place == first
    beyond = (lambda place: place >= first) if step > 0 else (lambda place: place <= first)
    return lambda place: beyond(place) & (F.pmod(place - first, F.lit(abs(step))) == 0)


def _from_end(nodes: Column, n: Column, same_type: bool) -> Column:
    """The place of an element among its siblings, counted from the last."""
    like = lambda m: (m["up"] == n["up"]) & (m["nth"] >= n["nth"])
    return F.size(F.filter(nodes, (lambda m: like(m) & (m["tag"] == n["tag"])) if same_type else like))


def _matches(steps: list[tuple[str, Test]], n: Column, nodes: Column) -> Column:
    """Whether a node is one that a selector finds, looked up from its right end."""
    (combinator, test), before = steps[-1], steps[:-1]
    if not before:
        return test(n)
    return test(n) & F.exists(nodes, lambda a: _joined(combinator, a, n) & _matches(before, a, nodes))


def _leads(steps: list[tuple[str, Test]], anchor: Column, m: Column, nodes: Column) -> Column:
    """Whether a relative selector leads from `anchor` to `m`."""
    (combinator, test), before = steps[-1], steps[:-1]
    if not before:
        return test(m) & _joined(combinator, anchor, m)
    return test(m) & F.exists(nodes, lambda a: _joined(combinator, a, m) & _leads(before, anchor, a, nodes))


def _has(argument: str, nodes: Column) -> Test:
    tests: list[Test] = []
    for group in _split_groups(argument):
        m = re.match(r"\s*([>+~])\s*", group)
        steps = _complex(group[m.end():] if m else group, nodes)
        steps[0] = (m.group(1) if m else " ", steps[0][1])
        inside = all(c in " >" for c, _ in steps)

        def test(n: Column, steps=steps, inside=inside) -> Column:
            base = F.get(nodes, F.lit(0))["i"]
            where = F.slice(nodes, F.greatest(F.lit(1), n["i"] - base + 2), n["last"] - n["i"]) if inside else nodes
            return F.exists(where, lambda m: _leads(steps, n, m, nodes))
        tests.append(test)
    return lambda n: F.coalesce(reduce(lambda a, b: a | b, [t(n) for t in tests]), F.lit(False))


def _pseudo_test(name: str, argument: str | None, nodes: Column) -> Test:
    if name in ("is", "where", "matches", "any", "not") and argument is not None:
        groups = [_complex(group, nodes) for group in _split_groups(argument)]
        some = lambda n: F.coalesce(reduce(lambda a, b: a | b, [_matches(steps, n, nodes) for steps in groups]), F.lit(False))
        return (lambda n: ~some(n)) if name == "not" else some
    if name == "has" and argument is not None:
        return _has(argument, nodes)
    counted = re.fullmatch(r"nth-(last-)?(child|of-type)", name)
    if counted and argument is not None:
        test, same_type = _counted(argument), counted.group(2) == "of-type"
        if counted.group(1):
            return lambda n: test(_from_end(nodes, n, same_type))
        return lambda n: test(n["nth_type" if same_type else "nth"])
    if name in ("contains", "-soup-contains") and argument is not None and re.fullmatch(r"\s*(\"[^\"]*\"|'[^']*')\s*", argument):
        return lambda n: node_content(nodes, n, False).contains(argument.strip()[1:-1])
    if argument is not None:
        raise RuleError(f"unsupported selector :{name}({argument})")
    same_type = name.endswith("-of-type")
    first = lambda n: n["nth_type" if same_type else "nth"] == 1
    last = lambda n: _from_end(nodes, n, same_type) == 1
    if name in ("first-child", "first-of-type"):
        return first
    if name in ("last-child", "last-of-type"):
        return last
    if name in ("only-child", "only-of-type"):
        return lambda n: first(n) & last(n)
    if name == "root":
        return lambda n: (n["up"] == -1) & (n["nth"] == 1)
    if name == "empty":
        return lambda n: ~F.exists(subtree(nodes, n), lambda m: (m["up"] == n["i"]) & (
            _is_element(m) | (m["tag"].startswith("#") & (m["tag"] != "#comment") & (F.trim(m["text"], F.lit(" \t\r\n\f")) != ""))))
    raise RuleError(f"unsupported selector :{name}")


def _all(tests: list[Test]) -> Test:
    return lambda n: reduce(lambda a, b: a & b, [_is_element(n)] + [t(n) for t in tests])


def _compound(selector: str, nodes: Column) -> tuple[Test, str]:
    """Read one compound selector off the front; returns its test and the remaining text."""
    tests: list[Test] = []
    while selector:
        m = _PIECE.match(selector)
        if not m or (m["tag"] and tests):
            break
        if m["tag"]:
            name = m["tag"].lower()
            tests.append(lambda n, name=name: F.lit(True) if name == "*" else n["tag"] == name)
        elif m["id"]:
            tests.append(lambda n, v=m["id"]: F.coalesce(attr(n, "id") == v, F.lit(False)))
        elif m["cls"]:
            tests.append(lambda n, v=m["cls"]: F.coalesce(
                F.concat(F.lit(" "), attr(n, "class"), F.lit(" ")).contains(f" {v} "), F.lit(False)))
        elif m["attr"]:
            tests.append(_attr_test(m["attr"].lower(), m["op"], m["val"], m["flag"]))
        else:
            end = _closing(selector, m.end()) if m["open"] else m.end()
            tests.append(_pseudo_test(m["pseudo"], selector[m.end():end - 1] if m["open"] else None, nodes))
            selector = selector[end:]
            continue
        selector = selector[m.end():]
    if not tests:
        raise RuleError(f"unsupported selector near {selector!r}")
    return _all(tests), selector


def _joined(combinator: str, a: Column, n: Column) -> Column:
    """How `n` has to lie to `a` for a combinator between them."""
    if combinator == ">":
        return a["i"] == n["up"]
    if combinator == "+":
        return (a["up"] == n["up"]) & (a["nth"] + 1 == n["nth"])
    if combinator == "~":
        return (a["up"] == n["up"]) & (a["nth"] < n["nth"])
    return (a["i"] < n["i"]) & (n["i"] <= a["last"])


def _related(combinator: str, left: Column, n: Column, nodes: Column) -> Column:
    return F.exists(left, lambda a: _joined(combinator, a, n))


def _closing(selector: str, at: int) -> int:
    """The place after the parenthesis that closes the one before `at`; quotes and brackets are skipped."""
    depth = 1
    for m in re.finditer(r"\"[^\"]*\"|'[^']*'|\[[^\]]*\]|[()]", selector[at:]):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if not depth:
            return at + m.end()
    raise RuleError(f"invalid selector {selector!r}")


def _split_groups(selector: str) -> list[str]:
    """The parts between commas that lie outside parentheses, brackets and quotes."""
    groups, start, depth = [], 0, 0
    for m in re.finditer(r"\"[^\"]*\"|'[^']*'|\[[^\]]*\]|[(),]", selector):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if m[0] == "," and not depth:
            groups.append(selector[start:m.start()])
            start = m.end()
    groups.append(selector[start:])
    if depth or any(not g.strip() for g in groups):
        raise RuleError(f"invalid selector {selector!r}")
    return [g.strip() for g in groups]


def _complex(selector: str, nodes: Column) -> list[tuple[str, Test]]:
    """Steps (combinator, test) of one selector without commas."""
    steps, rest, combinator = [], selector, ""
    while True:
        test, rest = _compound(rest, nodes)
        steps.append((combinator, test))
        m = re.match(r"\s*([>+~])\s*|\s+", rest)
        if not rest.strip():
            return steps
        if not m:
            raise RuleError(f"unsupported selector near {rest!r}")
        combinator, rest = m.group(1) or " ", rest[m.end():]


def _outermost(found: Column) -> Column:
    """Matches that lie in no other match: their subtrees are disjoint."""
    start = F.struct(F.lit(-1).alias("end"), F.slice(found, 1, 0).alias("kept"))
    return F.aggregate(found, start, lambda acc, a: F.when(
        a["i"] > acc["end"], F.struct(a["last"].alias("end"), F.array_append(acc["kept"], a).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"])


def _below(found: Column, test: Test, nodes: Column) -> Column:
    """Nodes passing `test` below any of the matches, each looked at once, in document order."""
    base = F.get(nodes, F.lit(0))["i"]
    inside = lambda a: F.slice(nodes, a["i"] - base + 2, a["last"] - a["i"])
    return F.flatten(F.transform(_outermost(found), lambda a: F.filter(inside(a), test)))


def css(selector: str, nodes: Column) -> Column:
    """Matching element nodes in document order."""
    plans = [_complex(group, nodes) for group in _split_groups(selector)]

    def found_by(steps: list[tuple[str, Test]]) -> Column:
        (combinator, test), before = steps[-1], steps[:-1]
        if not before:
            return F.filter(nodes, test)
        left = found_by(before)
        if combinator == " ":
            return _below(left, test, nodes)
        return text.let(left, lambda found: F.filter(nodes, lambda n: test(n) & _related(combinator, found, n, nodes)))

    def any_of(rest: list, tests: list[Test]) -> Column:
        """Alternatives share one scan of the nodes; left-hand matches are bound around it."""
        if not rest:
            return F.filter(nodes, lambda n: reduce(lambda a, b: a | b, [t(n) for t in tests]))
        (combinator, test), before = rest[0][-1], rest[0][:-1]
        if not before:
            return any_of(rest[1:], tests + [test])
        return text.let(found_by(before), lambda found: any_of(
            rest[1:], tests + [lambda n: test(n) & _related(combinator, found, n, nodes)]))
    return found_by(plans[0]) if len(plans) == 1 else any_of(plans, [])


def subtree(nodes: Column, n: Column) -> Column:
    """All nodes below `n` (not `n` itself); `nodes` must be the whole document."""
    return F.slice(nodes, n["i"] + 2, n["last"] - n["i"])


def _pieces(nodes: Column, n: Column) -> Column:
    kind = F.when(n["tag"].isin(*sorted(OWN_TEXT)), F.concat(F.lit("#"), n["tag"])).otherwise("#text")
    return F.filter(F.transform(F.filter(subtree(nodes, n), lambda m: m["tag"] == kind),
                                lambda m: text.strip(m["text"])), lambda t: t != "")


def node_text(nodes: Column, n: Column, separator: str = " ") -> Column:
    """Stripped text pieces below `n`, joined; '' when there are none."""
    return F.array_join(_pieces(nodes, n), separator)


def node_content(nodes: Column, n: Column, stripped: bool = True) -> Column:
    """All character data below `n` (scripts and styles too), stripped as a whole."""
    data = F.filter(subtree(nodes, n), lambda m: m["tag"].startswith("#") & (m["tag"] != "#comment"))
    whole = F.array_join(F.transform(data, lambda m: m["text"]), "")
    return text.strip(whole) if stripped else whole


def own_string(nodes: Column, n: Column) -> Column:
    """The text of an element whose only child is one text node, else null."""
    return F.when((n["last"] == n["i"] + 1), F.get(nodes, n["last"])["text"])


def _escape(c: Column) -> Column:
    amp = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def outer_html(nodes: Column, n: Column) -> Column:
    """Markup of the element, written out from the tree."""
    def opening(m: Column) -> Column:
        pairs = F.transform(F.map_entries(m["attrs"]), lambda e: F.concat(
            F.lit(" "), e["key"], F.lit('="'), F.replace(_escape(e["value"]), F.lit('"'), F.lit("&quot;")), F.lit('"')))
        end = F.when(m["tag"].isin(*sorted(VOID)), "/>").otherwise(">")
        return F.concat(F.lit("<"), m["tag"], F.array_join(pairs, ""), end)

    def written(m: Column) -> Column:
        return (F.when(_is_element(m), opening(m))
                .when(m["tag"] == "#comment", F.concat(F.lit("<!--"), m["text"], F.lit("-->")))
                .when(m["tag"].isin("#script", "#style"), m["text"]).otherwise(_escape(m["text"])))

    def closing(m: Column) -> Column:
        # The last node of the subtree may also end ancestors of `n`: those stay outside.
        outside = F.size(F.filter(nodes, lambda a: (a["i"] < n["i"]) & (a["last"] == n["last"]) & _is_element(a)
                                  & ~a["tag"].isin(*sorted(VOID))))
        shut = F.coalesce(m["shut"], F.array().cast("array<string>"))
        kept = F.when(m["i"] == n["last"], F.slice(shut, F.lit(1), F.size(shut) - outside)).otherwise(shut)
        return F.array_join(F.transform(kept, lambda name: F.concat(F.lit("</"), name, F.lit(">"))), "")
    whole = F.slice(nodes, n["i"] + 1, n["last"] - n["i"] + 1)
    return F.array_join(F.transform(whole, lambda m: F.concat(written(m), closing(m))), "")


# Attributes whose value is a url, for CSS and for XPath rules.
CSS_URL_ATTRS = ("href", "src", "action", "data-src")
XPATH_URL_ATTRS = ("href", "src")


def element_value(nodes: Column, n: Column, extract_type: str, attribute: str | None, by_xpath: bool,
                  url: Column, url_parts: Column) -> Column:
    """What a rule reads from a matched element: text, markup or an attribute (urls made absolute)."""
    if extract_type == "html":
        return text.strip(outer_html(nodes, n)) if by_xpath else outer_html(nodes, n)
    if extract_type == "attr":
        name = (attribute or "href").lower()
        value = F.coalesce(attr(n, name), F.lit(""))
        return resolve_with(url, url_parts, value) if name in (XPATH_URL_ATTRS if by_xpath else CSS_URL_ATTRS) else value
    if by_xpath:
        return node_content(nodes, n)
    return node_text(nodes, n, " " if extract_type == "text" else "")
