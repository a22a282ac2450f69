"""XPath 1.0 over a node array (`functions.html`), compiled to one Column expression.

A step keeps the nodes that lie in the right place to some node of the context: axes are comparisons of positions and
subtree ends, so no tree is walked.  A place predicate counts among the candidates that share a parent; on axes other than
child each context node has its own list.  Nothing here runs on executors.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import text
from webloom.model import RuleError

_TOKEN = re.compile(r"""\s*(?:(?P<str>"[^"]*"|'[^']*')|(?P<num>\d+(?:\.\d*)?|\.\d+)|(?P<op>::|//|\.\.|!=|<=|>=|[/|()\[\]@,.=<>+*\-])|(?P<name>[^\W\d][\w\-]*(?::(?!:)[\w\-]+)?))""")
_REVERSE = ("ancestor", "ancestor-or-self", "preceding", "preceding-sibling", "parent")
# How a node `n` lies to a context node `a`.  "below" is `//` before a child step: positions count per parent.
_RELATION: dict[str, Callable[[Column, Column], Column]] = {
    "child": lambda a, n: n["up"] == a["i"],
    "below": lambda a, n: (n["i"] > a["i"]) & (n["i"] <= a["last"]),
    "descendant": lambda a, n: (n["i"] > a["i"]) & (n["i"] <= a["last"]),
    "descendant-or-self": lambda a, n: (n["i"] >= a["i"]) & (n["i"] <= a["last"]),
    "self": lambda a, n: n["i"] == a["i"],
    "parent": lambda a, n: n["i"] == a["up"],
    "ancestor": lambda a, n: (n["i"] < a["i"]) & (n["last"] >= a["i"]),
    "ancestor-or-self": lambda a, n: (n["i"] <= a["i"]) & (n["last"] >= a["i"]),
    "following-sibling": lambda a, n: (n["up"] == a["up"]) & (n["i"] > a["i"]),
    "preceding-sibling": lambda a, n: (n["up"] == a["up"]) & (n["i"] < a["i"]),
    "following": lambda a, n: n["i"] > a["last"],
    "preceding": lambda a, n: n["last"] < a["i"],
}
_INSIDE = ("child", "below", "descendant", "descendant-or-self", "self")


@dataclass
class Step:
    axis: str
    test: str                       # a name, "*", "text()", "comment()" or "node()"
    predicates: list = field(default_factory=list)


@dataclass
class Path:
    steps: list[Step]
    absolute: bool
    start: object = None            # an expression that yields the first nodes, as in (//a)[1]
    filters: list = field(default_factory=list)


@dataclass
class Call:
    name: str
    args: list


class _Parser:
    """Reads an expression into Path, Call (operators too), str and float."""

    LEVELS = (("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod"))

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise self.error(source[at:])
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def error(self, near: str) -> RuleError:
        return RuleError(f"unsupported XPath near {near!r} in {self.source!r}")

    def peek(self, ahead: int = 0) -> str:
        at = self.at + ahead
        return self.tokens[at][1] if at < len(self.tokens) and self.tokens[at][0] != "str" else ""

    def take(self, *wanted: str) -> str:
        found = self.peek()
        if not found or (wanted and found not in wanted):
            raise self.error(found or "the end")
        self.at += 1
        return found

    def whole(self):
        tree = self.binary(0)
        if self.at < len(self.tokens):
            raise self.error(self.tokens[self.at][1])
        return tree

    def binary(self, level: int):
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek() in self.LEVELS[level]:
            op = self.take()
            left = Call(op, [left, self.binary(level + 1)])
        return left

    def unary(self):
        if self.peek() == "-":
            self.take()
            return Call("neg", [self.unary()])
        parts = [self.path()]
        while self.peek() == "|":
            self.take()
            parts.append(self.path())
        return parts[0] if len(parts) == 1 else Call("|", parts)

    def path(self):
        if self.at >= len(self.tokens):
            raise self.error("the end")
        kind, value = self.tokens[self.at]
        if kind in ("str", "num"):
            self.at += 1
            return value[1:-1] if kind == "str" else float(value)
        calls = kind == "name" and self.peek(1) == "(" and value not in ("text", "node", "comment")
        if value != "(" and not calls:
            return self.location()
        if value == "(":
            self.take()
            start = self.binary(0)
            self.take(")")
        else:
            self.take()
            self.take("(")
            args = []
            while self.peek() != ")":
                args.append(self.binary(0))
                if self.peek() != ")":
                    self.take(",")
            self.take(")")
            start = Call(value, args)
        filters = self.predicates()
        if not filters and self.peek() not in ("/", "//"):
            return start
        path = Path([], False, start, filters)
        self.steps(path)
        return path

    def location(self) -> Path:
        path = Path([], self.peek() in ("/", "//"))
        if not path.absolute:
            path.steps += self.step("")
        self.steps(path)
        if not path.steps:
            raise self.error(self.peek() or "the end")
        return path

    def steps(self, path: Path) -> None:
        while self.peek() in ("/", "//"):
            path.steps += self.step(self.take())

    def step(self, slash: str) -> list[Step]:
        deep = [Step("descendant-or-self", "node()")] if slash == "//" else []
        if self.peek() in (".", ".."):
            return [*deep, Step("self" if self.take() == "." else "parent", "node()")]
        axis = "child"
        if self.peek() == "@":
            self.take()
            axis = "attribute"
        elif self.peek(1) == "::":
            axis = self.take()
            self.take("::")
            if axis not in _RELATION and axis != "attribute" or axis == "below":
                raise self.error(axis)
        test = self.take()
        if test != "*" and self.tokens[self.at - 1][0] != "name":
            raise self.error(test)
        if self.peek() == "(":
            self.take()
            self.take(")")
            test += "()"
            if test not in ("text()", "node()", "comment()"):
                raise self.error(test)
        if slash == "//" and axis == "child":
            deep, axis = [], "below"
        return [*deep, Step(axis, test, self.predicates())]

    def predicates(self) -> list:
        found = []
        while self.peek() == "[":
            self.take()
            found.append(self.binary(0))
            self.take("]")
        return found


def _placed(tree, top: bool = True) -> bool:
    """Whether a predicate asks for the place of a node among its like."""
    if isinstance(tree, float):
        return top
    if isinstance(tree, Call):
        if tree.name in ("position", "last"):
            return True
        numeric = top and tree.name in ("+", "-", "*", "div", "mod", "neg", "count", "sum", "number", "string-length", "floor", "ceiling", "round")
        return numeric or any(_placed(a, False) for a in tree.args)
    return False


@dataclass
class Value:
    """kind: "nodes" (node structs), "strings" (structs i, k, value of attributes), "string", "number" or "boolean"."""
    kind: str
    column: Column


class _Compiler:
    def __init__(self, scope: Column, document: Column):
        self.nodes, self.document = scope, document

    # ---- values

    def content(self, n: Column) -> Column:
        """String value of a node: its character data, or all of it below an element."""
        data = F.filter(F.slice(self.document, n["i"] + 2, n["last"] - n["i"]), lambda m: m["tag"].startswith("#") & (m["tag"] != "#comment"))
        return F.when(n["nth"].isNull(), n["text"]).otherwise(F.array_join(F.transform(data, lambda m: m["text"]), ""))

    def texts(self, v: Value) -> Column:
        """All string values of a node set."""
        return F.transform(v.column, self.content if v.kind == "nodes" else lambda a: a["value"])

    def string(self, v: Value) -> Column:
        if v.kind in ("nodes", "strings"):
            return F.coalesce(F.get(self.texts(v), F.lit(0)), F.lit(""))
        if v.kind == "string":
            return v.column
        if v.kind == "boolean":
            return v.column.cast("string")
        whole = F.abs(v.column) < 1e15
        return F.when(whole & (v.column == F.floor(v.column)), v.column.cast("bigint").cast("string")).otherwise(v.column.cast("string"))

    def number(self, v: Value) -> Column:
        if v.kind == "number":
            return v.column
        if v.kind == "boolean":
            return v.column.cast("double")
        return self.to_number(self.string(v))

    def to_number(self, c: Column) -> Column:
        plain = text.strip(c)
        return F.when(plain.rlike(r"^-?(\d+(\.\d*)?|\.\d+)$"), plain.try_cast("double")).otherwise(F.lit(float("nan")))

    def boolean(self, v: Value) -> Column:
        if v.kind in ("nodes", "strings"):
            return F.size(v.column) > 0
        if v.kind == "boolean":
            return v.column
        return F.length(v.column) > 0 if v.kind == "string" else (v.column != 0) & ~F.isnan(v.column)

    # ---- paths

    def test(self, step: Step) -> Callable[[Column], Column]:
        element = lambda n: n["nth"].isNotNull()
        if step.test == "node()":
            return lambda n: F.lit(True)
        if step.test == "text()":
            return lambda n: n["tag"].startswith("#") & (n["tag"] != "#comment")
        if step.test == "comment()":
            return lambda n: n["tag"] == "#comment"
        return element if step.test == "*" else lambda n: element(n) & (n["tag"] == step.test.lower())

    def holds(self, tree, n: Column, place: Column | None, last: Column | None) -> Column:
        value = self.value(tree, n, place, last)
        return F.coalesce(value.column == place if value.kind == "number" and place is not None else self.boolean(value), F.lit(False))

    def ordered(self, places: Column) -> Column:
        """The nodes at some places, once each and in document order."""
        return text.let(places, lambda ids: F.filter(self.nodes, lambda n: F.array_contains(ids, n["i"])))

    def step(self, left: Column | None, step: Step, single: bool) -> Column:
        """Nodes of a step from the nodes `left` (None: the document itself; `single`: an array of one node)."""
        test, relation = self.test(step), _RELATION[step.axis]
        if step.axis not in ("child", "below") and any(map(_placed, step.predicates)):
            if left is None:
                return self.narrow(F.filter(self.nodes, test), step)
            return self.ordered(F.flatten(F.transform(left, lambda a: F.transform(
                self.narrow(F.filter(self.around(a, step.axis), lambda n: relation(a, n) & test(n)), step), lambda n: n["i"]))))
        if left is None:
            found = F.filter(self.nodes, (lambda n: test(n) & (n["up"] == -1)) if step.axis == "child" else test)
        elif single:
            found = text.let(F.get(left, F.lit(0)), lambda a: F.filter(self.around(a, step.axis), lambda n: relation(a, n) & test(n)))
        else:
            found = text.let(left, lambda found: F.filter(self.nodes, lambda n: test(n) & F.exists(found, lambda a: relation(a, n))))
        for tree in step.predicates:
            found = self.among_siblings(found, tree, step)
        return found

    def around(self, a: Column, axis: str) -> Column:
        """Where the nodes of an axis can lie: the subtree of `a` (with `a`), or anywhere."""
        base = F.get(self.nodes, F.lit(0))["i"]
        return F.slice(self.nodes, F.greatest(F.lit(1), a["i"] - base + 1), a["last"] - a["i"] + 1) if axis in _INSIDE else self.nodes

    def among_siblings(self, found: Column, tree, step: Step) -> Column:
        if not _placed(tree):
            return F.filter(found, lambda n: self.holds(tree, n, None, None))
        if isinstance(tree, float) and tree is step.predicates[0] and not step.test.endswith("()"):
            return F.filter(found, lambda n: n["nth" if step.test == "*" else "nth_type"] == tree)
        like = lambda all_, n: F.filter(all_, lambda m: m["up"] == n["up"])
        return text.let(found, lambda all_: F.filter(all_, lambda n: self.holds(
            tree, n, F.size(F.filter(like(all_, n), lambda m: m["i"] <= n["i"])).cast("double"), F.size(like(all_, n)).cast("double"))))

    def narrow(self, own: Column, step: Step) -> Column:
        """The predicates on the nodes of one context node, nearest first on a reverse axis."""
        own = F.reverse(own) if step.axis in _REVERSE else own
        return reduce(self.by_place, step.predicates, own)

    def by_place(self, own: Column, tree) -> Column:
        return text.let(own, lambda all_: F.filter(all_, lambda n, i: self.holds(tree, n, (i + 1).cast("double"), F.size(all_).cast("double"))))

    def path(self, path: Path, n: Column | None, place: Column | None, last: Column | None) -> Value:
        found, single = (F.array(n), True) if n is not None else (F.filter(self.nodes, lambda m: (m["up"] == -1) & m["nth"].isNotNull()), False)
        if path.absolute:
            found, single = None, False
        if path.start is not None:
            start = self.value(path.start, n, place, last)
            if start.kind != "nodes":
                if path.steps or path.filters or start.kind != "strings":
                    raise RuleError("XPath steps and predicates need nodes")
                return start
            found, single = reduce(self.by_place, path.filters, start.column), False
        for number, step in enumerate(path.steps):
            if step.axis == "attribute":
                if number < len(path.steps) - 1 or step.predicates or found is None or step.test.endswith("()"):
                    raise RuleError("an XPath attribute is the last step of its path, without predicates")
                return Value("strings", self.attributes(found, step.test.lower()))
            found = self.step(found, step, single)
            single = False
        return Value("nodes", found)

    def attributes(self, found: Column, name: str) -> Column:
        def of(n: Column) -> Column:
            entries = F.coalesce(F.map_entries(n["attrs"]), F.array().cast("array<struct<key:string,value:string>>"))
            made = F.transform(entries, lambda e, k: F.struct(n["i"].alias("i"), k.alias("k"), e["value"].alias("value"), e["key"].alias("key")))
            own = made if name == "*" else F.filter(made, lambda e: e["key"] == name)
            return F.transform(own, lambda e: F.struct(e["i"], e["k"], e["value"]))
        return F.flatten(F.transform(found, of))

    # ---- expressions

    def value(self, tree, n: Column | None, place: Column | None, last: Column | None) -> Value:
        if isinstance(tree, str):
            return Value("string", F.lit(tree))
        if isinstance(tree, float):
            return Value("number", F.lit(tree))
        if isinstance(tree, Path):
            return self.path(tree, n, place, last)
        args = [self.value(a, n, place, last) for a in tree.args]
        if tree.name == "|":
            return self.union(args)
        if tree.name in ("=", "!=", "<", "<=", ">", ">="):
            return Value("boolean", self.compare(tree.name, *args))
        return self.call(tree.name, args, n, place, last)

    def union(self, args: list[Value]) -> Value:
        if any(a.kind not in ("nodes", "strings") for a in args):
            raise RuleError("an XPath union needs node sets")
        if all(a.kind == "nodes" for a in args):
            return Value("nodes", self.ordered(F.concat(*[F.transform(a.column, lambda n: n["i"]) for a in args])))
        as_rows = lambda a: a.column if a.kind == "strings" else F.transform(
            a.column, lambda n: F.struct(n["i"].alias("i"), F.lit(-1).alias("k"), self.content(n).alias("value")))
        return Value("strings", F.array_sort(F.array_distinct(F.concat(*map(as_rows, args)))))

    def compare(self, op: str, a: Value, b: Value) -> Column:
        sets = ("nodes", "strings")
        done = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y,
                ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
        def numbers(x: Column, y: Column) -> Column:       # a not-a-number equals nothing and has no order
            return F.when(F.isnan(x) | F.isnan(y), F.lit(op == "!=")).otherwise(done(x, y))
        if "boolean" in (a.kind, b.kind) and op in ("=", "!="):
            return done(self.boolean(a), self.boolean(b))
        by_text = op in ("=", "!=") and "number" not in (a.kind, b.kind)
        if a.kind not in sets and b.kind not in sets:
            return done(self.string(a), self.string(b)) if by_text else numbers(self.number(a), self.number(b))
        test = done if by_text else lambda x, y: numbers(self.to_number(x), self.to_number(y))
        if a.kind in sets and b.kind in sets:
            return text.let(self.texts(b), lambda right: F.exists(self.texts(a), lambda x: F.exists(right, lambda y: test(x, y))))
        if a.kind in sets:
            return F.exists(self.texts(a), lambda x: test(x, self.string(b)) if by_text else numbers(self.to_number(x), self.number(b)))
        return F.exists(self.texts(b), lambda y: test(self.string(a), y) if by_text else numbers(self.number(a), self.to_number(y)))

    def call(self, name: str, args: list[Value], n: Column | None, place: Column | None, last: Column | None) -> Value:
        s, x, t = self.string, self.number, self.boolean
        here = Value("nodes", F.array(n)) if n is not None else Value("nodes", F.slice(F.filter(self.nodes, lambda m: (m["up"] == -1) & m["nth"].isNotNull()), 1, 1))
        arity = {"position": (0, 0), "last": (0, 0), "true": (0, 0), "false": (0, 0), "count": (1, 1), "sum": (1, 1), "not": (1, 1), "boolean": (1, 1),
                 "string": (0, 1), "number": (0, 1), "normalize-space": (0, 1), "string-length": (0, 1), "name": (0, 1), "local-name": (0, 1),
                 "contains": (2, 2), "starts-with": (2, 2), "substring-before": (2, 2), "substring-after": (2, 2), "substring": (2, 3),
                 "concat": (2, 99), "translate": (3, 3), "floor": (1, 1), "ceiling": (1, 1), "round": (1, 1), "neg": (1, 1),
                 "or": (2, 2), "and": (2, 2), "+": (2, 2), "-": (2, 2), "*": (2, 2), "div": (2, 2), "mod": (2, 2)}
        low, high = arity.get(name, (1, 0))
        if not low <= len(args) <= high:
            raise RuleError(f"unsupported XPath function {name}() with {len(args)} arguments")
        if name in ("position", "last"):
            if place is None:
                raise RuleError(f"XPath {name}() outside a predicate")
            return Value("number", place if name == "position" else last)
        if name in ("count", "sum", "name", "local-name") and args and args[0].kind not in ("nodes", "strings"):
            raise RuleError(f"XPath {name}() needs nodes")
        one = args[0] if args else here
        if name in ("true", "false", "not", "boolean", "or", "and", "contains", "starts-with"):
            made = {"true": lambda: F.lit(True), "false": lambda: F.lit(False), "not": lambda: ~t(one), "boolean": lambda: t(one),
                    "or": lambda: t(args[0]) | t(args[1]), "and": lambda: t(args[0]) & t(args[1]),
                    "contains": lambda: F.contains(s(args[0]), s(args[1])), "starts-with": lambda: F.startswith(s(args[0]), s(args[1]))}
            return Value("boolean", F.coalesce(made[name](), F.lit(False)))
        if name in ("string", "normalize-space", "substring-before", "substring-after", "substring", "concat", "translate", "name", "local-name"):
            made = {"string": lambda: s(one), "normalize-space": lambda: F.trim(F.regexp_replace(s(one), "[ \t\r\n]+", " ")),
                    "concat": lambda: F.concat(*map(s, args)), "translate": lambda: self.translate(args),
                    "substring-before": lambda: self.cut(s(args[0]), s(args[1]), True), "substring-after": lambda: self.cut(s(args[0]), s(args[1]), False),
                    "substring": lambda: self.substring(args), "name": lambda: self.node_name(one), "local-name": lambda: F.regexp_extract(self.node_name(one), "[^:]*$", 0)}
            return Value("string", made[name]())
        safe = lambda a, b: F.when(b == 0, F.lit(float("nan")) if name == "mod" else a * F.lit(float("inf"))).otherwise(a / b if name == "div" else a % b)
        made = {"count": lambda: F.size(one.column).cast("double"), "number": lambda: x(one), "string-length": lambda: F.length(s(one)).cast("double"),
                "sum": lambda: F.aggregate(self.texts(one), F.lit(0.0), lambda acc, v: acc + self.to_number(v)),
                "floor": lambda: F.floor(x(one)).cast("double"), "ceiling": lambda: F.ceil(x(one)).cast("double"), "round": lambda: F.floor(x(one) + 0.5).cast("double"),
                "neg": lambda: -x(one), "+": lambda: x(args[0]) + x(args[1]), "-": lambda: x(args[0]) - x(args[1]), "*": lambda: x(args[0]) * x(args[1]),
                "div": lambda: safe(x(args[0]), x(args[1])), "mod": lambda: safe(x(args[0]), x(args[1]))}
        return Value("number", made[name]())

    def node_name(self, v: Value) -> Column:
        if v.kind != "nodes":
            raise RuleError("XPath name() needs elements")
        first = F.get(v.column, F.lit(0))
        return F.coalesce(F.when(first["nth"].isNotNull(), first["tag"]), F.lit(""))

    def cut(self, whole: Column, mark: Column, before: bool) -> Column:
        at = F.instr(whole, mark)
        part = F.substring(whole, F.lit(1), at - 1) if before else F.substring(whole, at + F.length(mark), F.length(whole))
        return F.when(at > 0, part).otherwise("")

    def translate(self, args: list[Value]) -> Column:
        return F.call_function("translate", *[self.string(a) for a in args])

    def substring(self, args: list[Value]) -> Column:
        """Characters whose place lies from round(start) on, before round(start) + round(length)."""
        whole, first = self.string(args[0]), F.floor(self.number(args[1]) + 0.5)
        end = F.lit(2**31 - 1) if len(args) == 2 else first + F.floor(self.number(args[2]) + 0.5)
        start = F.greatest(first, F.lit(1))
        return F.when(end > start, F.substring(whole, start.cast("int"), F.least(end - start, F.lit(2**31 - 1)).cast("int"))).otherwise("")


def xpath(path: str, scope: Column, document: Column | None = None) -> Value:
    """What an XPath finds: nodes in document order, attribute values, or one string, number or boolean."""
    return _Compiler(scope, scope if document is None else document).value(_Parser(path).whole(), None, None, None)
