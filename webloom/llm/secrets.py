"""Secret scans: fixed patterns, and a battery of randomness tests on tokens of known encodings.

Patterns (kinds `assign`, `access`, `hex`) match leftmost and without overlap, each kind for itself.  The battery looks at
tokens of `MIN_TOKEN` characters or more that hold a digit and a letter and lie outside the pattern spans.  `=` parts a name from
its value and so ends a token; only at the end of a token it is padding.  Each token has an encoding: hex, base32, or the
letters of one case or both with digits and those of `+/` and `-_` that occur.  On the values of the token's characters in that
alphabet it computes
 * chi-squared uniformity over eight equal parts of the alphabet (Wilson-Hilferty approximation),
 * the runs test about the middle of the alphabet,
 * the serial correlation at lag one,
and takes three times the smallest of the three p-values.  Whether a token is too regular to be random is a family of tests
over the whole corpus: in each stratum of encoding and length class (doubling lengths) the Benjamini-Hochberg procedure at
`FALSE_DISCOVERIES` rejects the regular ones, so that the rate of random tokens lost among them is controlled at every
length, however many tokens of other lengths there are.

Short tokens pass such tests whatever they say, so what is left must also differ from ordinary words.  The null is a chain of
letter pairs: 26 letters without case, and one state for all digits; `-_/+` part a token.  Its 729 probabilities come
from the distinct words of 2 to 19 such characters of all documents, beside a fixed prior of letter frequencies.
Under the null the sum of a token's pair costs, less its mean and over its deviation, is about normal; its upper tail is the
p-value of an ordinary token.  The same procedure per stratum rejects the null at `FALSE_DISCOVERIES`, which controls the rate of
ordinary tokens among those reported as kind `random`.

p-values are compared in steps of a twentieth of a decade, rounded up, so each procedure needs only a table of counts of
bounded size (13 encodings x 32 length classes x 401 steps), from which at most 416 thresholds reach the driver.

Edge cases: null and empty texts have no spans; rows with equal doc_ids are scanned on their own; a token without any
variation has p = 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import materialize

KINDS = ("assign", "access", "hex", "random")
# Fixed patterns.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
MIN_VALUE = 12

MIN_TOKEN = 20
TOKEN = f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}(?![A-Za-z0-9+/_-])(?:={{1,6}}(?![A-Za-z0-9+/_=-]))?"
FALSE_DISCOVERIES = 0.05
# Usual letter frequencies of English text, in percent, a to z.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.15, 2.0, 0.07)
DIGIT_AFTER_LETTER, DIGIT_AFTER_DIGIT, PRIOR_PAIRS = 0.02, 0.8, 200      # the prior and its weight per state
STEPS, LAST_STEP = 20, 400      # p-value steps per decade; the last holds all smaller values

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
DIGITS = "0123456789"
# encoding -> (shape, alphabet); the first that fits is taken
ENCODINGS = {
    "hex": ("^([0-9a-f]+|[0-9A-F]+)=*$", DIGITS + "abcdef"),
    "base32": ("^[A-Z2-7]+=*$", UPPER + "234567"),
    "base36": ("^[a-z0-9]+=*$", DIGITS + LOWER),
    "base36upper": ("^[A-Z0-9]+=*$", DIGITS + UPPER),
    "lowerurl": ("^[a-z0-9_-]+=*$", DIGITS + LOWER + "-_"),
    "upperurl": ("^[A-Z0-9_-]+=*$", DIGITS + UPPER + "-_"),
    "lower64": ("^[a-z0-9+/]+=*$", DIGITS + LOWER + "+/"),
    "upper64": ("^[A-Z0-9+/]+=*$", DIGITS + UPPER + "+/"),
    "lowerall": ("^[a-z0-9+/_-]+=*$", DIGITS + LOWER + "+/-_"),
    "upperall": ("^[A-Z0-9+/_-]+=*$", DIGITS + UPPER + "+/-_"),
    "base64": ("^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    "base64url": ("^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
    "all": ("^[A-Za-z0-9+/_-]+=*$", UPPER + LOWER + DIGITS + "+/-_"),
}


def _spans(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """array<struct<a, b>> of a pattern's matches in characters; with `group`, of those whose group is long enough.

    The text is cut at the matches; matches and what lies between them add up to the offsets.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    sizes = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(matches), F.lit(1))), F.arrays_zip(matches.alias("m"), values.alias("v")),
                       lambda gap, mv: F.struct(F.length(gap).alias("gap"), F.length(mv["m"]).alias("own"), F.length(mv["v"]).alias("value")))
    start = F.struct(F.lit(0).alias("at"), _no_spans().alias("found"))
    walked = F.aggregate(sizes, start, lambda acc, s: F.struct(
        (acc["at"] + s["gap"] + s["own"]).alias("at"),
        F.when(s["value"] >= least, F.concat(acc["found"], F.array(F.struct((acc["at"] + s["gap"]).alias("a"), (acc["at"] + s["gap"] + s["own"]).alias("b")))))
        .otherwise(acc["found"]).alias("found")))
    return F.when(text.rlike(pattern), walked["found"]).otherwise(_no_spans())


def _no_spans() -> Column:
    return F.expr("cast(array() as array<struct<a:int,b:int>>)")


def _upper_tail(z: Column) -> Column:
    """1 - Phi(|z|), by the usual rational approximation (absolute error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return poly * F.exp(-x * x / 2) / 2.5066282746310002


def _p_step(c: Column) -> Column:
    """The step of the combined p-value of a candidate with the sums of `_sums`."""
    n, size = c["n"].cast("double"), c["size"].cast("double")
    expected = n / 8
    chi = reduce(lambda x, y: x + y, [(c[f"c{i}"] - expected) * (c[f"c{i}"] - expected) for i in range(8)]) / expected
    df = 7.0
    z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
    p_chi = F.when(z_chi >= 0, _upper_tail(z_chi)).otherwise(1 - _upper_tail(z_chi))
    high, low = c["high"].cast("double"), n - c["high"]
    mean = 2 * high * low / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = F.when(spread <= 0, 0.0).otherwise(2 * _upper_tail((c["runs"] - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9)))))
    m = c["s1"] / n
    variance = c["s2"] - n * m * m
    # sum of (x_i - m)(x_{i+1} - m), from plain sums
    lagged = c["s12"] - m * (2 * c["s1"] - c["first"] - c["last"]) + (n - 1) * m * m
    r = F.when(variance <= 0, 1.0).otherwise(lagged / F.greatest(variance, F.lit(1e-9)))
    p_serial = F.when(variance <= 0, 0.0).otherwise(2 * _upper_tail((r + 1 / n) * F.sqrt(n)))
    p = F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))
    return F.when(p <= 0, LAST_STEP).otherwise(F.least(F.lit(LAST_STEP), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * STEPS).cast("int")))


_SUM_FIELDS = ["n", "high", "runs", "s1", "s2", "s12", "first", "last", *[f"c{i}" for i in range(8)]]


def _sums(values: Column, size: Column) -> Column:
    """Everything the tests need of a sequence of alphabet values, in one pass."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f) for f in _SUM_FIELDS])

    def add(acc: Column, x: Column) -> Column:
        up, was_up = 2 * x >= size, 2 * acc["last"] >= size
        opening = acc["n"] == 0
        return F.struct(
            (acc["n"] + 1).alias("n"), (acc["high"] + up.cast("long")).alias("high"),
            (acc["runs"] + F.when(opening | (up != was_up), 1).otherwise(0)).alias("runs"),
            (acc["s1"] + x).alias("s1"), (acc["s2"] + x * x).alias("s2"),
            (acc["s12"] + F.when(opening, 0).otherwise(x * acc["last"])).alias("s12"),
            F.when(opening, x).otherwise(acc["first"]).alias("first"), x.alias("last"),
            *[(acc[f"c{i}"] + F.when(F.floor(8 * x / size) == i, 1).otherwise(0)).alias(f"c{i}") for i in range(8)])
    return F.aggregate(values, zero, add)


def _by_encoding(encoding: Column, of: dict[str, object]) -> Column:
    out = F.lit(None)
    for name, value in of.items():
        out = F.when(encoding == name, F.lit(value)).otherwise(out)
    return out


def _encoding(token: Column) -> Column:
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    out = F.lit(None).cast("string")
    for name, (shape, _) in reversed(ENCODINGS.items()):
        out = F.when(token.rlike(shape) & mixed, name).otherwise(out)
    return out


def _state(character: Column) -> Column:
    """0 to 25 for the letters a to z, 26 for digits, -1 for all else."""
    return F.when(character.between("0", "9"), F.lit(26)).otherwise(F.instr(F.lit(LOWER), character) - 1)


def word_pairs(docs: DataFrame) -> list[list[float]]:
    """The 27 x 27 probabilities of the state after a state, from the distinct words of `docs`; 729 counts reach the driver."""
    # a long token is no word and must not fall into several, so words end where tokens do
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), "[^a-z0-9+/_-]+")).alias("word"))
    words = words.where(F.length("word").between(2, MIN_TOKEN - 1)).distinct()
    pairs = words.select(F.transform(F.split("word", ""), _state).alias("x"))
    both = F.zip_with(F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.size("x") - 1), lambda a, b: F.when((a >= 0) & (b >= 0), 27 * a + b))
    pairs = pairs.select(F.explode(both).alias("pair")).where("pair is not null")
    share = [x / sum(LETTERS) for x in LETTERS]
    counts = [[PRIOR_PAIRS * p for p in (*[(1 - d) * x for x in share], d)] for d in [DIGIT_AFTER_LETTER] * 26 + [DIGIT_AFTER_DIGIT]]
    for pair, n in pairs.groupBy("pair").count().collect():
        counts[pair // 27][pair % 27] += n
    return [[n / sum(row) for n in row] for row in counts]


def _odd_step(token: Column, pairs: list[list[float]]) -> Column:
    """The step of the p-value of an ordinary token whose pairs are as rare as these."""
    mean = [sum(-p * math.log(p) for p in row) for row in pairs]
    variance = [sum(p * math.log(p) ** 2 for p in row) - m * m for row, m in zip(pairs, mean, strict=True)]
    costs, means, variances = (F.lit([float(x) for x in of]) for of in ([-math.log(p) for row in pairs for p in row], mean, variance))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("excess"), F.lit(0.0).alias("variance"))

    def add(acc: Column, x: Column) -> Column:
        known = (acc["last"] >= 0) & (x >= 0)
        return F.struct(x.alias("last"),
                        F.when(known, acc["excess"] + costs[F.greatest(27 * acc["last"] + x, F.lit(0))] - means[F.greatest(acc["last"], F.lit(0))])
                        .otherwise(acc["excess"]).alias("excess"),
                        F.when(known, acc["variance"] + variances[F.greatest(acc["last"], F.lit(0))]).otherwise(acc["variance"]).alias("variance"))

    def step(acc: Column) -> Column:
        z = acc["excess"] / F.sqrt(F.greatest(acc["variance"], F.lit(1e-9)))
        tail = F.greatest(_upper_tail(z), F.lit(1e-300))
        return F.when((acc["variance"] <= 0) | (z <= 0), 0).otherwise(F.least(F.lit(LAST_STEP), F.floor(-F.log10(tail) * STEPS).cast("int")))
    return F.aggregate(F.transform(F.split(F.lower(token), ""), _state), start, add, step)


def candidates(docs: DataFrame, pairs: list[list[float]] | None = None) -> DataFrame:
    """doc_id, base spans (`base`: kind number, a, b) and tested tokens (`tokens`: a, b, stratum, `step` of the battery, `odd` step
    against ordinary words).  No shuffle but that of `word_pairs`, if they are not given."""
    pairs = pairs or word_pairs(docs)
    text = F.col("_text")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = rows.select("*", _spans(text, ASSIGN, 1, MIN_VALUE).alias("_assign"), _spans(text, ACCESS).alias("_access"),
                       _spans(text, HEX).alias("_hex"), _spans(text, TOKEN).alias("_token"))

    def numbered(name: str, kind: int) -> Column:
        return F.transform(name, lambda s: F.struct(s["a"].alias("a"), F.lit(kind).alias("kind"), s["b"].alias("b")))
    rows = rows.withColumn("base", F.array_sort(F.concat(numbered("_assign", 0), numbered("_access", 1), numbered("_hex", 2))))
    free = F.filter("_token", lambda t: ~F.exists("base", lambda s: (s["a"] < t["b"]) & (t["a"] < s["b"])))
    named = F.transform(free, lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), F.substring(text, t["a"] + 1, t["b"] - t["a"]).alias("token")))
    rows = rows.withColumn("_named", F.transform(named, lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["token"].alias("token"),
                                                                           _encoding(t["token"]).alias("encoding"),
                                                                           _odd_step(t["token"], pairs).alias("odd"))))
    known = F.filter("_named", lambda t: t["encoding"].isNotNull())
    alphabet = {name: alphabet for name, (_, alphabet) in ENCODINGS.items()}
    valued = F.transform(known, lambda t: F.struct(
        t["a"].alias("a"), t["b"].alias("b"), t["encoding"].alias("encoding"), t["odd"].alias("odd"),
        _by_encoding(t["encoding"], {k: len(v) for k, v in alphabet.items()}).alias("size"),
        F.transform(F.split(F.rtrim(F.when(t["encoding"] == "hex", F.lower(t["token"])).otherwise(t["token"]), F.lit("=")), ""),
                    lambda ch: (F.instr(_by_encoding(t["encoding"], alphabet), ch) - 1).cast("long")).alias("values")))
    rows = rows.withColumn("_valued", valued)
    summed = F.transform("_valued", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["encoding"].alias("encoding"), t["odd"].alias("odd"),
                                                       t["size"].alias("size"), _sums(t["values"], t["size"]).alias("sums")))
    rows = rows.withColumn("_summed", summed)
    tested = F.transform("_summed", lambda t: F.struct(
        t["a"].alias("a"), t["b"].alias("b"),
        F.concat(t["encoding"], F.lit(":"), F.floor(F.log2(t["sums"]["n"].cast("double"))).cast("string")).alias("stratum"),
        _p_step(_Flat(t)).alias("step"), t["odd"].alias("odd")))
    return rows.select("doc_id", "base", tested.alias("tokens"))


class _Flat:
    """Field access over a candidate's own fields and its sums."""

    def __init__(self, c: Column):
        self.c = c

    def __getitem__(self, name: str) -> Column:
        return self.c[name] if name == "size" else self.c["sums"][name]


def thresholds(tested: DataFrame, rate: float = FALSE_DISCOVERIES, field: str = "step") -> dict[str, int]:
    """The first rejected step of each stratum that rejects any: the Benjamini-Hochberg step-up over stored counts."""
    counts = tested.select(F.explode("tokens").alias("t")).groupBy("t.stratum", F.col(f"t.{field}").alias("step")).agg(F.count("*").alias("n"))
    smaller = Window.partitionBy("stratum").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select("stratum", "step", F.sum("n").over(smaller).alias("k"), F.sum("n").over(Window.partitionBy("stratum")).alias("m"))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= rate * F.col("k") / F.col("m"))
    return {r[0]: r[1] for r in passed.groupBy("stratum").agg(F.min("step")).collect()}


def _listed(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(kind[s["kind"]], F.lit(":"), s["a"].cast("string"), F.lit(":"), s["b"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the pattern spans) and spans (all, `kind:start:end` by start)."""
    tested = materialize(candidates(docs), "tokens")

    def first(field: str, t: Column) -> Column:
        limits = limit_of[field]
        known = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else F.expr("cast(map() as map<string,int>)")
        return F.coalesce(F.element_at(known, t["stratum"]), F.lit(LAST_STEP + 1))
    limit_of = {field: thresholds(tested, rate, field) for field in ("step", "odd")}
    random = F.transform(F.filter("tokens", lambda t: (t["step"] < first("step", t)) & (t["odd"] >= first("odd", t))),
                         lambda t: F.struct(t["a"].alias("a"), F.lit(3).alias("kind"), t["b"].alias("b")))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return tested.select("doc_id", count(0), count(1), count(2), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                         _listed(F.array_sort(F.concat("base", random))).alias("spans"))
