"""Text helpers as Column expressions, with the character classes spelled out.

The shorthand `\\s`, `\\w`, `\\d` are ASCII in Java; these sets are the Unicode ones.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as split by `str.split()`, word characters, decimal digits.  The property
# form of the space set is four times as fast in Java as the same set written as ranges.
SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
               "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
SPACE_SET = r"\x1c-\x1f\p{IsWhite_Space}"
SPACE = f"[{SPACE_SET}]"
WORD_SET = r"\p{L}\p{N}_"
WORD = f"[{WORD_SET}]"
DIGIT = r"\p{Nd}"
TOKEN = WORD + "{2,}"

# Decimal digits of all scripts and their ASCII values, from the Unicode character database.
_FOREIGN_DIGITS = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd"]
_DIGITS_FROM = "".join(_FOREIGN_DIGITS)
_DIGITS_TO = "".join(str(unicodedata.digit(ch)) for ch in _FOREIGN_DIGITS)


def let(value: Column, body) -> Column:
    """Bind `value` once inside an expression: `body` may use it any number of times, also within
    lambdas, without it being evaluated again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; ends are stripped."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, _DIGITS_FROM, _DIGITS_TO)


def words(c: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Lower-case word tokens of at least two characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def tokenize(text: str) -> list[str]:
    """`tokens` for a single driver-side string such as a search query."""
    return re.findall(r"\w{2,}", text.lower())


def java_pattern(pattern: str) -> str:
    """A user's Python regular expression in Java spelling, shorthand classes kept Unicode-wide."""
    shorthand = {"w": WORD_SET, "d": DIGIT, "s": SPACE_SET}
    negated = {"W": f"[^{WORD_SET}]", "D": r"\P{Nd}", "S": f"[^{SPACE_SET}]"}
    out, in_class = [], False
    for piece in re.findall(r"\\.|\(\?P<|\(\?P=\w+\)|.", pattern, re.S):
        if piece[0] == "\\" and piece[1] in shorthand:
            body = shorthand[piece[1]]
            out.append(body if in_class else f"[{body}]")
        elif piece[0] == "\\" and piece[1] in negated:
            out.append(negated[piece[1]])
        elif piece == "(?P<":
            out.append("(?<")
        elif piece.startswith("(?P="):
            out.append(rf"\k<{piece[4:-1]}>")
        elif piece == r"\Z":
            out.append(r"\z")
        else:
            in_class = (piece == "[") or (in_class and piece != "]")
            out.append(piece)
    return "".join(out)


def java_replacement(replacement: str) -> str:
    """Python replacement text (`\\1`, `\\g<name>`) in Java spelling (`$1`, `${name}`)."""
    text = replacement.replace("$", r"\$")
    text = re.sub(r"\\g<(\d+)>", r"$\1", text)
    text = re.sub(r"\\g<(\w+)>", r"${\1}", text)
    return re.sub(r"\\(\d)", r"$\1", text)


def regex_pick(c: Column, pattern: str) -> Column:
    """First group of the first match (the whole match when there are no groups); null when the
    pattern does not match; empty text passes through untouched."""
    java = java_pattern(pattern)
    group = 1 if re.compile(pattern).groups else 0
    return F.when(c == "", c).when(c.rlike(java), F.regexp_extract(c, java, group))
