"""HTML to a flat node array.

`parse_html` is the only step that needs Python: it walks the document once and returns the tree as
an array of structs in document order.  A node's subtree is the index range (i, last], so ancestor
tests are interval tests and everything after the parse (selectors, text, tables, links) is a
Catalyst expression over that array.

Tree rules: an end tag closes the nearest open element of its name, unmatched end tags are ignored,
void elements never stay open.
"""

from __future__ import annotations

import re
import sys
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get this module's code with the function: nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Void elements, elements whose text is not page text, attributes holding token lists.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
                 "menuitem meta nextid param source spacer track wbr".split())
OWN_TEXT = frozenset("script style template rt rp".split())
TOKEN_ATTRS = {"class": "*", "accesskey": "*", "dropzone": "*", "rel": "a link area", "rev": "a link",
               "headers": "td th", "accept-charset": "form", "archive": "object", "sizes": "icon",
               "for": "output", "sandbox": "iframe"}

NODE = T.StructType([
    T.StructField("i", T.IntegerType()),          # position in the array, from 0
    T.StructField("up", T.IntegerType()),         # parent position, -1 at the top
    T.StructField("last", T.IntegerType()),       # last position of the subtree
    T.StructField("tag", T.StringType()),         # element name, or #text, #script, ..., #comment
    T.StructField("nth", T.IntegerType()),        # 1-based place among element siblings
    T.StructField("nth_type", T.IntegerType()),   # the same among siblings of this name
    T.StructField("text", T.StringType()),        # content of text and comment nodes
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("shut", T.ArrayType(T.StringType())),  # names of the elements that end after it
])
NODES = T.ArrayType(NODE)


# Text and the plain markup after it: an element's start with its attributes, its end, a comment, or a document type.  Everything else is
# left to the library; what is plain is read here as the library reads it.
_NAME = r"[a-zA-Z][-.a-zA-Z0-9:_]*"
_ATTR = rf"""[ \t\n\r\f]+({_NAME})(?:=(?:"([^"]*)"|'([^']*)'|([^\s"'>=][^\s"'>]*)))?"""
_PLAIN = re.compile(rf"""([^<]*)<(?:({_NAME})((?:{_ATTR.replace(f"({_NAME})", _NAME).replace("([^", "(?:[^")})*)[ \t\n\r\f]*(/?)>"""
                    rf"""|/({_NAME})[ \t\n\r\f]*>|!--(.*?)--\s*>|![dD][oO][cC][tT][yY][pP][eE][^>]*>)""", re.DOTALL)
_ATTRS = re.compile(_ATTR).findall
_BLANK = "\t\n\f\r "
_RAW_END = {tag: re.compile(rf"</\s*{tag}\s*>", re.IGNORECASE) for tag in HTMLParser.CDATA_CONTENT_ELEMENTS}


def _attributes(markup: str) -> list[tuple[str, str]]:
    return [(k.lower(), unescape(v) if "&" in (v := a or b or c) else v) for k, a, b, c in _ATTRS(markup)]


class _Flattener(HTMLParser):
    """Reads the tokens of one document and adds its nodes to columns shared by a whole batch.

    A token is text (or nothing) and what comes after it: a start tag, its attributes (as markup or as pairs) and whether it is
    closed, the name of an end tag, or a comment.
    """

    def __init__(self, batch: "_Batch"):
        super().__init__(convert_charrefs=True)
        self.batch = batch
        self.tokens: list[tuple] = []

    def updatepos(self, i, j):                     # line numbers are not needed
        return j

    def read(self, doc: str) -> None:
        """Read plain markup up to the first place that is not; the library reads on from there."""
        at, plain, tokens = 0, _PLAIN.match, self.tokens
        while (found := plain(doc, at)) is not None:
            token = found.groups()
            piece, tag, _, closed, _, _ = token
            stop = raw = None
            if tag is not None and not closed and tag.lower() in _RAW_END:
                stop = found.end()
                raw = _RAW_END[tag.lower()].search(doc, stop)
                if raw is None:
                    break
            tokens.append((unescape(piece), *token[1:]) if "&" in piece else token)
            if raw is None:
                at = found.end()
            else:
                tokens.append((doc[stop:raw.start()], None, None, None, tag, None))
                at = raw.end()
        if at < len(doc):
            self.feed(doc[at:])
            self.close()

    def handle_starttag(self, tag, attrs):
        self.tokens.append(("", tag, attrs, "", None, None))

    def handle_startendtag(self, tag, attrs):
        self.tokens.append(("", tag, attrs, "/", None, None))

    def handle_endtag(self, tag):
        self.tokens.append(("", None, None, None, tag, None))

    def handle_data(self, data):
        self.tokens.append((data, None, None, None, None, None))

    def handle_comment(self, data):
        self.tokens.append(("", None, None, None, None, data))

    def finish(self) -> None:
        """Add the nodes.  This is the loop that the parse spends its time in, so it calls nothing per node."""
        b = self.batch
        tags, ups, lasts, nths, nth_types, texts = b.tag, b.up, b.last, b.nth, b.nth_type, b.text
        attr_name, attr_value, attr_end, shut, shut_from = b.attr_name, b.attr_value, b.attr_end, b.shut, b.shut_from
        base, at, held = len(tags), 0, ""
        places, names, kinds, counts = [-1], [None], ["#text"], [{}]      # of the open elements, below them the top
        self.tokens.append(("", None, None, None, "", None))            # the text at the end
        for piece, tag, attrs, closed, ended, comment in self.tokens:
            if piece:
                if held:
                    held += piece
                else:
                    held = piece
            if tag is None and ended is None and comment is None:
                continue
            if held:
                if held[0] in _BLANK and not held.strip(_BLANK):        # blank runs carry no more than one break
                    held = "\n" if "\n" in held else " "
                tags.append(kinds[-1])
                ups.append(places[-1])
                lasts.append(at)
                nths.append(0)
                nth_types.append(0)
                texts.append(held)
                attr_end.append(len(attr_name))
                shut_from.append(len(shut))
                at += 1
                held = ""
            if ended is not None:
                ended = ended.lower()
                if ended != names[-1] and ended not in names:
                    continue
                name = None
                while name != ended:
                    name = names.pop()
                    kinds.pop()
                    counts.pop()
                    lasts[base + places.pop()] = at - 1
                    shut.append(name)
                continue
            nth = nth_type = 0
            if tag is None:
                tag = "#comment"
            else:
                tag = tag.lower()
                level = counts[-1]
                level[""] = nth = level.get("", 0) + 1
                level[tag] = nth_type = level.get(tag, 0) + 1
                if attrs:
                    kept = {}
                    for key, value in _attributes(attrs) if type(attrs) is str else attrs:
                        if value and (where := TOKEN_ATTRS.get(key)) and (where == "*" or tag in where.split()):
                            value = " ".join(value.split())
                        kept[key] = value or ""
                    attr_name += kept       # the names
                    attr_value += kept.values()
            tags.append(tag)
            ups.append(places[-1])
            lasts.append(at)
            nths.append(nth)
            nth_types.append(nth_type)
            texts.append(comment)
            attr_end.append(len(attr_name))
            shut_from.append(len(shut))
            if nth and not closed and tag not in VOID:
                places.append(at)
                names.append(tag)
                kinds.append("#" + tag if tag in OWN_TEXT else kinds[-1])
                counts.append({})
            at += 1
        while len(names) > 1:
            lasts[base + places.pop()] = at - 1
            shut.append(names.pop())


# Declarations that are neither comments nor the document type: bogus comments, which end at the next ">".
_BOGUS = re.compile(r"<!(?!--|doctype)[^>]*>", re.IGNORECASE)


class _Batch:
    """Columns of all documents of an Arrow batch: flat lists, no object per node."""

    def __init__(self):
        self.tag: list[str] = []
        self.up: list[int] = []
        self.last: list[int] = []
        self.nth: list[int] = []                  # 0 for none
        self.nth_type: list[int] = []
        self.text: list[str | None] = []
        self.attr_name: list[str] = []
        self.attr_value: list[str] = []
        self.attr_end = [0]
        self.shut: list[str] = []                 # names of elements in the order in which they end
        self.shut_from: list[int] = []            # how many have ended before a node
        self.offsets = [0]

    def read(self, doc: str | None) -> None:
        if doc and not self._flatten(doc):
            self._flatten(_BOGUS.sub("", doc))
        self.offsets.append(len(self.tag))

    def _flatten(self, doc: str) -> bool:
        """Add the nodes of a document; nothing is added if a declaration stops the tokenizer."""
        flat = _Flattener(self)
        try:
            flat.read(doc)
        except (AssertionError, ValueError):
            return False
        flat.finish()
        return True

    def to_arrow(self) -> pa.Array:
        starts = np.repeat(self.offsets[:-1], np.diff(self.offsets))
        position = np.arange(len(self.tag)) - starts
        ints = lambda values, none=None: pa.array(np.array(values, np.int32), mask=none)
        strings = lambda values: pa.array(values, pa.string())
        no_place = np.array(self.nth) == 0
        shut_from = np.array([*self.shut_from, len(self.shut)])
        fields = {"i": ints(position), "up": ints(self.up), "last": ints(self.last), "tag": strings(self.tag),
                  "nth": ints(self.nth, no_place), "nth_type": ints(self.nth_type, no_place), "text": strings(self.text),
                  "attrs": pa.MapArray.from_arrays(ints(self.attr_end), strings(self.attr_name), strings(self.attr_value)),
                  "shut": pa.ListArray.from_arrays(ints(shut_from), strings(self.shut), mask=pa.array(np.diff(shut_from) == 0, pa.bool_()))}
        nodes = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
        return pa.ListArray.from_arrays(ints(self.offsets), nodes)


def _parse_batch(html: pa.Array) -> pa.Array:
    batch = _Batch()
    for doc in html.to_pylist():
        batch.read(doc)
    return batch.to_arrow()


@F.arrow_udf(NODES)
def _parse_udf(html: pa.Array) -> pa.Array:
    return _parse_batch(html)


# A filter on what is read off the nodes stays above the parse; else the optimizer would copy the parse into it.
_parse_once = F.arrow_udf(_parse_batch, NODES).asNondeterministic()


def parse_html(html: Column, once: bool = False) -> Column:
    """The node array of an HTML document (empty for null or empty text).

    With `once` no filter moves below the parse, so that none repeats it: rows are then chosen before."""
    return _parse_once(html) if once else _parse_udf(html)


def register_sql(spark) -> None:
    """Make the parse step callable from SQL: `LATERAL VIEW OUTER inline(parse_html(html))` gives node rows."""
    spark.udf.register("parse_html", _parse_udf)
