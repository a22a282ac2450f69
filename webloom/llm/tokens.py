"""Token ids of texts by a public tokenizer file, through a bounded cache of space-delimited units.

A pretokenizer never joins characters across certain spaces, so the ids of a text are the ids of the units
between them, one after the other.  A unit is encoded by the tokenizers library the first time a worker
meets it; an `IdStore` keeps it while it is met again.

Strings of special tokens in a text are ordinary text (`encode_special_tokens`), as the vocabularies' own description
states: a document may quote an end marker, but only the writer of a file sets one.
"""

from __future__ import annotations

import ctypes
import functools
import itertools
import operator
import os
import re
import sys
import types
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CACHE_UNITS = 250_000      # units of one generation of a store
CACHE_IDS = 2_500_000
LONG_UNIT = 64          # characters; longer units are encoded one by one

_WORDS = re.compile("[^ \\t-\\r]+")
# A break, a Latin word and the punctuation after it are encoded apart by either pretokenizer.
_MARKS = "-.,;:!?%*&$#|()"
_STEM = re.compile(f"([\t\n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([{_MARKS}]*)")
_LATIN = "".join(c for c in map(chr, range(256)) if re.match("[A-Za-zÀ-ÖØ-öø-ÿ]", c))
_IDS = functools.partial(map, operator.attrgetter("id"))
_BARE = "\t"            # before a unit of kind "bytes": no space belongs to it
# How byte-level vocabularies spell bytes that are no visible Latin-1 character, 256 and up in order.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: b for b in _VISIBLE} | {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - _VISIBLE))}


def public_path(name: str) -> str:
    """Where an installed public vocabulary file lies; an absolute path stays as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class IdStore:
    """Id lists of units, in two generations.

    A full generation (`CACHE_UNITS` units or `CACHE_IDS` ids) becomes the older one and a new one starts; units of the
    older one that are met again move over, and those that are not go with it.
    """

    def __init__(self, most_units: int = CACHE_UNITS, most_ids: int = CACHE_IDS) -> None:
        self.most_units, self.most_ids, self.older = most_units, most_ids, None
        self._begin()

    def _begin(self) -> None:
        self.known = defaultdict(itertools.count().__next__)      # numbers units in the order in which they are first asked for
        self.learnt = 0                                           # so many of them are encoded
        self.start = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0

    def turn(self) -> None:
        """Between two batches: start a new generation if this one is full."""
        if len(self.known) > self.most_units or self.used > self.most_ids:
            self.older = types.SimpleNamespace(known=self.known, start=self.start, length=self.length, ids=self.ids)
            self._begin()

    def numbers(self, units: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def asked(self) -> tuple[list[str], np.ndarray]:
        """Units asked for since the last time that neither generation knows, and their numbers."""
        numbers = np.arange(self.learnt, len(self.known))
        units = list(itertools.islice(reversed(self.known), len(numbers)))[::-1]
        self.learnt = len(self.known)
        if self.older is None or not units:
            return units, numbers
        places = np.fromiter(map(self.older.known.get, units, itertools.repeat(-1)), np.int64, len(units))
        again = places >= 0
        self.put(numbers[again], *_gathered(self.older, places[again]))
        left = np.flatnonzero(~again)
        return [units[i] for i in left.tolist()], numbers[left]

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered units one after the other, and how many each has."""
        return _gathered(self, index)

    def put(self, numbers: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        total = len(ids)
        while len(self.known) > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used:self.used + total] = ids
        self.start[numbers] = self.used + np.cumsum(lens) - lens
        self.length[numbers] = lens
        self.used += total

    def put_lists(self, numbers: np.ndarray, found: list[list], of: Callable[[Iterable], Iterable[int]] = iter) -> None:
        lens = np.fromiter(map(len, found), np.int64, len(found))
        self.put(numbers, np.fromiter(of(itertools.chain.from_iterable(found)), np.uint32, int(lens.sum())), lens)


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _gathered(store, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lens = store.length[index]
    ends = np.cumsum(lens)
    return store.ids[np.repeat(store.start[index] - (ends - lens), lens) + np.arange(int(lens.sum()))], lens


class Encoder:
    """`encode(texts)` gives all ids of a list of texts and how many each has.

    `kind` "words": white space only separates (it leaves no id).  `kind` "bytes": white space has ids; a single
    space belongs to the word after it, so such units are stored without it and others behind `_BARE`.  None is encoded like the empty text, which has no ids.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(public_path(path))
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.kind = kind
        self.mark = "|" if kind == "words" else "\n"
        self.mark_id = self._raw([self.mark])[0][0]
        self.store = IdStore()

    def _raw(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _many(self, units: list[str], numbers: np.ndarray) -> None:
        """Learn units, encoded as long lines of units with the mark between them."""
        mark, plain, odd = self.mark, [], []
        for i, u in enumerate(units):
            if not u or mark in u or len(u) > LONG_UNIT or self.kind == "bytes" and not (u[-1] != " " and u.isprintable()):
                odd.append(i)       # white space at an end would join the mark
            else:
                plain.append(i)
        glue = f" {mark} " if self.kind == "words" else mark
        lines = [plain[i:i + 256] for i in range(0, len(plain), 256)]
        for line, ids in zip(lines, self._raw([glue.join([units[i] for i in x]) for x in lines]), strict=True):
            got = np.array(ids, np.uint32)
            cuts = np.flatnonzero(got == self.mark_id)
            if len(cuts) == len(line) - 1:
                self.store.put(numbers[line], got[got != self.mark_id], np.diff(np.concatenate([[-1], cuts, [len(got)]])) - 1)
            else:
                odd += line
        for first in range(0, len(odd), 1000):
            part = odd[first:first + 1000]
            self.store.put_lists(numbers[part], self._raw([units[i] for i in part]))

    def _letters(self, units: list[str], numbers: list[int]) -> None:
        """Learn units of Latin letters alone: each is one pretoken, so the library's merges are all it needs."""
        merge, words = self.model.tokenize, self.kind == "words"
        space, bare = chr(_BYTE_LETTERS[32]), (_BARE, chr(_BYTE_LETTERS[ord(_BARE)]))
        if words:
            units = [u.lower() for u in units]
        spelled = [u if u.isascii() else u.encode().decode("latin-1").translate(_BYTE_LETTERS) for u in units]
        if not words:       # a visible letter stands for itself
            spelled = [u[1:] if u[0] in bare else space + u for u in spelled]
        for first in range(0, len(spelled), 128):       # few at a time: the library's token objects stay in the processor's cache
            self.store.put_lists(np.array(numbers[first:first + 128], np.int64), list(map(merge, spelled[first:first + 128])), _IDS)

    def _learn(self) -> None:
        """Encode all units asked for since the last time.

        A unit of a break, letters and punctuation is put together from these parts, which either pretokenizer keeps apart.
        """
        letters, letter_numbers, others, other_numbers, whole, parts = [], [], [], [], [], []
        match, words = _STEM.fullmatch, self.kind == "words"
        units, numbers = self.store.asked()
        for u, n in zip(units, numbers.tolist(), strict=True):
            stem = u.rstrip(_MARKS)
            if stem.isalpha() and stem.isascii() and len(u) <= LONG_UNIT:       # most units; the others take the expression
                if len(stem) == len(u):
                    letters.append(u)
                    letter_numbers.append(n)
                else:
                    whole.append(n)
                    parts += (stem, u[len(stem):]) if words else (_BARE, stem, _BARE + u[len(stem):])
                continue
            m = match(u)
            if m is None or len(u) > LONG_UNIT:
                others.append(u)
                other_numbers.append(n)
                continue
            head, stem, tail = m.groups()
            if not tail and head != "\n":
                letters.append(u)
                letter_numbers.append(n)
            else:
                whole.append(n)
                parts += (stem, tail) if words else (_BARE + head.strip(_BARE), _BARE * bool(head) + stem, _BARE + tail)
        index = self.store.numbers(parts)
        units, numbers = self.store.asked()
        for u, n in zip(units, numbers.tolist(), strict=True):
            mine, its = (letters, letter_numbers) if u[-1].isalpha() else (others, other_numbers)
            mine.append(u)
            its.append(n)
        self._letters(letters, letter_numbers)
        self._many([self._text(u) for u in others], np.array(other_numbers, np.int64))
        if whole:
            ids, lens = self.store.gather(index)
            self.store.put(np.array(whole, np.int64), ids, lens.reshape(len(whole), -1).sum(1))

    def _text(self, unit: str) -> str:
        """The text that a unit stands for."""
        if self.kind == "words" or unit[0] == "\n":
            return unit
        return unit[1:] if unit[0] == _BARE else " " + unit

    def _glued(self, text: str) -> str | None:
        """The units of a text with one space between any two; None if they lie otherwise."""
        plain = text.replace("\n", " ")
        if not plain.isprintable() or "  " in plain or plain[:1] == " " or plain[-1:] == " ":
            return None
        return plain if self.kind == "words" else _BARE + text.replace("\n", f" \n {_BARE}")      # a break alone is a unit

    def units(self, text: str) -> list[str]:
        if (glued := self._glued(text)) is not None:
            return glued.split(" ")
        if self.kind == "words":
            return _WORDS.findall(text)
        return [u[1:] if u[0] == " " and len(u) > 1 and u[1] not in " \t\n" else _BARE + u for u in self._spaced(text)]

    def _spaced(self, text: str) -> list[str]:
        """Cut any text at the spaces and line breaks beside which pretokens end."""
        out: list[str] = []
        for line_no, line in enumerate(text.split("\n")):
            pieces = line.split(" ")
            whole = [pieces[0]]
            for p in pieces[1:]:
                if whole[-1] and p and not p[0].isspace() and p[0].isprintable() and not whole[-1][-1].isspace() and whole[-1][-1].isprintable():
                    whole.append(" " + p)
                else:
                    whole[-1] += " " + p
            if line_no:
                # a line break alone between two words is a unit of its own
                if out and out[-1] and out[-1][-1].isprintable() and not out[-1][-1].isspace() and whole[0] and whole[0][0].isprintable() and not whole[0][0].isspace():
                    out.append("\n")
                    out += whole
                else:
                    out[-1] += "\n" + whole[0]
                    out += whole[1:]
            else:
                out += whole
        return out if out != [""] else []

    def _parts(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each unit and -1, or the numbers of its letters and of the punctuation after them."""
        stems, tails = pc.utf8_rtrim(units, _MARKS), pc.utf8_ltrim(units, _LATIN + _BARE)
        sizes = [pc.binary_length(x).to_numpy() for x in (units, stems, tails)]
        apart = (sizes[1] > 0) & (sizes[2] > 0) & (sizes[1] + sizes[2] == sizes[0])
        stems = pc.if_else(pa.array(apart), stems, units).dictionary_encode()
        tails = tails.filter(pa.array(apart)).dictionary_encode()
        second = np.full(len(units), -1)
        second[apart] = self.store.numbers([t if self.kind == "words" else _BARE + t for t in _strings(tails.dictionary)])[tails.indices.to_numpy()]
        return self.store.numbers(_strings(stems.dictionary))[stems.indices.to_numpy()], second

    def _numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all units and how many each text has.  Arrow cuts the texts and finds their distinct units."""
        glued = [self._glued(text) if text else None for text in texts]
        cut = pc.split_pattern(pa.array(glued, pa.large_string()), " ")
        units = cut.flatten().dictionary_encode()
        both = np.stack([part[units.indices.to_numpy()] for part in self._parts(units.dictionary)], 1)
        there = np.concatenate([[0], np.cumsum((both >= 0).sum(1))])[cut.offsets.to_numpy()]
        index, counts = both[both >= 0], np.diff(there)
        others = [i for i, text in enumerate(texts) if text and glued[i] is None]
        if not others:
            return index, counts
        own = [self.units(texts[i]) for i in others]
        other = np.zeros(len(texts), bool)
        other[others] = True
        index = index[np.repeat(~other, counts)]
        counts[others] = list(map(len, own))
        other = np.repeat(other, counts)
        out = np.empty(len(other), np.int64)
        out[~other], out[other] = index, self.store.numbers(list(itertools.chain.from_iterable(own)))
        return out, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        self.store.turn()
        index, counts = self._numbered(texts)
        self._learn()
        out, lens = self.store.gather(index)
        edges = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])]
        return out, np.diff(edges)


def encoder(path: str, kind: str) -> Encoder:
    """One encoder per worker process and file: its cache serves all tasks that the process runs."""
    store = sys.modules.setdefault("_webloom_encoders", types.ModuleType("_webloom_encoders"))
    if not hasattr(store, "made"):
        store.made = {}
    if (path, kind) not in store.made:
        store.made[path, kind] = Encoder(path, kind)
    return store.made[path, kind]


def forget() -> None:
    """Let go of the encoders that this worker process holds from an earlier step; a step without tokens needs their memory.

    What is free goes back to the system: else the allocators keep most of it beside the JVM's.
    """
    sys.modules.pop("_webloom_encoders", None)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of the GNU library alone
    if trim is not None:
        trim(0)


def slices(texts: list[str | None], most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with at most `most` characters each, one text at least."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        own = len(text) if text else 0
        if i > first and size + own > most:
            yield first, i
            first, size = i, 0
        size += own
    if first < len(texts):
        yield first, len(texts)
