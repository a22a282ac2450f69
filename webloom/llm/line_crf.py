"""Document quality by line sequence labelling: a linear-chain conditional random field marks lines as content or boilerplate.

The model has two labels, weights for the features of a line, and weights for the step from one label to the next.  It is
trained on the driver from a bounded sample of labelled documents (`TRAIN_DOCUMENTS` of each quality class, chosen
by a hash of doc_id, none over `TRAIN_CHARS` characters) by gradient ascent of the conditional likelihood with forward-backward
sums.  Documents that fail the base rules are no examples.  Labels of lines are weak: lines of a document of quality 0 are boilerplate, lines of quality 1 content, and a line
of at most `COMMON_WORDS` words that occurs in `COMMON_LINE` sampled documents or more is boilerplate everywhere.  Each document is then decoded by Viterbi
over all its lines, and stays if content lines hold `CONTENT_SHARE` of its characters and it passes the base rules:
fifty words or more, and at most half of them in three-word windows that occur twice.

Edge cases: a null or empty text has no words and fails the base rules; lines without a word are never labelled; without
labelled documents of both classes there is no model, and the base rules alone decide; rows are judged one by one, so repeated
and null doc_ids do not matter; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.tokens import forget, slices
from webloom.llm.wordhash import constants, hash_words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAIN_DOCUMENTS = 1000
TRAIN_CHARS = 20_000
TRAIN_LINES = 64            # longer documents are several training sequences
COMMON_LINE, COMMON_WORDS = 5, 20
ITERATIONS, RATE, PENALTY = 400, 0.3, 1e-4
CONTENT_SHARE = 0.5
SLICE = 500_000             # characters measured at once, one text at least

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"

_KIND = {name: np.zeros(256, np.int8) for name in ("symbol", "bang", "upper", "lower", "digit", "pipe", "space", "point")}
for _b in range(256):
    _KIND["symbol"][_b] = _b in SYMBOLS
    _KIND["bang"][_b] = _b == 33
    _KIND["upper"][_b] = 65 <= _b <= 90
    _KIND["lower"][_b] = 97 <= _b <= 122
    _KIND["digit"][_b] = 48 <= _b <= 57
    _KIND["pipe"][_b] = _b == 124
    _KIND["space"][_b] = _b == 32 or 9 <= _b <= 13
    _KIND["point"][_b] = not 128 <= _b < 192        # the first byte of a code point
FEATURES = 15


class Measured:
    """Counts and line features of a batch of texts.

    `lines`: document, first and last byte of each line with a word; `x`: its features.
    """

    def __init__(self, texts: list[str | None]):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        hashes, self.n_words, first, last = hash_words(raw)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        text_at = np.cumsum(sizes + 1) - sizes - 1
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        sums = {name: np.concatenate([np.zeros(1, np.int32), np.cumsum(kind[data], dtype=np.int32)]) for name, kind in _KIND.items()}

        def count(name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (sums[name][b] - sums[name][a]).astype(np.int64)
        self.word_chars = count("point", text_at, text_at + sizes) - count("space", text_at, text_at + sizes)
        self.n_symbols = count("symbol", text_at, text_at + sizes)

        owner = np.repeat(np.arange(len(raw)), self.n_words)
        start = first + text_at[owner]
        repeated = self._repeated(hashes, owner)
        self.n_repeat_words = np.bincount(owner, repeated, len(raw)).astype(np.int64)

        ends = np.flatnonzero(data == 10)
        begins = np.concatenate([[0], ends[:-1] + 1])
        word_at = np.searchsorted(start, begins)
        words = np.diff(np.append(word_at, len(start)))
        full = words > 0
        a, b, words, word_at = begins[full], ends[full], words[full], word_at[full]
        self.document = np.searchsorted(text_at, a, "right") - 1
        self.begin, self.size = a, b - a
        self.keys = [bytes(data[i:j]) for i, j in zip(a, b, strict=True)]
        seen: set[tuple[int, bytes]] = set()
        again = np.zeros(len(a), bool)
        for i, key in enumerate(zip(self.document.tolist(), self.keys, strict=True)):
            again[i] = key in seen
            seen.add(key)
        self.n_dup_lines = np.bincount(self.document[again], minlength=len(raw)).astype(np.int64)

        size, cover = self.size.astype(float), np.concatenate([[0], np.cumsum(repeated)])
        letters = np.maximum(count("upper", a, b) + count("lower", a, b), 1)
        tail = data[np.maximum(b - 1, 0)]
        self.x = np.stack([
            np.ones(len(a)), np.log1p(size) / 8, np.log1p(words) / 6, count("symbol", a, b) / size * 5, count("bang", a, b) / size * 5,
            count("upper", a, b) / letters, count("digit", a, b) / size, count("pipe", a, b) / size * 10, size / words / 10,
            (cover[word_at + words] - cover[word_at]) / words, again, np.isin(tail, list(b".!?:;\"'")), words < 8, words < 20, words < 35], 1)
        self.chars = count("point", a, b)

    @staticmethod
    def _repeated(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Words in three-word windows that occur twice or more in their text."""
        covered = np.zeros(len(hashes), bool)
        if len(hashes) < 3:
            return covered
        c = constants(3, 41)
        windows = hashes[:-2] * c[0] + hashes[1:-1] * c[1] + hashes[2:] * c[2]
        at = np.flatnonzero(owner[:-2] == owner[2:])
        order = at[np.lexsort((windows[at], owner[at]))]
        same = (windows[order[1:]] == windows[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        for shift in range(3):
            covered[order[twice] + shift] = True
        return covered


class Chains:
    """Line sequences laid out by position: `rows[t]` are the lines at position t of the sequences longer than t."""

    def __init__(self, document: np.ndarray, cut: int | None = None):
        n = len(document)
        new = np.ones(n, bool)
        new[1:] = document[1:] != document[:-1]
        start = np.flatnonzero(new)
        position = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        if cut:
            start = np.flatnonzero(position % cut == 0)
        length = np.diff(np.append(start, n))
        order = np.argsort(-length, kind="stable")
        self.start, self.length = start[order], length[order]
        self.rows = [self.start[:int(np.searchsorted(-self.length, -t))] + t for t in range(int(self.length[0]) if n else 0)]


def viterbi(scores: np.ndarray, step: np.ndarray, chains: Chains) -> np.ndarray:
    """The best label of each line: `scores` (lines, 2), `step` (from, to)."""
    labels, back, best = np.zeros(len(scores), np.int8), np.zeros((len(scores), 2), np.int8), np.array(scores)
    for rows in chains.rows[1:]:
        ways = best[rows - 1][:, :, None] + step
        back[rows] = ways.argmax(1)
        best[rows] = scores[rows] + ways.max(1)
    last = chains.start + chains.length - 1
    labels[last] = best[last].argmax(1)
    for rows in reversed(chains.rows[1:]):
        labels[rows - 1] = back[rows, labels[rows]]
    return labels


def _gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, step: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """Of the conditional log-likelihood: observed minus expected counts, by forward and backward sums."""
    scores = x @ weights
    alpha, beta = np.array(scores), np.zeros_like(scores)
    for rows in chains.rows[1:]:
        alpha[rows] = scores[rows] + np.logaddexp.reduce(alpha[rows - 1][:, :, None] + step, axis=1)
    for rows in reversed(chains.rows[1:]):
        beta[rows - 1] = np.logaddexp.reduce(step + (scores[rows] + beta[rows])[:, None, :], axis=2)
    total = np.logaddexp.reduce(alpha + beta, axis=1, keepdims=True)
    one = np.eye(2)[y]
    of_weights = x.T @ (one - np.exp(alpha + beta - total))
    of_step = np.zeros((2, 2))
    for rows in chains.rows[1:]:
        joint = np.exp(alpha[rows - 1][:, :, None] + step + (scores[rows] + beta[rows])[:, None, :] - total[rows][:, :, None])
        of_step += (one[rows - 1][:, :, None] * one[rows][:, None, :] - joint).sum(0)
    return of_weights, of_step


def train(texts: list[str], qualities: list[int]) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights (features, labels) and steps (from, to) from whole labelled documents; None without both classes."""
    if len(set(qualities)) < 2:
        return None
    x, document, keys, labels, texts_seen = [], [], [], [], 0
    for a, b in slices(texts, SLICE):
        m = Measured(texts[a:b])
        # the base rules decide what fails them; lines of such a text need not be boilerplate
        good = ~judge(m, None)[0][m.document]
        x.append(m.x[good])
        document.append(m.document[good] + texts_seen)
        keys += [hash(k) if len(k.split()) <= COMMON_WORDS else None for k, g in zip(m.keys, good, strict=True) if g]
        labels.append(np.array(qualities[a:b])[m.document[good]])
        texts_seen += b - a
    x, document, y = np.concatenate(x), np.concatenate(document), np.concatenate(labels)
    if len(set(y.tolist())) < 2:
        return None
    common = Counter(key for _, key in set(zip(document.tolist(), keys, strict=True)) if key is not None)
    y = np.where(np.array([k is not None and common[k] >= COMMON_LINE for k in keys], bool), 0, y).astype(int)
    chains = Chains(document, TRAIN_LINES)
    weights, step = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    memory = [np.zeros_like(weights), np.zeros_like(step)]
    for _ in range(ITERATIONS):     # steps scaled by past gradients (AdaGrad)
        for i, (p, g) in enumerate(zip((weights, step), _gradient(x, y, weights, step, chains), strict=True)):
            g = g / len(y) - PENALTY * p
            memory[i] += g * g
            p += RATE * g / np.sqrt(memory[i] + 1e-12)
    return weights, step


def training_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> tuple[list[str], list[int]]:
    """At most `most` labelled documents of each quality, by a hash of doc_id."""
    texts, qualities = [], []
    for quality in (0, 1):
        chosen = (labels.where(F.col("quality") == quality).select(F.col("doc_id").cast("long").alias("_labelled")).dropna().distinct()
                  .orderBy(F.xxhash64("_labelled"), "_labelled").limit(most))
        # at most `most` ids are broadcast; of repeated doc_ids one text is taken
        own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).where(F.length("_text") <= TRAIN_CHARS)
        found = (own.join(F.broadcast(chosen), F.col("_id") == F.col("_labelled")).groupBy("_id").agg(F.min("_text").alias("_text"))
                 .orderBy("_id").select("_text").collect())
        texts += [r[0] for r in found]
        qualities += [quality] * len(found)
    return texts, qualities


def judge(m: Measured, model: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, content lines and verdict per text."""
    failed = (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words)
    n = len(m.n_words)
    if model is None or not len(m.x):
        return failed, np.bincount(m.document, minlength=n), ~failed
    weights, step = model
    content = viterbi(m.x @ weights, step, Chains(m.document)) == 1
    inside, every = np.bincount(m.document, m.chars * content, n), np.bincount(m.document, m.chars, n)
    return failed, np.bincount(m.document[content], minlength=n), ~failed & (inside >= CONTENT_SHARE * every)


_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
           "kept boolean, n_lines long, n_content_lines long")


def _label(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts, SLICE):
                m = Measured(texts[a:b])
                failed, content, kept = judge(m, model)
                columns = [m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, kept,
                           np.bincount(m.document, minlength=b - a), content]
                columns = [pa.array(c if c.dtype == bool else c.astype(np.int64)) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], names=[c.split()[0] for c in _SCHEMA.split(", ")])
    return run


def label_documents(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> DataFrame:
    """One row of counts and the verdict per document; no shuffle."""
    model = train(*training_sample(docs, labels, most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_label(model), _SCHEMA)


def keep_content(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> DataFrame:
    """The rows of `docs` that the rules and the model keep, with all their columns."""
    model = train(*training_sample(docs, labels, most))

    def verdict(texts):
        import pandas as pd
        forget()
        own = texts.tolist()
        return pd.Series(np.concatenate([judge(Measured(own[a:b]), model)[2] for a, b in slices(own, SLICE)]) if own else [], dtype=bool)
    return docs.where(F.pandas_udf(verdict, "boolean")(F.coalesce(F.col("text").cast("string"), F.lit(""))))
