"""Language of documents and of their spans: script ranges, word scores, and Viterbi with a switching penalty.

Model.  For each language, smoothed log-probabilities of hashed letter pairs and triples inside words, learned from at most
ROWS texts (and CHARS characters) a language.  For each script (a Unicode range), the languages that use it.  A
word's score for a language is the sum over its letters, within bounds; languages that do not use the word's script are
out of the race.  The best sequence of labels, one per word, pays PENALTY for each change; its runs are the spans.
A document's language is the label of most letters; its score is their share times the certainty of that label over the
whole text.

Most texts need no dynamic programme: if in no run of words another language gains more than PENALTY over the best
single language, one label for all words is an optimal sequence (a run in other languages costs a change at least).  The
others go through Viterbi together, one word of each at a time.

Cases.  A null text, or one without letters, is `und` with score 0.  Without labelled texts every text is `und`.  A
script that no training text has leaves all languages in the race.  Ties go to the first language by name.  Repeated
rows are all kept; other columns are ignored whatever their names; an empty table gives no rows.  Long texts are labelled whole.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_arrow, small_batches
from .samples import labelled_texts
from .token_files import in_parts

ROWS, CHARS = 1500, 5_000_000
PENALTY = 12.0
#: What one word may say for one language against another.
BOUND = 8.0
TABLE = 1 << 16
SMOOTH = 0.5
UNKNOWN = "und"

# First code points of Unicode ranges, and the script from there on (0: other).
SCRIPTS = ["other", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "georgian", "hangul", "ethiopic", "kana", "han"]
RANGES = [
    (0x0000, 0), (0x0041, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0900, 7), (0x0E00, 8), (0x0F00, 0), (0x10A0, 9),
    (0x1100, 10), (0x1200, 11), (0x13A0, 0), (0x1C80, 3), (0x1C90, 9), (0x1CC0, 0), (0x1D00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0),
    (0x2DE0, 3), (0x2E00, 13), (0x3040, 12), (0x3100, 13), (0x3130, 10), (0x3190, 13), (0xA000, 0), (0xA640, 3), (0xA6A0, 0), (0xA720, 1), (0xA800, 7),
    (0xA960, 10), (0xA980, 0), (0xAB30, 1), (0xABC0, 0), (0xAC00, 10), (0xD800, 0), (0xF900, 13), (0xFB00, 1), (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6),
    (0xFE00, 0), (0xFE70, 6), (0xFF00, 0), (0xFF21, 1), (0xFF66, 12), (0xFFA0, 10), (0xFFE0, 0), (0x20000, 13), (0x40000, 0),
]
#: Letters end before the first, marks stand from the second to before the third; no code point from there on is either.
LETTERS_END, MARKS_FROM, TOP = 0x40000, 0xE0100, 0xE01F0


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the small letter or 0, whether it is a letter that begins a word, and its script.  Marks continue words."""
    lower, letter, script = np.zeros(TOP + 1, np.uint32), np.zeros(TOP + 1, bool), np.zeros(TOP + 1, np.uint8)
    for c in (*range(LETTERS_END), *range(MARKS_FROM, TOP)):
        x = chr(c)
        if x.isalpha():
            y = x.lower()
            lower[c], letter[c] = ord(y) if len(y) == 1 else c, True
        elif c > 0x2FF and unicodedata.category(x)[0] == "M":
            lower[c] = c
    for a, s in RANGES:
        script[a:] = s
    return lower, letter, script


def _mix(x: np.ndarray) -> np.ndarray:
    return (((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int64)


class Words:
    """The words of some texts: places, letters, script, hashed letter groups."""

    def __init__(self, texts: list[str]) -> None:
        small, letter, script = tables()
        joined = "\n".join(texts) + "\n"
        points = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.uint32(TOP))
        low = small[points]
        inside = low != 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        size = np.array([len(x) + 1 for x in texts], np.int64)
        self.base = np.cumsum(size) - size
        self.where = np.searchsorted(self.start, np.concatenate((self.base, [len(points)])))
        n = len(self.start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.where))
        if not n:
            return
        # Each word's letters and the place after it, so that word ends count as letters do.
        span = self.end - self.start + 1
        self.first = np.cumsum(span) - span
        at = np.arange(span.sum()) - np.repeat(self.first - self.start, span)
        before = low[np.maximum(at - 1, 0)]
        spot = at - np.repeat(self.start, span)
        before2 = np.where(spot >= 2, low[np.maximum(at - 2, 0)], np.uint32(1))
        before = np.where(spot >= 1, before, np.uint32(1))
        here = low[at]
        self.pairs = _mix(before * np.uint32(0x9E3779B1) + here * np.uint32(0x7FEB352D))
        self.triples = _mix(before2 * np.uint32(0xC2B2AE35) + before * np.uint32(0x27D4EB2F) + here * np.uint32(0x165667B1))
        self.letters = np.add.reduceat(letter[points[at]].astype(np.int64), self.first)
        self.script = np.maximum.reduceat(np.where(low[at] != 0, script[points[at]], 0), self.first)


class Model:
    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.langs = sorted({k for k, _ in pairs})
        n = len(self.langs)
        counts = np.zeros((2, TABLE, max(n, 1)))
        used = np.zeros((len(SCRIPTS), max(n, 1)))
        for k, lang in enumerate(self.langs):
            for some in in_parts([t for x, t in pairs if x == lang], 1_000_000):
                w = Words(some)
                if len(w.start):
                    counts[0, :, k] += np.bincount(w.pairs, minlength=TABLE)
                    counts[1, :, k] += np.bincount(w.triples, minlength=TABLE)
                    used[:, k] += np.bincount(w.script, w.letters, len(SCRIPTS))
        logs = np.log((counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * TABLE))
        # Against the mean of the languages; triples and pairs overlap, so each counts half.
        self.logs = ((logs - logs.mean(2, keepdims=True)) / 2).astype(np.float32)
        share = used / np.maximum(used.sum(0, keepdims=True), 1)
        self.uses = share >= 0.01
        self.uses[~self.uses.any(1)] = True

    def scores(self, w: Words) -> np.ndarray:
        e = np.add.reduceat(self.logs[0][w.pairs] + self.logs[1][w.triples], w.first, axis=0)
        uses = self.uses[w.script]
        e = np.where(uses, e, -np.inf)
        e -= e.max(1, keepdims=True)
        return np.maximum(e, -BOUND).astype(np.float64)

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        w, n = Words(texts), len(self.langs)
        if not n or not len(w.start):
            return [(UNKNOWN, 0.0, [])] * len(texts)
        e = self.scores(w)
        full = np.flatnonzero(np.diff(w.where))
        head = w.where[full]
        total = np.add.reduceat(e, head, axis=0)
        best = total.argmax(1)
        of = np.repeat(np.arange(len(full)), np.diff(w.where)[full])
        labels = best[of]
        # The largest gain of any run of words from leaving the best label; e is at most 0, and 0 for a word's best.
        run = np.cumsum(-e[np.arange(len(e)), labels])
        mixed = np.flatnonzero(run[w.where[full + 1] - 1] - np.where(head > 0, run[np.maximum(head - 1, 0)], 0) > PENALTY)
        for some in _groups(mixed, np.diff(w.where)[full]):
            self._viterbi(e, head[some], w.where[full[some] + 1], labels)
        letters = np.zeros((len(full), n))
        np.add.at(letters, (of, labels), w.letters)
        lang = letters.argmax(1)
        share = letters.max(1) / np.maximum(letters.sum(1), 1)
        # Certainty of the label among the words that bear it.
        own = labels == lang[of]
        sums = np.add.reduceat(np.where(own[:, None], e, 0), head, axis=0)
        sums -= sums.max(1, keepdims=True)
        sure = np.exp(sums[np.arange(len(full)), lang]) / np.exp(sums).sum(1)
        cut = np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]) | (w.doc[1:] != w.doc[:-1]))))
        last = np.concatenate((cut[1:], [len(labels)])) - 1
        spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for d, a, b, k in zip(w.doc[cut].tolist(), w.start[cut].tolist(), w.end[last].tolist(), labels[cut].tolist(), strict=True):
            base = int(w.base[d])
            spans[d].append((a - base, b - base, self.langs[k]))
        out = [(UNKNOWN, 0.0, [])] * len(texts)
        for i, d in enumerate(full.tolist()):
            if letters[i].sum():
                out[d] = self.langs[lang[i]], float(share[i] * sure[i]), spans[d]
        return out

    def _viterbi(self, e: np.ndarray, head: np.ndarray, end: np.ndarray, labels: np.ndarray) -> None:
        """Labels the words of several texts, longest first, one word of each at a time."""
        order = np.argsort(head - end, kind="stable")
        head, size = head[order], (end - head)[order]
        longest, n = int(size[0]), e.shape[1]
        active = np.searchsorted(-size, -np.arange(longest), "left")  # texts with more than t words
        best = e[head].copy()
        came = []  # per word: the label before, if the label changes here, and for which labels it does
        for t in range(1, longest):
            k = active[t]
            now = best[:k]
            top = now.argmax(1)
            most = now[np.arange(k), top] - PENALTY
            change = now < most[:, None]
            came.append((top, change))
            best[:k] = np.where(change, most[:, None], now) + e[head[:k] + t]
        state = best.argmax(1)
        for t in range(longest - 1, -1, -1):
            k = active[t]
            labels[head[:k] + t] = state[:k]
            if t:
                top, change = came[t - 1]
                state[:k] = np.where(change[np.arange(k), state[:k]], top, state[:k])


def _groups(texts: np.ndarray, sizes: np.ndarray, words: int = 2_000_000) -> Iterator[np.ndarray]:
    """Runs of texts of about so many words, so that the steps kept in memory are bounded."""
    if len(texts):
        run = np.cumsum(sizes[texts]) // words
        yield from np.split(texts, np.flatnonzero(np.diff(run)) + 1)


def is_held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame) -> Model:
    return Model(labelled_texts(docs.where(~is_held_out()), None, "lang", ROWS, CHARS))


def label(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and the labelled spans (character places in the text)."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(pickle.dumps(model))  # bounded by TABLE and the number of languages
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    cache: list[Model] = []

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(pickle.loads(sent.value))
        for batch in batches:
            got = [x for some in in_parts([x or "" for x in batch.column(1).to_pylist()], 1_000_000) for x in cache[0].label(some)]
            spans = [[{"start": a, "end": b, "lang": k} for a, b, k in s] for _, _, s in got]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array([x for x, _, _ in got], pa.string()), "score": pa.array([x for _, x, _ in got], pa.float64()), "spans": pa.array(spans, kind)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_arrow(rows, step, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def language_rows(docs: DataFrame) -> DataFrame:
    rows = label(docs, fit(docs))
    return rows.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
