"""Quality scores: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Random indexing.  Every word and every word shape (its runs of letter case, digits and marks, and whether the word is the one before again) falls into a bucket, and
every bucket has a fixed sparse random vector.  A bucket's context vector is the sum of the random vectors of the
words within two places of it, over all documents (whole numbers, summed by partition and then by bucket).  A document is the mean context vector of its words beside that of
its shapes.  A hidden layer of tanh units and one output follow, and a temperature fitted on rows that training
did not see scales the output.

The network learns from at most ROWS labelled rows (and CHARS characters) a label, drawn by hash; it scores every whole text.  With fewer than ten
rows none are kept aside, and the temperature is 1.

Cases.  A null, empty or blank text has the zero vector, and the score that the network gives it.  Without labelled
rows, or with one label alone, every score is the smoothed share of label 1.  Repeated rows are all kept; extra columns
are ignored whatever their names; an empty table gives no rows.  Long texts are scored whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_arrow, release, small_batches, unused
from .samples import labelled_texts
from .token_files import in_parts

ROWS, CHARS = 4000, 8_000_000
WORDS, SHAPES, DIM, HIDDEN, REACH = 1 << 15, 1 << 11, 24, 24, 2
KEEP_FROM = 0.3

_RNG = np.random.default_rng(20_240_101)
BYTE = _RNG.integers(1, 1 << 32, 256, np.uint32)
POWER = _RNG.integers(1, 1 << 32, 64, np.uint32) | np.uint32(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The class of a byte: one for small letters and all of UTF-8's later bytes, one for capitals, one for digits, and each mark its own.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[ord("a") : ord("z") + 1] = CLASS[128:] = 1
CLASS[ord("A") : ord("Z") + 1] = 2
CLASS[ord("0") : ord("9") + 1] = 3


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word and the shape bucket of every word of all texts, and where each text's words begin (with the end)."""
    raw = [x.encode("utf-8", "surrogatepass") + b"\n" for x in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends_of = np.cumsum([len(x) for x in raw])
    inside = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    where = np.searchsorted(starts, np.concatenate(([0], ends_of)))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, where
    at = np.flatnonzero(inside)
    first = np.cumsum(ends - starts) - (ends - starts)
    spot = at - np.repeat(starts, ends - starts)
    chars = data[at]
    words = np.add.reduceat(BYTE[chars] * POWER[spot & 63], first, dtype=np.uint32)
    kind = CLASS[chars]
    change = np.concatenate(([True], kind[1:] != kind[:-1]))
    change[first] = True
    nth = np.cumsum(change) - 1
    nth -= np.repeat(nth[first], ends - starts)
    shapes = np.add.reduceat(np.where(change, BYTE[kind] * POWER[np.minimum(nth, 15)], np.uint32(0)), first, dtype=np.uint32)
    mixed = [((x ^ (x >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(s) for x, s in ((words, 17), (shapes, 22))]
    ditto = np.zeros(len(starts), np.int64)
    ditto[1:] = words[1:] == words[:-1]
    ditto[where[:-1][np.diff(where) > 0]] = 0
    return mixed[0].astype(np.int64), mixed[1].astype(np.int64) + ditto * (SHAPES // 2), where


def index_vectors(n: int, seed: int) -> np.ndarray:
    """Sparse random vectors: six entries of +1 or -1 in each."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.int8)
    places = np.argsort(rng.random((n, DIM)), axis=1)[:, :6]
    out[np.arange(n)[:, None], places] = rng.choice(np.int8([-1, 1]), (n, 6))
    return out


class ContextSums:
    """Of words and, after them, of shapes: the summed random vectors of the words near by."""

    def __init__(self) -> None:
        self.words, self.shapes = index_vectors(WORDS, 1), index_vectors(SHAPES, 2)
        self.sums = np.zeros((WORDS + SHAPES, DIM), np.int64)

    def add(self, texts: list[str]) -> None:
        words, shapes, where = units(texts)
        if not len(words):
            return
        owner = np.repeat(np.arange(len(texts)), np.diff(where))
        vectors = self.words[words] + self.shapes[shapes]
        near = np.zeros_like(vectors)  # at most 2 * REACH vectors with entries from -2 to 2
        for d in range(1, REACH + 1):
            same = (owner[d:] == owner[:-d])[:, None]
            near[d:] += vectors[:-d] * same
            near[:-d] += vectors[d:] * same
        for bucket in (words, shapes + WORDS):
            order = np.argsort(bucket, kind="stable")
            b = bucket[order]
            head = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            self.sums[b[head]] += np.add.reduceat(near[order], head, axis=0, dtype=np.int64)


def context_sums(docs: DataFrame) -> np.ndarray:
    """ContextSums over all documents: a row a bucket from each partition, added up by bucket.  The driver gets WORDS + SHAPES rows at most."""
    small_batches(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ContextSums()
        for batch in batches:
            for some in in_parts([x or "" for x in batch.column(0).to_pylist()], 500_000):
                own.add(some)
        seen = np.flatnonzero(own.sums.any(1))
        for at in range(0, len(seen), 4096):
            b = seen[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), *(pa.array(own.sums[b, i]) for i in range(DIM))], names=["b", *(f"s{i}" for i in range(DIM))])

    rows = in_arrow(docs.select("text"), step, "b int, " + ", ".join(f"s{i} long" for i in range(DIM)))
    total = rows.groupBy("b").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(DIM)]).toArrow()
    out = np.zeros((WORDS + SHAPES, DIM), np.int64)
    if total.num_rows:
        out[total.column("b").to_numpy()] = np.stack([total.column(f"s{i}").to_numpy() for i in range(DIM)], 1)
    return out


def context_vectors(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words and of shapes, at unit length; zero where never seen."""
    size = np.linalg.norm(sums.astype(float), axis=1, keepdims=True)
    unit = np.divide(sums, size, out=np.zeros(sums.shape), where=size > 0).astype(np.float32)
    return unit[:WORDS], unit[WORDS:]


def pooled(texts: list[str], word_vectors: np.ndarray, shape_vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), 2 * DIM), np.float32)
    words, shapes, where = units(texts)
    n = np.diff(where)
    full = np.flatnonzero(n)
    if len(full):
        for k, v in enumerate((word_vectors[words], shape_vectors[shapes])):
            out[full, k * DIM : (k + 1) * DIM] = np.add.reduceat(v, where[full], axis=0) / n[full, None]
    return out


class Network:
    """tanh layer, linear output, temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 0.02, decay: float = 1e-4) -> None:
        self.prior = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        self.fitted = len(set(y.tolist())) == 2
        self.temperature = 1.0
        if not self.fitted:
            return
        rng = np.random.default_rng(5)
        held = np.arange(len(y)) % 5 == 4
        if len(y) < 10 or len(set(y[~held].tolist())) < 2:
            held[:] = False
        self.mean, self.scale = x[~held].mean(0), x[~held].std(0) + 1e-4
        a, b = (x[~held] - self.mean) / self.scale, y[~held].astype(float)
        self.w = [rng.normal(0, 1 / np.sqrt(a.shape[1]), (a.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w]
        for t in range(1, steps + 1):
            h = np.tanh(a @ self.w[0] + self.w[1])
            d = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - b) / len(b)
            back = np.outer(d, self.w[2]) * (1 - h * h)
            grads = [a.T @ back + decay * self.w[0], back.sum(0), h.T @ d + decay * self.w[2], d.sum(keepdims=True)]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        z, kept = self.logits(x[held]), y[held]
        loss = lambda T: np.mean(np.logaddexp(0, np.where(kept == 1, -z, z) / T))
        if held.any():
            self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


class Model:
    def __init__(self, pairs: list[tuple[int, str]], sums: np.ndarray) -> None:
        texts = [t for _, t in pairs]
        # One class in turn with the other would let the held part differ from the rest; the draw's order is by id.
        self.vectors = context_vectors(sums)
        parts = [pooled(some, *self.vectors) for some in in_parts(texts, 500_000)]
        self.network = Network(np.concatenate(parts) if parts else np.zeros((0, 2 * DIM)), np.array([int(y) for y, _ in pairs]))

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.network.probability(pooled(texts, *self.vectors).astype(float))


def is_held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~is_held_out())
    model = Model(labelled_texts(docs, usable, "quality", ROWS, CHARS), context_sums(docs))
    release()
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """keep (columns of docs, all by default), and score, as the last column (`_score` if there is a score, and so on)."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(pickle.dumps(model))  # bounded by WORDS, SHAPES and DIM
    cols = docs.columns if keep is None else keep
    text, to = unused("text_of", cols), unused("score", cols)
    rows = docs.select(*[F.col(f"`{c}`") for c in cols], F.col("text").alias(text))
    schema = rows.drop(text).schema.add(to, "double")
    cache: list[Model] = []

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(pickle.loads(sent.value))
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            got = [cache[0].scores(some) for some in in_parts(texts, 1_000_000)]
            values = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.float64())], names=[*cols, to])

    return in_arrow(rows, step, schema)


def quality_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels), ["doc_id"])
    return rows.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    scored = score(docs, fit(docs, labels))
    return scored.where(F.col(scored.columns[-1]) >= KEEP_FROM).select(*[F.col(f"`{c}`") for c in docs.columns])
