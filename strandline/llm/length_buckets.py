"""Packing into optimal length buckets.

The global histogram of token lengths has a row for each different length; m different lengths take at least
m * m / 2 tokens, so its rows grow with the square root of the input at most.  A dynamic programme over it chooses at most BUCKETS upper bounds so that the padding of all
documents, each padded to its bucket's bound, is least.  Inside a bucket, documents stand in the order of
(hash block, doc_id), and every BUDGET // bound of them in turn form a batch, so a batch's padded size is within the
budget; a document longer than the budget is a batch alone.

Plan.  One pass counts tokens; lengths (not texts) are written to the shared folder.  Places inside a bucket come from
counts per hash block, summed over the blocks before, and a rank within the block: no bucket meets in one task, and
a hot bucket is dealt over as many blocks as its rows need.  A block follows from doc_id, length and the row's place in the written
table, so rows without doc_id, or that share one, are spread as well.

Cases.  A null or empty text has the end id alone, so length 1.  Rows that repeat or share a doc_id are all kept and have
places of their own.  A null doc_id counts as any other.  An empty table gives no rows.  Extra columns are
ignored whatever their names.  Long texts are counted whole.  Equal costs: the fewer and lower bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, in_arrow, small_batches, unused
from .token_files import encoder, in_parts

BUCKETS, BUDGET = 16, 65_536
BLOCK_ROWS = 20_000


def lengths(docs: DataFrame, tokenizer: str, keep: list[str] | None = None) -> DataFrame:
    """keep (columns, doc_id by default) and n_tokens, with the end id."""
    small_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    text = unused("text_of", keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(text))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[str]:
            for b in batches:
                held.append(pa.RecordBatch.from_arrays(b.columns[:-1], names=keep))
                for x in b.column(b.num_columns - 1).to_pylist():
                    yield x or ""

        counts: list[int] = []
        for some in in_parts(texts()):
            counts += encoder(tokenizer).counts(some)
            while held and held[0].num_rows <= len(counts):
                b = held.pop(0)
                n, counts = counts[: b.num_rows], counts[b.num_rows :]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return in_arrow(rows, step, rows.drop(text).schema.add("n_tokens", "long"), "words").withColumn("n_tokens", F.col("n_tokens") + 1)


def bounds(sizes: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The upper bounds of at most `buckets` buckets over ascending sizes that pad least.

    cost(i, j): rows i to j - 1 padded to sizes[j - 1].  It meets the quadrangle inequality, so the best split of j is no
    lower than that of j - 1, and each round of the programme is solved by halving, all halves of a depth at once.  Whole numbers throughout."""
    m = len(sizes)
    if not m:
        return []
    rows, total = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * sizes)))
    top = np.concatenate(([0], sizes))
    best = top * rows - total  # with one bucket
    cuts: list[np.ndarray] = []
    for _ in range(1, min(buckets, m)):
        new, came = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
        lo, hi, a, b = (np.array([x]) for x in (1, m, 0, m - 1))
        while len(lo):
            j = (lo + hi) // 2
            n = np.minimum(b, j - 1) - a + 1
            first = np.cumsum(n) - n
            i = np.arange(n.sum()) - np.repeat(first - a, n)
            at = np.repeat(j, n)
            cost = best[i] + top[at] * (rows[at] - rows[i]) - (total[at] - total[i])
            least = np.minimum.reduceat(cost, first)
            hit = np.flatnonzero(cost == np.repeat(least, n))
            k = i[hit[np.searchsorted(hit, first)]]
            new[j], came[j] = least, k
            lo, hi, a, b = (np.concatenate(x) for x in ((lo, j + 1), (j - 1, hi), (a, k), (k, b)))
            some = lo <= hi
            lo, hi, a, b = lo[some], hi[some], a[some], b[some]
        cuts.append(came)
        best = new
    out, j = [], m
    for came in [*cuts[::-1], np.zeros(m + 1, np.int64)]:
        if j:
            out.append(int(sizes[j - 1]))
            j = int(came[j])
    return out[::-1]


def pack(sized: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """sized (with doc_id and n_tokens) with bucket_len, padding, batch (per bucket) and slot."""
    cols, row = sized.columns, unused("__row", sized.columns)
    sized = cut(sized.withColumn(row, F.monotonically_increasing_id()), "lengths")
    histogram = sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").collect()
    limits = bounds(np.array([r["n_tokens"] for r in histogram], np.int64), np.array([r["n"] for r in histogram], np.int64), buckets)
    n_rows = sum(r["n"] for r in histogram)
    blocks = max(1, -(-n_rows // BLOCK_ROWS))
    if not limits:
        limits = [1]
    bound = F.element_at(F.filter(F.array(*[F.lit(x).cast("long") for x in limits]), lambda b: b >= F.col("n_tokens")), 1)
    own = sized.withColumns({"bucket_len": bound, "__block": F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "n_tokens", row), F.lit(blocks)).cast("int")})
    sums = own.groupBy("bucket_len", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = sums.withColumn("__before", F.sum("__n").over(Window.partitionBy("bucket_len").orderBy("__block")) - F.col("__n")).drop("__n")
    before = before.select(F.col("bucket_len").alias("__bl"), F.col("__block").alias("__bb"), "__before")
    ranked = own.withColumn("__k", F.row_number().over(Window.partitionBy("bucket_len", "__block").orderBy("doc_id", "n_tokens", row)))
    placed = ranked.join(before, (F.col("bucket_len") == F.col("__bl")) & (F.col("__block") == F.col("__bb")))
    place = F.col("__before") + F.col("__k") - 1
    size = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_len")))
    return placed.select(*cols, "bucket_len", (F.col("bucket_len") - F.col("n_tokens")).alias("padding"), F.floor(place / size).cast("long").alias("batch"), (place % size).cast("int").alias("slot"))


def packed(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(lengths(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenizer))
