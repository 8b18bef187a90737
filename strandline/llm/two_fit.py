"""Packing by best-two-fit: few sequences of at most SIZE tokens, documents whole.

A sequence is filled greedily, each time by the longest unpacked piece that fits.  Then its smallest piece is taken out again, if two unpacked
pieces fit the gap that this leaves more tightly: the two whose sum is greatest, and of those the two most alike.  That is repeated
until no two are better; the piece that a sequence began with stays, so long ones are not put off.  Where exchanges use up what later sequences needed and greedy filling alone
takes fewer sequences, its plan is taken.  Only documents that are longer than a sequence are cut.

Plan.  One pass encodes the texts and writes pieces with their ids, each with its number among the pieces of its length in its task.  What the packing needs to
know is how many pieces have each length, so at most SIZE rows whatever the input; those go to the driver.  There a filling is found once and used as often as
its pieces last (until then, each further sequence would be filled alike), so the work depends on the number of different fillings:
a filling ends when a length has fewer pieces left than the filling asks for, which can happen SIZE / length times for a
length, so some SIZE * ln(SIZE) times at most.  A filling gives runs of numbers of a length their sequences.  A piece finds its number from its task's own number and
the counts of the tasks before, so no length, however common, meets in one task, and nothing but those counts is sorted.

Cases.  A null or empty text is the end id alone, a piece of length 1.  Null, repeated and shared doc_ids are kept as rows of their own.  An empty table gives no
rows.  Extra columns are ignored, whatever their names.  Long texts are encoded whole.  Equal lengths are given their places in the order of tasks and rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, in_arrow, small_batches
from .token_files import encoder, in_parts

SIZE = 4096


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian 32-bit), task and nth (among the task's pieces of that length): a written table."""
    small_batches(docs.sparkSession)

    def rows(doc_ids: list[int | None], texts: list[bytes], width: np.dtype, seen: np.ndarray) -> pa.RecordBatch:
        n = np.fromiter(map(len, texts), np.int64, len(texts)) // width.itemsize
        ids = np.frombuffer(b"".join(texts), width).astype("<u4")
        of = -(-n // size)  # pieces of each text
        doc = np.repeat(np.arange(len(n)), of)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(of) - of, of)
        length = np.minimum(size, n[doc] - piece * size)
        order = np.argsort(length, kind="stable")
        among = np.arange(len(order)) - np.searchsorted(length[order], length[order])
        nth = np.empty(len(order), np.int64)
        nth[order] = among + seen[length[order]]
        np.add.at(seen, length, 1)
        edges = np.concatenate(([0], np.cumsum(length * 4))).astype("<i4")
        held = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
        task = np.full(len(doc), TaskContext.get().partitionId(), np.int32)
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece * size), pa.array(length), held, pa.array(task), pa.array(nth)], names=["doc_id", "piece", "start", "length", "ids", "task", "nth"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(tokenizer), np.zeros(size + 1, np.int64)
        end = np.array([end_id], enc.width).tobytes()
        each = ((d, t or "") for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for some in in_parts(each, length=lambda x: len(x[1])):
            yield rows([d for d, _ in some], [x + end for x in enc.encode([t for _, t in some])], enc.width, seen)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(in_arrow(own, step, "doc_id long, piece int, start long, length long, ids binary, task int, nth long", "words"), "pieces")


def best_two(free: np.ndarray, room: int) -> tuple[int, int]:
    """The lengths of the two free pieces that fill room best, the lesser first; (0, 0) if no two fit."""
    least = np.flatnonzero(free[: room // 2 + 1] > 0)
    if not len(least):
        return 0, 0
    at = np.arange(room + 1)
    longest = np.maximum.accumulate(np.where(free[: room + 1] > 0, at, 0))  # that is no longer than this
    other = longest[room - least]
    both = np.where((other == least) & (free[least] < 2), 0, least + other)
    k = len(both) - 1 - int(np.argmax(both[::-1]))
    return (int(least[k]), int(other[k])) if both[k] else (0, 0)


def filled(free: np.ndarray, size: int, exchange: bool = True) -> tuple[dict[int, int], int]:
    """One sequence from the free pieces (their number by length): how many of each length, and how often it can be filled alike."""
    left, taken, gap = free.copy(), {}, size
    while True:
        fits = np.flatnonzero(left[: gap + 1])
        if not len(fits):
            break
        x = int(fits[-1])
        taken[x] = min(int(left[x]), gap // x)
        left[x] -= taken[x]
        gap -= x * taken[x]
    most = dict(taken)  # that this length had at any time
    while exchange and gap and sum(taken.values()) > 1:
        least = min(taken)
        two = best_two(left, gap + least)
        if sum(two) <= least:
            break
        for x, n in ((two[0], 1), (two[1], 1), (least, -1)):
            taken[x] = taken.get(x, 0) + n
            left[x] -= n
            most[x] = max(most.get(x, 0), taken[x])
        gap += least - sum(two)
        taken = {x: n for x, n in taken.items() if n}
    return taken, min((int(free[x]) - most[x]) // n + 1 for x, n in taken.items())


def fillings(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """counts: pieces by length, from 0 to the size of a sequence.  Fillings and how many sequences have each, in order."""
    plans = []
    for exchange in (True, False):
        free, out = counts.astype(np.int64).copy(), []
        while free.any():
            taken, times = filled(free, len(counts) - 1, exchange)
            for x, n in taken.items():
                free[x] -= n * times
            out.append((taken, times))
        plans.append(out)
    return min(plans, key=lambda plan: sum(times for _, times in plan))  # the first of equals


def runs(plan: list[tuple[dict[int, int], int]], size: int) -> np.ndarray:
    """Rows of length, first number, numbers a sequence, first sequence and offset; ordered by length and number."""
    out, used, sequence = [], np.zeros(size + 1, np.int64), 0
    for taken, times in plan:
        offset = 0
        for x in sorted(taken, reverse=True):
            out.append((x, used[x], taken[x], sequence, offset))
            used[x] += taken[x] * times
            offset += x * taken[x]
        sequence += times
    rows = np.array(out, np.int64).reshape(-1, 5)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def placed(found: DataFrame, size: int = SIZE) -> DataFrame:
    """found: what pieces() gives, with at least length, task and nth.  Its other columns with sequence_id and offset."""
    spark, keep = found.sparkSession, [c for c in found.columns if c not in ("task", "nth")]
    sums = cut(found.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(size + 1, np.int64)
    for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length, so `size` at most
        counts[r["length"]] = r["n"]
    plan = spark.sparkContext.broadcast(runs(fillings(counts), size))
    before = sums.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    own = found.join(before, ["task", "length"]).select(*keep, (F.col("before") + F.col("nth")).alias("number"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        first = np.searchsorted(rows[:, 0], np.arange(size + 2))  # the runs of each length
        for b in batches:
            length, number = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            # All lengths' bounds are searched at once, by halving.
            lo, hi = first[length], first[length + 1] - 1
            while (lo < hi).any():
                mid = (lo + hi + 1) // 2
                up = rows[mid, 1] <= number
                lo, hi = np.where(up, mid, lo), np.where(up, hi, mid - 1)
            run = rows[lo]
            at = number - run[:, 1]
            more = [pa.array(run[:, 3] + at // run[:, 2]), pa.array(run[:, 4] + at % run[:, 2] * length)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*keep, "sequence_id", "offset"])

    return in_arrow(own, step, own.drop("number").schema.add("sequence_id", "long").add("offset", "long"))


def sequences(packed: DataFrame) -> DataFrame:
    """packed: placed pieces with ids.  A row a sequence: its ids one after the other, and which documents begin where.  A group has `size` tokens at most."""
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    own = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    inside = F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length")))
    return own.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("n_tokens"), inside.alias("pieces"), ids.alias("ids"))


def packed_rows(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE) -> DataFrame:
    """A row a piece: where it comes from, its length, the checksum of its ids, its sequence and its place there."""
    found = pieces(docs, tokenizer, end_id, size).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "nth")
    return placed(found, size)
