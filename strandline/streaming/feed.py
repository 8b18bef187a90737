"""A stream of queries against the index: each micro-batch is searched as one batch, and its variants are handed on.

The stream is stateless (a query's answer does not depend on other queries), so it needs no watermark; a checkpoint folder lets it go on after a loss."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import kmer as K
from ..operators import search


def joined(stream: DataFrame, kmers: DataFrame, n: int) -> DataFrame:
    """variants of a streaming table (query_id, text), as a stream: the index is the static side of a block join.  A hit is taken in the first block that it shares, so a
    stream needs no distinct."""
    own = stream.select("query_id", K.pack(F.col("text")).alias("q")).where("q is not null")
    both = _either_way(own, "query_id", "q")
    by = search.Blocks(n)
    met = both.select("query_id", "q", "o", "flipped", by.of("o")).join(kmers.select("kmer", by.of("kmer")), ["block", "value"])
    near = K.hamming(F.col("kmer"), F.col("o"))
    own = met.where((near <= n) & (by.first("kmer", "o") == F.col("block")))
    return own.select("query_id", "q", F.when(F.col("flipped"), K.revcomp(F.col("kmer"))).otherwise(F.col("kmer")).alias("variant"), near.alias("mismatches"), F.col("kmer").alias("leaf"), "flipped")


def _either_way(own: DataFrame, *keep: str) -> DataFrame:
    """Two rows for each: o is q or its reverse complement (flipped).  Without a union, which would read a stream twice."""
    ways = F.array(F.struct(F.col("q").alias("o"), F.lit(False).alias("flipped")), F.struct(K.revcomp(F.col("q")).alias("o"), F.lit(True).alias("flipped")))
    return own.select(*keep, F.explode(ways).alias("z")).select(*keep, "z.*")


#: Bits of an index into a table of `sieve`, and how full a table may be before it leaves out too little.
SIEVE, FULL = 24, 0.25


def sieve(probes: DataFrame, n: int) -> Callable[[np.ndarray], np.ndarray] | None:
    """Which packed windows may be within n substitutions of a probe, in either orientation: all that are, and few others.  None if too many would be.

    Of n + 2 disjoint blocks two at least are the same.  Each pair of blocks has a table of bits, by a hash of the probes' letters there; it is of one size, whatever the number of probes, and
    is put together from bytes that Spark groups.  What is kept is still to be compared."""
    edges = [K.K * i // (n + 2) for i in range(n + 3)]
    spans = list(combinations(zip(edges, edges[1:], strict=False), 2))
    mask = np.array([sum(((1 << 2 * (b - a)) - 1) << 2 * (K.K - b) for a, b in pair) for pair in spans], np.uint64)[:, None]
    base = (np.arange(len(spans)) << (SIEVE - 3))[:, None]

    def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (((x.view(np.uint64) & mask) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIEVE)).astype(np.int64)
        return base + (slot >> 3), (1 << (slot & 7)).astype(np.uint8)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bit = (c.ravel() for c in places(batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bit.astype(np.int64))], names=["at", "bits"])

    own = _either_way(probes, "query_id", "q").select("o").mapInArrow(step, "at long, bits long")
    known = own.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(len(spans) << (SIEVE - 3), np.uint8)
    table[known.column("at").to_numpy()] = known.column("bits").to_numpy().astype(np.uint8)
    most = [min(1 << SIEVE, 4 ** sum(b - a for a, b in pair)) for pair in spans]
    if any(np.bitwise_count(t).sum() > FULL * m for t, m in zip(table.reshape(len(spans), -1), most, strict=True)):
        return None

    def keep(fwd: np.ndarray) -> np.ndarray:
        at, bit = places(fwd)
        return (table[at] & bit).any(axis=0)

    return keep


def screened(windows: DataFrame, probes: DataFrame, n: int) -> DataFrame:
    """windows: contig_id, start, fwd, a stream or a table.  probes: query_id and q, a table.  A row for each window within n substitutions of a probe, in either orientation:
    query_id, contig_id, start, strand, mismatches and variant (the window as the probe reads it).  Probes are the side that Spark may send out, by its own measure of their size."""
    by = search.Blocks(n)
    sought = _either_way(probes, "query_id", "q").select("query_id", "q", "o", "flipped", by.of("o"))
    met = windows.select("contig_id", "start", "fwd", by.of("fwd")).join(sought, ["block", "value"])
    near = K.hamming(F.col("fwd"), F.col("o"))
    own = met.where((near <= n) & (by.first("fwd", "o") == F.col("block")))
    variant = F.when(F.col("flipped"), K.revcomp(F.col("fwd"))).otherwise(F.col("fwd"))
    return own.select("query_id", "contig_id", "start", F.when(F.col("flipped"), "-").otherwise("+").alias("strand"), near.alias("mismatches"), variant.alias("variant"))


def feed(stream: DataFrame, kmers: DataFrame, n: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Searches each micro-batch and gives (variants, batch number) to sink."""

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.select("query_id", K.pack(F.col("text")).alias("q")).where("q is not null")
        sink(search.blocks(kmers, own, n), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
