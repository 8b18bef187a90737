"""Screens sequences for probes as they arrive: where, and how closely, each new sequence matches any of a set of 31-letter probes, on either strand.

    python -m jobs.probe_screen SEQUENCES PROBES OUTPUT CHECKPOINT [--config jobs/probe_screen.json]

SEQUENCES: a Parquet table (a folder that files are added to, or one file) with a number and a text for each sequence.  PROBES: a Parquet table of probe_id and
letters (31 of ACGT).  OUTPUT: a Parquet table of hits, in folders by mismatches: probe_id, contig_id, start, strand, letters (as the probe reads them).

A run takes what files are new since the last one and ends.  CHECKPOINT holds the stream's marks, and the settings and probes that it began with: a run with others stops,
since its hits would not be those of the sequences already taken.  Hits are written by Spark's file sink, exactly once: a run that was broken off goes on where it stopped, and
a run without new files changes nothing.  Files must be added whole, and not be changed later.

Sequences without a number have no name for their hits: they are left out and counted in the log.  Null and short texts have no windows.  Rows that share a number are screened
each.  Probes that are not 31 clean letters are left out and counted; equal probes (also as reverse complements) count once, by the least probe_id, so hits grow with the sequences and
the different probes, not with copies on both sides."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.functions import kmer as K
from strandline.sources import genome as G
from strandline.streaming import feed

from . import settings

#: mismatches: at most so many.  files_a_batch: files that one micro-batch takes, which bounds what a broken run does again.
DEFAULTS = {"id": "doc_id", "text": "text", "letters": "text", "mismatches": 3, "files_a_batch": 1000}
HITS = "probe_id string, contig_id long, start long, strand string, letters string, mismatches int"
SETTINGS = "mismatches int, letters string, probes long, digest long"
LOG = settings.logger("probe_screen")


def probe_table(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """query_id and q of the different clean probes; how many rows there were, and how many of them were not clean."""
    rows = spark.read.parquet(path).select(F.col("probe_id").cast("string").alias("query_id"), K.pack(F.col("letters")).alias("q"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("q").isNull() | F.col("query_id").isNull()).alias("bad")).first()
    least = F.min(F.struct("query_id", "q")).alias("x")
    return rows.dropna().groupBy(K.canonical(F.col("q")).alias("__k")).agg(least).select("x.*"), counts["n"], counts["bad"]


def _same_settings(spark: SparkSession, probes: DataFrame, conf: dict, checkpoint: str) -> None:
    """Keeps the settings of the first run; a later one must have the same."""
    sums = probes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.pmod(F.xxhash64("query_id", "q"), F.lit(1 << 31))), F.lit(0)).alias("h")).first()
    now = (conf["mismatches"], conf["letters"], sums["n"], sums["h"])
    path = f"{checkpoint.rstrip('/')}/settings"
    kept = settings.there(spark, path, SETTINGS)
    rows = [] if kept is None else [tuple(r) for r in kept.collect()]  # one row
    if rows and rows != [now]:
        raise ValueError(f"the checkpoint began with other probes or settings: {rows}, now {now}")
    if not rows:
        spark.createDataFrame([now], SETTINGS).coalesce(1).write.mode("overwrite").parquet(path)


def stream_of(spark: SparkSession, path: str, conf: dict) -> DataFrame:
    """contig_id and seq of the sequences, as a stream.  A single file is named as a pattern, which Spark's file source asks for."""
    table = spark.read.parquet(path)
    base, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", conf["files_a_batch"]).parquet(f"{base}/{{{name}}}")
    return source.select(F.col(conf["id"]).cast("long").alias("contig_id"), settings.letters(conf["letters"], conf["text"]).alias("seq"))


def run(spark: SparkSession, sequences: str, probes: str, output: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Takes what is new, and returns what was read and written."""
    conf = settings.config(DEFAULTS, **(config or {}))
    if not 0 <= conf["mismatches"] <= 6:
        raise ValueError("mismatches must be from 0 to 6: beyond, the blocks that windows meet in have fewer than 4 letters")
    sought, rows, bad = probe_table(spark, probes)
    _same_settings(spark, sought, conf, checkpoint)
    taken = stream_of(spark, sequences, conf).observe("read", F.count(F.lit(1)).alias("sequences"), F.count_if(F.col("contig_id").isNull()).alias("unnamed"))
    windows = G.windows(taken.where("contig_id is not null"), deal=False, keep=feed.sieve(sought, conf["mismatches"]))
    hits = feed.screened(windows, sought, conf["mismatches"])
    hits = hits.select(F.col("query_id").alias("probe_id"), "contig_id", "start", "strand", K.unpack(F.col("variant")).alias("letters"), F.col("mismatches").cast("int").alias("mismatches"))
    hits = hits.observe("written", F.count(F.lit(1)).alias("hits"))
    query = hits.writeStream.format("parquet").partitionBy("mismatches").option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream").trigger(availableNow=True).start(output)
    query.awaitTermination()
    seen = [x.observedMetrics for x in query.recentProgress if x.observedMetrics]
    total = {k: sum(m[part][k] for m in seen if part in m) for part, k in (("read", "sequences"), ("read", "unnamed"), ("written", "hits"))}
    out = total | {"batches": len(seen), "probes": rows, "unclean_probes": bad}
    LOG.info("read %(sequences)d new sequences in %(batches)d batches (%(unnamed)d without a number) and %(probes)d probes (%(unclean_probes)d not clean); wrote %(hits)d hits", out)
    return out


def hits(spark: SparkSession, output: str) -> DataFrame:
    """All hits so far; none if nothing was ever written."""
    found = settings.there(spark, output, HITS)
    return spark.createDataFrame([], HITS) if found is None else found


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Screens new sequences for probes.")
    for name in ("sequences", "probes", "output", "checkpoint"):
        p.add_argument(name)
    p.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    a = p.parse_args(argv)
    settings.log_to_console()
    spark = SparkSession.builder.appName("probe_screen").getOrCreate()
    try:
        run(spark, a.sequences, a.probes, a.output, a.checkpoint, settings.config(DEFAULTS, spark, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
