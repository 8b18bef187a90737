"""Binned signal tracks: base bins, a pyramid of coarser levels, statistics, summaries, local maxima.

Base bins hold 32 letters; each level joins 4 bins, while there are more than 1,024.  A bin has the mean over covered letters and
the greatest value; bins without data have no row.  Coarser means weigh by covered letters, so sums and coverage are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .views import _d

BIN, FACTOR, TOP = 32, 4, 1024


def base_bins(signal: DataFrame) -> DataFrame:
    """track, bin, total, cov, high from intervals track, start, end, value; what is not finite has no part."""
    own = signal.where("end > start and value is not null and not isnan(value) and abs(value) < double('Infinity')")
    own = own.select("track", "start", "end", "value", F.explode(F.sequence((F.col("start") / BIN).cast("long"), ((F.col("end") - 1) / BIN).cast("long"))).alias("bin"))
    over = F.least(F.col("end"), (F.col("bin") + 1) * BIN) - F.greatest(F.col("start"), F.col("bin") * BIN)
    return own.groupBy("track", "bin").agg(F.sum(F.col("value") * over).alias("total"), F.sum(over).alias("cov"), F.max("value").alias("high"))


def levels(length: int) -> int:
    """How many levels a track over so many letters has."""
    bins, n = -(-length // BIN), 1
    while bins > TOP:
        bins, n = -(-bins // FACTOR), n + 1
    return n


def pyramid(base: DataFrame, length: int) -> DataFrame:
    """track, level, bin, mean, high (floats), cov.  Each level is aggregated from the one before, a quarter of its rows."""
    out, own = None, base
    for level in range(levels(length)):
        if level:
            own = own.groupBy("track", F.shiftright("bin", 2).alias("bin")).agg(F.sum("total").alias("total"), F.sum("cov").alias("cov"), F.max("high").alias("high"))
        part = own.select("track", F.lit(level).alias("level"), "bin", (F.col("total") / F.col("cov")).cast("float").alias("mean"), F.col("high").cast("float").alias("high"), "cov")
        out = part if out is None else out.unionByName(part)
    return out


def statistics(base: DataFrame, length: int) -> DataFrame:
    """track: the means' lower-rank 1st and 99th percentiles, least and greatest, and the share of base bins with data.

    Ranks come from counts of equal means, so no track is sorted in one piece of rows."""
    means = base.select("track", (F.col("total") / F.col("cov")).cast("float").alias("mean"))
    counts = means.groupBy("track", "mean").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("track").orderBy("mean")
    ranked = counts.withColumns({"to": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy("track"))}).withColumn("from", F.col("to") - F.col("n"))

    def pick(f: float):
        rank = F.floor((F.col("all") - 1) * F.lit(f))
        return F.max(F.when((F.col("from") <= rank) & (rank < F.col("to")), F.col("mean")))

    bins = -(-length // BIN)
    return ranked.groupBy("track").agg(pick(0.01).alias("p01"), pick(0.99).alias("p99"), F.min("mean").alias("low"), F.max("mean").alias("high"), (F.max("all") / F.lit(bins)).alias("coverage"))


def scaled(stats: DataFrame) -> DataFrame:
    """track, lo and hi of the drawn scale: from 0 or the 1st percentile to the 99th, or the greatest if that is not above."""
    lo = F.least(F.lit(0.0), F.col("p01").cast("double"))
    return stats.select("track", lo.alias("lo"), F.when(F.col("p99") > lo, F.col("p99")).otherwise(F.col("high")).cast("double").alias("hi"))


def summary(levels_of: DataFrame, length: int, start: float, end: float, width: int) -> DataFrame:
    """track, col, mean (unweighted, over bins with data) and high, from the coarsest level whose bins are within a column."""
    per, level, size = (end - start) / width, 0, BIN
    while level + 1 < levels(length) and size * FACTOR <= per:
        level, size = level + 1, size * FACTOR
    bins = -(-length // size)
    spark = levels_of.sparkSession
    i = F.col("id").cast("double")
    s, e = F.lit(float(start)) + i * F.lit(per), F.lit(float(start)) + (i + 1) * F.lit(per)
    b0 = F.floor(F.floor(s) / size)
    grid = spark.range(width).select(F.col("id").alias("col"), b0.alias("b0"), F.least(F.greatest(F.ceil(F.ceil(e) / size), b0 + 1), F.lit(bins)).alias("b1"))
    grid = grid.where("b1 > b0").select("col", F.explode(F.sequence(F.col("b0"), F.col("b1") - 1)).alias("bin"))
    own = levels_of.where(F.col("level") == level).join(F.broadcast(grid), "bin")  # a stated grid: columns times bins within each
    return own.groupBy("track", "col").agg(F.avg(F.col("mean").cast("double")).cast("float").alias("mean"), F.max("high").alias("high"))


def value_at(base: DataFrame, pos: int) -> DataFrame:
    return base.where(F.col("bin") == pos // BIN).select("track", (F.col("total") / F.col("cov")).cast("float").alias("value"))


def gc_bins(tiles32: DataFrame) -> DataFrame:
    """bin, gc, acgt and the share: from letters of each base bin (bin, bit); letters that are none of ACGT have no part."""
    gc = F.length(F.regexp_replace("bit", "[^GCgc]", ""))
    acgt = F.length(F.regexp_replace("bit", "[^ACGTacgt]", ""))
    own = tiles32.select("bin", gc.alias("gc"), acgt.alias("acgt")).groupBy("bin").agg(F.sum("gc").alias("gc"), F.sum("acgt").alias("acgt"))
    return own.where("acgt > 0").withColumn("share", (F.col("gc") / F.col("acgt")).cast("float"))


def bin_tiles(genome: DataFrame, where: DataFrame) -> DataFrame:
    """bin and bit: the letters of every base bin of the concatenation; a bin that two contigs share has two rows."""
    own = genome.select("contig_id", F.col("seq").cast("binary").alias("b")).join(where.where("len > 0").select("contig_id", "offset", "len"), "contig_id")
    bins = F.sequence((F.col("offset") / BIN).cast("long"), ((F.col("offset") + F.col("len") - 1) / BIN).cast("long"))
    own = own.select("b", "offset", "len", F.explode(bins).alias("bin"))
    lo = F.greatest(F.lit(0), F.col("bin") * BIN - F.col("offset"))
    hi = F.least(F.col("len"), (F.col("bin") + 1) * BIN - F.col("offset"))
    return own.select("bin", F.substring(F.col("b"), (lo + 1).cast("int"), (hi - lo).cast("int")).cast("string").alias("bit"))


def local_maxima(base: DataFrame, reach: int = 16, top: int | None = None) -> DataFrame:
    """track, bin, value: bins that no bin within reach exceeds.  Tracks are cut into stretches of bins with a margin of reach on either
    side, so no track is one window."""
    own = base.select("track", "bin", (F.col("total") / F.col("cov")).cast("float").alias("value"))
    size = 4096
    near = own.withColumn("part", F.explode(F.array_distinct(F.array(F.floor((F.col("bin") - reach) / size), F.floor(F.col("bin") / size), F.floor((F.col("bin") + reach) / size)))))
    w = Window.partitionBy("track", "part").orderBy("bin").rangeBetween(-reach, reach)
    peaks = near.withColumn("most", F.max("value").over(w)).where((F.floor(F.col("bin") / size) == F.col("part")) & (F.col("most") <= F.col("value"))).select("track", "bin", "value")
    return peaks if top is None else peaks.orderBy(F.desc("value"), "track", "bin").limit(top)


def gc_signal(bins: DataFrame) -> DataFrame:
    """gc_bins as base bins: the share weighs by counted letters."""
    return bins.select(F.lit("GC").alias("track"), "bin", F.col("gc").cast("double").alias("total"), F.col("acgt").alias("cov"), _d(F.col("share")).alias("high"))
