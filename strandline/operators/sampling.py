"""Query sets: windows drawn by hash, random ones that the genome lacks, shuffled twins; and a cost model fitted to timings."""

from __future__ import annotations

from statistics import median

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import kmer as K
from ..sources import shared
from .search import absent


def drawn(site: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """query_id and q of n sites, by hash of their place."""
    return site.orderBy(F.xxhash64("pos", F.lit(seed)), "pos").limit(n).select(F.col("pos").cast("string").alias("query_id"), F.col("fwd").alias("q"))


def unique_windows(site: DataFrame, kmers: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return drawn(site.join(kmers.where("copies = 1").select("kmer"), "kmer", "left_semi"), n, seed)


def random_absent(kmers: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n random windows that the genome has in neither orientation: the hashes of numbers, of which four times as many are tried."""
    own = kmers.sparkSession.range(4 * n).select(F.format_string("r%08d", "id").alias("query_id"), F.xxhash64("id", F.lit(seed)).bitwiseAND(F.lit(K.ALL)).alias("q"))
    return absent(kmers, own).orderBy("query_id").limit(n)


def shuffled(queries: DataFrame, seed: int = 0) -> DataFrame:
    """queries: query_id, text and t (the number of a try).  With q, the letters in the order of their hashes by query, try and place, packed."""
    h = lambda i: F.md5(F.concat_ws("-", "query_id", F.lit(seed), "t", i))
    letters = F.transform(F.sequence(F.lit(0), F.lit(K.K - 1)), lambda i: F.struct(h(i).alias("h"), F.substring(F.col("text"), i + 1, F.lit(1)).alias("c")))
    return queries.select("query_id", "text", "t", K.pack_clean(F.array_join(F.transform(F.array_sort(letters), lambda x: x["c"]), "")).alias("q"))


#: Tries of the first round of twins; each round has four times as many as the one before.
FIRST_TRIES = 20


def shuffled_twins(spark: SparkSession, queries: DataFrame | list[tuple[str, str]], kmers: DataFrame, seed: int = 0, tries: int = 1000) -> DataFrame:
    """queries: query_id and text.  query_id and q: for each, its letters in another order that the genome lacks, the first of so many tries.  A query without any has no row.  Orders
    are drawn and looked up in Spark, in rounds for the queries that have none yet; a round has more tries, so there are few."""
    missing = spark.createDataFrame(queries, "query_id string, text string") if isinstance(queries, list) else queries.select("query_id", "text")
    out, first, many = None, 0, FIRST_TRIES
    while first < tries:
        own = missing.withColumn("t", F.explode(F.sequence(F.lit(first), F.lit(min(first + many, tries) - 1))))
        got = shared.settled(absent(kmers, shuffled(own, seed)).groupBy("query_id").agg(F.min_by("q", "t").alias("q")))
        out = got if out is None else out.unionByName(got)
        missing = shared.settled(missing.join(got, "query_id", "left_anti"))
        if missing.isEmpty():
            break
        first, many = first + many, 4 * many
    return out


def centred(points: DataFrame, site: DataFrame, name: str, n: int, seed: int = 0) -> DataFrame:
    """class, query_id, q and own of n windows that lie around given places (column pos: the middle), by hash; places without a clean window are passed over."""
    own = points.select((F.col("pos") - K.K // 2).alias("pos")).distinct().join(site.select("pos", "fwd"), "pos")
    own = own.orderBy(F.xxhash64("pos", F.lit(seed)), "pos").limit(n)
    return own.select(F.lit(name).alias("class"), F.concat(F.lit(f"{name}:"), "pos").alias("query_id"), F.col("fwd").alias("q"), F.col("pos").alias("own"))


def query_classes(site: DataFrame, kmers: DataFrame, n: int, motif: DataFrame | None = None, peaks: DataFrame | None = None, repeats: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """class, query_id, q and own (null: none): the queries of a study, n of each class.

    unique: windows that come once; motif: around occurrences of a motif (pos: its middle); summit: around the strongest local maxima of a
    track (pos); te: windows inside features (start, end); for each of them a twin `<class>_shuf`; absent: random windows."""
    spark = kmers.sparkSession
    once = site.join(kmers.where("copies = 1").select("kmer"), "kmer", "left_semi")
    out = once.orderBy(F.xxhash64("pos", F.lit(seed)), "pos").limit(n).select(F.lit("unique").alias("class"), F.concat(F.lit("unique:"), "pos").alias("query_id"), F.col("fwd").alias("q"), F.col("pos").alias("own"))
    for name, points in (("motif", motif), ("summit", peaks)):
        if points is not None:
            out = out.unionByName(centred(points, site, name, n, seed))
    if repeats is not None:
        inside = repeats.where(F.col("end") - F.col("start") >= K.K).select((F.col("start") + F.pmod(F.xxhash64("start", "end", F.lit(seed)), F.col("end") - F.col("start") - K.K + 1) + K.K // 2).alias("pos"))
        out = out.unionByName(centred(inside, site, "te", n, seed))
    out = shared.settled(out)
    twins = shuffled_twins(spark, out.select(F.concat("class", F.lit("_shuf/"), "query_id").alias("query_id"), K.unpack(F.col("q")).alias("text")), kmers, seed)
    twins = twins.select(F.split("query_id", "/")[0].alias("class"), "query_id", "q", F.lit(None).cast("long").alias("own"))
    none = random_absent(kmers, n, seed).select(F.lit("absent").alias("class"), "query_id", "q", F.lit(None).cast("long").alias("own"))
    return out.unionByName(twins).unionByName(none)


def fit_line(rows: list[tuple[float, float]]) -> tuple[float, float] | None:
    """a and b of t = a + b x, least squares of the relative error; through the origin if a or b would be negative."""
    rows = [(x, t) for x, t in rows if t > 0]
    if not rows:
        return None
    w = [1 / t**2 for _, t in rows]
    sw, sx, st = sum(w), sum(k * x for k, (x, _) in zip(w, rows, strict=True)), sum(k * t for k, (_, t) in zip(w, rows, strict=True))
    sxx, sxt = sum(k * x * x for k, (x, _) in zip(w, rows, strict=True)), sum(k * x * t for k, (x, t) in zip(w, rows, strict=True))
    det = sw * sxx - sx * sx
    if len(rows) > 1 and det > 0:
        b = (sw * sxt - sx * st) / det
        a = (st - b * sx) / sw
        if a >= 0 and b >= 0:
            return a, b
    return (0.0, sxt / sxx) if sxx else None


def timed(run, times: int = 3) -> float:
    """The median seconds of a few runs."""
    import time

    took = []
    for _ in range(times):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return median(took)


def parse_region(text: str, contigs: dict[str, dict], length: int) -> tuple[int, int]:
    """`all`, `name`, `name:start` (a thousand letters from there) or `name:start-end`; places from 1, commas do not count."""
    text = text.strip().replace(",", "")
    if text in ("", "all"):
        return 0, length
    name, colon, span = text.rpartition(":") if text not in contigs else (text, "", "")
    c = contigs[name or text]
    if not colon:
        return c["offset"], c["offset"] + c["len"]
    a, dash, b = span.partition("-")
    start = int(a) - 1
    end = int(b) if dash and b else start + 1000
    return c["offset"] + max(0, start), c["offset"] + min(c["len"], end)
