"""Results drawn by position: histograms, rasters, pages of variants and sites.

Pixel arithmetic is in doubles and in the stated order of operations, so that any engine with IEEE doubles gets the same cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import kmer as K


def _d(x) -> Column:
    return (F.lit(x) if isinstance(x, (int, float)) else x).cast("double")


def _int(x: Column) -> Column:
    return x.cast("long")


def column_of(pos: Column, start: int, end: int, width: int) -> Column:
    """The column of a site by its first letter; one that begins before the region is in the first."""
    x = F.floor(_d(F.greatest(pos, F.lit(start)) - start) * _d(width) / _d(end - start))
    return F.least(x, F.lit(width - 1))


def histogram(site: DataFrame, n: int, start: int, end: int, width: int) -> DataFrame:
    """query_id, col, mismatches, sites: each site that meets the region, once.  site: query_id, pos, mismatches."""
    own = site.where((F.col("mismatches") <= n) & (F.col("pos") + K.K > start) & (F.col("pos") < end))
    return own.groupBy("query_id", column_of(F.col("pos"), start, end, width).alias("col"), "mismatches").agg(F.count(F.lit(1)).alias("sites"))


def dense(bars: DataFrame, width: int, n: int) -> DataFrame:
    """histogram with a row for every column and number of mismatches (a stated grid for each query)."""
    grid = bars.sparkSession.range(width * (n + 1)).select((F.col("id") / (n + 1)).cast("long").alias("col"), (F.col("id") % (n + 1)).cast("int").alias("mismatches"))
    full = bars.select("query_id").distinct().join(F.broadcast(grid))
    return full.join(bars, ["query_id", "col", "mismatches"], "left").na.fill(0, ["sites"])


def stacked(bars: DataFrame) -> DataFrame:
    """histogram with each bar's share of its column, and the column's total and share of the highest."""
    col = Window.partitionBy("query_id", "col")
    totals = bars.groupBy("query_id", "col").agg(F.sum("sites").alias("total"))
    most = totals.groupBy("query_id").agg(F.max("total").alias("highest"))
    return bars.withColumn("total", F.sum("sites").over(col)).join(most, "query_id").select("query_id", "col", "mismatches", "sites", "total", (F.col("sites") / F.col("total")).alias("share"), (F.col("total") / F.col("highest")).alias("height"))


def raster(site: DataFrame, order: DataFrame, start: int, end: int, width: int, row0: int, row1: int, height: int) -> DataFrame:
    """query_id, x, y, sites (at most 65535), min_mismatches, strands (1: forward, 2: reverse, 3: both), of cells that have any.

    site: query_id, vi, pos, reverse, mismatches; order: query_id, vi, row.  A site covers its 31 letters in x and its row in y."""
    span, rows = end - start, row1 - row0
    own = site.where((F.col("pos") + K.K > start) & (F.col("pos") < end)).join(order.where((F.col("row") >= row0) & (F.col("row") < row1)).select("query_id", "vi", "row"), ["query_id", "vi"])
    x0 = F.least(F.floor(_d(F.greatest(F.col("pos"), F.lit(start)) - start) * _d(width) / _d(span)), F.lit(width - 1))
    x1 = F.ceil(_d(F.least(F.col("pos") + K.K, F.lit(end)) - start) * _d(width) / _d(span))
    y0 = F.floor(_d(F.col("row") - row0) * _d(height) / _d(rows))
    y1 = F.ceil(_d(F.col("row") - row0 + 1) * _d(height) / _d(rows))
    own = own.withColumns({"x0": _int(x0), "y0": _int(F.least(y0, F.lit(height - 1)))})
    own = own.withColumns({"x1": F.greatest(F.least(_int(x1), F.lit(width)), F.col("x0") + 1), "y1": F.greatest(F.least(_int(y1), F.lit(height)), F.col("y0") + 1)})
    cells = own.select("query_id", "mismatches", "reverse", "y0", "y1", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))
    cells = cells.select("query_id", "mismatches", "reverse", "x", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"))
    bits = F.bit_or(F.when(F.col("reverse"), F.lit(2)).otherwise(F.lit(1)))
    return cells.groupBy("query_id", "x", "y").agg(F.least(F.count(F.lit(1)), F.lit(65535)).alias("sites"), F.min("mismatches").alias("min_mismatches"), bits.alias("strands"))


def turned(cells: DataFrame) -> DataFrame:
    """Cells of a query that was looked up by its other strand: the two strand bits change places."""
    s = F.col("strands")
    return cells.withColumn("strands", F.when(s == 1, F.lit(2)).when(s == 2, F.lit(1)).otherwise(s))


def intensity(cells: DataFrame, log: bool = True, levels: int = 255) -> DataFrame:
    """cells with level: the count against the highest of the picture, on a logarithmic or linear scale, in so many steps."""
    most = F.max("sites").over(Window.partitionBy("query_id"))
    share = F.log1p(F.col("sites").cast("double")) / F.log1p(most.cast("double")) if log else F.col("sites") / most
    return cells.withColumn("level", F.round(share * levels).cast("int"))


def packed(cells: DataFrame) -> DataFrame:
    """Each cell as four bytes: count low, count high, least mismatches, strands."""
    n = F.col("sites")
    value = [n.bitwiseAND(F.lit(255)), F.shiftright(n, 8), F.col("min_mismatches").cast("long"), F.col("strands").cast("long")]
    return cells.select("query_id", "x", "y", F.unhex(F.concat(*[F.lpad(F.hex(v), 2, "0") for v in value])).alias("cell"))


def sites_drawn(site: DataFrame, order: DataFrame, start: int, end: int, row0: int, row1: int) -> DataFrame:
    own = site.where((F.col("pos") + K.K > start) & (F.col("pos") < end)).join(order.where((F.col("row") >= row0) & (F.col("row") < row1)).select("query_id", "vi"), ["query_id", "vi"])
    return own.groupBy("query_id").agg(F.count(F.lit(1)).alias("sites_drawn"))


def variants_page(order: DataFrame, result: DataFrame, kmers: DataFrame, row0: int = 0, limit: int = 100) -> DataFrame:
    """Rows from row0 on, at most `limit` (10,000 at most): variant, mismatches, copies, places of the substitutions (from 1)."""
    own = order.where((F.col("row") >= row0) & (F.col("row") < row0 + min(limit, 10_000))).select("query_id", "row", "vi")
    met = own.join(result.select("query_id", "vi", "q", "variant", "mismatches", "leaf"), ["query_id", "vi"]).join(kmers.select(F.col("kmer").alias("leaf"), "copies"), "leaf")
    places = F.transform(K.mismatch_positions(F.col("q"), F.col("variant")), lambda p: p + 1)
    return met.withColumn("positions", places).select("query_id", "row", K.unpack(F.col("variant")).alias("variant"), "mismatches", F.col("copies").alias("sites"), "positions")


def sites_page(hit: DataFrame, start: int, end: int, limit: int = 5000) -> DataFrame:
    """The first sites of a region by place, at most `limit` (100,000 at most), each with the number of all."""
    own = hit.where((F.col("pos") + K.K > start) & (F.col("pos") < end))
    total = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    ranked = own.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "strand", "variant"))).where(F.col("k") <= min(limit, 100_000))
    return ranked.join(total, "query_id").drop("k")


def export_rows(hit: DataFrame, names: DataFrame, bed: bool = False, order: DataFrame | None = None) -> DataFrame:
    """Sites as the TSV (places from 1; with the variant's row, if there is an order) or BED (from 0) export has them, in the order of place.  names: contig_id, name;
    order: query_id, row and variant or vi of the hits."""
    own = hit.join(names.select("contig_id", "name"), "contig_id")
    if order is not None:
        own = own.join(order.select("query_id", "vi", "row"), ["query_id", "vi"])
    own = own.orderBy("query_id", "pos", "strand", "variant")
    start = F.col("start") if bed else F.col("start") + 1
    end, variant = F.col("start") + K.K, K.unpack(F.col("variant")).alias("kmer" if order is not None else "variant")
    last = ["strand", variant, "mismatches", "row"] if order is not None else [variant, "mismatches", "strand"]
    return own.select(F.col("name").alias("contig"), start.alias("start"), end.alias("end"), *last)
