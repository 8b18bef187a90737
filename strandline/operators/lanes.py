"""Lanes of features in views: an interval colouring with a fixed number of colours.

In the order of (start, end, kind, name, strand), a feature takes the first lane that is free for more than a pixel before it, and holds it to its end and that of its label; if none is
free, it stands without a label in the lane that ends first (of equals the first).  The choice is sequential only where features stand close: where nothing before reaches a feature, every
lane is free, as at the beginning.  So a view is parted there, with a running maximum of what features reach at most, and the parts are folded apart from each other.

Cases.  Rows with a null start or end, or in a view without length, are left out; a null name has no label.  Repeated features each get a lane.  A part without a pause is one task, which streams its rows
and holds the ends of the lanes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.genome import numbered
from .features import carried, join_overlapping
from .views import _d

# The height of a lane, the least width of a feature that holds its label inside, and the widest label beside one.
LANE, INSIDE, LABEL = 9, 40, 80
ORDER = ["start", "end", "kind", "name", "strand"]
_KINDS = "view_id string, start long, end long, kind string, name string, strand string, lane int, labelled boolean"


def lanes_of(height: int) -> int:
    return max(1, (height - 2) // LANE)


def placed(views: DataFrame, features: DataFrame, width: int, letter: float = 6.0) -> DataFrame:
    """view_id and the features that meet each view, with x0, x1 (pixels, one wide at least) and label, the pixels of the name beside it.  letter: of one of its letters.
    views: view_id, start, end."""
    span = views.where("end > start").select("view_id", F.col("start").alias("v0"), (F.col("end") - F.col("start")).alias("span"))
    met = join_overlapping(views.where("end > start").select(F.col("view_id").alias("region_id"), "start", "end"), features.where("start is not null and end is not null"))
    own = met.select(F.col("region_id").alias("view_id"), *ORDER).join(span, "view_id")
    x = lambda c: _d(F.col(c) - F.col("v0")) / _d(F.col("span")) * _d(width)
    own = own.select("view_id", *ORDER, x("start").alias("x0"), F.greatest(x("start") + 1.0, x("end")).alias("x1"))
    text = F.least(_d(LABEL), _d(F.length("name")) * letter + 4.0)
    return own.withColumn("label", F.when((F.col("x1") - F.col("x0") > INSIDE) | F.col("name").isNull(), F.lit(0.0)).otherwise(text))


def parts(rows: DataFrame) -> DataFrame:
    """rows with __i, their number, and part, the number of the first row of the stretch that they stand in."""
    own = carried(numbered(rows, ["view_id", *ORDER], "__i").withColumn("__reach", F.col("x1") + F.col("label")), "view_id", "__reach", "__before", own=False)
    alone = F.coalesce(F.col("__before") < F.col("x0") - 1, F.lit(True))
    return carried(own.withColumn("__head", F.when(alone, F.col("__i"))), "view_id", "__head", "part").drop("__reach", "__before", "__head")


def packed(views: DataFrame, features: DataFrame, width: int, height: int, letter: float = 6.0) -> DataFrame:
    """view_id, the features that meet it, lane (from 0) and labelled: whether its name stands beside it or in it."""
    many = lanes_of(height)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ends = None, []
        for batch in batches:
            lane, named = [], []
            for p, x0, x1, label in zip(*(batch.column(c).to_pylist() for c in ("part", "x0", "x1", "label")), strict=True):
                if p != part:
                    part, ends = p, [float("-inf")] * many
                at = next((i for i, e in enumerate(ends) if e < x0 - 1), -1)
                named.append(at >= 0)
                if at < 0:
                    at, label = ends.index(min(ends)), 0.0
                ends[at] = max(ends[at], x1 + label)
                lane.append(at)
            kept = [batch.column(c) for c in ("view_id", *ORDER)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lane, pa.int32()), pa.array(named, pa.bool_())], names=["view_id", *ORDER, "lane", "labelled"])

    rows = parts(placed(views, features, width, letter)).withColumn("view_id", F.col("view_id").cast("string"))
    return rows.repartition("part").sortWithinPartitions("part", "__i").drop("__i").mapInArrow(step, _KINDS)
