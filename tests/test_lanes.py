from __future__ import annotations

import random

from strandline.operators import features as FE, lanes

SCHEMA = "set string, start long, end long, kind string, name string, strand string"


def _fold(view, features, width, height, letter=6.0):
    """All features of a view, one after the other."""
    v, a, b = view
    met = sorted((f for f in features if f[1] is not None and f[1] < b and f[2] > a), key=lambda f: (f[1], f[2], f[3], f[4] is not None, f[4] or "", f[5]))
    ends, out = [float("-inf")] * max(1, (height - 2) // 9), []
    for _, s, e, kind, name, strand in met:
        x0 = (s - a) / (b - a) * width
        x1 = max(x0 + 1, (e - a) / (b - a) * width)
        label = 0.0 if x1 - x0 > 40 or name is None else min(80.0, letter * len(name) + 4)
        free = [i for i, x in enumerate(ends) if x < x0 - 1]
        lane = free[0] if free else ends.index(min(ends))
        ends[lane] = max(ends[lane], x1 + (label if free else 0.0))
        out.append((v, s, e, kind, name, strand, lane, bool(free)))
    return out


def test_lanes_are_those_of_a_fold(spark, monkeypatch):
    monkeypatch.setattr(FE, "STEP", 16)  # many steps
    rng = random.Random(3)
    features = []
    for _ in range(250):
        s = rng.choice([rng.randrange(100_000), rng.randrange(40_000, 42_000)])
        features.append(("f", s, s + rng.choice([1, 50, 400, 3000]), rng.choice("AB"), rng.choice([None, "", "n", "a long name of it"]), rng.choice("+-")))
    features += [features[7]] * 5 + [("f", 0, 100_000, "A", "all", "+"), ("f", None, 5, "A", "x", "+")]
    df = spark.createDataFrame(features, SCHEMA)
    views = [("a", 0, 100_000), ("b", 39_000, 43_000), ("c", 90_000, 100_000), ("far", 500_000, 600_000), ("none", 10, 10)]
    vdf = spark.createDataFrame(views, "view_id string, start long, end long")
    for height in (5, 30, 90):
        want = sorted((x for v in views[:4] for x in _fold(v, features, 600, height)), key=str)
        got = sorted((tuple(r) for r in lanes.packed(vdf, df, 600, height).collect()), key=str)
        assert got == want
    assert lanes.packed(vdf.limit(0), df, 600, 30).count() == 0 and lanes.packed(vdf, df.limit(0), 600, 30).count() == 0


def test_a_view_is_parted_where_nothing_reaches(spark):
    features = spark.createDataFrame([("f", 1000 * i + d, 1000 * i + d + 90, "A", None, "+") for i in range(40) for d in (0, 50)], SCHEMA)
    views = spark.createDataFrame([("v", 0, 40_000)], "view_id string, start long, end long")
    own = lanes.parts(lanes.placed(views, features, 4000))
    assert own.select("part").distinct().count() == 40 and {r.n for r in own.groupBy("part").count().withColumnRenamed("count", "n").collect()} == {2}
    assert sorted({(r.start % 1000, r.lane) for r in lanes.packed(views, features, 4000, 30).collect()}) == [(0, 0), (50, 1)]
