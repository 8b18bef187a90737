from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from strandline.operators import features as FE, profiles as P, tracks as T, tree, views as V


@pytest.fixture
def drawn(spark):
    rows = [("q", 0, 90, False, 0), ("q", 1, 100, True, 2), ("q", 1, 130, False, 2), ("q", 2, 199, True, 3), ("q", 2, 400, True, 3), ("q", 3, 150, False, 1)]
    site = spark.createDataFrame(rows, "query_id string, vi long, pos long, reverse boolean, mismatches int")
    order = spark.createDataFrame([("q", 0, 0), ("q", 3, 1), ("q", 1, 2), ("q", 2, 3)], "query_id string, vi long, row long")
    return site, order, rows


@pytest.mark.parametrize(("width", "height", "row0", "row1"), [(10, 4, 0, 4), (7, 3, 1, 4), (300, 1, 0, 1), (3, 9, 0, 4)])
def test_raster(drawn, width, height, row0, row1):
    site, order, rows = drawn
    start, end, place = 100, 200, {0: 0, 3: 1, 1: 2, 2: 3}
    want: dict[tuple[int, int], list] = {}
    for _, vi, pos, rev, mm in rows:
        r = place[vi]
        if pos + 31 <= start or pos >= end or not row0 <= r < row1:
            continue
        x0 = min(math.floor((max(pos, start) - start) * width / (end - start)), width - 1)
        x1 = max(min(math.ceil((min(pos + 31, end) - start) * width / (end - start)), width), x0 + 1)
        y0 = min(math.floor((r - row0) * height / (row1 - row0)), height - 1)
        y1 = max(min(math.ceil((r - row0 + 1) * height / (row1 - row0)), height), y0 + 1)
        for x in range(x0, x1):
            for y in range(y0, y1):
                c = want.setdefault((x, y), [0, 255, 0])
                c[0] += 1
                c[1] = min(c[1], mm)
                c[2] |= 2 if rev else 1
    got = {(r.x, r.y): [r.sites, r.min_mismatches, r.strands] for r in V.raster(site, order, start, end, width, row0, row1, height).collect()}
    assert got == want
    assert V.sites_drawn(site, order, start, end, 0, 4).first().sites_drawn == 5


def test_histogram_and_cells(drawn):
    site, order, _ = drawn
    bars = V.histogram(site, 3, 100, 200, 10)
    assert {(r.col, r.mismatches, r.sites) for r in bars.collect()} == {(0, 0, 1), (0, 2, 1), (3, 2, 1), (9, 3, 1), (5, 1, 1)}
    assert V.dense(bars, 10, 3).count() == 40
    cells = V.raster(site, order, 100, 200, 10, 0, 4, 4)
    assert {r.strands for r in V.turned(cells).where("x = 9").collect()} == {1}
    assert all(len(r.cell) == 4 for r in V.packed(cells).collect())
    assert V.intensity(cells).agg(F.max("level")).first()[0] == 255


def test_requests_of_views():
    near, far = FE.request("genes", 0, 199_999, 801), FE.request("genes", 0, 200_000, 800)
    assert "exon" in near["kinds"] and "exon" not in far["kinds"] and FE.request("repeats", 0, 10, 1)["kinds"] is None
    assert (near["width"], far["width"], far["limit"]) == (401, 400, 1500)
    assert [tree.detail(0, rows, 400)["min_rows"] for rows in (0, 200, 201, 400, 401)] == [2, 2, 3, 4, 5]
    assert tree.detail(3, 10, 0) == {"row0": 3, "row1": 10, "min_rows": 28, "limit": 5000}


def test_features(spark):
    rows = [("s", 0, 10, "a", "x", "+"), ("s", 5, 40, "b", "y", "-"), ("s", 39, 41, "a", "z", "."), ("s", 100, 90000, "c", "w", "+")]
    f = spark.createDataFrame(rows, "set string, start long, end long, kind string, name string, strand string")
    assert {r.name for r in FE.overlapping(f, 10, 40).collect()} == {"y", "z"} and {r.name for r in FE.at(f, 39).collect()} == {"y", "z"}
    assert FE.overlapping(f, 0, 100, []).count() == 0
    assert {(r.col, r.features) for r in FE.density(f, 0, 50, 5).collect()} == {(0, 2), (1, 1), (2, 1), (3, 2), (4, 1)}
    regions = spark.createDataFrame([(1, 8, 39), (2, 50_000, 60_000), (3, 95, 100)], "region_id long, start long, end long")
    assert {(r.region_id, r.name) for r in FE.join_overlapping(regions, f).collect()} == {(1, "x"), (1, "y"), (2, "w")}
    assert FE.features_or_density(f, 0, 50, 5, limit=2)[0] == "density" and FE.features_or_density(f, 0, 50, 5)[2] == 3
    kind, few, total = FE.features_or_density(f, 0, 50, 5, kinds=["a"])
    assert (kind, total, {r.name for r in few.collect()}) == ("features", 2, {"x", "z"})
    own = FE.sorted_set(f).orderBy("row").collect()
    assert [r.kind_id for r in own] == [0, 1, 0, 2] and [r.max_end for r in own] == [10, 40, 41, 90000]


def test_tracks(spark):
    signal = spark.createDataFrame([("t", 0, 40, 2.0), ("t", 32, 64, 4.0), ("t", 1000, 1001, float("nan")), ("t", 40000, 40032, 10.0)], "track string, start long, end long, value double")
    base = T.base_bins(signal)
    assert {(r.bin, r.total / r["cov"], r.high) for r in base.collect()} == {(0, 2.0, 2.0), (1, (16 + 128) / 40, 4.0), (1250, 10.0, 10.0)}
    length = 40_032
    assert T.levels(length) == 2 and T.levels(1024 * 32) == 1 and T.levels(1024 * 32 + 1) == 2
    top = {r.bin: r for r in T.pyramid(base, length).where("level = 1").collect()}
    assert abs(top[0]["mean"] - (64 + 144) / 72) < 1e-6 and top[312].high == 10
    assert [r["mean"] for r in T.value_at(base, 40_000).selectExpr("value as mean").collect()] == [10.0] and T.value_at(base, 500).count() == 0
    s = T.statistics(base, length).first()
    assert (s.p01, s.low, s.high) == (2.0, 2.0, 10.0) and abs(s.coverage - 3 / 1251) < 1e-9
    sums = {r.col: r["mean"] for r in T.summary(T.pyramid(base, length), length, 0, 128, 2).collect()}
    assert sums == {0: pytest.approx((2.0 + 3.6) / 2)}
    assert {r.bin for r in T.local_maxima(base).collect()} == {1, 1250}
    assert T.scaled(T.statistics(base, length)).first().lo == 0.0


def test_profiles(spark):
    rows = [("q", 0, 0, 1_000_000, p, False) for p in (100, 3000, 4196, 4197, 8294, 8293 + 4097 * 3)]
    site = spark.createDataFrame(rows, "query_id string, contig_id long, offset long, len long, pos long, reverse boolean")
    kept, last = [], None
    for p in sorted(r[4] for r in rows):
        if last is None or p - last > 4096:
            kept.append(p)
            last = p
    assert sorted(r.pos for r in P.thinned(site).collect()) == kept
    assert P.subsampled(site, 2).count() == 2
    own = spark.createDataFrame([(100, None), (100, 2000), (100, 9000)], "pos long, own long")
    assert P.not_own(own).count() == 2
    stats = spark.createDataFrame([("q", "t", i, float(i % 7), 1.0) for i in range(1, 21)] + [("q", "t", 0, 9.0, 1.0), ("r", "t", 0, 1.0, 1.0)], "query_id string, track string, shift int, shape double, level double")
    got = {r.query_id: r for r in P.tested(stats).collect()}
    null = [float(i % 7) for i in range(1, 21)]
    m = sum(null) / 20
    sd = math.sqrt(sum((x - m) ** 2 for x in null) / 19)
    assert got["q"].z == pytest.approx((9 - m) / sd) and got["q"].p == pytest.approx(1 / 21) and got["r"].p is None
    level = {r.query_id: r for r in P.tested(stats, "level").collect()}
    assert level["q"].z == 0 and level["q"].p == 1


def test_summaries_and_verdicts(spark):
    rows = [("unique", "T", 4, 10 + i, float(i), 0.01 if i < 8 else 0.5, 0.5) for i in range(10)] + [("absent", "T", 4, 9, 0.0, 0.5, 0.5)] * 10
    own = P.class_summary(spark.createDataFrame(rows, "class string, track string, n int, effective int, z double, p double, level_p double"))
    u = own.where("class = 'unique'").first()
    assert (u.testable, u.significant, u.share, u.median_sites, u.median_z) == (10, 8, 0.8, 15, 5.0)
    assert P.verdict(P.survivors(own)) == "CONTINUE: unique/T/n=4" and P.verdict(P.survivors(own.where("class = 'absent'"))) == "KILL"
    motif = [(f"q{i}", s, z, 0.001) for i in range(6) for s, z in (("H8", 3.0), ("E8c", 5.0 if i < 4 else 1.0))]
    v = P.motif_verdict(spark.createDataFrame(motif, "query_id string, set string, z double, p double")).first()
    assert (v.qualifying, v.beaten, v.verdict) == (6, 4, "PIVOT")


def test_sampling(spark):
    from strandline.operators import sampling
    from strandline.sources import genome as G, synthetic

    own = synthetic.genome(spark, synthetic.Spec(seed=5, contig_lens=(2000,)))
    site = G.sites(own).persist()
    kmers = G.kmers(site)
    assert sampling.drawn(site, 7).count() == 7 and sampling.unique_windows(site, kmers, 5).count() == 5 and sampling.random_absent(kmers, 6).count() == 6
    twins = sampling.shuffled_twins(spark, [("a", "ACGT" * 7 + "ACG"), ("b", "A" * 30 + "C")], kmers).collect()
    assert {r.query_id for r in twins} == {"a", "b"}
    assert sampling.fit_line([(1, 3.0), (2, 5.0), (4, 9.0)]) == (pytest.approx(1), pytest.approx(2)) and sampling.fit_line([(1, 4.0), (2, 4.0), (4, 1.0)])[0] == 0 and sampling.fit_line([]) is None
    where = {"c": {"offset": 100, "len": 50}, "d:x": {"offset": 150, "len": 5000}}
    assert [sampling.parse_region(t, where, 9) for t in ("all", "c", "c:11", "d:x:1,001", "c:2-5")] == [(0, 9), (100, 150), (110, 150), (1150, 2150), (101, 105)]
    assert sampling.timed(lambda: None) >= 0


def test_thinned_sites_and_permutations_reach_the_whole_genome(spark):
    """The sites past the first million letters count, and have signal."""
    from strandline.plans import catalogue, fixtures

    sf = "/root/testdata/sf0.01"
    own = catalogue.QUERIES["thinned_sites"](spark, sf)
    assert own.agg(F.max("pos")).first()[0] > 1_000_000
    length = fixtures.contigs(spark, sf).agg(F.max(F.col("offset") + F.col("len"))).first()[0]
    assert length - 100_000 < fixtures.signal(spark, sf).agg(F.max("start")).first()[0] < length
    effective = {min(r["count"], 500) for r in own.groupBy("query_id").count().collect()}
    got = {r.median_sites for r in catalogue.QUERIES["permutation_study"](spark, sf).collect()}
    assert got and got <= effective
