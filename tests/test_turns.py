"""Windows that are taken in turns: neither their number nor that of ranges changes ranks or runs, and a turn's shuffles do not stay."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import kmer as K
from strandline.sources import genome as G, shared


def _genome(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices("ACGTN", (9, 9, 9, 9, 1), k=n)) for n in (0, 30, 31, 800, 3000)]
    texts += [texts[3], texts[4][500:1500], "A" * 200]
    return spark.createDataFrame(list(enumerate(texts)), "contig_id long, seq string").repartition(3), sum(map(len, texts))


@pytest.mark.parametrize("counted", [1 << 22, 300])
@pytest.mark.parametrize("turned", [False, True])
def test_ranks_are_dense(spark, monkeypatch, counted, turned):
    monkeypatch.setattr(G, "COUNTED", counted)
    own, letters = _genome(spark)
    key = K.rotate(F.col("kmer")) if turned else F.col("kmer")
    want = sorted((r.k, r.n) for r in G.windows(own, False).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect())
    got = G.ranked(own, letters, turned)
    assert sorted((r.leaf, r.kmer, r.copies) for r in got.collect()) == [(i, k, n) for i, (k, n) in enumerate(want)]


def test_ranks_of_nothing(spark):
    assert G.ranked(spark.createDataFrame([(1, "ACG")], "contig_id long, seq string"), 3).count() == 0


@pytest.mark.parametrize("turns", [1, 3, 50])
def test_runs_of_repeated_windows(spark, monkeypatch, turns):
    monkeypatch.setattr(G, "REPEATED_TURNS", turns)
    own, letters = _genome(spark)
    w = G.windows(own, False)
    many = w.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    want = sorted((r.contig_id, r.start) for r in w.join(many, "kmer").collect())
    runs = G.repeated(own, letters, 2, 1 << 16).collect()
    assert sorted((r.contig_id, i) for r in runs for i in range(r.first, r.last + 1)) == want and want
    assert sum(r.copies for r in runs) == w.join(many, "kmer").agg(F.sum("n")).first()[0]


def test_settings_are_as_they_were(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    with shared.shuffles_end(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == was
