"""The sieve of windows that may be near a probe."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strandline.functions import kmer as K
from strandline.sources import genome as G
from strandline.streaming import feed

RNG = random.Random(8)


def _probes(spark, rows):
    return spark.createDataFrame([(str(i), x) for i, x in enumerate(rows)], "query_id string, text string").select("query_id", K.pack(F.col("text")).alias("q"))


def _changed(text, n):
    at = RNG.sample(range(31), n)
    return "".join(RNG.choice("ACGT".replace(c, "")) if i in at else c for i, c in enumerate(text))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 6])
def test_all_near_windows_pass_and_few_others(spark, n):
    texts = ["".join(RNG.choices("ACGT", k=31)) for _ in range(40)] + ["A" * 31]
    keep = feed.sieve(_probes(spark, texts), n)
    turned = [t[::-1].translate(str.maketrans("ACGT", "TGCA")) for t in texts]
    near = [_changed(t, d) for t in texts + turned for d in range(n + 1) for _ in range(4)]
    other = ["".join(RNG.choices("ACGT", k=31)) for _ in range(3000)]
    packed = lambda some: np.concatenate([G.packed_windows(t.encode())[1] for t in some])
    assert keep(packed(near)).all()
    assert keep(packed(other)).mean() < (0.01 if n < 4 else 0.3)


def test_only_near_windows_become_rows(spark):
    text = "".join(RNG.choices("ACGT", k=5000))
    own = spark.createDataFrame([(1, text)], "contig_id long, seq string")
    probes = _probes(spark, [text[100:131], _changed(text[700:731], 2)])
    got = [r.start for r in G.windows(own, deal=False, keep=feed.sieve(probes, 2)).select("start").collect()]
    assert {100, 700} <= set(got) and len(got) < 50
    every, few = (sorted(tuple(r) for r in feed.screened(w, probes, 2).collect()) for w in (G.windows(own, deal=False), G.windows(own, deal=False, keep=feed.sieve(probes, 2))))
    assert few == every
    assert G.windows(own, deal=False, keep=feed.sieve(probes.limit(0), 2)).count() == 0


def test_a_full_table_is_no_sieve(spark, monkeypatch):
    monkeypatch.setattr(feed, "FULL", 1e-9)
    assert feed.sieve(_probes(spark, ["ACGT" * 7 + "ACG"]), 2) is None
