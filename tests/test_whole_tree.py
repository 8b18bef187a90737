"""Spanning trees are Prim's whatever their size."""

from __future__ import annotations

import random

import numpy as np

from strandline.operators import tree

LETTERS = 31


def _prim(query: int, own: list[int]) -> tuple[list[int], list[int]]:
    apart = lambda a, b: sum((a ^ b) >> 2 * i & 3 != 0 for i in range(LETTERS))
    parent, edge, left = [-1] * len(own), [apart(query, x) for x in own], set(range(len(own)))
    while left:
        i = min(left, key=lambda j: (edge[j], j))
        left.remove(i)
        for j in left:
            if apart(own[i], own[j]) < edge[j]:
                parent[j], edge[j] = i, apart(own[i], own[j])
    return parent, edge


def _near(query: int, n: int, seed: int) -> list[int]:
    rng, out = random.Random(seed), set()
    while len(out) < n:
        x = query
        for i in rng.sample(range(12), rng.randint(1, 6)):
            x ^= rng.randint(1, 3) << 2 * i
        out.add(x)
    return sorted(out, key=lambda x: (x * 0x9E3779B97F4A7C15) % 2**64)


def test_trees_of_every_small_size():
    for n in [*range(12), 33, 100]:
        own = _near(12345678901234567, n, n)
        parent, edge = tree.spanning_tree(12345678901234567, np.array(own, np.int64))
        assert (parent.tolist(), edge.tolist()) == _prim(12345678901234567, own)


def test_no_size_changes_the_tree(spark, monkeypatch):
    own = _near(987654321, 60, 1)
    parent, edge = _prim(987654321, own)
    rows = spark.createDataFrame([("x", 987654321, v, 6, i) for i, v in enumerate(own)], "query_id string, q long, variant long, mismatches int, vi long")
    monkeypatch.setattr(tree, "MST_LIMIT", 3)
    got = {r.vi: (-1 if r.parent_vi is None else r.parent_vi, r.edge) for r in tree.mst(rows, 8).collect()}
    assert got == {i: (parent[i], edge[i]) for i in range(60)}
