"""Order of variants by shared substitutions: characters, ranks, keys, neighbours' prefixes, clades; and minimum spanning trees.

All functions take result rows (query_id, q, variant, mismatches, vi) and work per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import kmer as K

#: Ranks in a key; results of more mismatches cannot be ordered.
MOST_RANKS = 18
#: Variants up to which a session shows a spanning tree where one is asked for; `mst` itself takes any number.
MST_LIMIT = 25_000


def character_ranks(result: DataFrame, n: int) -> DataFrame:
    """query_id, char, n_variants, rank (from 1): the most shared first, then the lower id.  At most 93 rows a query."""
    chars = result.where(F.col("mismatches") <= n).select("query_id", F.explode(K.characters(F.col("q"), F.col("variant"))).alias("char"))
    counts = chars.groupBy("query_id", "char").agg(F.count(F.lit(1)).alias("n_variants"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_variants"), "char")))


def keys(result: DataFrame, n: int, ranked_at: int | None = None) -> DataFrame:
    """result within n, with key: the ranks of its characters, ascending.  ranked_at: rank by the variants within another n, for a frozen order."""
    ranks = character_ranks(result, n if ranked_at is None else ranked_at)
    maps = ranks.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("char", "rank"))).alias("m"))
    own = result.where(F.col("mismatches") <= n).join(maps, "query_id", "left")
    key = F.array_sort(F.transform(K.characters(F.col("q"), F.col("variant")), lambda c: F.get(F.array(F.element_at("m", c)), F.lit(0))))
    return own.withColumn("key", F.when(F.col("mismatches") == 0, F.array().cast("array<int>")).otherwise(key)).drop("m")


def shared(a: Column, b: Column) -> Column:
    """The length of the common prefix of two arrays; 0 if one is null."""
    same = F.zip_with(a, b, lambda x, y: x == y)
    first = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False)
    return F.coalesce(F.when(first == 0, F.size(same)).otherwise(first.cast("int") - 1), F.lit(0))


def ordered(result: DataFrame, n: int, ranked_at: int | None = None) -> DataFrame:
    """query_id, row, vi, variant, mismatches, key, lcp: in the order of keys; lcp with the row before.

    Rows of different first rank share nothing, so neighbours are looked up within a first rank; rows are numbered from its offset."""
    own = keys(result, n, ranked_at).withColumn("__f", F.coalesce(F.get("key", F.lit(0)), F.lit(0)))
    sizes = own.groupBy("query_id", "__f").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__b", F.sum("__n").over(Window.partitionBy("query_id").orderBy("__f")) - F.col("__n")).drop("__n")
    w = Window.partitionBy("query_id", "__f").orderBy("key")
    own = own.withColumns({"__r": F.row_number().over(w) - 1, "lcp": shared(F.lag("key").over(w), F.col("key"))}).join(before, ["query_id", "__f"])
    return own.select("query_id", (F.col("__b") + F.col("__r")).alias("row"), "vi", "variant", "mismatches", "key", "lcp")


def clades(order: DataFrame) -> DataFrame:
    """query_id, depth, start, end: every prefix of two keys or more that two neighbours share to its end, and the root.  order is read twice."""
    marks = order.where("lcp > 0").select("query_id", F.col("lcp").alias("depth"), F.slice("key", F.lit(1), F.col("lcp")).alias("p")).distinct()
    # All keys with a prefix are neighbours, so a clade is the span of the rows that have it.
    deep = F.explode(F.sequence(F.lit(1), F.size("key")))
    pre = order.where(F.size("key") > 0).select("query_id", "row", "key", deep.alias("depth")).select("query_id", "row", "depth", F.slice("key", F.lit(1), F.col("depth")).alias("p"))
    spans = pre.join(marks, ["query_id", "depth", "p"]).groupBy("query_id", "depth", "p").agg(F.min("row").alias("start"), (F.max("row") + 1).alias("end")).drop("p")
    root = order.groupBy("query_id").agg(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("start"), F.count(F.lit(1)).alias("end"))
    return spans.unionByName(root)


def clade_labels(clade: DataFrame, order: DataFrame, ranks: DataFrame, flipped: bool = False) -> DataFrame:
    """clades with label: the substitutions that all its members share; mirrored for a query that was turned round."""
    first = order.select("query_id", F.col("row").alias("start"), "key")
    maps = ranks.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "char"))).alias("m"))
    own = clade.join(first, ["query_id", "start"]).join(maps, "query_id", "left")
    chars = F.transform(F.slice("key", F.lit(1), F.col("depth")), lambda r: F.element_at("m", r))
    chars = F.array_sort(K.mirror(chars)) if flipped else F.array_sort(chars)
    return own.select("query_id", "depth", "start", "end", K.letters_of(chars).alias("label"))


def detail(row0: int, row1: int, pixels: int) -> dict:
    """What a view so many pixels high passes to shown_clades: clades of four pixels or more, 5,000 at most."""
    pixels = max(1, pixels)
    return {"row0": row0, "row1": row1, "min_rows": max(2, -(-4 * (row1 - row0) // pixels)), "limit": 5000}


def shown_clades(clade: DataFrame, row0: int, row1: int, min_rows: int = 2, limit: int = 20_000) -> DataFrame:
    """Clades but the root that a row window meets and that are large enough, the first so many by (start, -end, depth)."""
    own = clade.where((F.col("depth") > 0) & (F.col("start") < row1) & (F.col("end") > row0) & (F.col("end") - F.col("start") >= max(2, min_rows)))
    return own.orderBy("query_id", "start", F.desc("end"), "depth").limit(min(limit, 200_000))


def lengths(order: DataFrame) -> DataFrame:
    """Per query: the substitutions of the tree, and of a star without sharing."""
    return order.groupBy("query_id").agg(F.count(F.lit(1)).alias("variants"), F.sum(F.col("mismatches") - F.col("lcp")).alias("tree_length"), F.sum("mismatches").cast("long").alias("star_length"))


def _distance(a: np.ndarray, b: np.int64) -> np.ndarray:
    x = np.bitwise_xor(a, b)
    x |= x >> 1
    x &= 0x1555555555555555
    return np.bitwise_count(x)


#: Above any distance: what windows of the tree have in place of an edge.
_SHUT = np.uint8(64)


def spanning_tree(query: int, kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prim from the query, of any number of windows: the parent (-1: the query) and the edge of each window.  Of equal edges the lower index is taken, and a parent changes
    only for a shorter edge.  Distances are made when they are needed, so memory is some numbers a window; time is the square of their number, and those of the tree leave the arrays."""
    parent, edge = np.full(len(kmers), -1, np.int64), np.zeros(len(kmers), np.int64)
    at, own, up = np.arange(len(kmers)), kmers.astype(np.int64), parent.copy()
    near = _distance(own, np.int64(query))
    while len(at):
        shut = np.zeros(len(at), np.uint8)
        for _ in range(-(-len(at) // 2)):
            i = int(near.argmin())
            parent[at[i]], edge[at[i]], near[i], shut[i] = up[i], near[i], _SHUT, _SHUT
            d = _distance(own, own[i]) | shut
            nearer = d < near
            near[nearer], up[nearer] = d[nearer], at[i]
        left = shut == 0
        at, own, up, near = at[left], own[left], up[left], near[left]
    return parent, edge


def preorder(parent: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Visiting order (nearest child first, then lower index), the depth and the size of the subtree of each node."""
    n = len(parent)
    children: list[list[int]] = [[] for _ in range(n + 1)]
    for i in sorted(range(n), key=lambda i: (edge[i], i)):
        children[parent[i]].append(i)
    order, depth, size = [], np.zeros(n, np.int64), np.ones(n, np.int64)
    stack = [(i, 0) for i in reversed(children[-1])]
    while stack:
        i, d = stack.pop()
        order.append(i)
        depth[i] = d
        stack += [(c, d + 1) for c in reversed(children[i])]
    for i in reversed(order):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
    return np.array(order, np.int64), depth, size


def mst(result: DataFrame, n: int) -> DataFrame:
    """query_id, row, vi, parent_vi (null: the query), edge, depth (emitted: one more than the node's, at most 255), size.  A query's tree is sequential, so each is
    one group, whatever its size."""
    own = result.where(F.col("mismatches") <= n).select("query_id", "q", "variant", "vi")

    def group(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vi", ignore_index=True)
        parent, edge = spanning_tree(int(g.q[0]), g.variant.to_numpy(np.int64))
        order, depth, size = preorder(parent, edge)
        vi = g.vi.to_numpy()
        up = pd.array([None if p < 0 else int(vi[p]) for p in parent[order]], dtype="Int64")
        return pd.DataFrame({"query_id": g.query_id[0], "row": np.arange(len(g)), "vi": vi[order], "parent_vi": up, "edge": edge[order], "depth": np.minimum(depth[order] + 1, 255), "size": size[order]})

    return own.groupBy("query_id").applyInPandas(group, "query_id string, row long, vi long, parent_vi long, edge long, depth long, size long")


def mst_clades(tree: DataFrame) -> DataFrame:
    """Subtrees of two nodes or more, and the root, as row spans."""
    own = tree.where("size >= 2").select("query_id", F.col("depth").cast("int").alias("depth"), F.col("row").alias("start"), (F.col("row") + F.col("size")).alias("end"))
    return own.unionByName(tree.groupBy("query_id").agg(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("start"), F.count(F.lit(1)).alias("end")))


def order_mode(asked: str, variants: int) -> str:
    if asked not in ("per_n", "frozen", "mst"):
        raise ValueError(f"no such order: {asked}")
    return "per_n" if asked == "mst" and variants > MST_LIMIT else asked

