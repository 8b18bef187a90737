"""Near copies by order MinHash, verified by banded alignment of words.

Sketch.  A text's items are its runs of K words, each labelled with how often the same run came before.  Each of BANDS hash
functions takes the two least items and keeps their order in the text, so the sketch depends on edits and moves, not
on the set alone.  Texts that share a band's sketch are candidates.  Every member of such a group is first compared with the
group's least document; then all pairs of a group whose two texts are not yet in one class are compared too, so no near pair of a group
depends on a document that is near neither.

Check.  A pair is near if the edit distance of the word sequences is at most 1 - SIMILARITY of the longer; it is computed in a
band of that width around the diagonal, one column of bits at a time.  Equal texts are grouped by hash beforehand, and only the
first of them is compared.  Classes are the connected components of exact and near links; class_id is the least doc_id.

Second comparison.  A text's words are counted in CELLS hashed cells of four bits.  One edit raises at most one cell by one and lowers at most one by one,
so what the cells differ by bounds the edit distance from below: a pair over the bound is dropped without its texts, and no
near pair is.  A group's members are dealt into blocks, and a task compares two blocks; a pair that shares several groups is compared in
the first of them alone.

Plan.  One pass makes sketches (no shuffle of texts).  Texts that take part in a pair are then joined to their pairs, dealt by
(first document, salt) with at most MEMBERS members a salt, and stream past the first document's words.

Cases.  Texts without words (null, empty, blank) are alone.  A null doc_id is alone, with class null.  Rows that share a doc_id are one
document.  Ties go to the lesser doc_id.  Extra columns are ignored whatever their names.  An empty table gives no rows.  Long
texts are compared whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, drop, in_arrow, partitions, small_batches
from .components import components
from .quality_net import BYTE, POWER, SPACE
from .token_files import in_parts

K, BANDS, SIMILARITY = 5, 64, 0.8
#: In short texts one edit touches most runs of K words, so pairs with a text of at most SHORT words get more sketches over runs of SHORT_K.
#: The other text of such a pair has at most SHORT / SIMILARITY words, so all texts up to there have them.
SHORT, SHORT_K, SHORT_BANDS = 50, 2, 32
TWICE = int(SHORT / SIMILARITY)
MEMBERS = 200
#: Counted cells of a text's words, those of a first, coarser comparison, the most that a cell counts, and members of a block in the second comparison.
CELLS, COARSE, CELL_MOST, BLOCK = 512, 64, 15, 500

_RNG = np.random.default_rng(20_240_202)
SCALE = _RNG.integers(1, 1 << 63, BANDS, np.uint64) | np.uint64(1)
SHIFT = _RNG.integers(1, 1 << 63, BANDS, np.uint64)
#: Places in a run of texts are told apart by so many bits; a longer text takes as many as it needs.
PLACE_BITS = 20


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where each text's words begin (with the end)."""
    raw = [x.encode("utf-8", "surrogatepass") + b"\n" for x in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    inside = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    where = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
    if not len(starts):
        return np.zeros(0, np.uint64), where
    at = np.flatnonzero(inside)
    first = np.cumsum(ends - starts) - (ends - starts)
    spot = at - np.repeat(starts, ends - starts)
    low = np.add.reduceat(BYTE[data[at]].astype(np.uint64) * (POWER[spot & 63].astype(np.uint64) << np.uint64(20)), first, dtype=np.uint64)
    return _mix(low + (ends - starts).astype(np.uint64)), where


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def cells(words: np.ndarray, where: np.ndarray) -> np.ndarray:
    """How many words of each text fall in each of CELLS cells, two cells a byte, cut off at CELL_MOST (which brings two texts only nearer)."""
    n = np.diff(where)
    spot = np.repeat(np.arange(len(n)), n) * CELLS + (words % np.uint64(CELLS)).astype(np.int64)
    counts = np.minimum(np.bincount(spot, minlength=len(n) * CELLS), CELL_MOST).astype(np.uint8).reshape(-1, CELLS // 2, 2)
    return counts[:, :, 0] << 4 | counts[:, :, 1]


def counted(packed: np.ndarray) -> np.ndarray:
    """cells() with a byte for each cell."""
    return np.stack((packed >> 4, packed & 15), 2).reshape(len(packed), CELLS)


def sketches(texts: list[str], k: int = K, found: tuple[np.ndarray, np.ndarray] | None = None, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, so many sketches over runs of k words) of each text.  found: the texts' word_hashes()."""
    words, where = found or word_hashes(texts)
    n = np.diff(where)
    out = np.zeros((len(texts), bands), np.int64)
    full = np.flatnonzero(n)
    if not len(full):
        return n, out
    # Runs of k words; a shorter text is one run.
    run = words.copy()
    for d in range(1, k):
        more = np.zeros_like(words)
        more[: len(words) - d] = words[d:]
        size = np.repeat(n, n) - (np.arange(len(words)) - np.repeat(where[:-1], n))
        run = _mix(run * np.uint64(31) + np.where(size > d, more, np.uint64(7)))
    items = np.maximum(n[full] - k + 1, 1)
    head = np.cumsum(items) - items
    at = np.arange(items.sum()) - np.repeat(head, items)
    run = run[np.repeat(where[full], items) + at]
    # The label of an occurrence: how many equal runs of the text come before.
    owner = np.repeat(np.arange(len(full)), items)
    order = np.lexsort((at, run, owner))
    same = np.concatenate(([False], (run[order][1:] == run[order][:-1]) & (owner[order][1:] == owner[order][:-1])))
    if same.any():
        nth = np.arange(len(run)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(run))))
        label = np.zeros(len(run), np.uint64)
        label[order] = nth.astype(np.uint64)
        run = np.where(label > 0, _mix(run + label * np.uint64(0xD6E8FEB86659FD93)), run)
    bits = max(PLACE_BITS, int(items.max()).bit_length())
    place = at.astype(np.uint64)
    low, most = np.uint64((1 << bits) - 1), np.uint64(0xFFFFFFFFFFFFFFFF)
    two = items >= 2
    for j in range(bands):
        v = (run ^ SHIFT[j]) * SCALE[j]
        v = ((v ^ (v >> np.uint64(31))) & ~low) | place
        a = np.minimum.reduceat(v, head)
        v[head + (a & low).astype(np.int64)] = most
        b = np.where(two, np.minimum.reduceat(v, head), a)
        a, b = head + (a & low).astype(np.int64), head + (b & low).astype(np.int64)
        x, y = run[np.minimum(a, b)], run[np.maximum(a, b)]  # in the order of the text
        out[full, j] = _mix(_mix(x + np.uint64(j)) * np.uint64(3) + y).view(np.int64)
    return n, out


def distance_within(a: list[str], b: list[str], most: int) -> int | None:
    """The edit distance of two sequences if it is at most `most`, from the cells within `most` of the diagonal.

    Column j holds rows j - most to j + most as bits, so each column stands one row lower than the one before; the value on the
    lowest diagonal is followed down to the last row, and then along that row."""
    if len(a) < len(b):
        a, b = b, a
    lo, top = 0, min(len(a), len(b))
    while lo < top and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < top - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    m, n = len(a), len(b)
    if m - n > most:
        return None
    if not n:
        return m
    most = min(most, m)
    found: dict[str, int] = {}
    for i, w in enumerate(a):
        found[w] = found.get(w, 0) | 1 << (i + most)
    mask = (1 << (2 * most + 1)) - 1
    up, down = mask >> most << most, 0  # cells that are one more, or one less, than the cell above
    value, last, end = most, 1 << (2 * most), m - most
    for j, w in enumerate(b):
        x = found.get(w, 0) >> j & mask
        diagonal = ((((x & up) + up) ^ up) | x | down) & mask
        right_up = (down | (mask ^ (diagonal | up))) & mask
        right_down = diagonal & up
        if j < end:
            value += not diagonal & last
            if value > 2 * most + n - m:
                return None
        else:
            last >>= 1
            value += (right_up & last > 0) - (right_down & last > 0)
        up = (right_down | (mask ^ ((diagonal >> 1) | right_up))) & mask
        down = (diagonal >> 1) & right_up
    return value if value <= most else None


def near(a: list[str], b: list[str], similarity: float = SIMILARITY) -> bool:
    size = max(len(a), len(b))
    most = int(size * (1 - similarity) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if sum((Counter(a) & Counter(b)).values()) < size - most:
        return False
    return distance_within(a, b, most) is not None


def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2 (two hashes of the text), n_words, bands, cells; without null doc_ids."""
    small_batches(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bands, counts = [], [], []
            for some in in_parts([x or "" for x in batch.column(3).to_pylist()], 1_000_000):
                found = word_hashes(some)
                n, own = sketches(some, found=found)
                counts += [x.tobytes() for x in cells(*found)]
                short = np.flatnonzero((n > 0) & (n <= TWICE))
                more = dict(zip(short.tolist(), sketches([some[i] for i in short], SHORT_K, bands=SHORT_BANDS)[1], strict=True)) if len(short) else {}
                sizes.append(n)
                bands += [np.concatenate((x, more[i])) if i in more else x for i, x in enumerate(own)]
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in bands]))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n.astype(np.int32)), bands, pa.array(counts, pa.binary())], names=["doc_id", "t1", "t2", "n_words", "bands", "cells"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text").where("doc_id is not null")
    return in_arrow(rows, step, "doc_id long, t1 long, t2 long, n_words int, bands array<long>, cells binary")


def shared_groups(copies: DataFrame) -> DataFrame:
    """doc_id, j, s and first: the members of every band's group of two documents or more, and the group's least doc_id."""
    each = copies.select("doc_id", F.posexplode("bands").alias("j", "s"))
    head = each.groupBy("j", "s").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("j").alias("j2"), F.col("s").alias("s2"), "first")
    head = cut(head, "groups")  # a written side lets Spark split a hot group's rows
    return cut(each.join(head, (F.col("j") == F.col("j2")) & (F.col("s") == F.col("s2"))).select("doc_id", "j", "s", "first"), "shared")


def candidates(shared: DataFrame) -> DataFrame:
    """member and first: every document of a group with the group's least doc_id, once."""
    return shared.where("doc_id <> first").select(F.col("doc_id").alias("member"), "first").distinct()


def may_be_near(counts: np.ndarray, sizes: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Which texts (a row of counted cells and a number of words each) the bound leaves within reach of one text of n words."""
    most = (np.maximum(sizes, n) * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    apart = counts.astype(np.int16) - own
    return (np.abs(apart).sum(1, dtype=np.int64) + np.abs(apart.sum(1, dtype=np.int64)) <= 2 * most) & (np.abs(sizes - n) <= most)


def coarser(counts: np.ndarray) -> np.ndarray:
    """Sums of neighbouring cells, for which the bound holds as well."""
    return counts.reshape(len(counts), COARSE, -1).sum(2, dtype=np.int16)


def others(shared: DataFrame, copies: DataFrame, roots: DataFrame) -> DataFrame:
    """member and first: the pairs of a group whose texts are in different classes so far and may be near, once.

    shared: the groups; copies: doc_id, n_words, cells; roots: node and root.  Groups are found by rows of a few numbers; cells join those rows of documents
    that stand in a mixed group alone."""
    each = shared.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("class"), "j", "s")
    mixed = each.groupBy("j", "s").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    mixed = cut(mixed.where("lo <> hi").select(F.col("j").alias("j2"), F.col("s").alias("s2"), "blocks"), "mixed")
    members = cut(each.join(mixed, (F.col("j") == F.col("j2")) & (F.col("s") == F.col("s2"))).select("doc_id", "class", "j", "s", "blocks"), "members")
    # Of a document: its mixed groups, in order.  Two that share one have a pair there, unless they share one before it.
    groups = members.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("j", "s"))).alias("groups"))  # at most BANDS + SHORT_BANDS
    known = copies.select(F.col("doc_id").alias("d"), "n_words", "cells").join(groups, F.col("d") == F.col("doc_id")).select("d", "n_words", "cells", "groups")
    met = members.join(known, F.col("doc_id") == F.col("d"))
    met = met.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    earlier = F.transform(F.filter("groups", lambda g: g["j"] < F.col("j")), lambda g: F.xxhash64(g["s"], g["j"]))
    met = met.select("j", "s", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), (F.col("block") > F.col("with")).cast("int").alias("role"), "doc_id", "class", "n_words", "cells", earlier.alias("earlier"))
    met = met.repartition(partitions(copies.sparkSession), "j", "s", "a", "b").sortWithinPartitions("j", "s", "a", "b", "role")

    def pairs(a: int, b: int, group: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        role, doc, root, n = (np.array([x[i] for x in group], np.int64) for i in range(4))
        none = np.zeros(0, np.int64)
        if len(set(root.tolist())) < 2:
            return none, none
        counts = counted(np.frombuffer(b"".join(x[4] for x in group), np.uint8).reshape(len(group), -1))
        coarse = coarser(counts)
        # Groups before this one, named by numbers from 0: which of two texts share one.
        size = [len(x[5]) for x in group]
        names, which = np.unique(np.array([g for x in group for g in x[5]], np.int64), return_inverse=True)
        before = np.zeros((len(group), len(names)), bool)
        before[np.repeat(np.arange(len(group)), size), which] = True
        left = np.flatnonzero(role == 0) if a < b else np.arange(len(doc))
        begin = len(left)  # the other block's members follow
        us, vs = [none], [none]
        for i in left.tolist():
            k = begin if a < b else i + 1
            hit = np.flatnonzero((root[k:] != root[i]) & may_be_near(coarse[k:], n[k:], coarse[i], n[i])) + k
            hit = hit[~(before[hit] & before[i]).any(1)]
            hit = hit[may_be_near(counts[hit], n[hit], counts[i].astype(np.int16), n[i])]
            us.append(np.maximum(doc[hit], doc[i]))
            vs.append(np.minimum(doc[hit], doc[i]))
        return np.concatenate(us), np.concatenate(vs)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def solved() -> Iterator[pa.RecordBatch]:
            u, v = pairs(*key[2:], group)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["member", "first"])

        for batch in batches:
            for j, s, a, b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (j, s, a, b) != key:
                    if group:
                        yield from solved()
                    key, group = (j, s, a, b), []
                group.append(row)
        if group:
            yield from solved()

    return in_arrow(met, step, "member long, first long")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """u and v: the pairs whose texts are near.  pairs: member, first; it is read twice."""
    sizes = cut(pairs.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("salts")), "sizes")
    heads = sizes.select(F.col("first").alias("id"), "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    large = sizes.where("salts > 1").select(F.col("first").alias("f2"), "salts")
    salted = pairs.join(large, F.col("first") == F.col("f2"), "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    members = salted.select(F.col("member").alias("id"), "first", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), "text").where("d is not null")
    rows = heads.union(members).join(texts, F.col("id") == F.col("d")).select("first", "salt", "role", "id", "text")
    rows = rows.repartition(partitions(docs.sparkSession), "first", "salt").sortWithinPartitions("first", "salt", "role", "id")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for batch in batches:
            u, v = [], []
            for first, salt, role, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (first, salt) != key:
                    key, heads = (first, salt), []
                words = (text or "").split()
                if not role:
                    heads.append(words)
                elif any(near(words, h) for h in heads):
                    u.append(doc)
                    v.append(first)
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return in_arrow(rows, step, "u long, v long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every row."""
    table = cut(sketch_table(docs).where("n_words > 0").withColumn("at", F.monotonically_increasing_id()), "sketches")
    # Of equal texts the row with the least doc_id, the first of those that share it, by rows of a few numbers.
    slim = table.select("at", "doc_id", "t1", "t2")
    several = slim.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("t1").alias("a"), F.col("t2").alias("b"), "first")
    twins = cut(slim.join(cut(several, "several"), (F.col("t1") == F.col("a")) & (F.col("t2") == F.col("b"))).select("at", "doc_id", "first", "t1", "t2"), "twins")
    chosen = twins.where("doc_id = first").groupBy("t1", "t2").agg(F.min("at").alias("one")).select("one")
    gone = cut(twins.select(F.col("at").alias("gone")).join(chosen, F.col("gone") == F.col("one"), "left_anti"), "gone")
    copies = cut(table.join(gone, F.col("at") == F.col("gone"), "left_anti").select("doc_id", "n_words", "bands", "cells"), "copies")
    drop(table)
    shared = shared_groups(copies)
    pairs = cut(candidates(shared), "pairs")
    exact = twins.where("doc_id <> first").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    roots = cut(components(verified(docs, pairs).union(exact)), "roots")
    rest = cut(others(shared, copies, roots), "others")
    roots = components(verified(docs, rest).union(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return own.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))


def kept(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least doc_id, with its own columns."""
    gone = classes(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
