"""Packing by best-two-fit and spelling forms: against plain versions, on odd rows, ties, empty tables and whole small tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

pytest.importorskip("strandline.llm")
from strandline.llm import queries, spelling_forms, two_fit

from ..compare import assert_same, database
from .test_edges import TOKENIZER, clash, docs, none


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]


def packing_is_sound(rows, texts):
    """rows: of packed_rows(); texts: doc_id and text.  Every document is there whole, and sequences have no gaps."""
    rows = rows.assign(doc_id=rows.doc_id.fillna(-1))
    want = Counter()
    for (d, _), ids in zip(texts, ids_of([t for _, t in texts]), strict=True):
        for k, at in enumerate(range(0, len(ids), two_fit.SIZE)):
            part = ids[at : at + two_fit.SIZE]
            want[-1 if d is None else d, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(zip(rows.doc_id, rows.piece, rows.start, rows.length, rows.ids_crc32, strict=True)) == want
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]]
        assert g.length.sum() <= two_fit.SIZE


def first_fit_decreasing(lengths, size):
    gaps = []
    for x in sorted(lengths, reverse=True):
        k = next((i for i, g in enumerate(gaps) if g >= x), None)
        if k is None:
            gaps.append(size - x)
        else:
            gaps[k] -= x
    return len(gaps)


def test_packing_of_odd_rows(spark):
    own = docs(spark)
    rows = two_fit.packed_rows(own, TOKENIZER).toPandas()
    packing_is_sound(rows, [(r.doc_id, r.text) for r in own.select("doc_id", "text").collect()])
    assert two_fit.packed_rows(none(spark), TOKENIZER).count() == 0


def test_packing_of_a_table(spark, sf):
    own = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op11_two_fit(spark, sf).toPandas()
    packing_is_sound(rows, [(r.doc_id, r.text) for r in own.select("doc_id", "text").collect()])
    assert rows.sequence_id.nunique() <= min(first_fit_decreasing(rows.length, two_fit.SIZE), 1.02 * rows.length.sum() / two_fit.SIZE + 1)


def test_equal_lengths_are_dealt_over_sequences(spark):
    own = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one and the same text " * 20).alias("text")).repartition(16)
    rows = two_fit.packed_rows(own, TOKENIZER).toPandas()
    packing_is_sound(rows, [(i, "one and the same text " * 20) for i in range(3000)])
    length = rows.length.iloc[0]
    assert rows.sequence_id.nunique() == -(-3000 // (two_fit.SIZE // length))


def test_sequences_hold_the_ids(spark):
    own = docs(spark)
    packed = two_fit.placed(two_fit.pieces(own, TOKENIZER)).cache()
    got = two_fit.sequences(packed).collect()
    parts = {(r.sequence_id, r.offset): bytes(r.ids) for r in packed.collect()}
    assert sum(len(r.pieces) for r in got) == len(parts)
    for r in got:
        assert r.n_tokens * 4 == len(r.ids) <= 4 * two_fit.SIZE
        for p in r.pieces:
            assert bytes(r.ids)[4 * p.offset : 4 * (p.offset + p.length)] == parts[r.sequence_id, p.offset]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 60)), max_size=14))
def test_fillings_are_those_of_one_sequence_at_a_time(some):
    counts = np.zeros(41, np.int64)
    for x, n in some:
        counts[x] += n
    plans = []
    for exchange in (True, False):
        plain, free = [], counts.copy()
        while free.any():
            taken, _ = two_fit.filled(free, 40, exchange)
            for x, n in taken.items():
                free[x] -= n
            assert sum(x * n for x, n in taken.items()) <= 40
            plain.append(taken)
        plans.append(plain)
    assert [t for t, times in two_fit.fillings(counts) for _ in range(times)] == min(plans, key=len)
    assert min(map(len, plans)) <= first_fit_decreasing(np.repeat(np.arange(41), counts), 40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12), st.integers(0, 60))
def test_best_two(free, room):
    counts = np.bincount(free, minlength=100)
    pairs = [(min(a, b), max(a, b)) for i, a in enumerate(free) for b in free[i + 1 :] if a + b <= room]
    assert two_fit.best_two(counts, room) == max(pairs, key=lambda p: (p[0] + p[1], p[0]), default=(0, 0))


def test_two_smaller_pieces_take_a_smallest_one_s_place():
    counts = np.zeros(101, np.int64)
    counts[[60, 30, 25, 14]] = 1
    assert two_fit.filled(counts, 100)[0] == {60: 1, 25: 1, 14: 1}  # 60 and 30 leave 10; 25 and 14 fill 39 of 40
    assert two_fit.filled(counts, 100, exchange=False)[0] == {60: 1, 30: 1}


def brute_forms(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = defaultdict(set)
    for w in n:
        for v in n:
            if v != w and (sum(a != b for a, b in zip(w, v, strict=True)) == 1 if len(v) == len(w) else len(v) == len(w) + 1 and any(v[:i] + v[i + 1 :] == w for i in range(len(v)))):
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w, c in n.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * c else None
    out = set()
    for w, c in n.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, c, len(near[w]), n[form[w]] if form[w] else None))
    return out


def forms_of(df):
    return [tuple(r) for r in spelling_forms.forms(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]


WORDS = "colour color colours colouur colur aaaaa aaaaaa aaaaaaa aaaab straße strasse strase naïve naive naives ×÷×÷× ×÷×÷ ÉCOLE école ecole ÀÀÀÀÀ abcde abcdf abcdg bcdef".split()


def test_forms_of_odd_rows(spark):
    rows = [(i % 7 if i % 5 else None, " ".join(w for k, w in enumerate(WORDS) for _ in range(1 + (i * k) % 4)) + " 12 x-y_z") for i in range(12)]
    rows += [(20, None), (21, ""), (22, " \n"), (23, "z" * 3000), (24, "z" * 3000), (25, "z" * 3000), (25, "z" * 2999 + " " + "z" * 2999 + " Z" + "z" * 2998), (26, "zy" * 1500), (27, "zy" * 1500), (27, "zy" * 1500)]
    rows += [(1, "Colour COLOUR")] * 40 + [(30, "🙂colour🙂 ünïçø ünïçø ünïçö ünïçö ünïçö")] * 2
    own = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash())
    got = forms_of(own)
    assert len(got) == len(set(got))
    assert set(got) == brute_forms(rows)
    assert forms_of(none(spark)) == []
    assert forms_of(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")) == []


def test_ties_go_to_the_first_in_code_point_order(spark):
    rows = [(None, "abcdz " * 3 + "abcdé " * 9 + "abcdb " * 9 + "abcdc " * 9 + "abcd " * 9)]
    assert set(forms_of(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_forms(rows)


def test_chains_of_forms_end_in_a_root(spark):
    rows = [(1, " ".join(f"{'q' * k}wwwww" for k in range(9) for _ in range(3 * 2**k)))]
    got = {r[0]: r for r in forms_of(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert set(got.values()) == brute_forms(rows)
    assert len({r[2] for r in got.values()}) < len(got)


def test_slips_are_drawn_by_document(spark):
    rows = [(d, "mountain") for d in range(970)]
    got = forms_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(got) == brute_forms(rows)


def test_forms_are_those_of_sql(spark, sf):
    assert_same(queries.op12_spelling_forms(spark, sf).toPandas(), database(sf).execute(spelling_forms.ORACLE).df())


def test_collisions_give_no_links(spark, monkeypatch):
    """With keys of a few values, strings alone decide."""
    monkeypatch.setattr(spelling_forms, "MOST", 1)
    known = spelling_forms.words(spark.createDataFrame([(None, "house mouse hose horse nurse purse")], "doc_id long, text string"), least=4, most=1)
    true = {r.wid: (r.n_near, r.best) for r in spelling_forms.near(known).collect()}
    shared = spelling_forms.shared_keys

    def crowded(rows):
        return shared(rows).unionByName(rows.selectExpr("7L AS key", "wid", "explode(array(0, 1, -1, -2)) AS place"))

    monkeypatch.setattr(spelling_forms, "shared_keys", crowded)
    assert {r.wid: (r.n_near, r.best) for r in spelling_forms.near(known).collect()}.keys() >= true.keys()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=8), min_size=1, max_size=8, unique=True))
def test_near_words_share_exactly_one_key(own):
    key, place, word = spelling_forms.deletion_keys(own)
    kinds = defaultdict(list)
    for k, p, w in zip(key.tolist(), place.tolist(), word.tolist(), strict=True):
        kinds[k].append((0 if p >= 0 else 1 if p == -1 else 2, w))
    for i, a in enumerate(own):
        for j, b in enumerate(own):
            met = sum((0, i) in g and (0, j) in g or (1, i) in g and (2, j) in g or (2, i) in g and (1, j) in g for g in kinds.values())
            same = len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
            long, short = (a, b) if len(a) > len(b) else (b, a)
            inserted = len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))
            if i != j:
                assert met == (same or inserted)
