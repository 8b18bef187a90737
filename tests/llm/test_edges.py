"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

from __future__ import annotations

import hashlib
import itertools
import json
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

pytest.importorskip("strandline.llm")
from strandline.llm import common, lang_spans, length_buckets, media_chunks, order_minhash, quality_net, samples, suffix_dedup, tag_paths, template_leaks, token_files, url_lists

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
#: Columns whose names the operators use inside.
def clash():
    return {c: F.lit(7) for c in "h d a b c k n w part row start end score __score __text first node root t1 t2 u v bands copies hot data did item_id bucket_len n_tokens lang_x __host key at_".split()}


SENTENCE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river "


def docs(spark, rows=None):
    if rows is None:
        rows = [(1, SENTENCE * 4), (2, SENTENCE * 4), (2, SENTENCE * 4), (3, None), (4, ""), (None, "short text"), (None, "short text"), (5, " \n\t "), (6, "word " * 40_000), (7, "ünï çødé 🙂 " * 30), (8, "x" * 5000), (9, SENTENCE * 4 + "with one more word")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({**clash(), "lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("long")})


def none(spark):
    return docs(spark, [])


def payload(x):
    raw = (x or "").encode()
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def key(r):
    return tuple((x is None, x) for x in r)


def brute_spans(texts):
    raw = [(x or "").encode() for x in texts]
    seen, twice = set(), set()
    for x in raw:
        for i in range(len(x) - 199):
            w = x[i : i + 200]
            (twice if w in seen else seen).add(w)
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 199):
            if x[i : i + 200] in twice:
                gone[i : i + 200] = True
        rest = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((len(x), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "most"), [(4096, 200_000), (1, 200_000), (4096, 1), (3, 1), (0, 200_000)])
def test_suffix_dedup(spark, monkeypatch, hot, most):
    """hot: groups are parted, and windows of crowds counted; most: groups are ordered on files."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PASS_SUFFIXES", most)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    rng = np.random.default_rng(8)
    passage = "a passage of some length that very many documents go on from in ways of their own, since it is what stands before every text of this kind and " * 2
    more = [(100 + i, passage[:188] + "".join(rng.choice(list("xyz"), 4)) + f" and on from {i % 5}") for i in range(40)]
    own = docs(spark).unionByName(docs(spark, more))
    rows = [(r.doc_id, r.text) for r in own.collect()]
    got = suffix_dedup.removed_rows(own).collect()
    want = [(i, *x) for (i, _), x in zip(rows, brute_spans([t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = {r.doc_id: r.kept_text for r in suffix_dedup.dedup(own, ["lang"]).collect()}
    assert kept[3] is None and kept[4] == "" and kept[1] == "" and kept[7] == ""
    assert suffix_dedup.removed_rows(none(spark)).count() == 0


def test_suffix_dedup_of_whole_tables(spark, sf):
    own = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in own.collect()]
    want = [(i, *x) for (i, _), x in zip(rows, brute_spans([t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, suffix_dedup.removed_rows(own).collect()), key=key) == sorted(want, key=key) and any(x[2] for x in want)


def test_suffix_order_from_files(tmp_path, monkeypatch):
    """As in memory, whatever fits in memory at once."""
    rng = np.random.default_rng(2)
    for case in range(60):
        monkeypatch.setattr(suffix_dedup, "CHUNK", int(rng.integers(1, 9)))
        size = rng.integers(1, 16, rng.integers(1, 30))
        first = np.cumsum(size) - size
        symbols = rng.integers(0, 3, size.sum()).astype(np.uint64)
        files = suffix_dedup._Columns(f"file://{tmp_path}/{case}")
        for j in range(1, size.max() + 1):
            with files.writer(f"column-{j}") as f:
                f.write(symbols[(first + size)[size >= j] - j].tobytes())
        got = suffix_dedup.order_from_files(files, size)
        want = suffix_dedup.order_suffixes(symbols, first, size, np.zeros(len(size), np.int64))
        text = lambda o: [symbols[first[d] + size[d] - k : first[d] + size[d]].tolist() for d, k in zip(o[0], o[1], strict=True)]  # noqa: B023, E731
        assert text(got) == text(want) and got[3].tolist() == want[3].tolist() and sorted(zip(got[0], got[1], strict=True)) == sorted(zip(want[0], want[1], strict=True))
        place = {(d, k): i for i, (d, k) in enumerate(zip(got[0].tolist(), got[1].tolist(), strict=True))}
        assert got[2].tolist() == [place.get((d, k - 1), -1) for d, k in zip(got[0].tolist(), got[1].tolist(), strict=True)]
        files.close()


def test_repeated_windows_by_bytes(monkeypatch):
    """If names were too few, the bytes would tell."""
    rng = np.random.default_rng(9)
    base = bytes(rng.integers(97, 123, 400).astype(np.uint8))
    pieces = [base[:230], base[10:240], bytes(rng.integers(97, 123, 230).astype(np.uint8)), base[20:220]]
    windows = [len(p) - 199 for p in pieces]
    want = suffix_dedup.repeated_starts(pieces, windows, [1] * 4, np.zeros(4, np.int64))
    assert [w.sum() for w in want] == [21, 21, 0, 1]
    monkeypatch.setattr(suffix_dedup, "symbol_hashes", lambda data: np.zeros(len(data), np.uint64))
    assert all((a == b).all() for a, b in zip(want, suffix_dedup.repeated_starts(pieces, windows, [1] * 4, np.zeros(4, np.int64)), strict=True))


def test_suffix_order():
    rng = np.random.default_rng(1)
    for _ in range(60):
        size = rng.integers(1, 12, rng.integers(1, 9))
        first, group = np.cumsum(size) - size, np.sort(rng.integers(0, 3, len(size)))
        symbols = rng.integers(0, 3, size.sum()).astype(np.uint64)
        doc, left, tail, prefix = suffix_dedup.order_suffixes(symbols, first, size, group)
        texts = [(int(group[d]), symbols[first[d] + size[d] - k : first[d] + size[d]].tolist()) for d, k in zip(doc, left, strict=True)]
        assert texts == sorted(texts) and len(texts) == size.sum()
        place = {(d, k): i for i, (d, k) in enumerate(zip(doc.tolist(), left.tolist(), strict=True))}
        for i, (d, k) in enumerate(zip(doc.tolist(), left.tolist(), strict=True)):
            assert tail[i] == (place[d, k - 1] if k > 1 else -1)
            if i:
                a, b = texts[i - 1], texts[i]
                n = 0
                while a[0] == b[0] and n < min(len(a[1]), len(b[1])) and a[1][n] == b[1][n]:
                    n += 1
                assert prefix[i] == n


def test_languages(spark):
    rows = [(i, (SENTENCE if i % 2 else "der schnelle braune fuchs springt über den faulen hund und die weisen eulen ") * 3) for i in range(40)]
    train = spark.createDataFrame(rows, "doc_id long, text string").withColumns({**clash(), "lang": F.when(F.col("doc_id") % 2 == 0, "de").otherwise("en")})
    model = lang_spans.fit(train)
    text = SENTENCE * 2 + "der schnelle braune fuchs springt über den faulen hund und die weisen eulen "
    r = lang_spans.label(docs(spark, [(1, text), (2, None), (3, "123 !?"), (4, "")]), model).collect()
    by = {x.doc_id: x for x in r}
    assert [s.lang for s in by[1].spans] == ["en", "de"] and by[1].lang_pred == "en" and 0 < by[1].score < 1
    assert "".join(text[s.start : s.end] for s in by[1].spans).replace(" ", "") == text.replace(" ", "")
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 4))
    odd = [(1, "\ue000\uf8ff"), (2, "\U000e0100"), (3, "\U000f0000 \U0010fffd"), (4, "\U0001f642 \u0301"), (5, "\U00020000\U0002a700"), (6, "\U00031350")]
    assert {x.doc_id: x.lang_pred == "und" for x in lang_spans.label(docs(spark, odd), model).collect()} == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False}
    assert lang_spans.language_rows(docs(spark)).count() == 12 and lang_spans.language_rows(none(spark)).count() == 0
    nolabel = docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {x.lang_pred for x in lang_spans.language_rows(nolabel).collect()} == {"und"}


def test_viterbi_is_best():
    m = lang_spans.Model([("en", SENTENCE * 5), ("de", "der schnelle braune fuchs springt über den faulen hund " * 5), ("ru", "быстрая бурая лиса прыгает через ленивую собаку " * 5)])
    rng = np.random.default_rng(2)
    pieces = SENTENCE.split() + "der schnelle braune fuchs springt über den faulen hund".split() + "быстрая бурая лиса".split()
    texts = [" ".join(rng.choice(pieces, rng.integers(1, 40))) for _ in range(60)] + [SENTENCE + "der schnelle braune fuchs springt über den faulen hund " * 2 + SENTENCE]
    got = m.label(texts)
    for text, (_, _, spans) in zip(texts, got, strict=True):
        w = lang_spans.Words([text])
        e = m.scores(w)
        best = e[0].copy()
        for row in e[1:]:
            best = np.maximum(best, best.max() - lang_spans.PENALTY) + row
        label = np.zeros(len(e), int)
        for a, b, k in spans:
            label[(w.start >= a) & (w.end <= b)] = m.langs.index(k)
        assert abs(e[np.arange(len(e)), label].sum() - lang_spans.PENALTY * (np.diff(label) != 0).sum() - best.max()) < 1e-6


def test_packing(spark):
    out = length_buckets.packed(docs(spark), TOKENIZER).collect()
    assert len(out) == 12 and all(r.n_tokens >= 1 and r.padding >= 0 for r in out)
    batches: dict = {}
    for r in out:
        batches.setdefault((r.bucket_len, r.batch), []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in batches.values())
    assert all(len(s) == 1 or len(s) * k[0] <= length_buckets.BUDGET for k, s in batches.items())
    assert length_buckets.packed(none(spark), TOKENIZER).count() == 0
    # Lengths of any size are told apart; rows without doc_id, and those that share one, are all placed.
    sized = spark.createDataFrame([(None, 200_001)] * 3 + [(7, 200_002)] * 3 + [(8, 1)], "doc_id long, n_tokens long")
    got = length_buckets.pack(sized, buckets=3).collect()
    assert sorted((r.bucket_len, r.padding) for r in got) == [(1, 0)] + [(200_001, 0)] * 3 + [(200_002, 0)] * 3 and len({(r.bucket_len, r.batch, r.slot) for r in got}) == 7
    sized = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 97 + 1).alias("n_tokens"))
    got = length_buckets.pack(sized, buckets=4, budget=1000).collect()
    places: dict = {}
    for r in got:
        places.setdefault(r.bucket_len, []).append(r.batch * (1000 // r.bucket_len) + r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(places) == 4


def test_bounds_are_best():
    rng = np.random.default_rng(0)
    for _ in range(60):
        m, k = int(rng.integers(1, 8)), int(rng.integers(1, 5))
        sizes, counts = np.sort(rng.choice(np.arange(1, 60), m, replace=False)), rng.integers(1, 50, m)
        pad = lambda b: sum(c * (min(x for x in b if x >= s) - s) for s, c in zip(sizes, counts, strict=True))  # noqa: B023, E731
        got = length_buckets.bounds(sizes, counts, k)
        assert len(got) <= k and pad(got) == min(pad([*x, sizes[-1]]) for r in range(k) for x in itertools.combinations(sizes[:-1], min(r, m - 1)))


def test_near_copies(spark):
    got = {(r.doc_id, r.class_id) for r in order_minhash.classes(docs(spark)).collect()}
    assert {(1, 1), (2, 1), (9, 1), (3, 3), (4, 4), (5, 5), (None, None)} <= got
    assert order_minhash.classes(docs(spark)).count() == 12 and order_minhash.classes(none(spark)).count() == 0
    assert sorted((r.doc_id or 0) for r in order_minhash.kept(docs(spark)).collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8]


def test_near_copies_of_several_texts_of_one_id(spark):
    """Rows that share a doc_id are one document, whose texts all count."""
    words = SENTENCE.split()
    other = " ".join(f"other{i}" for i in range(30))
    rows = [(1, SENTENCE), (1, other), (2, SENTENCE), (3, other), (4, " ".join([*words[:-1], "creek"])), (5, other + " more")]
    assert {(r.doc_id, r.class_id) for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(i, 1) for i in range(1, 6)}


def test_near_copies_that_share_only_a_common_passage(spark):
    """Groups of a passage are led by a text that is near neither of two near copies."""
    rng = np.random.default_rng(3)
    rows, want = [], []
    for case in range(60):
        word = lambda: f"w{rng.integers(1 << 40)}"
        passage, own = [word() for _ in range(40)], [word() for _ in range(20)]
        changed = [word() if i in (0, 5, 10, 15) else w for i, w in enumerate(own)]
        rows += [(case * 100 + i, " ".join(passage + [word() for _ in range(20)])) for i in range(12)]
        rows += [(case * 100 + 50, " ".join(passage + own)), (case * 100 + 51, " ".join(passage + changed))]
        want.append((case * 100 + 51, case * 100 + 50))
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(d, got[d]) for d, _ in want] == want
    assert all(got[d] == d for d, _ in rows if d % 100 != 51)


def test_links_of_edited_texts(spark):
    """Pairs with a share of random words changed; all of them are near."""
    rng = np.random.default_rng(5)
    rows, cases = [], [(words, share) for words in (30, 60, 200, 1000) for share in (0.05, 0.1, 0.15) for _ in range(40)]
    for k, (words, share) in enumerate(cases):
        a = [f"w{x}" for x in rng.integers(0, 1 << 40, words)]
        b = list(a)
        for i in rng.choice(words, int(words * share), replace=False):
            b[i] = f"z{rng.integers(1 << 40)}"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for share in (0.05, 0.1, 0.15):
        linked = [got[2 * k + 1] == got[2 * k] for k, (_, s) in enumerate(cases) if s == share]
        assert np.mean(linked) >= (0.95 if share == 0.15 else 0.99)


def test_cells_bound_the_distance():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = [f"w{i}" for i in rng.integers(0, 40, rng.integers(1, 60))]
        b = [w for w in a if rng.random() > 0.1]
        b = [f"w{rng.integers(40)}" if rng.random() < 0.1 else w for w in b] + ["w1"] * int(rng.integers(0, 4))
        counts = order_minhash.counted(order_minhash.cells(*order_minhash.word_hashes([" ".join(a), " ".join(b)])))
        if order_minhash.near(a, b):
            for c in (counts.astype(np.int16), order_minhash.coarser(counts)):
                assert order_minhash.may_be_near(c[:1], np.array([len(a)]), c[1], len(b)).all()


def test_sketches_of_long_texts():
    """Places beyond 2 ** 20 count: a sketch is that of the two least items in the order of the text, by a plain computation."""
    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 40, 1_300_000)
    text = " ".join(map(str, words.tolist()))
    n, got = order_minhash.sketches([text])
    assert n[0] == len(words)
    hashes, _ = order_minhash.word_hashes([text])
    run = hashes.copy()
    for d in range(1, order_minhash.K):
        run = order_minhash._mix(run * np.uint64(31) + np.concatenate((hashes[d:], np.full(d, 7, np.uint64))))
    run = run[: len(words) - order_minhash.K + 1]
    for j in range(order_minhash.BANDS):
        v = (run ^ order_minhash.SHIFT[j]) * order_minhash.SCALE[j]
        i, k = np.sort(np.argsort(v ^ (v >> np.uint64(31)))[:2])
        assert got[0, j] == order_minhash._mix(order_minhash._mix(run[[i]] + np.uint64(j)) * np.uint64(3) + run[[k]]).view(np.int64)[0]


def test_short_texts_share_all_sketches(spark):
    """Any pair with a text of at most SHORT words has the sketches of short texts on both sides."""
    assert order_minhash.near(["w"] * 50, ["w"] * order_minhash.TWICE) and not order_minhash.near(["w"] * 50, ["w"] * (order_minhash.TWICE + 1))
    rows = [(n, " ".join(f"w{i}" for i in range(n))) for n in (1, 50, 51, order_minhash.TWICE, order_minhash.TWICE + 1)]
    got = {r.doc_id: len(r.bands) for r in order_minhash.sketch_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: order_minhash.BANDS + order_minhash.SHORT_BANDS * (n <= order_minhash.TWICE) for n, _ in rows}


def test_banded_alignment():
    import random

    rng = random.Random(1)
    for _ in range(500):
        a = [rng.choice("abcdef") for _ in range(rng.randint(0, 30))]
        b = [x for x in a if rng.random() > 0.1] + [rng.choice("abcdef") for _ in range(rng.randint(0, 3))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            was, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(was[j] + (x != y), was[j + 1] + 1, row[j] + 1))
        most = rng.randint(0, 10)
        assert order_minhash.distance_within(a, b, most) == (row[-1] if row[-1] <= most else None)


def test_components(spark):
    from strandline.llm.components import components

    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


def test_url_lists(spark):
    captures = spark.createDataFrame([(1, "http://a.b.com/x", 5), (1, "http://a.b.com/x", 5), (2, None, 5), (3, "nonsense", 5), (4, "https://u:p@C.B.com:80/", 25), (5, "http://a.b.com", None), (6, "http://b.com", 12)], "page_id long, url string, fetch_s long").withColumns(clash())
    entries = spark.createDataFrame([("l", "b.com", "block", "add", 1), ("l", "b.com", "block", "strike", 10), ("l", "b.com", "block", "add", 20), ("t", "a.b.com", "allow", "add", 2), ("l", None, "block", "add", 1)], "list string, key string, action string, change string, at long").withColumns({"extra": F.lit(1)})
    got = {(r.page_id, r.verdict, r.rule_key, r.n_active) for r in url_lists.judge(captures, entries).collect()}
    assert got == {(1, "allow", "a.b.com", 2), (2, "none", None, 0), (3, "none", None, 0), (4, "block", "b.com", 1), (5, "none", None, 0), (6, "none", None, 0)}
    assert url_lists.judge(captures, entries).count() == 7
    hosts = spark.createDataFrame([("http://10.0.0.1:8/x",), ("http://[2001:db8::1]:80/",), ("http://a.b.co/",)], "url string").select(url_lists.host_of(F.col("url")).alias("h"))
    assert [tuple(r) for r in hosts.select("h", F.array_join(url_lists.keys_of(F.col("h")), " ")).collect()] == [("10.0.0.1", "10.0.0.1"), ("[2001:db8::1]", "[2001:db8::1]"), ("a.b.co", "a.b.co b.co")]
    assert {r.verdict for r in url_lists.judge(captures, entries.limit(0)).collect()} == {"none"} and url_lists.judge(captures.limit(0), entries).count() == 0


def test_templates(spark):
    items = spark.createDataFrame([(1, "A train leaves from Paris at 5 pm with Mary and travels 300 km in 4 hours while Mary drinks 2 cups of tea"), (2, None), (3, "short one")], "item_id long, text string").withColumns({"doc_id": F.lit(1)})
    rows = [
        (1, "Intro. Hello. A train leaves from Paris at 5 pm with Mary and travels 300 km in 4 hours while Mary drinks 2 cups of tea. End"),
        (2, "so a train leaves from London at 7 pm with Joe and travels 1,250.5 km in 9 hours while Joe drinks 3 cups of tea"),
        (3, "so a train leaves from London at 7 pm with Joe and travels 1,250.5 km in 9 hours while Ann drinks 3 cups of tea"),
        (4, None), (None, ""), (5, "5 km " * 3000), (6, SENTENCE),
    ]
    own = docs(spark, [*rows, rows[1]])
    got = sorted(((r.doc_id or 0, r.n_items, r.item_id, r.n_changed) for r in template_leaks.leaks(own, items).collect()), key=str)
    assert got == sorted([(1, 1, 1, 0), (2, 1, 1, 6), (2, 1, 1, 6), (3, 0, None, None), (4, 0, None, None), (0, 0, None, None), (5, 0, None, None), (6, 0, None, None)], key=str)
    assert sorted(r.doc_id or 0 for r in template_leaks.clean(own, items).collect()) == [0, 3, 4, 5, 6]
    assert template_leaks.leaks(none(spark), items).count() == 0 and template_leaks.leaks(own, items.limit(0)).where("n_items > 0").count() == 0


PAGE = """<html><head><title>T</title></head><body><header><a href=/>Home page of the site.</a></header><nav class="main menu"><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div id="cookie-notice">We use cookies, and more cookies, to serve you better.</div><div class="content"><h1>A &amp; B</h1><p>First   paragraph, with <b>bold</b> text, and more&nbsp;of it.<p>Second one; it is
long enough to matter, surely.</p><ul><li>item one, of a list</li><li>item two</li></ul><aside>Related: other things, here.</aside><table><tr><td>cell a<td>cell b</table></div>
<div class="comments"><p>A reader says: this is long, and has marks, and more.</p></div><form><label>Mail</label><input></form><script>var x = "<p>no</p>";</script><footer>&copy; 2024, all rights.</footer></body></html>"""


def test_templates_of_short_and_number_heavy_items(spark):
    """Copies are found at every place of the tiles."""
    texts = {1: "why do owls sleep all day", 2: "where do seven wise owls sleep", 3: "what makes rivers bend", 4: "why is the sky over the sea so blue at noon", 5: "add 1 2 3 4 then 5 6 7 8 then 9 10 11 12 and stop"}
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    copies = texts | {4: texts[4].removesuffix("noon") + "dusk"}
    rows = [(100 * k + lead, "filler " * lead + x + " and so on" * 3) for k, x in copies.items() for lead in range(6)]
    got = {r.doc_id: r.item_id for r in template_leaks.leaks(spark.createDataFrame([*rows, (0, "nothing to see here " * 9)], "doc_id long, text string"), items).collect()}
    assert got == {d: d // 100 for d, _ in rows} | {0: None}


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>cut off <b>te"), (5, "u", "no markup at all"), (5, "u", "no markup at all"), (None, "u", "<<<>>> & < >"), (6, "u", "<article>" + "<p>Some text, here.</p>" * 5000 + "</article>")]
    own = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(1)})
    got = {r.page_id: r for r in tag_paths.extract(own).collect()}
    assert got[1].text == "A & B First paragraph, with bold text, and more of it. Second one; it is long enough to matter, surely. item one, of a list item two cell a cell b"
    assert got[2].text == "" and got[3].n_chars == 0 and got[4].text == "cut off te" and got[5].text == "no markup at all"
    assert got[6].text == " ".join(["Some text, here."] * 5000) and tag_paths.extract(own).count() == 8 and tag_paths.extract(own.limit(0)).count() == 0


PROSE = "It is a sentence of some length, with marks; and it goes on for a while, as sentences in articles do."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<form id=aspnetForm><div><h1>Top</h1><p>{PROSE}</p><p>{PROSE} More.</p></div><button>Go</button></form>", f"Top {PROSE} {PROSE} More."),
        (f"<div class='widget article-body'><p>{PROSE}</p></div><div class='widget'>Follow us</div>", PROSE),
        (f"<title>A title - Site</title><header><a>Site</a><h1>A title</h1></header><main><p>{PROSE}</p></main>", f"A title {PROSE}"),
        (f"<header><h1>Site name</h1></header><main><h1>A title</h1><p>{PROSE}</p></main>", f"A title {PROSE}"),
        (f"<nav><a>x</a></nav><article><p>{PROSE}</p></article><div id=comments>{f'<p>{PROSE}</p>' * 9}</div>", PROSE),
        (f"<nav>{'<a>one, two.</a>' * 30}</nav><footer>All rights, reserved.</footer>", ""),
        (f"<div><h1>A title</h1><span>by me</span><div><p>{PROSE}</p><p>{PROSE}</p></div></div>", f"A title {PROSE} {PROSE}"),
        (f"<article><h1>A title</h1><div><p>{PROSE}</p><p>{PROSE}</p></div><p>End.</p></article>", f"A title {PROSE} {PROSE} End."),
        (f"<p title='a > b' data-id=nav>{PROSE}<p x=\"<nav>\">{PROSE}", f"{PROSE} {PROSE}"),
        (f"<article><table><tr><td>a<table><tr><td>{PROSE}<td>b</table>c<td>d</table></article>", f"a {PROSE} b c d"),
        (f"<main><ul><li>a<ul><li>b<li>{PROSE}</ul><li>c</ul>", f"a b {PROSE} c"),
        (f"<main><dl><dt>a<dd><p>{PROSE}<dt>b</dl>", f"a {PROSE} b"),
        (f"3 < 4 and <5 <p>{PROSE}</p><!-- no --><![CDATA[x < y]]> <script>'</p>'</SCRIPT >end", f"3 < 4 and <5 {PROSE} x < y end"),
        (f"<p>{PROSE}</p><p><a href='unclosed>cut", f"{PROSE} cut"),
    ],
)
def test_pages(page, text):
    assert tag_paths.main_text(page) == text


def test_generated_pages():
    """Articles of random blocks among random boilerplate: all of the article, and nothing else."""
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(6, 25))).capitalize() + rng.choice([".", "!", "; and so on."])
    for _ in range(200):
        want, body = [], []
        for _ in range(rng.randint(3, 12)):
            kind = rng.choice(["p", "p", "p", "h2", "ul", "table", "blockquote", "div"])
            if kind in ("p", "blockquote", "div"):
                parts = [sentence() for _ in range(rng.randint(1, 5))]
                want += parts
                body.append(f"<{kind}>" + rng.choice([" ", "\n  "]).join(f"<b>{x}</b>" if rng.random() < 0.1 else x for x in parts) + (f"</{kind}>" if kind != "p" or rng.random() < 0.7 else ""))
            elif kind == "h2":
                want.append(word())
                body.append(f"<h2>{want[-1]}</h2>")
            else:
                cells = [sentence() for _ in range(3)]
                want += cells
                body.append("<ul>" + "".join(f"<li>{c}" for c in cells) + "</ul>" if kind == "ul" else "<table><tr>" + "".join(f"<td>{c}" for c in cells) + "</table>")
        junk = lambda: rng.choice([f"<div class='{rng.choice(['ad', 'site-banner', 'cookie-notice', 'sidebar', 'promo box'])}'><p>{sentence()}</p></div>", f"<nav><ul>{''.join(f'<li><a href=x>{word()}</a></li>' for _ in range(5))}</ul></nav>", f"<aside>{sentence()}</aside>", f"<form><label>{word()}</label><input></form>", f"<div id=comments><p>{sentence()}</p><p>{sentence()}</p></div>", "<script>if (a < b) x = '</p>';</script>", "<!-- <p>no</p> -->"])
        box = rng.choice(["article", "main", "div class='content'", "div id=story"])
        page = f"<html><head><title>x</title></head><body>{junk()}{junk()}<{box}>{''.join(body)}</{box.split()[0]}>{junk()}{junk()}<footer>{sentence()}</footer></body></html>"
        assert tag_paths.main_text(page) == " ".join(want)


@pytest.mark.parametrize("piece", ["<div>x", "<p>x, y. ", "<ul><li>x", "<b>x", "<a href=\"x", "<a b='", "<!--", "<![CDATA[", "<script>", "<table><tr><td>x", "</div>", "<", "<x ", "&amp", "<p class=\"a b\" "])
def test_pages_in_linear_time(piece):
    import time

    began = time.perf_counter()
    tag_paths.main_text(piece * (400_000 // len(piece)))
    assert time.perf_counter() - began < 5


def test_main_text_beside_the_container():
    lead = "".join(f"<p>Lead {i}, a shorter paragraph with some words, and more.</p>" for i in range(3))
    body = "".join(f"<p>Body {i}, {'a longer paragraph with many words, and then more of them. ' * 3}</p>" for i in range(6))
    text = tag_paths.main_text(f"<html><body><main><div class='lead'>{lead}</div><div class='body'>{body}</div></main></body></html>")
    assert all(f"Lead {i}," in text for i in range(3)) and all(f"Body {i}," in text for i in range(6))


def test_quality(spark):
    rows = [(i, SENTENCE if i % 3 else "SPAM!! BUY!! NOW!! | $$$ | $$$ " * 5) for i in range(300)]
    own = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash())
    labels = own.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    got = quality_net.quality_rows(own, labels).collect()
    assert all(r.predicted == (1 if r.doc_id % 3 else 0) and 0 <= r.score <= 1 for r in got) and {r.held_out for r in got} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    few = quality_net.quality_rows(own, labels.where("doc_id < 8")).select("score").distinct().count()
    assert few > 1  # a handful of rows trains the network too
    # Context vectors are of all documents: a plain sum over words, neighbour by neighbour.
    sums, plain = quality_net.context_sums(own.limit(40).repartition(3)), quality_net.ContextSums()
    want = np.zeros_like(sums)
    for r in own.limit(40).collect():
        w, s, _ = quality_net.units([r.text])
        for i in range(len(w)):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if j != i:
                    for b in (w[i], quality_net.WORDS + s[i]):
                        want[b] += plain.words[w[j]].astype(int) + plain.shapes[s[j]]
    assert (sums == want).all()
    repeated = own.union(own.where("doc_id = 1")).union(own.where("doc_id = 1"))
    assert len(samples.labelled_texts(repeated, labels, "quality", 10, 10**6)) <= 40 and len(samples.labelled_texts(repeated.where("doc_id = 1"), labels, "quality", 1000, 10**6)) == 1
    model = quality_net.fit(own, labels)
    assert quality_net.score(docs(spark).drop("score"), model).where("score is null or score < 0 or score > 1").count() == 0
    assert quality_net.quality_rows(docs(spark), labels.limit(0)).select("score").distinct().count() == 1
    assert quality_net.quality_rows(none(spark), labels).count() == 0
    assert quality_net.kept(own, labels).columns == own.columns and quality_net.kept(own, labels).count() == 200


def plain_form(data):
    """The chunk list of a payload, byte by byte."""
    ends, last, h = [], 0, 0
    for i, b in enumerate(data, 1):
        h = (h * 2 + int(media_chunks.GEAR[b])) % (1 << 32)
        if i - last == media_chunks.MOST or i - last >= media_chunks.LEAST and h % (1 << media_chunks.BITS) == 0 or i == len(data):
            ends.append(i)
            last = i
    return b"CDC1" + len(data).to_bytes(8, "little") + len(ends).to_bytes(4, "little") + b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() + (b - a).to_bytes(4, "little") for a, b in zip([0, *ends], ends, strict=False))


def plain_feature(data):
    n = [data.count(bytes([b])) for b in range(256)]
    mean = sum(b * k for b, k in enumerate(n)) / len(data)
    dev = (sum((b - mean) ** 2 * k for b, k in enumerate(n)) / len(data)) ** 0.5
    bits = -sum(k / len(data) * np.log2(k / len(data)) for k in n if k)
    return [mean, dev, max(0.0, bits), sum(k > 0 for k in n)]


def test_media(spark):
    own = docs(spark).repartition(3)
    rows = media_chunks.media_rows(own).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows), key=key)
    want = [(r.doc_id, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(plain_form(p)), hashlib.sha256(plain_form(p)).hexdigest()) for r in own.collect() for p, n in [payload(r.text)]]
    assert got == sorted(want, key=key) and media_chunks.media_rows(none(spark)).count() == 0
    plain = {hashlib.sha256(p).hexdigest(): plain_feature(p) for r in own.collect() for p, _ in [payload(r.text)]}
    for r in rows:
        assert np.allclose([float(x.split("=")[1]) for x in r.feature.split()], plain[r.payload_sha256], atol=2e-3)
    # Each different chunk is stored once, whatever partitions hold it.
    folder = common.new_folder(spark, "media")
    lists, places = media_chunks.store(own, folder)
    chunks = {f[i : i + 16] for r in lists.collect() for f in [bytes(r.form)] for i in range(16, len(f), 20)}
    assert sorted(bytes(r.digest) for r in places.collect()) == sorted(chunks)
    data = np.random.default_rng(3).integers(0, 256, 200_000).astype(np.uint8).tobytes()
    ends = media_chunks.cuts([data, data[1000:], b"\0" * 64])
    assert ends[0][-1] == len(data) and ends[2] == [64] and len({*ends[0]} & {e + 1000 for e in ends[1]}) > 0.9 * len(ends[1])


def test_token_files_deal_rows_of_one_id(spark, tmp_path):
    """Documents without an id, and those of one id, are dealt over the files; the index has all of them, at places without gaps."""
    texts = [f"word{i} " * (i % 9) + str(i) for i in range(3000)]
    own = spark.createDataFrame([(None if i < 1500 else 7 if i < 2900 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    files = token_files.write(own, f"file://{tmp_path}", TOKENIZER, seq_len=64)
    assert len(files) > 4 and max(f["n_docs"] for f in files) < 1500
    got = token_files.read_documents(spark, f"file://{tmp_path}", files).orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [None] * 1500 + [7] * 1400 + list(range(2900, 3000))
    encode = token_files.WordEncoder(TOKENIZER).tokenizer.encode
    want = sorted(zlib.crc32(np.array([*encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for t in texts)
    assert sorted(r.ids_crc32 for r in got) == want


def test_token_files(spark):
    from tokenizers import Tokenizer

    own = docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    tok, start = Tokenizer.from_file(TOKENIZER), 0
    got = {r.doc_id: r for r in token_files.token_rows(own, TOKENIZER, seq_len=64).collect()}
    for r in own.orderBy("doc_id").collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_rows(docs(spark), TOKENIZER).count() == 12 and token_files.token_rows(none(spark), TOKENIZER).count() == 0


LETTERS = st.text(st.sampled_from("aAbBzZéÉßİıΣσςﬁÅ\u0301\u0308\u0387ǅ0९½²_'’!?.,<>|-+=~\u0338 \t\n\r\u00a0\u2003\u200d日本한👍🏽") | st.characters(), max_size=40)


@pytest.fixture(scope="module")
def words():
    return token_files.WordEncoder(TOKENIZER)


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(LETTERS | st.lists(st.sampled_from(["it's", "we've", "'s", "x''ll", "<|endoftext|>", "<|endoftext|", "|>", "don't!", "a!'re", "3.14", "İ", "word..", "=\u0338"]), max_size=8).map(" ".join))
def test_words_as_whole_texts(words, text):
    assert words.parts
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(words.encode([text])[0], words.width).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    other = token_files.WordEncoder(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    texts = ["a  b", " lead", "it's\n\n  spaced", ""]
    assert not other.parts and [np.frombuffer(x, other.width).tolist() for x in other.encode(texts)] == [e.ids for e in other.tokenizer.encode_batch(texts, add_special_tokens=False)]
    config = json.loads(token_files.WordEncoder(TOKENIZER).tokenizer.to_str())
    assert token_files.parts_at_spaces(config)
    for change in ({"normalizer": {"type": "Prepend", "prepend": "x"}}, {"pre_tokenizer": None}, {"truncation": {"max_length": 3}}, {"added_tokens": [{**config["added_tokens"][0], "lstrip": True}]}, {"added_tokens": [{**config["added_tokens"][0], "content": "a b"}]}, {"added_tokens": [{**config["added_tokens"][0], "content": "word"}]}):
        assert not token_files.parts_at_spaces(config | change)


def test_random_access(spark, tmp_path):
    own = spark.createDataFrame([(i, SENTENCE * (i % 5)) for i in range(50)], "doc_id long, text string")
    files = token_files.write(own, f"file://{tmp_path}", TOKENIZER, seq_len=16)
    f = token_files.TokenFile(f"file://{tmp_path}/ids-{files[0]['part']:05d}.arrow")
    whole = f.ids(0, files[0]["n_ids"])
    ids, mask = f.sequence(1)
    assert ids.tolist() == whole[16:32].tolist() and all(mask.to_pylist()) and ids.base is not None


def test_held_out_languages(spark, sf):
    """Learned from the other documents alone, nearly all held-out ones are labelled as the table says."""
    own = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lang_spans.language_rows(own).where("held_out").join(own.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_held_out_quality(spark, sf):
    """Held-out rows of label 1 mostly score over those of label 0."""
    path = sf.replace("sf0.001", "sf0.01")
    own, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = quality_net.quality_rows(own, labels).where("held_out").join(labels, "doc_id").where("quality is not null").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 10 and len(bad) > 5 and np.mean([a > b for a in good for b in bad]) >= 0.9
