from __future__ import annotations

import pytest

pytest.importorskip("strandline.llm")
import __spark_entry__ as entry

from ..compare import assert_same, database

pipeline = pytest.importorskip("corpus_pipeline")


def test_oracles(spark, sf):
    db = database(sf)
    for name in ("op5_url_lists", "op6_template_leaks"):
        assert_same(entry.queries()[name](spark, sf).toPandas(), db.execute(entry.oracle_sql()[name]).df())


def test_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_stages(spark, sf):
    """Each stage against the plain meaning of what it does, on what the one before kept."""
    from strandline.llm import order_minhash, quality_net, template_leaks
    from strandline.llm.common import cut, table

    docs = table(spark, sf, "documents")
    kept = [docs]
    for name, f in pipeline.STAGES[:-1]:
        kept.append(cut(f(spark, kept[-1], sf), name))
        assert kept[-1].columns == pipeline.COLUMNS
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    scores = {r.doc_id: r.score for r in quality_net.quality_rows(docs, table(spark, sf, "labels")).collect()}
    assert ids[1] == {i for i, s in scores.items() if s >= 0.3}
    # Near copies: every pair is compared.
    texts = {r.doc_id: (r.text or "").split() for r in kept[1].collect()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(texts)
    for n, i in enumerate(order):
        for j in order[:n]:
            if texts[i] and abs(len(texts[i]) - len(texts[j])) <= 0.2 * max(len(texts[i]), len(texts[j])) and find(i) != find(j) and len(set(texts[i]) & set(texts[j])) > 0.3 * len(set(texts[i])) and order_minhash.near(texts[i], texts[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert ids[2] == {i for i in texts if find(i) == i}
    assert ids[3] == ids[2]
    before = {r.doc_id: r.text for r in kept[2].collect()}
    left = dict(zip(before, brute_left(list(before.values())), strict=True))
    assert {r.doc_id: (r.text, r.n_chars) for r in kept[3].collect()} == {i: (x, None if x is None else len(x)) for i, x in left.items()}
    leaked = {r.doc_id for r in template_leaks.leaks(kept[3], table(spark, sf, "benchmark")).where("n_items > 0").collect()}
    assert ids[4] == ids[3] - leaked
    out = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == ids[4]
    # Packed: lengths by the whole text's ids, places without gaps, and the least padding that 16 bounds allow.
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    sizes = {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in kept[4].collect()}
    assert {r.doc_id: r.n_tokens for r in out} == sizes
    bounds = sorted({r.bucket_len for r in out})
    assert all(r.bucket_len == min(b for b in bounds if b >= r.n_tokens) for r in out) and sum(r.padding for r in out) == least_padding(sorted(sizes.values()), 16)
    assert len({(r.bucket_len, r.batch, r.slot) for r in out}) == len(out)


def least_padding(sizes, buckets):
    """By trying every split of the sorted lengths, bucket after bucket."""
    values = sorted(set(sizes))
    best = {0: 0}
    for _ in range(min(buckets, len(values))):
        best = {j: min(best[i] + sum(values[j - 1] - s for s in sizes if (values[i - 1] if i else 0) < s <= values[j - 1]) for i in best if i < j) for j in range(1, len(values) + 1)} | {0: 0}
    return best[len(values)]


def brute_left(texts):
    raw = [(x or "").encode() for x in texts]
    seen, twice = set(), set()
    for x in raw:
        for i in range(len(x) - 199):
            w = x[i : i + 200]
            (twice if w in seen else seen).add(w)
    out = []
    for text, x in zip(texts, raw, strict=True):
        gone = bytearray(len(x))
        for i in range(len(x) - 199):
            if x[i : i + 200] in twice:
                gone[i : i + 200] = b"\1" * 200
        out.append(None if text is None else bytes(c for c, g in zip(x, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


ODD = [(1, "a plain text " * 60), (2, "a plain text " * 60), (2, "a plain text " * 60), (3, None), (4, ""), (None, "a text without an id"), (None, None), (5, " \n "), (6, "word " * 30_000), (7, "ünï çødé 🙂 " * 40)]


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows, and other columns with names that stages use."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    docs = docs.withColumns({c: F.lit("clash") for c in ("score", "class_id", "did", "h", "part", "row", "n_tokens", "kept_text", "__gone", "bucket_len")})
    labels = spark.createDataFrame([(None, 1, 0), (1, None, None), (3, 1, None), (99, 0, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    items = spark.createDataFrame([(1, None), (None, "short"), (2, "nothing like any of the texts that stand in these rows of the table here")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", items)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    stages = [docs]
    for name, f in pipeline.STAGES[:-1]:
        stages.append(f(spark, stages[-1], str(tmp_path)))
        assert stages[-1].columns == pipeline.COLUMNS, name
    assert stages[1].count() == len(ODD)
    assert sorted(r.doc_id or 0 for r in stages[2].collect()) == [0, 0, 1, 3, 4, 5, 6, 7]
    left = {r.doc_id or 0: (r.text, r.n_chars) for r in stages[3].where("doc_id is not null").collect()}
    assert left[3] == (None, None) and left[4] == ("", 0) and left[5] == (" \n ", 3) and left[6] == ("", 0) and stages[3].count() == 8
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 0, 1, 3, 4, 5, 6, 7] and len({(r.bucket_len, r.batch, r.slot) for r in out}) == 8


def test_empty_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    tables = {"documents": docs, "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([], "item_id long, text string")}
    for case, empty in (("docs", {"documents": docs.limit(0)}), ("others", {})):
        for name, table in (tables | empty).items():
            table.write.parquet(f"{tmp_path}/{case}/{name}.parquet")
        assert pipeline.run(spark, f"{tmp_path}/{case}").count() == (0 if case == "docs" else 8)
