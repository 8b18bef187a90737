"""Re-parameterised questions: names at a sentence's start, number words, lower-cased copies; and random mixtures against SQL that trusts no tile."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("strandline.llm")
from strandline.llm import template_leaks as T

from ..compare import assert_same

TALK = "we know that rice is good and people who want more of it pay for it at the market as how many of them have now is of no matter to any but them"
ASKED = [
    ("Sarah bought 5 kg of rice. Ali bought 3 kg of rice. Who paid more?", "Emma bought 9 kg of rice. Noah bought 2 kg of rice. Who paid more?", 4),
    ("Alice has three apples and gives two to Bob. Carol then buys 12 more apples at the market. David wants to know how many they have now.", "Maria has 47 apples and gives two to Bob. Petra then buys five more apples at the market. Oscar wants to know how many they have now.", 5),
    ('"Tom," said the man, "went to (Paris) for seven days. Anna stayed for twenty five days."', '"Jim," said the man, "went to (Rome) for 12 days. Lena stayed for thirty two days."', 6),
]


def found(spark, docs, items):
    rows = T.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {r.doc_id: (r.item_id, r.n_changed) for r in rows if r.n_items}


@pytest.mark.parametrize(("item", "other", "changed"), ASKED)
def test_other_names_and_numbers_are_found(spark, item, other, changed):
    docs = [(1, other), (2, TALK), (3, f"{TALK}. {other} {TALK}"), (4, item), (5, None), (6, "")]
    assert found(spark, docs, [(7, item), (8, None)]) == {1: (7, changed), 3: (7, changed), 4: (7, 0)}


def test_slots_must_be_consistent(spark):
    item = "Ali sold 4 boxes to Ben and then Ali sold 6 boxes to Ben at the end of the day."
    good = "Eva sold 1 boxes to Max and then Eva sold 2 boxes to Max at the end of the day."
    bad = "Eva sold 1 boxes to Max and then Ida sold 2 boxes to Max at the end of the day."
    assert found(spark, [(1, good), (2, bad), (3, TALK)], [(7, item)]) == {1: (7, 4)}


def test_common_words_at_a_sentence_s_start_are_ordinary(spark):
    """So copies in lower case are found, if they have no names."""
    item = "The rice is good. They pay for it at the market. How many of them want more of it now?"
    assert found(spark, [(1, item.lower()), (2, TALK + " they the how"), (3, item)], [(7, item)]) == {1: (7, 0), 3: (7, 0)}
    own = spark.createDataFrame([(f" {T.MAYBE}the the {T.MAYBE}bob {T.NUMBER}3 {T.MAYBE}a {T.MAYBE}a a ",), (f" {T.MAYBE}the the the cat cat ",)], "m string")
    assert T.common_words(own) == ["the"]  # a is rarer as an ordinary word, bob is none, cat never stands where a name might
    assert T.common_words(spark.createDataFrame([], "m string")) == [] and T.common_words(spark.createDataFrame([("  ",)], "m string")) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Sarah met Bob, Al. Tim", "M:sarah met N:bob N:al M:tim"),
        ("twenty five cats, One dog. Three-quarters", "#:twenty #:five cats N:one dog #:three quarters"),
        ("5 kg and seven Miles", "#:5 U:kg and #:seven N:miles"),
        ("1,000.5 km x2y (Berlin) O'Neil", "#:1,000.5 U:km x#:2 y M:berlin N:o M:neil"),
        ("Ärger\nÉcole", "M:ärger M:école"),
        ("", ""),
    ],
)
def test_drafts(spark, text, want):
    marks = str.maketrans({T.NAME: "N:", T.NUMBER: "#:", T.UNIT: "U:", T.MAYBE: "M:"})
    got = spark.createDataFrame([(text,)], "t string").select(T.drafted(F.col("t")).alias("m")).first().m
    assert got.translate(marks).split() == want.split()


def mixture(seed):
    """Documents made of pieces of items with other fillings, and items with many placeholders and of any length."""
    r = random.Random(seed)
    names, plain = "Ann Bob Cy Dan Eve Fay".split(), "has sold met saw the a to of and then box cart road now".split()

    def word():
        x = r.random()
        return r.choice(names) if x < 0.18 else str(r.randint(1, 30)) if x < 0.28 else r.choice(["two", "Nine", "kg", "The"]) if x < 0.4 else r.choice(plain)

    def text(n):
        return "".join(w + r.choice([" ", " ", " ", ". ", ", ", "\n", ' "']) for w in (word() for _ in range(n)))

    def other(x):
        fill = {n: r.choice(names) for n in names}
        return "".join(fill.get(w, w if r.random() < 0.97 else "odd") for w in __import__("re").split(r"(\W)", x))

    items = [(i, text(r.choice([2, 4, 5, 6, 8, 12, 14, 20, 40]))) for i in range(12)] + [(50, None), (51, "")]
    docs = []
    for d in range(40):
        parts = [text(r.randint(0, 12))]
        for _ in range(r.randint(0, 3)):
            words = items[r.randrange(12)][1]
            parts.append(other(words) if r.random() < 0.7 else words[r.randint(0, 9) :])
            parts.append(text(r.randint(0, 5)))
        docs.append((d, "".join(parts)))
    return [*docs, (90, None), (91, ""), (0, docs[0][1])], items


@pytest.mark.parametrize("seed", range(4))
def test_mixtures_are_as_sql_says(spark, seed):
    docs, items = mixture(seed)
    c = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        df = pd.DataFrame(rows, columns=[key, "text"])
        c.register(f"_{name}", df)
        c.execute(f"CREATE TABLE {name} AS SELECT {key}::BIGINT AS {key}, text FROM _{name}")
    want = c.execute(T.ORACLE).df()
    got = T.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).toPandas()
    assert_same(got, want)
    assert (want.n_items > 0).any()
