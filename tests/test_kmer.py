from __future__ import annotations

import random

from pyspark.sql import functions as F

from strandline.functions import ball, kmer as K

from .brute import distance, turned


def words(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("ACGT") for _ in range(31)) for _ in range(n)]


def test_packed_functions(spark):
    a, b = words(300), words(300, 2)
    b[:100] = [x[:5] + "A" + x[6:] for x in a[:100]]
    a[0], b[0], a[1] = "A" * 31, "T" * 31, "T" * 31
    df = spark.createDataFrame(list(zip(a, b, strict=True)), "a string, b string").select("a", "b", K.pack(F.col("a")).alias("x"), K.pack(F.col("b")).alias("y"))
    c = df.select(
        "a", "b", "x", K.unpack(F.col("x")).alias("back"), K.unpack(K.revcomp(F.col("x"))).alias("rc"), K.revcomp(K.revcomp(F.col("x"))).alias("twice"), K.hamming(F.col("x"), F.col("y")).alias("d"),
        K.hamming_lead(F.col("x"), F.col("y")).alias("lead"), K.unrotate(K.rotate(F.col("x"))).alias("turn"), K.unpack(K.rotate(F.col("x"))).alias("rot"), K.mismatch_positions(F.col("x"), F.col("y")).alias("at"),
        K.characters(F.col("x"), F.col("y")).alias("chars"), K.unpack(K.window(F.col("x"), 12, 7), 12).alias("w"), K.unpack(K.canonical(F.col("x"))).alias("canon"),
    ).collect()
    for r in c:
        at = [i for i in range(31) if r.a[i] != r.b[i]]
        assert r.back == r.a and r.rc == turned(r.a) and r.twice == r.x and r.turn == r.x and r.x >= 0
        assert r.d == distance(r.a, r.b) and r.lead == distance(r.a[:15], r.b[:15])
        assert r.rot == r.a[15:] + r.a[:15] and r["at"] == at and r.chars == [4 * i + "ACGT".index(r.b[i]) for i in at]
        assert r.w == r.a[7:19] and r.canon == min(r.a, turned(r.a))


def test_parse_and_text(spark):
    df = spark.createDataFrame([("acgt" * 7 + "acg",), ("A" * 30,), ("A" * 30 + "N",), (None,)], "s string")
    assert [r.x is None for r in df.select(K.pack(F.col("s")).alias("x")).collect()] == [False, True, True, True]
    one = spark.range(1).select(K.revcomp_text(F.lit("aCgTN")).alias("a"), K.percent_decode(F.lit("a%20b+c")).alias("b"), K.percent_decode(F.lit("50%zz")).alias("c"), K.gff_attribute(F.lit("ID=x;Name=y z"), "Name").alias("d"), K.gff_attribute(F.lit("xName=1"), "Name").alias("e"), K.letters_of(F.array(F.lit(0), F.lit(7))).alias("f"), K.mirror(F.array(F.lit(0))).alias("g")).first()
    assert (one.a, one.b, one.c, one.d, one.e, one.f, one.g) == ("NAcGt", "a b+c", "50%zz", "y z", None, "1A 2T", [123])


def test_ball():
    assert ball.ball(31, 0) == 1 and ball.ball(31, 1) == 94 and ball.ball(31, 31) == 4**31 and ball.shell(31, 2) == 465 * 9
    assert [ball.prefix_length(n) for n in (0, 4**10, 4**20)] == [8, 10, 15]
    assert abs(ball.expected_chance_hits(4**31, 0) - 2) < 1e-9
