"""What the repeated runs of a super-window meet."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.llm import suffix_dedup


def test_a_place_is_met_once(spark, monkeypatch):
    """However many runs a super-window has; here its windows are counted one by one."""
    monkeypatch.setattr(suffix_dedup, "HOT", 0)
    met, hand = [], suffix_dedup.hand

    def watched(df, label):
        if label == "spans":
            df = df.cache()
            met.append((df.count(), df.select("part", "row", "start").distinct().count(), df.agg(F.max(F.size("a")) if dict(df.dtypes)["a"].startswith("array") else F.lit(1)).first()[0]))
        return hand(df, label)

    monkeypatch.setattr(suffix_dedup, "hand", watched)
    passage = " ".join(f"word{i} of a passage" for i in range(40))
    docs = spark.createDataFrame([(i, f"{i} begins otherwise {i * 7919} {passage} and ends so {i * 104729}") for i in range(30)], "doc_id long, text string")
    assert all(r.n_removed > 500 for r in suffix_dedup.removed_rows(docs).collect())
    (rows, places, most), = met
    assert rows == places and most > 1
