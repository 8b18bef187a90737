"""Bounded samples of labelled texts for fitting models, alike at every size of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Hashes of ids are compared with a threshold out of so many.
STEPS = 1 << 30


def place(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("long"), F.lit(7)), F.lit(STEPS))


def labelled_texts(docs: DataFrame, labels: DataFrame | None, label: str, rows: int, chars: int) -> list[tuple[object, str]]:
    """(label, text) pairs, at most `rows` and about `chars` characters a label, by the hash of doc_id.

    docs: doc_id, text and, without `labels`, the label; labels: doc_id and the label.  The number of different labels is
    small.  All labelled ids stand for the draw, each once however often it comes (with its least label and text); what is drawn is bounded by the two
    parameters, whatever the input."""
    from_ = docs if labels is None else labels
    keys = from_.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["n"] for r in keys.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    limit = F.lit(0)
    for k, n in sorted(counts.items(), key=str):
        limit = F.when(F.col("label") == F.lit(k), F.lit(min(STEPS, -(-rows * STEPS // n)))).otherwise(limit)
    drawn = keys.where(place(F.col("doc_id")) < limit)
    if labels is None:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (place(F.col("doc_id")) < limit))
    else:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min(F.struct("label", "text")).alias("t")).select("doc_id", "t.label", "t.text")
    sizes = texts.select("doc_id", "label", F.coalesce(F.length("text"), F.lit(0)).alias("n"), place(F.col("doc_id")).alias("h")).collect()
    room, taken, ids = {k: chars for k in counts}, {k: rows for k in counts}, []
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id, r.n)):
        if room[r.label] > 0 and taken[r.label] > 0:
            room[r.label] -= r.n
            taken[r.label] -= 1
            ids.append((r.doc_id,))
    if not ids:
        return []
    wanted = docs.sparkSession.createDataFrame(ids, "doc_id long").distinct()
    got = texts.join(F.broadcast(wanted), "doc_id").collect()
    return [(r.label, r.text or "") for r in sorted(got, key=lambda r: (r.doc_id, r.text or ""))]
