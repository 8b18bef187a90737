"""Spelling variants: words one edit apart, found by rolling hashes of their deletions.

Words are the maximal runs of RUN in all texts with A-Z in lower case, and one run in SLIP loses a code point, as a slip of the pen would (see `slipped`);
those of at least LEAST code points that come MOST times or more are compared.  Two are near if one inserted, deleted or replaced code point tells them apart.  A word's form is the
commonest near word, if that is at least twice as common; its root is the last of its forms' forms.

Keys.  A word is a polynomial over its code points' mixed values, modulo 2 ** 64.  Sums from the front (prefix hashes) and what is left behind a place (suffix hashes, by the base's
inverse) give the hash of the word without any one of its code points in a fixed number of array operations, for all places of a batch of words at once.  Words that differ by a replacement share
the deletion at its place, and the shorter of two words is a deletion of the longer, at the first place of a run of equal code points.  So a word has its length + runs + 1 whole-number
keys, each with its kind, and near words share exactly one.  Keys are dealt by their leading bits (a radix; they are hashes, so parts are even), sorted in arrays, and only those that come twice are kept;
these alone get their strings back, and are grouped by what is really left of the string, so a collision of hashes costs a row and gives no link.

Work.  A group of one replacement has no more words than the alphabet has letters, and of a group no pairs are made: each word of it counts the others and takes the best of
them, which is the group's best or second best.  A deletion meets one word at most.  So rows grow with the keys, and strings move only for real links.  Roots are found by
pointer jumping; a form is twice as common, so chains are short.

Cases.  A null or empty text has no words.  A null doc_id counts as empty text where a slip is drawn.  Repeated rows count each time.  Ties between forms go to the
first in code-point order.  Words without near words have n_near 0, no form, and are their own root.  Empty tables give no rows.  Extra columns are ignored whatever their names.  Runs may
be as long as a text: their keys are as many as their letters, none of which carries the word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, drop, in_arrow, partitions, release, small_batches

RUN = "[A-Za-zÀ-ÿ]+"
SLIP, LEAST, MOST, TIMES = 97, 5, 3, 2
#: Different words that a task counts before it hands them on, and keys of one part of the sort.
HELD, PART_KEYS = 500_000, 4_000_000
UPPER = {i: i + 32 for i in range(65, 91)}
BASE = 0x9E3779B97F4A7C15 | 1
UNDO = pow(BASE, -1, 1 << 64)


def slipped(word: str, seed: int) -> str:
    """The run, or, if SLIP divides the checksum of its document's id and itself, the run without one of its code points.  seed: the checksum of the id and a colon."""
    h = zlib.crc32(word.encode(), seed)
    at = h % len(word)
    return word if h % SLIP else word[:at] + word[at + 1 :]


def words(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """wid, word, n: the different words, counted over all texts and numbered; a written table."""
    small_batches(docs.sparkSession)
    find = re.compile(RUN).findall

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            own = list(total.items())
            total.clear()
            for at in range(0, len(own), 50_000):
                some = own[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(find((text or "").translate(UPPER))).items():
                    word = slipped(run, seed)
                    if len(word) >= least:
                        total[word] += n
                if len(total) >= HELD:
                    yield from out()
        yield from out()

    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sums = in_arrow(own, step, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= most)
    return cut(sums.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "words")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits, each spread over all bits."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(own: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, place and the word's number, for all keys of a batch of words.  place: where a code point is taken out, for links by replacement; -1 for the whole word, and
    -2 - place for what a longer word leaves, for links by insertion."""
    size = np.fromiter(map(len, own), np.int64, len(own))
    code = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
    word = np.repeat(np.arange(len(own)), size)
    first = np.cumsum(size) - size
    at = np.arange(len(code)) - first[word]
    power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(size.max(initial=0)), BASE, np.uint64))))
    term = _mixed(code) * power[at]
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)))
    begin = upto[first]
    whole = upto[first + size] - begin
    before, behind = upto[:-1] - begin[word], whole[word] - (upto[1:] - begin[word])  # prefix hashes, and suffix hashes one place too far
    left = before + behind * np.uint64(UNDO)
    other = np.flatnonzero((at == 0) | (code != np.concatenate((code[:1], code[:-1]))))
    key = np.concatenate((_mixed(_mixed(left) + at.astype(np.uint64) + np.uint64(1)), _mixed(whole), _mixed(left[other])))
    place = np.concatenate((at, np.full(len(own), -1), -2 - at[other]))
    return key.view(np.int64), place, np.concatenate((word, np.arange(len(own)), word[other]))


def shared_keys(known: DataFrame) -> DataFrame:
    """key, wid and place of the keys that links may come from: replacements of two words or more, and whole words with what longer ones leave."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wid, own, lo, size = b.column(0).to_numpy(), b.column(1).to_pylist(), 0, 0
            for i, x in enumerate(own):
                size += len(x)
                if size >= 200_000 or i == len(own) - 1:
                    key, place, word = deletion_keys(own[lo : i + 1])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(wid[lo : i + 1][word]), pa.array(place.astype(np.int32))], names=["key", "wid", "place"])
                    lo, size = i + 1, 0

    def met(key: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Which rows have a partner; rows are ordered by key."""
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = [np.add.reduceat((kind == k).astype(np.int64), edge) for k in range(3)]
        size = np.diff(np.concatenate((edge, [len(key)])))
        return np.where(kind == 0, np.repeat(n[0] > 1, size), np.where(kind == 1, np.repeat(n[2] > 0, size), np.repeat(n[1] > 0, size)))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One column at a time, so that a part is held once and a sorted column besides.
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        key, wid, place = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        held.clear()
        order = np.argsort(key)
        key, wid, place = key[order], wid[order], place[order]
        keep = np.flatnonzero(met(key, np.where(place >= 0, 0, np.where(place == -1, 1, 2))))
        for at in range(0, len(keep), 100_000):
            some = keep[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(wid[some]), pa.array(place[some])], names=["key", "wid", "place"])
        del key, wid, place, order, keep
        release()

    shape = "key long, wid long, place int"
    total = known.agg(F.coalesce(F.sum(2 * F.length("word") + 1), F.lit(0)).alias("n")).first()["n"]
    parts = max(partitions(known.sparkSession), -(-total // PART_KEYS))
    bits = max(1, (8 * parts - 1).bit_length())  # some radix values a part
    keys = in_arrow(known.select("wid", "word"), make, shape).repartition(parts, F.shiftrightunsigned("key", 64 - bits))
    return cut(in_arrow(keys, sort, shape), "shared-keys")


def _without(word: Column, at: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def near(known: DataFrame) -> DataFrame:
    """wid, n_near, and best: n and word of the commonest near word."""
    found = shared_keys(known).join(known, "wid")
    # Replacements: the others of a group that have the same letters left.  Its first word takes the second, all others the first.
    place = F.col("place")
    same = found.where("place >= 0").select("wid", "key", "place", "word", "n", _without(F.col("word"), place).alias("left"))
    group = Window.partitionBy("key", "place", "left")
    ranked = group.orderBy(F.desc("n"), "word")
    one = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    own = same.select("wid", one.alias("one"), F.row_number().over(ranked).alias("k"), F.first(one).over(ranked).alias("first"), F.lead(one).over(ranked).alias("next"), (F.count(F.lit(1)).over(group) - 1).alias("others"))
    replaced = own.where("others > 0").select("wid", "others", F.when(F.col("k") == 1, F.col("next")).otherwise(F.col("first")).alias("best"))
    # Insertions: what a word leaves is another word.
    long = found.where("place < -1").select(F.col("wid").alias("wid_l"), "key", _without(F.col("word"), -2 - place).alias("left"), one.alias("best_l"))
    short = found.where("place = -1").select(F.col("wid").alias("wid_s"), F.col("key").alias("key_s"), F.col("word").alias("left_s"), one.alias("best_s"))
    links = long.join(short, (F.col("key") == F.col("key_s")) & (F.col("left") == F.col("left_s")))
    both = F.explode(F.array(F.struct(F.col("wid_l").alias("wid"), F.col("best_s").alias("best")), F.struct(F.col("wid_s").alias("wid"), F.col("best_l").alias("best"))))
    inserted = links.select(both.alias("x")).select("x.wid", F.lit(1).cast("long").alias("others"), "x.best")
    return replaced.unionByName(inserted).groupBy("wid").agg(F.sum("others").alias("n_near"), F.min("best").alias("best"))


def roots(formed: DataFrame) -> DataFrame:
    """formed: word and form.  word and root of those that have a form: each round looks twice as far ahead, until nothing changes."""
    now = cut(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("w2"), F.col("root").alias("r2"))
        after = cut(now.join(on, F.col("root") == F.col("w2"), "left").select("word", F.coalesce("r2", "root").alias("root"), F.col("r2").isNotNull().alias("moved")), "roots")
        drop(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def forms(docs: DataFrame, least: int = LEAST, most: int = MOST, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word."""
    known = words(docs, least, most)
    good = -F.col("best.less") >= times * F.col("n")
    own = known.join(near(known), "wid", "left").select("word", F.when(good, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, -F.col("best.less")).alias("form_n"))
    own = cut(own, "forms")
    met = roots(own).withColumnRenamed("word", "__of")
    return own.join(met, F.col("word") == F.col("__of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_ASCII = "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tb),
r AS (SELECT d, translate(x, '{_ASCII.upper()}', '{_ASCII}') AS x, count(*) AS c
      FROM (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS x FROM documents) GROUP BY ALL),
hx AS (SELECT d, x, c, hex(d || ':' || x) AS h FROM r),
hs AS (SELECT d, x, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)),
         lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM hx, tab),
s AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(x, 1, h % length(x)) || substr(x, h % length(x) + 2) ELSE x END AS word, c FROM hs),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM s WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(c) >= {MOST}),
del AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM del a JOIN del b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM del a JOIN w b ON a.rest = b.word
          UNION SELECT b.word, a.word, a.n FROM del a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
pick AS (SELECT p.word, min(p.other) AS other, any_value(b.n_near) AS n_near, any_value(b.m) AS m FROM pairs p JOIN best b ON p.word = b.word AND p.m = b.m GROUP BY p.word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * w.n THEN other END AS form, CASE WHEN m >= {TIMES} * w.n THEN m END AS form_n FROM w LEFT JOIN pick USING (word)),
walk AS (SELECT word, word AS at_, form AS up FROM f UNION ALL SELECT walk.word, walk.up, f.form FROM walk JOIN f ON f.word = walk.up)
SELECT f.word, f.form, walk.at_ AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM f JOIN walk ON walk.word = f.word AND walk.up IS NULL
"""
