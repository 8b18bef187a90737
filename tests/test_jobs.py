"""The jobs: two runs over growing input, runs that were broken off, odd rows, settings, and the command line; against plain versions."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import probe_screen, repeat_mask, settings
from strandline.operators import repeats
from strandline.sources import genome as G, shared

from .brute import distance, turned

REPO = Path(__file__).resolve().parents[1]


def sequences(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def plain(rows):
    """number and letters of each row, as the jobs read texts."""
    table = str.maketrans("abcdefghijklmnopqrstuvwxyz\n", "ACGTACGTACGTACGTACGTACGTACN")
    return [(i, "".join(c for c in (t or "").lower() if c in "abcdefghijklmnopqrstuvwxyz\n").translate(table)) for i, t in rows]


def brute_hits(rows, probes, n):
    out = []
    for i, seq in plain(rows):
        for at in range(len(seq) - 30):
            w = seq[at : at + 31]
            if "N" in w or i is None:
                continue
            for p, q in probes:
                for strand, o in (("+", q), ("-", turned(q))):
                    if (d := distance(w, o)) <= n:
                        out.append((p, i, at, strand, w if strand == "+" else turned(w), d))
    return sorted(out)


def taken(spark, where):
    return sorted(tuple(r) for r in probe_screen.hits(spark, where).select("probe_id", "contig_id", "start", "strand", "letters", "mismatches").collect())


TEXT = "it was the best of times and the worst of times for all who came to see the old house by the river "
ROWS = [(1, TEXT), (2, None), (3, ""), (4, "short"), (None, TEXT), (5, TEXT.upper() + "\n" + TEXT), (5, TEXT), (6, "x" * 200), (7, TEXT.replace("best", "rest").replace("old", "odd"))]


@pytest.fixture
def probes(spark, tmp_path):
    a, b = plain([(0, TEXT[10:60])])[0][1][:31], plain([(0, TEXT)])[0][1][20:51]
    rows = [("b", b), ("a", a), ("z", turned(a)), ("bad", "ACGT"), (None, b), ("n", None), ("low", "A" * 31)]
    spark.createDataFrame(rows, "probe_id string, letters string").write.parquet(str(tmp_path / "probes"))
    return str(tmp_path / "probes"), [("a", a), ("b", b), ("low", "A" * 31)]


def test_screen_takes_only_what_is_new(spark, tmp_path, probes):
    path, clean = probes
    data, out, mark = (str(tmp_path / x) for x in ("data", "hits", "mark"))
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").withColumn("mismatches", F.lit(9))
    table(ROWS[:4]).coalesce(1).write.parquet(data)
    conf = {"mismatches": 3}
    first = probe_screen.run(spark, data, path, out, mark, conf)
    assert (first["sequences"], first["unclean_probes"]) == (4, 3)
    assert taken(spark, out) == brute_hits(ROWS[:4], clean, 3)
    files = {f.name for f in Path(out).rglob("*.parquet")}
    again = probe_screen.run(spark, data, path, out, mark, conf)
    assert again["sequences"] == again["hits"] == 0
    table(ROWS[4:]).repartition(3).write.mode("append").parquet(data)
    more = probe_screen.run(spark, data, path, out, mark, {**conf, "files_a_batch": 1})
    assert (more["sequences"], more["unnamed"]) == (5, 1) and more["batches"] >= 2
    assert taken(spark, out) == brute_hits(ROWS, clean, 3)
    assert files <= {f.name for f in Path(out).rglob("*.parquet")}  # what was written stays


def test_screen_goes_on_where_a_run_was_broken_off(spark, tmp_path, probes):
    path, clean = probes
    data, out, mark = (str(tmp_path / x) for x in ("data", "hits", "mark"))
    spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1).write.parquet(data)
    probe_screen.run(spark, data, path, out, mark)
    # As if the run had ended after its files were written, and before its marks were.
    for f in [*Path(mark, "stream", "commits").glob("0"), *Path(mark, "stream", "commits").glob(".0.crc")]:
        f.unlink()
    probe_screen.run(spark, data, path, out, mark)
    assert taken(spark, out) == brute_hits(ROWS, clean, 3)
    # Files of a broken batch that the sink's log does not name are not read.
    stray = next(Path(out).rglob("part-*.parquet"))
    (stray.parent / f"part-00099-{'0' * 8}.snappy.parquet").write_bytes(stray.read_bytes())
    assert taken(spark, out) == brute_hits(ROWS, clean, 3)


def test_screen_keeps_to_its_settings(spark, tmp_path, probes):
    path, _ = probes
    data, out, mark = (str(tmp_path / x) for x in ("data", "hits", "mark"))
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(data)
    probe_screen.run(spark, data, path, out, mark)
    with pytest.raises(ValueError, match="other probes or settings"):
        probe_screen.run(spark, data, path, out, mark, {"mismatches": 2})
    spark.createDataFrame([("new", "C" * 31)], "probe_id string, letters string").write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="other probes or settings"):
        probe_screen.run(spark, data, path, out, mark)
    with pytest.raises(ValueError, match="mismatches"):
        probe_screen.run(spark, data, path, out, mark, {"mismatches": 7})
    with pytest.raises(ValueError, match="unknown setting"):
        settings.config(probe_screen.DEFAULTS, mismatch=1)
    with pytest.raises(ValueError, match="of kind"):
        settings.config(probe_screen.DEFAULTS, mismatches="1")


def test_screen_of_nothing(spark, tmp_path, probes):
    path, _ = probes
    data, out, mark = (str(tmp_path / x) for x in ("data", "hits", "mark"))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(data)
    assert probe_screen.run(spark, data, path, out, mark)["hits"] == 0
    assert taken(spark, out) == [] and probe_screen.hits(spark, str(tmp_path / "never")).count() == 0


def test_screen_of_bases(spark, tmp_path):
    dna = "ACGTTGCAAGCTTAGGCATCGATTACGGCATNNACGTTGCAAGCTTAGGCATCGATTACGGCATC"
    spark.createDataFrame([("p", dna[:31].lower())], "probe_id string, letters string").write.parquet(str(tmp_path / "probes"))
    spark.createDataFrame([(1, dna), (2, turned(dna).lower())], "chrom long, dna string").write.parquet(str(tmp_path / "data"))
    probe_screen.run(spark, *(str(tmp_path / x) for x in ("data", "probes", "hits", "mark")), {"id": "chrom", "text": "dna", "letters": "bases", "mismatches": 0})
    n = len(dna)
    want = [("p", 1, 0, "+"), ("p", 1, 33, "+"), ("p", 2, n - 31, "-"), ("p", 2, n - 33 - 31, "-")]
    assert [r[:4] for r in taken(spark, str(tmp_path / "hits"))] == sorted(want)


def brute_mask(rows, copies):
    seqs = [(i, s) for i, s in plain(rows) if i is not None]
    count, at = {}, {}
    for i, s in seqs:
        for k in range(len(s) - 30):
            if "N" not in s[k : k + 31]:
                w = min(s[k : k + 31], turned(s[k : k + 31]))
                count[w] = count.get(w, 0) + 1
                at.setdefault(i, []).append((k, w))
    out = []
    for i, places in at.items():
        now = None
        for k, w in sorted(places):
            if count[w] < copies:
                continue
            if now is None or k - now[1] > 31:
                now = [k, k, 0, 0, 0]
                out.append((i, now))
            now[1], now[2], now[3], now[4] = k, now[2] + 1, max(now[3], count[w]), now[4] + count[w]
    return sorted((i, a, b + 31, n, m, c) for i, (a, b, n, m, c) in out)


def masked(spark, out, snapshot):
    return sorted(tuple(r) for r in spark.read.schema(repeat_mask.MASK).parquet(f"{out}/mask/snapshot={snapshot}").select("contig_id", "start", "end", "windows", "most_copies", "copies").collect())


UNIQUE = [r for r in ROWS if r[0] is not None and r != ROWS[6]] + [(None, TEXT), (8, "z" * 31), (9, TEXT * 3)]


def test_mask_is_that_of_a_plain_version_and_reruns_alike(spark, tmp_path):
    data, out = str(tmp_path / "data"), str(tmp_path / "out")
    spark.createDataFrame(UNIQUE, "doc_id long, text string").withColumns({"start": F.lit(1), "copies": F.lit("x")}).write.parquet(data)
    got = repeat_mask.run(spark, data, out, "a")
    assert (got["sequences"], got["unnamed"]) == (len(UNIQUE), 1)
    assert masked(spark, out, "a") == brute_mask(UNIQUE, 2)
    # A run that was broken off left half a snapshot: the next one replaces it whole, and no other.
    repeat_mask.run(spark, data, out, "b", config={"copies": 4})
    half = sorted(Path(out, "mask", "snapshot=a").rglob("part-*.parquet"))
    half[0].rename(half[0].with_name("part-99999-stray.parquet"))
    (Path(out, "mask", "snapshot=a", "copies_class=30")).mkdir()
    half[-1].rename(Path(out, "mask", "snapshot=a", "copies_class=30", half[-1].name))
    assert repeat_mask.run(spark, data, out, "a") == got
    assert masked(spark, out, "a") == brute_mask(UNIQUE, 2) and masked(spark, out, "b") == brute_mask(UNIQUE, 4)
    report = spark.read.schema(repeat_mask.REPORT).parquet(f"{out}/report").collect()
    assert sum(r.letters for r in report) == sum(x[2] - x[1] for n in (2, 4) for x in brute_mask(UNIQUE, n))


def test_mask_with_features(spark, tmp_path):
    data, out, bed = (str(tmp_path / x) for x in ("data", "out", "bed"))
    spark.createDataFrame([(1, TEXT), (2, TEXT)], "doc_id long, text string").write.parquet(data)
    lines = ["track name=x", "seq1\t0\t10\tfirst", "seq1\t70\t500\tlast", "seq1\t2\t4\tfirst", "seq2\t5\t5\tempty", "seq9\t1\t2\tnowhere", "seq2\tx\ty\tbad"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(bed)
    got = repeat_mask.run(spark, data, out, "a", bed)
    assert (got["features_imported"], got["features_skipped"], got["features_unknown"]) == (3, 2, 1)
    rows = spark.read.schema(repeat_mask.MASK).parquet(f"{out}/mask/snapshot=a").orderBy("contig_id").collect()
    assert [(r.contig_id, r.start, r.features, r.labels) for r in rows] == [(1, 0, 3, "first,last"), (2, 0, 0, "")]


def test_mask_of_nothing_and_of_ambiguous_numbers(spark, tmp_path):
    for name, rows in (("none", []), ("null", [(1, None), (None, TEXT)]), ("twice", [(1, TEXT), (1, TEXT)])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / name))
    for name in ("none", "null"):
        assert repeat_mask.run(spark, str(tmp_path / name), str(tmp_path / "out"), name)["stretches"] == 0
        assert masked(spark, tmp_path / "out", name) == []
    with pytest.raises(ValueError, match="one number"):
        repeat_mask.run(spark, str(tmp_path / "twice"), str(tmp_path / "out"), "twice")
    for bad in ({"copies": 1}, {"letters": "codons"}):
        with pytest.raises(ValueError):
            repeat_mask.run(spark, str(tmp_path / "none"), str(tmp_path / "out"), "x", config=bad)
    with pytest.raises(ValueError, match="name"):
        repeat_mask.run(spark, str(tmp_path / "none"), str(tmp_path / "out"), "a/b")


@pytest.mark.parametrize("gap", [1, 31, 400])
def test_stretches_over_part_borders(spark, gap):
    part = 1 << repeats.PART
    places = sorted({0, 1, 5, part - 2, part - 1, part, part + 1, part + 40, 2 * part - 31, 2 * part - 1, 2 * part, 2 * part + 31, 3 * part + 30, 5 * part, 5 * part + 390, *range(6 * part - 100, 8 * part + 100, 25)})
    want, now = [], None
    for p in places:
        if now is None or p - now[1] > gap:
            now = [p, p, 0]
            want.append(now)
        now[1], now[2] = p, now[2] + 1
    own = spark.createDataFrame([(c, p, 2) for c in (1, 2) for p in places], "contig_id long, start long, copies long")
    got = repeats.stretches(own, gap, {"copies": "sum"}).select("contig_id", "first", "last", "places", "copies").collect()
    assert sorted(tuple(r) for r in got) == [(c, a, b, n, 2 * n) for c in (1, 2) for a, b, n in want]


def test_a_long_sequence_is_many_tasks(spark):
    """One contig of several dealt tiles gives the windows that plain reading gives, from many partitions."""
    seq = spark.range(1).select(F.lit(0).cast("long").alias("contig_id"), F.expr("concat_ws('', transform(sequence(1, 300000), i -> substring(md5(cast(i as string)), 1, 5)))").alias("t"))
    genome = seq.select("contig_id", F.translate("t", "0123456789abcdef", "ACGTACGTACGTACGN").alias("seq"))
    assert G.longest(genome) == 1_500_000 > G.DEALT
    dealt, plain_ = G.windows(genome), G.windows(genome, deal=False)
    assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() > 1 == plain_.select(F.spark_partition_id().alias("p")).distinct().count()
    sums = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("contig_id", "start", "fwd", "kmer").cast("decimal(38,0)"))).first()
    assert sums(dealt) == sums(plain_)


@pytest.mark.parametrize("job", ["probe_screen", "repeat_mask"])
def test_command_line(spark, tmp_path, probes, job):
    data = str(tmp_path / "data")
    spark.createDataFrame([r for r in ROWS if r != ROWS[6]], "doc_id long, text string").write.parquet(data)
    args = [data, probes[0], f"{tmp_path}/hits", f"{tmp_path}/mark"] if job == "probe_screen" else [data, f"{tmp_path}/out", "s1"]
    env = os.environ | {"PYTHONPATH": str(REPO), "PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.checkpoint.dir={shared.folder(spark)} pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read" in done.stderr and "wrote" in done.stderr
    assert (probe_screen.hits(spark, args[2]) if job == "probe_screen" else spark.read.parquet(f"{tmp_path}/out/mask")).count() > 0
