"""python -m strandline build|search|verify|info|annotate|serve|bench."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession, functions as F

from .functions import kmer as K
from .operators import sampling, search as S, tracks as T, tree
from .plans.session import Session
from .sources import annotations as A, fasta, genome as G, store


def session_of() -> SparkSession:
    spark = SparkSession.builder.appName("strandline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tsv(df) -> None:
    out = sys.stdout
    out.write("\t".join(df.columns) + "\n")
    for r in df.toLocalIterator():
        out.write("\t".join("" if v is None else str(v) for v in r) + "\n")


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    s = Session(spark, a.index)
    own = S.query_table(spark, {"q": s.parse(a.query)})
    found = S.search(s.kmers, own, a.n, a.engine, s.manifest["distinct"], s.walks, s.costs).persist()
    if a.output == "summary":
        tsv(S.by_mismatch(found, s.kmers, a.n).drop("query_id").orderBy("mismatches"))
    elif a.output == "variants":
        places = s.sites.groupBy(F.col("kmer").alias("leaf")).agg(F.sort_array(F.collect_list("pos")).alias("sites"))
        positions = found.withColumn("positions", F.array_join(K.mismatch_positions(F.col("q"), F.col("variant")).cast("array<string>"), ","))
        own = positions.join(places, "leaf")
        tsv(own.select(K.unpack(F.col("variant")).alias("variant"), "mismatches", "positions", F.array_join(F.col("sites").cast("array<string>"), ",").alias("sites")))
    else:
        hit = S.hits(found, s.sites).join(s.contigs.select("contig_id", "name"), "contig_id").orderBy("pos", "strand", "variant", "mismatches")
        tsv(hit.select(F.col("name").alias("contig"), (F.col("start") + 1).alias("start"), (F.col("start") + K.K).alias("end"), "strand", K.unpack(F.col("variant")).alias("variant"), "mismatches"))


def annotate(spark: SparkSession, a: argparse.Namespace) -> None:
    contigs = store.table(spark, a.index, "contigs")
    length = store.read_json(spark, f"{a.index}/manifest.json")["genome_len"]
    aliases = None
    for path in a.aliases:
        aliases = A.alias_table(spark, path, contigs)
        shown = A.display_names(aliases, contigs).join(contigs.select("contig_id", "name"), "contig_id").where("display <> name")
        reg = store.registry(spark, a.index)
        store.write_json(spark, f"{a.index}/annotations.json", reg | {"display": {str(r.contig_id): r.display for r in shown.collect()}})  # names of an alias table
    for path in a.gff:
        features, counts = A.place(A.read_gff(spark, path), contigs, aliases)
        print(store.write_features(features, a.index, "genes", source=path), counts.first().asDict())
    if a.tracks:
        manifest = A.read_manifest(spark, a.tracks)
        folder = a.tracks.rpartition("/")[0] or "."
        for m in manifest:
            features, signal, warned = A.annotate(spark, [m], folder, contigs, aliases)
            if features is not None:
                store.write_features(features, a.index, m["name"], m["description"], m["source"])
            if signal is not None:
                store.write_track(T.base_bins(signal), a.index, m["name"], length, m["description"], m["source"])
            for w in warned:
                print(w, file=sys.stderr)
    if a.gc:
        genome = G.read_fasta(spark, a.gc)
        store.write_track(T.gc_signal(T.gc_bins(T.bin_tiles(genome, G.contigs(genome)))), a.index, "GC", length)


def bench(spark: SparkSession, a: argparse.Namespace) -> None:
    s = Session(spark, a.index)
    own = S.query_table(spark, {"top": s.parse(a.query)} if a.query else {"top": S.top_copy(s.kmers).select(K.unpack(F.col("kmer")).alias("w")).first().w}).persist()
    s.kmers.persist().count()
    if a.what == "calibrate":
        print(json.dumps(s.calibrate()))
        return
    for n in range(a.n + 1):
        if a.what == "search":
            engines = ("scan", "pigeonhole")
            found = {e: S.search(s.kmers, own, n, e, walks=s.walks) for e in engines}
            took = {f"{e}_ms": round(sampling.timed(lambda e=e: found[e].count()) * 1000) for e in engines}
            a_, b_ = (found[e] for e in engines)
            if a_.exceptAll(b_).count() or b_.exceptAll(a_).count():
                raise SystemExit(f"the engines differ at {n}")
            plan = S.plan(s.manifest["distinct"], n, s.manifest["prefix"], **s.costs)
            print(json.dumps({"n": n, "variants": a_.count(), "planned": plan["engine"], "predicted_ms": {e: round(plan[f"{e}_ms"], 3) for e in engines}} | took))
        else:
            whole = S.result_set(S.scan(s.kmers, own, a.n)).persist()
            began = time.time()
            r = tree.lengths(tree.ordered(whole, n)).first()
            took = round((time.time() - began) * 1000)
            if r is not None:
                frozen = tree.lengths(tree.ordered(whole, n, a.n)).first()
                spanning = tree.mst(whole, n).agg(F.sum("edge").alias("w")).first().w
                print(json.dumps({"n": n, "variants": r.variants, "tree_per_variant": r.tree_length / r.variants, "frozen_per_variant": frozen.tree_length / r.variants, "mst_per_variant": spanning / r.variants, "star_per_variant": r.star_length / r.variants, "ms": took}))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="strandline")
    sub = p.add_subparsers(dest="do", required=True)
    x = sub.add_parser("build")
    x.add_argument("fasta")
    x.add_argument("index")
    x.add_argument("--name", default="index")
    x.add_argument("--spot-checks", type=int, default=10_000)
    x = sub.add_parser("search")
    x.add_argument("index")
    x.add_argument("query")
    x.add_argument("-n", type=int, default=2)
    x.add_argument("--output", choices=("summary", "variants", "sites"), default="summary")
    x.add_argument("--engine", choices=("scan", "pigeonhole", "blocks"))
    for name in ("verify", "info", "serve"):
        x = sub.add_parser(name)
        x.add_argument("index")
        if name == "serve":
            x.add_argument("--port", type=int, default=8080)
    x = sub.add_parser("annotate")
    x.add_argument("index")
    x.add_argument("--gff", action="append", default=[])
    x.add_argument("--tracks")
    x.add_argument("--aliases", action="append", default=[])
    x.add_argument("--gc", help="the FASTA to take the GC track from")
    x = sub.add_parser("bench")
    x.add_argument("what", choices=("search", "order", "calibrate"))
    x.add_argument("index")
    x.add_argument("--query")
    x.add_argument("-n", type=int, default=6)
    a = p.parse_args(argv)
    spark = session_of()
    if a.do == "build":
        print(json.dumps({k: v for k, v in store.build(fasta.read(spark, a.fasta), a.index, a.name, a.spot_checks).items() if k != "files"}))
    elif a.do == "verify":
        faults = store.verify(spark, a.index, files=True)
        print("\n".join(faults) or "sound")
        sys.exit(bool(faults))
    elif a.do == "info":
        print(json.dumps(Session(spark, a.index).summary()))
    elif a.do == "serve":
        from .service import serve

        serve(Session(spark, a.index), port=a.port).serve_forever()
    else:
        {"search": search, "annotate": annotate, "bench": bench}[a.do](spark, a)


if __name__ == "__main__":
    main()
