"""Queries as jobs over one index: states, cached results, views.

A query is answered in its canonical orientation and turned round for a user whose window is the other strand, so both strands share
one cached result; a result searched to n serves every smaller n.  Results are kept by Spark and dropped least recently used first.
States: queued, searching, ordering, ready, failed, cancelled; the last three stay as they are.
"""

from __future__ import annotations

import threading
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ball, kmer as K
from ..operators import sampling, search, tree, views
from ..sources import store

MOST_N, KEPT_RESULTS, KEPT_JOBS, KEPT_ORDERS = 17, 8, 256, 16
FINAL = ("ready", "failed", "cancelled")
_TURN = str.maketrans("ACGT", "TGCA")


class NotFound(KeyError):
    pass


@dataclass
class Job:
    id: int
    text: str
    canonical: str
    max_n: int
    order: str
    state: str = "queued"
    error: str | None = None
    result: DataFrame | None = None
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    @property
    def flipped(self) -> bool:
        return self.text != self.canonical

    def to(self, state: str, error: str | None = None) -> bool:
        with self.lock:
            if self.state in FINAL:
                return False
            self.state, self.error = state, error
            return True


class Session:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.manifest = store.read_json(spark, f"{path}/manifest.json")
        self.kmers, self.sites, self.contigs = (store.table(spark, path, t) for t in ("kmers", "sites", "contigs"))
        self.walks = search.Walks.stored(spark, path, self.manifest["prefix"], self.manifest["folder"])
        self.costs: dict = store.read_json(spark, f"{path}/costs.json", {})
        self.orders: OrderedDict[tuple, DataFrame] = OrderedDict()
        self.jobs: OrderedDict[int, Job] = OrderedDict()
        self.cache: OrderedDict[tuple[str, int], DataFrame] = OrderedDict()
        self.lock, self.heavy = threading.Lock(), threading.Semaphore(1)
        self.next = 1

    # Queries.

    def parse(self, text: str) -> str:
        """A window of 31 letters, or CONTIG:POS with a place from 1; commas in numbers do not count."""
        if len(text) == K.K and not set(text.upper()) - set("ACGT"):
            return text.upper()
        name, colon, at = text.rpartition(":")
        if not colon:
            raise ValueError(f"neither 31 letters of ACGT nor CONTIG:POS: {text!r}")
        return self.at(name, int(at.replace(",", "")))

    def at(self, name: str, start: int) -> str:
        if start < 1:
            raise ValueError("places begin at 1")
        return self.at_pos(self.contig(name)["offset"] + start - 1)

    def contig(self, name: str) -> dict:
        """By its name (the first of equal ones), or by the name that it is shown under."""
        row = self.contigs.where(F.col("name") == name).orderBy("contig_id").first()
        shown = None if row else next((c for c, d in store.registry(self.spark, self.path).get("display", {}).items() if d == name), None)
        if shown is not None:
            row = self.contigs.where(F.col("contig_id") == int(shown)).first()
        if row is None:
            raise NotFound(name)
        return row.asDict()

    def calibrate(self, steps: tuple[int, ...] = (0, 4, 8)) -> dict:
        """Measures both engines on the index's top window and fits the constants of `search.plan`, which later searches go by; they are kept beside the index."""
        own = search.top_copy(self.kmers).select(F.lit("q").alias("query_id"), F.col("kmer").alias("q")).persist()
        distinct, p = self.manifest["distinct"], self.manifest["prefix"]
        run = lambda engine, n: sampling.timed(lambda: search.search(self.kmers, own, n, engine, walks=self.walks).count())
        scans = sampling.fit_line([(0.0, run("scan", 0)), (float(distinct), run("scan", steps[-1]))])
        walks = sampling.fit_line([(ball.walk_steps(p, n) + 4 * distinct * min(1.0, ball.ball(p, n // 2) / 4**p), run("pigeonhole", n)) for n in steps])
        own.unpersist()
        (a, b), (c, d) = scans or (0.0, 0.0), walks or (0.0, 0.0)
        self.costs = {"scan_ns": (a + b * distinct) / max(distinct, 1) * 1e9, "walk_ns": d * 1e9, "fixed_ns": c * 1e9, "parallel_ns": 0.0}
        store.write_json(self.spark, f"{self.path}/costs.json", self.costs)
        return self.costs

    def at_pos(self, pos: int) -> str:
        row = self.sites.where(F.col("pos") == pos).select(K.unpack(F.col("fwd")).alias("w")).first()
        if row is None:
            raise ValueError("no whole clean window is there")
        return row.w

    def submit(self, text: str, max_n: int = 10, order: str = "per_n", wait: bool = True) -> Job:
        if not 0 <= max_n <= MOST_N:
            raise ValueError(f"max_n is between 0 and {MOST_N}")
        tree.order_mode(order, 0)
        with self.lock:
            job = Job(self.next, text, min(text, text.translate(_TURN)[::-1]), max_n, order)
            self.next += 1
            self.jobs[job.id] = job
            while len(self.jobs) > KEPT_JOBS:
                self.jobs.popitem(last=False)
        hit = self._cached(job.canonical, max_n)
        if hit is not None:
            job.result = hit
            job.to("ready")
        elif wait:
            self._run(job)
        else:
            threading.Thread(target=self._run, args=(job,), daemon=True).start()
        return job

    def _cached(self, canonical: str, n: int) -> DataFrame | None:
        with self.lock:
            fit = [k for k in self.cache if k[0] == canonical and k[1] >= n]
            if not fit:
                return None
            key = min(fit, key=lambda k: k[1])
            self.cache.move_to_end(key)
            return self.cache[key]

    def _run(self, job: Job) -> None:
        group = f"query-{job.id}"
        try:
            plan = search.plan(self.manifest["distinct"], job.max_n, self.manifest["prefix"], **self.costs)
            with self.heavy:
                if not job.to("searching"):
                    return
                self.spark.sparkContext.setJobGroup(group, job.text, True)
                own = search.query_table(self.spark, {"q": job.canonical})
                found = search.result_set(search.search(self.kmers, own, job.max_n, plan["engine"], walks=self.walks)).persist()
                found.count()
            if not job.to("ordering"):
                found.unpersist()
                return
            with self.lock:
                self.cache[job.canonical, job.max_n] = found
                while len(self.cache) > KEPT_RESULTS:
                    self.cache.popitem(last=False)[1].unpersist()
            job.result = found
            job.to("ready")
        except Exception as e:  # noqa: BLE001  a job's failure is its state
            job.to("failed", str(e)[:500])

    def cancel(self, job_id: int) -> None:
        if self.job(job_id).to("cancelled"):
            self.spark.sparkContext.cancelJobGroup(f"query-{job_id}")

    def job(self, job_id: int) -> Job:
        if job_id not in self.jobs:
            raise NotFound(str(job_id))
        return self.jobs[job_id]

    # Views.  n: at most the job's max_n, which is what it is by default.

    def _n(self, job: Job, n: int | None) -> int:
        return job.max_n if n is None else min(n, job.max_n)

    def _result(self, job: Job) -> DataFrame:
        if job.state != "ready":
            raise RuntimeError(f"the query is {job.state}")
        return job.result

    def region(self, start: int | None = None, end: int | None = None) -> tuple[int, int]:
        length = self.manifest["genome_len"]
        a, b = max(0, start or 0), min(length, length if end is None else end)
        if a >= b:
            raise ValueError("the region is empty")
        return a, b

    def status(self, job: Job) -> list[dict]:
        own = search.by_mismatch(self._result(job), self.kmers, job.max_n)
        # Noisy: chance alone would find over half as many.
        return [r.asDict() | {"noisy": r.expected_chance_hits > 0.5 * r.cum_variants} for r in own.drop("query_id").orderBy("mismatches").collect()]

    def ordered(self, job: Job, n: int | None = None) -> DataFrame:
        """query_id, row, vi.  A frozen order is ranked at the job's own max_n, whatever cached result serves it."""
        own, n = self._result(job), self._n(job, n)
        key = job.canonical, job.order, n, job.max_n if job.order == "frozen" else n
        with self.lock:
            if key in self.orders:
                self.orders.move_to_end(key)
                return self.orders[key]
        if job.order == "mst" and tree.order_mode("mst", own.where(F.col("mismatches") <= n).count()) == "mst":
            made = tree.mst(own, n).persist()
        else:
            made = tree.ordered(own, n, job.max_n if job.order == "frozen" else None).persist()
        with self.lock:
            self.orders[key] = made
            while len(self.orders) > KEPT_ORDERS:
                self.orders.popitem(last=False)[1].unpersist()
        return made

    def result_sites(self, job: Job, n: int | None = None) -> DataFrame:
        return search.result_sites(self._result(job).where(F.col("mismatches") <= self._n(job, n)), self.sites)

    def hits(self, job: Job, n: int | None = None) -> DataFrame:
        own = search.hits(self._result(job).where(F.col("mismatches") <= self._n(job, n)), self.sites)
        if job.flipped:
            own = own.withColumns({"variant": K.revcomp(F.col("variant")), "strand": F.when(F.col("strand") == "+", "-").otherwise("+")})
        return own

    def raster(self, job: Job, start: int, end: int, width: int, height: int, row0: int = 0, row1: int | None = None, n: int | None = None) -> DataFrame:
        if width * height > 16_000_000 or width < 1 or height < 1:
            raise ValueError("a raster has 1 to 16,000,000 cells")
        order = self.ordered(job, n)
        row1 = order.count() if row1 is None else row1
        cells = views.raster(self.result_sites(job, n), order, start, end, width, row0, max(row1, row0 + 1), height)
        return views.turned(cells) if job.flipped else cells

    def histogram(self, job: Job, start: int, end: int, width: int, n: int | None = None) -> DataFrame:
        n = self._n(job, n)
        return views.dense(views.histogram(self.result_sites(job, n), n, start, end, width), width, n)

    def clades(self, job: Job, row0: int, row1: int, min_rows: int = 2, limit: int = 20_000, n: int | None = None) -> DataFrame:
        order = self.ordered(job, n)
        if "lcp" not in order.columns:
            return tree.shown_clades(tree.mst_clades(order), row0, row1, min_rows, limit).withColumn("label", F.lit(""))
        n = self._n(job, n)
        ranks = tree.character_ranks(self._result(job), job.max_n if job.order == "frozen" else n)
        return tree.clade_labels(tree.shown_clades(tree.clades(order), row0, row1, min_rows, limit), order, ranks, job.flipped)

    def variants(self, job: Job, row0: int = 0, limit: int = 100, n: int | None = None) -> DataFrame:
        own = views.variants_page(self.ordered(job, n), self._result(job), self.kmers, row0, limit)
        if job.flipped:
            own = own.withColumns({"variant": K.revcomp_text(F.col("variant")), "positions": F.array_sort(F.transform("positions", lambda p: K.K + 1 - p))})
        return own.orderBy("row")

    def summary(self) -> dict:
        return {k: self.manifest[k] for k in ("name", "k", "genome_len", "distinct", "sites", "prefix")} | {"contigs": self.contigs.count(), "chance": [ball.expected_chance_hits(self.manifest["distinct"], n) for n in range(MOST_N + 1)]}
