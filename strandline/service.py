"""The /v1 interface over HTTP: python -m strandline serve --index DIR."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, functions as F

from .functions import kmer as K
from .operators import features as FE, tracks as T, views
from .plans.session import Job, NotFound, Session
from .sources import store

MOST_LETTERS, MOST_WIDTH, MOST_CONTIGS = 1_000_000, 16_384, 100_000
#: Bytes of an export that are sent at once.
PIECE = 1 << 20


class Api:
    """Each route gives (content type, bytes or pieces of them, headers)."""

    def __init__(self, session: Session) -> None:
        self.s = session

    def json(self, value: object) -> tuple[str, bytes, dict]:
        return "application/json", json.dumps(value, default=str).encode(), {}

    def get(self, path: list[str], q: dict[str, str]) -> tuple[str, bytes, dict]:
        s = self.s
        num = lambda k, d=None: int(q[k].replace(",", "")) if k in q else d
        match path:
            case ["health"]:
                return self.json({"status": "ok"} | s.summary())
            case ["genome"]:
                return self.json(s.summary() | {"contigs": [r.asDict() for r in s.contigs.orderBy("contig_id").limit(MOST_CONTIGS).collect()]})
            case ["tracks"]:
                return self.json(store.registry(s.spark, s.path))
            case ["tracks", name]:
                return self.track(name, *s.region(num("start"), num("end")), num("width", 1000))
            case ["features", name]:
                return self.features(name, *s.region(num("start"), num("end")), num("width", 1000), num("limit", 2000), q.get("kinds"))
            case ["sequence"]:
                a, b = s.region(num("start"), num("end"))
                if b - a > MOST_LETTERS:
                    raise ValueError("at most a million letters")
                return "text/plain", self.letters(a, b).encode(), {}
            case ["kmer"]:
                return self.json({"pos": num("pos"), "kmer": s.at_pos(num("pos", -1))})
            case ["queries", job]:
                return self.status(s.job(int(job)))
            case ["queries", job, view]:
                return self.view(s.job(int(job)), view, q, num)
        raise NotFound("/".join(path))

    def letters(self, start: int, end: int) -> str:
        own = store.table(self.s.spark, self.s.path, "tiles").join(self.s.contigs.select("contig_id", "offset"), "contig_id")
        at = F.col("offset") + F.col("at")
        rows = own.where((at < end) & (at + F.col("n") > start)).select(at.alias("pos"), "n", "bits").orderBy("pos").collect()  # within a million letters
        text = list("".join(store.unpacked(bytes(r.bits), r.n) for r in rows)) if rows else []
        base = rows[0].pos if rows else 0
        runs = store.table(self.s.spark, self.s.path, "runs").join(self.s.contigs.select("contig_id", "offset"), "contig_id").select((F.col("offset") + F.col("start")).alias("a"), (F.col("offset") + F.col("end")).alias("b"), "what")
        for r in runs.where((F.col("a") < end) & (F.col("b") > start)).orderBy(F.desc("what")).collect():
            for i in range(max(r.a, base) - base, min(r.b - base, len(text))):
                text[i] = "N" if r.what == "other" else text[i].lower()
        return "".join(text)[start - base : end - base]

    def track(self, name: str, start: int, end: int, width: int) -> tuple[str, bytes, dict]:
        info = next((t for t in store.registry(self.s.spark, self.s.path)["tracks"] if t["name"] == name), None)
        if info is None:
            raise NotFound(name)
        if not 1 <= width <= MOST_WIDTH:
            raise ValueError("width is between 1 and 16384")
        own = T.summary(self.s.spark.read.parquet(f"{self.s.path}/tracks/{name}"), info["length"], start, end, width)
        out = [(float("nan"), float("nan"))] * width
        for r in own.collect():
            out[r.col] = r["mean"], r.high
        return "application/octet-stream", b"".join(struct.pack("<ff", *x) for x in out), {"X-Width": str(width)}

    def features(self, name: str, start: int, end: int, width: int, limit: int, kinds: str | None) -> tuple[str, bytes, dict]:
        info = next((t for t in store.registry(self.s.spark, self.s.path)["features"] if t["name"] == name), None)
        if info is None:
            raise NotFound(name)
        own, asked = self.s.spark.read.parquet(f"{self.s.path}/features/{name}"), kinds.split(",") if kinds is not None else None
        own = own if asked is None else own.where(F.col("kind").isin(asked))
        mode, rows, total = FE.features_or_density(own, start, end, width, min(limit, 50_000))
        return self.json({"mode": mode, "total": total, "rows": [r.asDict() for r in rows.collect()]})

    def status(self, job: Job) -> tuple[str, bytes, dict]:
        out = {"id": job.id, "kmer": job.text, "max_n": job.max_n, "order": job.order, "state": job.state, "error": job.error}
        return self.json(out | ({"counts": self.s.status(job)} if job.state == "ready" else {}))

    def view(self, job: Job, view: str, q: dict[str, str], num) -> tuple[str, bytes, dict]:
        s, n = self.s, num("n")
        a, b = s.region(num("start"), num("end"))
        match view:
            case "raster":
                width, height = num("width", 1000), num("height", 500)
                cells = s.raster(job, a, b, width, height, num("row0", 0), num("row1"), n)
                out = bytearray(struct.pack("<HBB", 0, 255, 0) * (width * height))
                for r in views.packed(cells).collect():  # at most as many as the picture has cells
                    at = 4 * (r.y * width + r.x)
                    out[at : at + 4] = r.cell
                return "application/octet-stream", bytes(out), {"X-Width": str(width), "X-Height": str(height)}
            case "histogram":
                width, m = num("width", 1000), s._n(job, n)
                out = [0] * (width * (m + 1))
                for r in s.histogram(job, a, b, width, n).collect():
                    out[r.col * (m + 1) + r.mismatches] = r.sites
                return "application/octet-stream", struct.pack(f"<{len(out)}I", *out), {"X-Width": str(width), "X-Mismatches": str(m)}
            case "tree":
                rows = s.clades(job, num("row0", 0), num("row1", 1 << 40), num("min_rows", 2), num("limit", 20_000), n)
                return self.json([r.asDict() for r in rows.drop("query_id").collect()])
            case "variants":
                return self.json([r.asDict() for r in s.variants(job, num("row0", 0), num("limit", 100), n).drop("query_id").collect()])
            case "sites":
                own = views.sites_page(s.hits(job, n), a, b, num("limit", 5000)).join(s.contigs.select("contig_id", "name"), "contig_id")
                rows = own.orderBy("pos", "strand").select("name", (F.col("start") + 1).alias("start"), (F.col("start") + K.K).alias("end"), "strand", K.unpack(F.col("variant")).alias("variant"), "mismatches", "total").collect()
                return self.json({"total": rows[0].total if rows else 0, "sites": [{k: v for k, v in r.asDict().items() if k != "total"} for r in rows]})
            case "export":
                bed = q.get("format") == "bed"
                hit = s.hits(job, n).where((F.col("pos") + K.K > a) & (F.col("pos") < b))
                rows = views.export_rows(hit, s.contigs, bed, None if bed else s.ordered(job, n))
                head = [] if bed else ["contig\tstart\tend\tstrand\tkmer\tmismatches\trow\n"]
                return "text/plain", self.pieces(head, rows), {"Content-Disposition": f'attachment; filename="{job.text}_n{s._n(job, n)}.{"bed" if bed else "tsv"}"'}
        raise NotFound(view)

    def pieces(self, head: list[str], rows: DataFrame) -> Iterator[bytes]:
        """Lines in pieces; the driver holds one partition of rows and one piece."""
        held, size = head, 0
        for r in rows.toLocalIterator():
            held.append("\t".join(map(str, r)) + "\n")
            size += len(held[-1])
            if size >= PIECE:
                yield "".join(held).encode()
                held, size = [], 0
        yield "".join(held).encode()

    def post(self, path: list[str], body: dict) -> tuple[str, bytes, dict]:
        if path != ["queries"]:
            raise NotFound("/".join(path))
        if "kmer" in body:
            text = self.s.parse(body["kmer"])
        elif "pos" in body:
            text = self.s.at_pos(int(body["pos"]))
        else:
            text = self.s.at(body["contig"], int(body["start"]))
        job = self.s.submit(text, int(body.get("max_n", 10)), body.get("order", "per_n"), wait=False)
        return self.json({"id": job.id, "kmer": job.text, "state": job.state})


def serve(session: Session, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    api = Api(session)

    class Handler(BaseHTTPRequestHandler):
        def _do(self, method: str) -> None:
            at = urlsplit(self.path)
            path = [p for p in at.path.split("/") if p]
            try:
                if path[:1] != ["v1"]:
                    raise NotFound(at.path)
                if method == "POST":
                    got = api.post(path[1:], json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}"))
                elif method == "DELETE":
                    session.cancel(int(path[2]))
                    got = api.json({"state": session.job(int(path[2])).state})
                else:
                    got = api.get(path[1:], {k: v[-1] for k, v in parse_qs(at.query).items()})
                code = 200
            except NotFound as e:
                code, got = 404, api.json({"error": f"not found: {e}"})
            except RuntimeError as e:
                code, got = 409, api.json({"error": str(e)})
            except (ValueError, KeyError) as e:
                code, got = 400, api.json({"error": str(e)})
            kind, data, headers = got
            self.send_response(code)
            whole = isinstance(data, bytes)
            for k, v in {"Content-Type": kind, **({"Content-Length": str(len(data))} if whole else {"Connection": "close"}), **headers}.items():
                self.send_header(k, v)
            self.end_headers()
            for piece in [data] if whole else data:
                self.wfile.write(piece)
            self.close_connection = self.close_connection or not whole

        def do_GET(self) -> None:
            self._do("GET")

        def do_POST(self) -> None:
            self._do("POST")

        def do_DELETE(self) -> None:
            self._do("DELETE")

        def log_message(self, *_: object) -> None:
            return

    return ThreadingHTTPServer((host, port), Handler)


