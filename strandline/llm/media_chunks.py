"""Media columns as content-defined chunks: a chunk store, ordered chunk lists, and verified reads.

`store` pads each payload with zero bytes to a positive multiple of 64 and cuts it where a rolling gear hash says.  The stored form of a
document is its chunk list: `CDC1`, the payload's length, the number of chunks, and for each chunk its 16-byte digest and length.  It is
written as a binary column.  Equal payloads have equal lists.

Chunk digests are deduplicated by Spark: every digest gets one home, the least place (partition, row, offset) that has it, however many documents hold it.
A second scan of the texts writes each partition's home chunks, and nothing else, into one container in the shared folder (compressed blocks and their
offsets).  `read` reads the lists back, joins their digests with the places of the chunks, rebuilds every payload in the order of its list, and checks
it against the digest taken when it was stored.

Plan.  Both scans read the same file partitions (see `stable`), and the second checks every chunk's digest.  The join moves a row for each chunk of a document, not
its bytes; a very common digest's rows are on the side that Spark can split.  Rows are then dealt by partition and SLICE documents, so that the
blocks of a container are read together.

Cases.  A null or empty text is 64 zero bytes.  Rows with equal or null `doc_id` are all kept.  Other columns are
ignored, whatever their names.  An empty table gives no rows.  Long texts are cut in more chunks; memory holds
one text, one batch, and a bounded number of blocks of containers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut, hand, handed, in_arrow, new_folder, opened, partitions, put, small_batches, stable
from .token_files import in_parts

UNIT = 64
#: Bytes of a chunk: least, most, and the bits of the hash that must be zero.
LEAST, MOST, BITS = 256, 4096, 10
WINDOW = 32
BLOCK = 1 << 18
KEPT_BLOCKS = 64
#: Documents of one scan partition that are read by one task.
SLICE = 1000
HEAD, HEAD_SIZE = "<4sQI", 16

GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)

LIST = "part int, row int, doc_id long, n_bytes long, sha binary, form binary, ends array<int>"
PLACE = "digest binary, h_part int, h_block int, h_off int"


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash of the last 32 bytes at each place, by doubling the window five times."""
    h, span = GEAR[data], 1
    while span < WINDOW:
        more = h.copy()
        more[span:] += h[:-span] << np.uint32(span)
        h, span = more, span * 2
    return h


def cuts(payloads: list[bytes]) -> list[list[int]]:
    """The ends of the chunks of each payload.  A cut depends on the last 32 bytes alone, and LEAST is more than that, so payloads can be hashed in one run."""
    found = np.flatnonzero(gear_hashes(np.frombuffer(b"".join(payloads), np.uint8)) & np.uint32((1 << BITS) - 1) == 0) + 1
    out, base = [], 0
    for p in payloads:
        lo, hi = np.searchsorted(found, (base, base + len(p)), "right")
        ends, last = [], 0
        for c in (found[lo:hi] - base).tolist():
            while c - last > MOST:
                last += MOST
                ends.append(last)
            if c - last >= LEAST:
                ends.append(last := c)
        while len(p) - last > MOST:
            last += MOST
            ends.append(last)
        if last < len(p):
            ends.append(len(p))
        out.append(ends)
        base += len(p)
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def form_of(data: bytes, ends: list[int]) -> bytes:
    """The stored form of a payload that is cut at these places."""
    return struct.pack(HEAD, b"CDC1", len(data), len(ends)) + b"".join(digest_of(data[a:b]) + struct.pack("<I", b - a) for a, b in zip([0, *ends], ends, strict=False))


class _Container:
    """Chunks of one scan partition: compressed blocks, then the offsets of the blocks."""

    def __init__(self, sink: pa.NativeFile) -> None:
        self.sink, self.press = sink, zstandard.ZstdCompressor(level=1)
        self.ends, self.block = [0], bytearray()

    def add(self, data: bytes) -> tuple[int, int]:
        """The block and the offset in it."""
        at = len(self.ends) - 1, len(self.block)
        self.block += data
        if len(self.block) >= BLOCK:
            self.flush()
        return at

    def flush(self) -> None:
        packed = self.press.compress(bytes(self.block))
        self.sink.write(packed)
        self.ends.append(self.ends[-1] + len(packed))
        self.block.clear()

    def close(self) -> None:
        if self.block:
            self.flush()
        self.sink.write(struct.pack(f"<{len(self.ends)}Q", *self.ends) + struct.pack("<Q", len(self.ends)))


class _Blocks:
    """Reads blocks of containers, and keeps the last ones."""

    def __init__(self, folder: str) -> None:
        self.folder, self.unpress = folder, zstandard.ZstdDecompressor()
        self.files: OrderedDict[int, tuple[pa.NativeFile, tuple]] = OrderedDict()
        self.kept: OrderedDict[tuple[int, int], bytes] = OrderedDict()

    def _file(self, part: int) -> tuple[pa.NativeFile, tuple]:
        if part not in self.files:
            f = opened(f"{self.folder}/chunks-{part:05d}.bin")
            size = f.size()
            n = struct.unpack("<Q", f.read_at(8, size - 8))[0]
            self.files[part] = f, struct.unpack(f"<{n}Q", f.read_at(8 * n, size - 8 - 8 * n))
            if len(self.files) > KEPT_BLOCKS:
                self.files.popitem(last=False)
        return self.files[part]

    def chunk(self, part: int, block: int, off: int, size: int) -> bytes:
        key = part, block
        if key in self.kept:
            self.kept.move_to_end(key)
        else:
            f, ends = self._file(part)
            self.kept[key] = self.unpress.decompress(f.read_at(ends[block + 1] - ends[block], ends[block]))
            if len(self.kept) > KEPT_BLOCKS:
                self.kept.popitem(last=False)
        return self.kept[key][off : off + size]


def lists_of(texts: DataFrame) -> DataFrame:
    """The chunk list of every document, with its place in the scan and the ends of its chunks."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids, at = batch.column(0), 0
            for some in in_parts([x or "" for x in batch.column(1).to_pylist()]):
                padded = [payload_of(x) for x in some]
                ends = cuts([p for p, _ in padded])
                n = len(some)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": np.full(n, part, np.int32), "row": np.arange(row, row + n, dtype=np.int32), "doc_id": doc_ids.slice(at, n), "n_bytes": pa.array([k for _, k in padded], pa.int64()),
                        "sha": pa.array([hashlib.sha256(p).digest() for p, _ in padded], pa.binary()), "form": pa.array([form_of(p, e) for (p, _), e in zip(padded, ends, strict=True)], pa.binary()), "ends": pa.array(ends, pa.list_(pa.int32())),
                    }
                )
                row, at = row + n, at + n

    return in_arrow(texts, step, LIST)


def uses_of(lists: DataFrame) -> DataFrame:
    """A row for each chunk of a document, as its list has it."""
    each = lists.select("part", "row", F.posexplode("ends").alias("seq", "end"), "ends", "form")
    digest = F.substring(F.col("form"), HEAD_SIZE + 1 + 20 * F.col("seq"), F.lit(16))
    return each.select("part", "row", "seq", digest.alias("digest"), F.when(F.col("seq") == 0, 0).otherwise(F.get("ends", F.col("seq") - 1)).alias("off"), "end")


def write_homes(texts: DataFrame, wanted: str, folder: str) -> DataFrame:
    """Writes each partition's home chunks (handed over in `wanted`) and gives their places."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        want = handed(wanted, part)
        if want is None:
            for _ in batches:
                pass
            return
        want = want.sort_by([("row", "ascending"), ("off", "ascending")])
        rows, off, end, digest = (want.column(c) for c in ("row", "off", "end", "digest"))
        rows, off, end = (x.to_numpy() for x in (rows, off, end))
        block, spot = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)

        def fill(sink: pa.NativeFile) -> None:
            nonlocal row
            box, done = _Container(sink), 0
            for batch in batches:
                for i, text in enumerate(batch.column(1)):
                    if done < len(rows) and rows[done] == row + i:
                        data = payload_of(text.as_py())[0]
                        while done < len(rows) and rows[done] == row + i:
                            chunk = data[off[done] : end[done]]
                            if digest_of(chunk) != digest[done].as_py():
                                raise ValueError("the scan's partitions have changed")
                            block[done], spot[done] = box.add(chunk)
                            done += 1
                row += batch.num_rows
            if done < len(rows):
                raise ValueError("the scan's partitions have changed")
            box.close()

        put(f"{folder}/chunks-{part:05d}.bin", fill)
        out = pa.table({"digest": digest.cast(pa.binary()), "h_part": np.full(len(rows), part, np.int32), "h_block": block, "h_off": spot})
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return in_arrow(texts, step, PLACE)


def store(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Writes the chunk lists and the containers; gives the lists, and the place of each different chunk."""
    small_batches(docs.sparkSession)
    texts = stable(docs, [])
    lists = cut(lists_of(texts), "chunk-lists")
    homes = uses_of(lists).groupBy("digest").agg(F.min(F.struct("part", "row", "off", "end")).alias("home"))
    wanted = hand(homes.select("home.part", "home.row", "home.off", "home.end", "digest"), "homes")
    return lists, cut(write_homes(texts, wanted, folder), "places")


def features(samples: np.ndarray) -> str:
    """Mean, deviation, entropy in bits, and the count of distinct values, of 8-bit samples."""
    n = np.bincount(samples, minlength=256)
    p = n[n > 0] / len(samples)
    mean = float((n @ np.arange(256)) / len(samples))
    dev = float(np.sqrt(max(0.0, (n @ np.arange(256) ** 2) / len(samples) - mean**2)))
    return f"mean={mean:.3f} dev={dev:.3f} bits={max(0.0, float(-(p * np.log2(p)).sum())):.3f} values={len(p)}"


def read(lists: DataFrame, places: DataFrame, folder: str) -> DataFrame:
    """Rebuilds every payload from its stored list and the places of its chunks, and describes it."""
    uses = uses_of(lists).select("part", "row", "seq", "digest", (F.col("end") - F.col("off")).alias("len"))
    met = uses.join(places, "digest").select("part", "row", "seq", "len", "h_part", "h_block", "h_off")
    heads = lists.select("part", "row", F.lit(-1).alias("seq"), "doc_id", "n_bytes", "sha", "form")  # a document's list comes before its chunks
    rows = met.unionByName(heads, allowMissingColumns=True).withColumn("slice", F.floor(F.col("row") / SLICE))
    rows = rows.repartition(partitions(lists.sparkSession), "part", "slice").sortWithinPartitions("part", "row", "seq")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, now, data, out = _Blocks(folder), None, [], []

        def done() -> None:
            doc_id, n, sha, form = now
            whole = b"".join(data)
            magic, size, chunks = struct.unpack_from(HEAD, form)
            got = hashlib.sha256(whole)
            if magic != b"CDC1" or size != len(whole) or chunks != len(data) or got.digest() != sha:
                raise ValueError(f"document {doc_id}: the stored payload does not give its digest")
            out.append((doc_id, n, size, got.hexdigest(), zlib.crc32(whole[-UNIT:]), len(form), hashlib.sha256(form).hexdigest(), features(np.frombuffer(whole, np.uint8)), chunks))

        def flushed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split(" ")[0] for x in ROW.split(", ")])

        for batch in batches:
            for seq, size, part, block, off, doc_id, n, sha, form in zip(*(batch.column(c).to_pylist() for c in ("seq", "len", "h_part", "h_block", "h_off", "doc_id", "n_bytes", "sha", "form")), strict=True):
                if seq < 0:
                    if now:
                        done()
                    now, data = (doc_id, n, sha, form), []
                else:
                    data.append(blocks.chunk(part, block, off, size))
            if len(out) >= 2000:
                yield flushed()
        if now:
            done()
        if out:
            yield flushed()

    return in_arrow(rows, step, ROW)


ROW = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"


def media_rows(docs: DataFrame) -> DataFrame:
    folder = new_folder(docs.sparkSession, "media")
    return read(*store(docs, folder), folder)

