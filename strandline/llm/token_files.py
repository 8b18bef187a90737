"""Token ids in Arrow files: equal-length sequences with masks, readable at any place without copying.

Files.  `write` deals documents by ascending `doc_id`, and the hash of their text, into ranges; each range becomes `ids-NNNNN.arrow`, an Arrow file
whose batches hold two fixed-size lists per row, `ids` (`seq_len` unsigned integers of the smallest width that
holds the vocabulary) and `mask` (true where an id is real; only the last row of a file is padded), and
`docs-NNNNN.arrow`, which says where each document begins.  Rows have equal length, so sequence *i* is at a known
place of a known batch, and a mapped file gives it as a view.

Cases.  A null or empty text is the end id alone.  A null `doc_id` comes first.  Rows with equal `doc_id` are all
kept, in order of that hash, and may stand in several files.  A task holds a batch of documents at a time, of its index too.  Columns besides the two named ones are ignored, whatever their names.  An empty table
gives no files and no rows.  Long texts are encoded whole.  A tokenizer whose description does not prove that pieces between spaces can be
encoded one by one encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import BATCH_ROWS, KEPT, in_arrow, new_folder, opened, partitions, put, small_batches

#: Words whose ids one Python worker keeps.
KEPT_WORDS = 400_000
ROWS_A_BATCH = 256
#: Letters, then marks that neither are letters, digits or white space nor begin with an apostrophe: the tokenizer parts them there.
WORD_THEN_MARKS = re.compile("([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!#$%&()*+,./:;=?@|-]*)").fullmatch


#: Fixed value: a pre-tokenizer's pattern none of whose matches holds white space, and which parts letters from the marks after them.
PARTING = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def parts_at_spaces(config: dict) -> bool:
    """Whether a tokenizer's own description proves that a text's ids are those of its pieces between spaces and line ends, one after the other.

    No step may look across a space.  Composition and case do not: a space joins with nothing and ends a word.  Runs of white space become one
    space, which the pattern then drops (only what it matches is kept, and no match holds white space).  Added tokens are looked for in the raw text, so they
    may neither hold nor strip white space, nor ask for word borders, nor be made of letters and the marks that WORD_THEN_MARKS parts.  The model sees one match at a time."""
    normal, pre, model = config.get("normalizer"), config.get("pre_tokenizer") or {}, config.get("model", {})
    steps = normal.get("normalizers", [normal]) if normal else []
    local = all(x["type"] in ("NFC", "NFD", "Lowercase") or x == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} for x in steps)
    split = {"type": "Split", "pattern": {"Regex": PARTING}, "behavior": "Removed", "invert": True}
    parts = pre.get("pretokenizers", [pre])
    parted = parts[:1] == [split] and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in parts[1:])
    plain = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or re.search(r"\s", x["content"]) or WORD_THEN_MARKS(x["content"])) for x in config.get("added_tokens", []))
    alone = model.get("type") == "BPE" and not model.get("dropout") and model.get("end_of_word_suffix") == "</w>"
    return local and parted and plain and alone and not config.get("truncation") and not config.get("padding")


class WordEncoder:
    """Encodes whole texts; if the tokenizer parts them at spaces (see `parts_at_spaces`), by their pieces, each distinct piece once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = parts_at_spaces(json.loads(self.tokenizer.to_str()))
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _each(self, pieces: list[str]) -> dict[str, bytes]:
        found = {}
        for at in range(0, len(pieces), 20_000):
            some = pieces[at : at + 20_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                found[w] = np.array(e.ids, self.width).tobytes()
        return found

    def _in_runs(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters alone, encoded many at a time and parted where an id ends a word; should the count differ, they go one by one."""
        found = {}
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            runs = self.tokenizer.encode_batch_fast([" ".join(some[i : i + 50]) for i in range(0, len(some), 50)], add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in runs), self.width)
            ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * self.width.itemsize).tolist()
            if len(ends) != len(some):
                found |= self._each(some)
                continue
            raw = ids.tobytes()
            found |= zip(some, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True)
        return found

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        words, rest, parts = [w for w in pieces if w.isalpha()], [], []
        for w in pieces.difference(words):
            if m := WORD_THEN_MARKS(w):
                parts.append((w, m[1], m[2]))
            else:
                rest.append(w)
        found = self._in_runs(words)
        found |= self._in_runs(list({x for _, x, _ in parts}.difference(found).difference(self.known)))
        marks = self._each(list({x for _, _, x in parts}))
        known = self.known
        return self._each(rest) | found | {w: (found.get(x) or known[x]) + marks[y] for w, x, y in parts}

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.parts:
            return [np.array(e.ids, self.width).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        pieces, known = [x.replace("\n", " ").split(" ") for x in texts], self.known
        new = self._learn(set(chain.from_iterable(pieces)).difference(known))
        known |= new
        out = [b"".join(map(known.__getitem__, x)) for x in pieces]
        if len(known) > KEPT_WORDS:
            for w in new:
                known.pop(w, None)
        return out

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) // self.width.itemsize for x in self.encode(texts)]


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder with the words it knows."""
    KEPT["words"] = _encoder.cache_clear
    return _encoder(path)


def in_parts(texts: Iterable, most: int = 8_000_000, length: Callable = len) -> Iterator[list]:
    """Runs of texts of about so many characters."""
    some, size = [], 0
    for x in texts:
        some.append(x)
        size += length(x)
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def _schema(width: np.dtype, seq_len: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(width), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class _Writer:
    """Turns a run of ids into rows of equal length, a batch at a time."""

    def __init__(self, sink: pa.NativeFile, width: np.dtype, seq_len: int) -> None:
        self.width, self.seq_len = width, seq_len
        self.file = pa.ipc.new_file(sink, _schema(width, seq_len))
        self.held, self.size = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        full = self.seq_len * ROWS_A_BATCH
        if self.size < full:
            return
        flat = np.concatenate(self.held)
        whole = len(flat) // full * full
        for at in range(0, whole, full):
            self._batch(flat[at : at + full], full)
        self.held, self.size = [flat[whole:].copy()], len(flat) - whole

    def _batch(self, ids: np.ndarray, real: int) -> None:
        parts = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, np.arange(len(ids)) < real)]
        self.file.write_batch(pa.RecordBatch.from_arrays(parts, schema=self.file_schema))

    @property
    def file_schema(self) -> pa.Schema:
        return _schema(self.width, self.seq_len)

    def close(self) -> None:
        if self.size:
            ids = np.zeros(-(-self.size // self.seq_len) * self.seq_len, self.width)
            ids[: self.size] = np.concatenate(self.held)
            self._batch(ids, self.size)
        self.file.close()


class TokenFile:
    """One file of ids: sequence i, or any run of ids, as views of the mapped file where it lies in one batch."""

    def __init__(self, uri: str) -> None:
        self.reader = pa.ipc.open_file(opened(uri))
        self.seq_len = self.reader.schema.field("ids").type.list_size
        self.at, self.values = -1, None

    def _batch(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.values = k, self.reader.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)
        return self.values

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        k, row = divmod(i, ROWS_A_BATCH)
        return self._batch(k)[row * self.seq_len : (row + 1) * self.seq_len], self.reader.get_batch(k).column("mask")[row].values

    def ids(self, start: int, n: int) -> np.ndarray:
        size, parts = self.seq_len * ROWS_A_BATCH, []
        while n:
            k, at = divmod(start, size)
            parts.append(self._batch(k)[at : at + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, "<u4"), *parts])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _texts(batches: Iterable[pa.RecordBatch], doc_ids: list) -> Iterator[str]:
    for batch in batches:
        doc_ids.extend(batch.column(0).to_pylist())
        for x in batch.column(1).to_pylist():
            yield x or ""


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, seq_len: int = 1024) -> list[dict]:
    """Writes the files; returns one entry a file, in order: its number, ids and documents."""
    spark = docs.sparkSession
    small_batches(spark)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        end = np.array([end_id], enc.width).tobytes()
        docs_of, n_ids, n_docs = [], 0, 0  # of documents that are read and not yet written

        def fill_both(sink: pa.NativeFile, index_sink: pa.NativeFile) -> None:
            nonlocal n_ids, n_docs
            out = _Writer(sink, enc.width, seq_len)
            with pa.ipc.new_file(index_sink, INDEX) as index:
                for some in in_parts(_texts(batches, docs_of)):
                    got = enc.encode(some)
                    n = np.array([len(x) // enc.width.itemsize + 1 for x in got], np.int64)
                    out.add(np.frombuffer(end.join([*got, b""]), enc.width))
                    index.write_batch(pa.RecordBatch.from_arrays([pa.array(docs_of[: len(some)], pa.int64()), pa.array(n_ids + np.cumsum(n) - n), pa.array(n)], schema=INDEX))
                    del docs_of[: len(some)]
                    n_ids, n_docs = n_ids + int(n.sum()), n_docs + len(n)
            out.close()

        put(f"{folder}/ids-{part:05d}.arrow", lambda sink: put(f"{folder}/docs-{part:05d}.arrow", lambda index_sink: fill_both(sink, index_sink)))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_ids": pa.array([n_ids], pa.int64()), "n_docs": pa.array([n_docs], pa.int64())})

    # A range may part the documents of one doc_id (or of none) by the hash of their texts, so they are many tasks too.
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.xxhash64("text").alias("hash"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    found = in_arrow(rows, step, "part int, n_ids long, n_docs long", "words").collect()  # as many rows as partitions
    return sorted((r.asDict() for r in found if r.n_docs), key=lambda r: r["part"])


def read_documents(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """A row for each document, from the files: its place in the whole run of ids, its number of ids and their checksum."""
    base, starts = 0, []
    for f in files:
        starts.append((f["part"], base))
        base += f["n_ids"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                part, first = starts[i]
                index = pa.ipc.open_file(opened(f"{folder}/docs-{part:05d}.arrow")).read_all()
                ids, n = TokenFile(f"{folder}/ids-{part:05d}.arrow"), index.num_rows
                start, size = (index.column(c).to_numpy() for c in ("start", "n_tokens"))
                sums = [zlib.crc32(ids.ids(s, k).astype("<u4").tobytes()) for s, k in zip(start.tolist(), size.tolist(), strict=True)]
                out = pa.table({"doc_id": index.column("doc_id"), "start": start + first, "n_tokens": size, "ids_crc32": pa.array(sums, pa.int64()), "file": pa.array([part] * n, pa.int32()), "file_start": start})
                yield from out.to_batches(max_chunksize=10 * BATCH_ROWS)

    n = max(1, len(starts))
    return in_arrow(spark.range(0, len(starts), 1, n), step, "doc_id long, start long, n_tokens long, ids_crc32 long, file int, file_start long")


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = 1, seq_len: int = 1024) -> DataFrame:
    folder = new_folder(docs.sparkSession, "token-files")
    return read_documents(docs.sparkSession, folder, write(docs, folder, tokenizer, end_id, seq_len))
