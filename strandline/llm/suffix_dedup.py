"""Exact substring dedup: every byte covered by a 200-byte string that also starts anywhere else is removed.

1. Shards.  A window is a 200-byte string at a place of a text.  Its minimizer is the least hash among its 24-byte strings, so
   equal windows have equal minimizers.  Neighbouring windows with one minimizer form a super-window, at most 177
   windows long: every window lies in one, and equal windows meet in the group of their minimizer.  Minimizers of
   one super-window, once in it, leave at once: their windows are unique.
2. Copies.  Equal super-windows of a group are counted and one of them is kept, whole, with the count.
3. Suffix order.  The super-windows of a group are a collection whose documents are their 25 phases, each a run of 25-byte symbols
   (named by 64-bit hashes), so that a window is 8 symbols of one phase.  Column by column from the right, one symbol of each document is inserted per round,
   and each round rewrites the collection's transform and its common prefixes in one sequential pass.  Many
   groups advance together as separate stretches of the same pass.
4. A window repeats if the common prefix with a neighbour is 8 symbols, or its super-window has copies.  Names only find: the bytes of
   neighbours are compared, and those of copies by a digest of the one that was kept.  Repeated windows go back to all copies, and the covered
   bytes are cut out.

The transform is kept as its inverse: `tail[i]`, the place of the suffix after the first symbol of suffix i.  The symbol before
the suffix at tail[i] (the transform's letter there) is the first symbol of i.  `order_suffixes` gives both, and the prefixes.
A pass of many small groups, PASS_SUFFIXES suffixes together, has its columns as arrays in memory.  A group that is larger alone has them as
files in the shared folder (`order_from_files`): one for each column of symbols, and four for the suffixes so far (symbol, tail, prefix, owner), which each
round reads once from the front for the new places, once for the prefixes, and once to merge them with the new suffixes into the next four.

Hot groups.  A minimizer with more than HOT different super-windows is dealt anew: windows whose minimizer stands
at the same sixteenth of places before it share 185 bytes, and the hash of those bytes parts the group.  If more than HOT pieces still share them (a
passage with very many continuations), their windows are counted one by one by a 16-byte digest of all 200 bytes, which needs no task to hold a group.

Plan.  Texts are never shuffled: each of three scans works on the same file partitions, and what concerns a partition is handed to it
as files in the shared folder.  Input that is no plain scan is written there first.

Cases.  A null text is empty.  Texts under 200 bytes lose nothing.  Rows that repeat, share a doc_id or have none are all kept and
count as texts of their own.  Extra columns are ignored whatever their names.  An empty table gives no rows.  Long texts are
treated whole.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut, drop, hand, handed, in_arrow, new_folder, partitions, same_text, small_batches, stable, store_of
from .token_files import in_parts

LENGTH, GRAM, SYMBOL = 200, 24, 25
REACH = LENGTH - GRAM + 1
DEPTH = LENGTH // SYMBOL
HOT, BLOCK = 1000, 16
PASS_SUFFIXES = 200_000
#: Entries of a column file that are in memory at once.
CHUNK = 1 << 16

_RNG = np.random.default_rng(20_240_303)
LETTER = _RNG.integers(1, 1 << 63, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
FACTOR = _RNG.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
PLACE = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on; the last places have no meaning."""
    n = len(data)
    h, b, span = LETTER[data], int(BASE), 1
    while span < 8:
        h[: n - span] = h[: n - span] * np.uint64(b) + h[span:]
        b, span = b * b % (1 << 64), span * 2
    if n <= 16:
        return _mix(h)
    g = h.copy()
    g[: n - 16] = h[: n - 16] * np.uint64(0xC2B2AE3D27D4EB4F) + h[8 : n - 8] * np.uint64(0x165667B19E3779F9) + h[16:]
    return _mix(g)


def symbol_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the SYMBOL bytes from each place on, which names the symbol."""
    g = gram_hashes(data)
    g[:-GRAM] = _mix(g[:-GRAM] * BASE + LETTER[data[GRAM:]])
    return g


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    m, span = x.copy(), 1
    while span * 2 <= width:
        m[: len(m) - span] = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    d = width - span
    if d:
        m[: len(m) - d] = np.minimum(m[: len(m) - d], m[d:])
    return m


def super_windows(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """text (index), start, n (windows), anchor (place of the minimizer from the start), own (whether it comes more than once in there), h (its
    hash), d (hash of the whole) of every super-window."""
    size = np.array([len(x) for x in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    base = np.cumsum(size) - size
    none = np.zeros(0, np.int64)
    if not (size >= LENGTH).any():
        return none, none, none, none, none, none, none
    g = gram_hashes(data)
    packed = sliding_least((g & ~PLACE) | (np.arange(len(g), dtype=np.uint64) & PLACE), REACH)
    text = np.repeat(np.arange(len(raw)), np.maximum(size - LENGTH + 1, 0))
    first = np.cumsum(np.maximum(size - LENGTH + 1, 0)) - np.maximum(size - LENGTH + 1, 0)
    at = np.arange(len(text)) - first[text] + base[text]
    where = (packed[at] & PLACE).astype(np.int64)  # a part has fewer than 2 ** 24 bytes, but for one long text
    where += at & ~int(PLACE)
    where += np.where(where < at, int(PLACE) + 1, 0)
    h = g[where]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))
    # Runs of one hash are cut after REACH windows, so that periodic text makes no endless run.
    start = np.flatnonzero(new)
    long = np.flatnonzero(np.diff(np.concatenate((start, [len(text)]))) > REACH)
    if len(long):
        ends = np.concatenate((start, [len(text)]))
        new[np.concatenate([np.arange(ends[i], ends[i + 1], REACH) for i in long])] = True
        start = np.flatnonzero(new)
    n = np.diff(np.concatenate((start, [len(text)])))
    s = at[start]
    # The hash of a super-window: those of its strings of GRAM bytes side by side, and of its last ones.
    steps = np.minimum(np.arange(0, REACH + LENGTH, GRAM), (n + LENGTH - 1 - GRAM)[:, None])
    d = _mix((g[s[:, None] + steps] ^ (steps.astype(np.uint64) * BASE)) * FACTOR[: steps.shape[1]]).sum(1, dtype=np.uint64) + n.astype(np.uint64) * BASE
    return text[start], s - base[text[start]], n, where[start] - s, where[start + n - 1] != where[start], h[start].view(np.int64), d.view(np.int64)


def order_suffixes(symbols: np.ndarray, first: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of a collection in order, by column-wise insertion.

    Document d of group[d] has the symbols symbols[first[d] : first[d] + size[d]].  Gives, in suffix order (group first), the document and the
    length of each suffix, its tail's place (-1: none), and its common prefix with the suffix before it; ends of documents differ from all."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    bits = max(1, int(len(symbols) + 1).bit_length())
    rank += np.repeat(group.astype(np.int64) << bits, size)
    rank <<= bits
    low = np.int64((1 << bits) - 1)
    place = np.zeros(len(size), np.int64)  # of each document's last inserted suffix, plus one
    keyed = np.zeros(0, np.int64)  # first symbol, and the tail's place plus one, of each suffix in order
    prefix = np.zeros(0, np.int8)
    owner = np.zeros(0, np.int32)  # the symbol's own number, which tells document and length
    by_size = np.argsort(-size, kind="stable")
    falling = -size[by_size]
    end = first + size
    for j in range(1, int(size.max(initial=0)) + 1):
        docs = by_size[: np.searchsorted(falling, -j, "right")]
        q = rank[end[docs] - j] | place[docs]
        order = np.argsort(q, kind="stable")
        docs, q = docs[order], q[order]
        m, n = len(docs), len(keyed)
        at = np.searchsorted(keyed, q)
        new = at + np.arange(m)
        tail = q & low
        # Common prefixes: one more than the least between the two tails, if the first symbols agree.
        fresh = np.zeros(m, np.int8)
        again = np.zeros(m, bool)
        np.equal(at[1:], at[:-1], out=again[1:])  # stands right after another new suffix
        before = np.empty(m, np.int64)
        before[0] = -1
        before[1:] = q[:-1]
        if n:
            before = np.where(again, before, np.where(at > 0, keyed[at - 1], -1))
        ask = np.flatnonzero((before ^ q) >> bits == 0)
        fresh[ask] = 1
        if n:
            before_tail = before & low
            deep = ask[(before_tail[ask] > 0) & (tail[ask] > 0)]
            last = np.ones(m, bool)
            last[:-1] = ~again[1:]
            after = np.flatnonzero(last & (at < n))
            beyond = keyed[at[after]]
            agree = (beyond ^ q[after]) >> bits == 0
            after, next_tail = after[agree], beyond[agree] & low
            both = (next_tail > 0) & (tail[after] > 0)
            spans = np.concatenate((np.stack((before_tail[deep], tail[deep]), 1), np.stack((tail[after][both], next_tail[both]), 1)))
            changed = np.ones(len(after), np.int8)
            if len(spans):
                least = np.minimum.reduceat(np.append(prefix, np.int8(0)), spans.ravel())[::2]
                fresh[deep] += least[: len(deep)]
                changed[both] += least[len(deep) :]
            prefix[at[after]] = changed
            # Places move by the number of new suffixes before them; tails follow.
            moved = np.zeros(n + 1, np.int64)
            moved[1:] = np.cumsum(np.bincount(at, minlength=n + 1)[:n])
            keyed += moved[keyed & low]
            q += moved[tail]
            place += moved[place]
            old = moved[1:] + np.arange(n)
        else:
            old = np.zeros(0, np.int64)
        # The pass: old and new suffixes merge.
        merged = []
        for was, put in ((keyed, q), (prefix, fresh), (owner, (end[docs] - j).astype(np.int32))):
            out = np.empty(n + m, was.dtype)
            out[old] = was
            out[new] = put
            merged.append(out)
        keyed, prefix, owner = merged
        place[docs] = new + 1
    doc = np.repeat(np.arange(len(size), dtype=np.int32), size)[owner]
    return doc, end[doc] - owner, (keyed & low) - 1, prefix


class _Columns:
    """Sequential files of numbers in the shared folder: written from the front, read from the front."""

    def __init__(self, uri: str) -> None:
        self.store, self.folder = store_of(uri)
        self.store.create_dir(self.folder, recursive=True)

    def writer(self, name: str) -> pa.NativeFile:
        return self.store.open_output_stream(f"{self.folder}/{name}")

    def chunks(self, kinds: dict[str, str], at: str) -> Iterator[tuple[np.ndarray, ...]]:
        """The columns of a round side by side, CHUNK entries at a time."""
        files = [self.store.open_input_stream(f"{self.folder}/{k}-{at}") for k in kinds]
        types = [np.dtype(t) for t in kinds.values()]
        try:
            while True:
                got = [np.frombuffer(f.read(CHUNK * t.itemsize), t) for f, t in zip(files, types, strict=True)]
                if not len(got[0]):
                    return
                yield tuple(got)
        finally:
            for f in files:
                f.close()

    def drop(self, *names: str) -> None:
        for n in names:
            self.store.delete_file(f"{self.folder}/{n}")

    def close(self) -> None:
        self.store.delete_dir(self.folder)


STATE = {"symbol": "<u8", "tail": "<i8", "prefix": "|i1", "owner": "<i8"}


def order_from_files(files: _Columns, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """order_suffixes() of one group, whose symbols are in the files `column-j` (the j-th from the right of every document that long, in order).

    In memory are a few numbers for each document and CHUNK entries of each file."""
    place = np.zeros(len(size), np.int64)  # of each document's last inserted suffix, plus one
    n = 0
    for j in range(1, int(size.max(initial=0)) + 1):
        docs = np.flatnonzero(size >= j)
        symbol = np.concatenate([x for (x,) in files.chunks({"column": "<u8"}, str(j))])
        tail = place[docs]
        order = np.lexsort((tail, symbol))
        docs, symbol, tail = docs[order], symbol[order], tail[order]
        names, m, span = np.unique(symbol), len(docs), n + 2

        def keys(of: np.ndarray, tails: np.ndarray, names: np.ndarray = names, span: int = span) -> np.ndarray:
            """Numbers in the order of (symbol, tail): symbols that are new in this round are odd, what lies between them is even."""
            k = np.searchsorted(names, of)
            return (2 * k + (names[np.minimum(k, len(names) - 1)] == of)) * span + tails

        q = keys(symbol, tail)
        # First reading: where the new suffixes go, and what stands before and after.
        at, before, after = np.full(m, n), np.full(m, -1), np.full(m, -1)
        lo, base, last = 0, 0, -1
        if n:
            for old, tails in files.chunks({k: STATE[k] for k in ("symbol", "tail")}, str(j - 1)):
                k = keys(old, tails)
                hi = lo + int(np.searchsorted(q[lo:], k[-1], "right"))
                spot = np.searchsorted(k, q[lo:hi])
                at[lo:hi], after[lo:hi], before[lo:hi] = base + spot, k[spot], np.where(spot > 0, k[np.maximum(spot - 1, 0)], last)
                lo, base, last = hi, base + len(k), int(k[-1])
            before[lo:] = last
        again = np.zeros(m, bool)
        np.equal(at[1:], at[:-1], out=again[1:])
        before[1:] = np.where(again[1:], q[:-1], before[1:])
        ends = np.ones(m, bool)
        ends[:-1] = ~again[1:]
        # Common prefixes: one more than the least between the two tails, if the first symbols agree.
        fresh = ((before >= 0) & (before // span == q // span)).astype(np.int8)
        deep = np.flatnonzero((fresh > 0) & (before % span > 0) & (tail > 0))
        follows = np.flatnonzero(ends & (after >= 0) & (after // span == q // span))
        both = (after[follows] % span > 0) & (tail[follows] > 0)
        spans = np.concatenate((np.stack((before[deep] % span, tail[deep]), 1), np.stack((tail[follows][both], after[follows][both] % span), 1)))
        least, base = np.full(len(spans), 127, np.int8), 0
        if len(spans):  # second reading
            for (prefix,) in files.chunks({"prefix": STATE["prefix"]}, str(j - 1)):
                some = np.flatnonzero((spans[:, 0] < base + len(prefix)) & (spans[:, 1] > base))
                if len(some):
                    cut_ = np.stack((np.maximum(spans[some, 0], base) - base, np.minimum(spans[some, 1], base + len(prefix)) - base), 1)
                    least[some] = np.minimum(least[some], np.minimum.reduceat(np.append(prefix, np.int8(127)), cut_.ravel())[::2])
                base += len(prefix)
        fresh[deep] += least[: len(deep)]
        changed = np.ones(len(follows), np.int8)
        changed[both] += least[len(deep) :]
        where = at[follows]  # ascending, each once
        # Third reading: old and new suffixes merge.  Tails move by the number of new suffixes before them.
        new = {"symbol": symbol, "tail": tail + np.searchsorted(at, tail), "prefix": fresh, "owner": docs * 16 + j}
        out = {k: files.writer(f"{k}-{j}") for k in STATE}

        def put_out(old: dict[str, np.ndarray], lo: int, hi: int, base: int, out: dict = out, new: dict = new, at: np.ndarray = at) -> None:
            count = len(old["symbol"]) if old else 0
            spot = at[lo:hi] - base + np.arange(hi - lo)
            rest = np.ones(count + hi - lo, bool)
            rest[spot] = False
            for k, kind in STATE.items():
                row = np.empty(count + hi - lo, kind)
                row[spot] = new[k][lo:hi]
                if old:
                    row[rest] = old[k]
                out[k].write(row.tobytes())

        lo, base = 0, 0
        if n:
            for got in files.chunks(STATE, str(j - 1)):
                old = dict(zip(STATE, got, strict=True))
                c = len(got[0])
                old["tail"] = old["tail"] + np.searchsorted(at, old["tail"])
                x, y = np.searchsorted(where, (base, base + c))
                old["prefix"] = old["prefix"].copy()
                old["prefix"][where[x:y] - base] = changed[x:y]
                hi = int(np.searchsorted(at, base + c))
                put_out(old, lo, hi, base)
                lo, base = hi, base + c
        put_out({}, lo, m, n)
        for f in out.values():
            f.close()
        files.drop(f"column-{j}", *([f"{k}-{j - 1}" for k in STATE] if n else []))
        place += np.searchsorted(at, place)
        place[docs] = at + np.arange(m) + 1
        n += m
    got = [np.concatenate(x) for x in zip(*files.chunks({k: STATE[k] for k in ("owner", "tail", "prefix")}, str(int(size.max(initial=0)))), strict=True)]
    return (got[0] // 16).astype(np.int32), got[0] % 16, got[1] - 1, got[2]


def _named(pieces: list[bytes], phases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the documents of some pieces (phases: how many each has; size: how many symbols each has), one document after the other, and where each begins in the joined pieces."""
    length = np.array([len(p) for p in pieces], np.int64)
    phase = np.arange(len(size)) - np.repeat(np.cumsum(phases) - phases, phases)
    begin = np.repeat(np.cumsum(length) - length, phases) + phase
    first = np.cumsum(size) - size
    at = np.repeat(begin - SYMBOL * first, size) + SYMBOL * np.arange(size.sum())
    return symbol_hashes(np.frombuffer(b"".join(pieces), np.uint8))[at], begin


def _written(pieces: list[bytes], phases: np.ndarray, size: np.ndarray, files: _Columns) -> None:
    """Writes the columns of symbols, some pieces at a time."""
    out = {j: files.writer(f"column-{j}") for j in range(1, int(size.max()) + 1)}
    ends = np.cumsum(phases)
    for some in in_parts(range(len(pieces)), CHUNK, lambda i: len(pieces[i])):
        lo, hi = ends[some[0]] - phases[some[0]], ends[some[-1]]
        n = size[lo:hi]
        symbols, last = _named([pieces[i] for i in some], phases[some], n)[0], np.cumsum(n)
        for j, f in out.items():
            f.write(symbols[last[n >= j] - j].tobytes())
    for f in out.values():
        f.close()


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the windows that begin at a are those that begin at b, byte by byte."""
    for at in range(0, len(a), 10_000):
        step = np.arange(LENGTH)
        if not np.array_equal(data[a[at : at + 10_000, None] + step], data[b[at : at + 10_000, None] + step]):
            return False
    return True


def repeated_starts(pieces: list[bytes], windows: list[int], copies: list[int], group: np.ndarray, folder: str | None = None) -> list[np.ndarray]:
    """For each super-window, which of its windows occur elsewhere in its group.  folder: where one large group keeps its columns."""
    n = np.array(windows, np.int64)
    phases = np.minimum(n, SYMBOL)
    piece = np.repeat(np.arange(len(n)), phases)
    phase = np.arange(len(piece)) - np.repeat(np.cumsum(phases) - phases, phases)
    size = (n[piece] - 1 - phase) // SYMBOL + DEPTH  # a symbol more for each window after a document's first
    data = np.frombuffer(b"".join(pieces), np.uint8)
    length = np.array([len(p) for p in pieces], np.int64)
    begin = (np.cumsum(length) - length)[piece] + phase
    if folder is None:
        owner, left, _, prefix = order_suffixes(_named(pieces, phases, size)[0], np.cumsum(size) - size, size, group[piece])
    else:
        files = _Columns(f"{folder}/{uuid.uuid4().hex}")
        _written(pieces, phases, size, files)
        owner, left, _, prefix = order_from_files(files, size)
        files.close()
    out = [np.full(k, c > 1) for k, c in zip(windows, copies, strict=True)]
    flat, base = np.concatenate(out), np.cumsum(n) - n
    pair = np.flatnonzero(prefix >= DEPTH)
    start = begin[owner] + SYMBOL * (size[owner] - left)
    if not same_bytes(data, start[pair], start[pair - 1]):  # two names for one or one for two: by the bytes themselves
        seen: dict[tuple[int, bytes], int] = {}
        for k, (p, w) in enumerate(zip(pieces, windows, strict=True)):
            for i in range(w):
                key, here = (int(group[k]), p[i : i + LENGTH]), int(base[k]) + i
                flat[[here, there]] = True if (there := seen.setdefault(key, here)) != here else flat[here]
        return np.split(flat, np.cumsum(n)[:-1])
    hit = np.union1d(pair, pair - 1)
    d = owner[hit]
    flat[base[piece[d]] + phase[d] + SYMBOL * (size[d] - left[hit])] = True
    return np.split(flat, np.cumsum(n)[:-1])


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def covered(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal byte runs under the windows that begin in [a, b) runs."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    lo, hi = spans[:, 0], np.maximum.accumulate(spans[:, 1] + LENGTH - 1)
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    return list(zip(lo[new].tolist(), hi[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(hi) - 1]))].tolist(), strict=True))


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in batches:
        for x in batch.column(1).to_pylist():
            yield x or ""


def _encoded(texts: list[str]) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") for x in texts]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, row = TaskContext.get().partitionId(), 0
    for some in in_parts(_raw(batches), 1_000_000):
        raw = _encoded(some)
        text, start, n, anchor, own, h, d = super_windows(raw)
        t = np.array([zlib.crc32(x) for x in raw], np.int64)
        for at in range(0, len(text), 50_000):
            s = slice(at, at + 50_000)
            yield pa.RecordBatch.from_pydict({"part": np.full(len(text[s]), part, np.int32), "row": (text[s] + row).astype(np.int32), "t": t[text[s]], "start": start[s].astype(np.int32), "n": n[s].astype(np.int16), "anchor": anchor[s].astype(np.int16), "own": own[s].astype(bool), "h": h[s], "d": d[s]})
        row += len(raw)


SW = "part int, row int, t long, start int, n short, anchor short, own boolean, h long, d long"


def digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _pieces(path: str):
    """From the chosen super-windows of a partition, their bytes; hot ones in blocks with a second key."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        want = handed(path, part)
        if want is None:
            for _ in batches:
                pass
            return
        want = want.sort_by([("row", "ascending"), ("start", "ascending")])
        cols = {c: want.column(c).to_numpy() for c in ("row", "t", "start", "n", "anchor", "h", "d", "copies", "hot")}
        for some in in_parts(_raw(batches), 1_000_000):
            raw = _encoded(some)
            lo, hi = np.searchsorted(cols["row"], (row, row + len(raw)))
            out: list[tuple] = []
            same_text(raw, cols["row"][lo:hi] - row, cols["t"][lo:hi])
            for r, s, n, anchor, h, d, c, hot in zip(*(cols[k][lo:hi].tolist() for k in ("row", "start", "n", "anchor", "h", "d", "copies", "hot")), strict=True):
                data = raw[r - row][s : s + n + LENGTH - 1]
                z = digest(data)
                if hot:
                    out += [(h, k2, d, z, c, a, b - a, data[a : b + LENGTH - 1]) for k2, a, b in blocks_of(data, n, anchor)]
                else:
                    out.append((h, 0, d, z, c, 0, n, data))
            row += len(raw)
            for at in range(0, len(out), 20_000):
                x = list(zip(*out[at : at + 20_000], strict=True))
                kinds = (*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(x, kinds, strict=True)], names=["h", "k2", "d", "z", "copies", "off", "n", "data"])

    return step


def blocks_of(data: bytes, n: int, anchor: int) -> list[tuple[int, int, int]]:
    """(key, from, to) of runs of windows whose first minimizer stands in one sixteenth of places; the key hashes the bytes that all such windows share."""
    gram, places, p = data[anchor : anchor + GRAM], [], data.find(data[anchor : anchor + GRAM])
    while p >= 0:
        places.append(p)
        p = data.find(gram, p + 1)
    at = np.array(places, np.int64)
    start = np.arange(n)
    spot = at[np.searchsorted(at, start)]
    block = (spot - start) // BLOCK
    cut_at = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (spot[1:] != spot[:-1]))))
    out = []
    for a, b in zip(cut_at.tolist(), [*cut_at[1:].tolist(), n], strict=True):
        top = int(spot[a]) - int(block[a]) * BLOCK  # the last start of the block
        core = data[top : top - BLOCK + 1 + LENGTH]
        out.append((digest(core + bytes([int(block[a])])) or 1, a, b))
    return out


FOUND = "h long, d long, z long, a array<int>, b array<int>"


def _found(got: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*got, strict=True)) if got else [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h", "d", "z", "a", "b"])


def _collections(folder: str):
    """Rows sorted by h and k2: whole groups are gathered into passes; one that is large alone is a pass by itself, on files."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # of whole groups, and of the one that is being read
        weight, key, first, own = 0, None, 0, 0  # own: the weight of that one, which begins at row `first`

        def solve(some: list[tuple], files: str | None = None) -> pa.RecordBatch:
            change = np.array([i > 0 and some[i][:2] != some[i - 1][:2] for i in range(len(some))])
            flags = repeated_starts([r[7] for r in some], [r[6] for r in some], [r[4] for r in some], np.cumsum(change), files)
            return _found([(r[0], r[2], r[3], [r[5] + a for a, _ in x], [r[5] + b for _, b in x]) for r, f in zip(some, flags, strict=True) if (x := runs(f))])

        def finished() -> Iterator[pa.RecordBatch]:
            """After the last row of a group."""
            nonlocal rows, weight, first, own
            if own > PASS_SUFFIXES:
                yield solve(rows[first:], folder)
                rows, weight = rows[:first], weight - own
            if weight >= PASS_SUFFIXES:
                yield solve(rows)
                rows, weight = [], 0
            first, own = len(rows), 0

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:2] != key:
                    yield from finished()
                    key = r[:2]
                rows.append(r)
                weight += len(r[7])
                own += len(r[7])
        yield from finished()
        if rows:
            yield solve(rows)

    return step


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the pieces of crowded groups: its place in its super-window, and a digest of its bytes."""
    for batch in batches:
        out = []
        for h, _, d, z, c, off, n, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            out += [(h, d, z, c, off + i, hashlib.blake2b(data[i : i + LENGTH], digest_size=16).digest()) for i in range(n)]
        for at in range(0, len(out), 20_000):
            cols = zip(*out[at : at + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (*[pa.int64()] * 4, pa.int32(), pa.binary()), strict=True)], names=["h", "d", "z", "copies", "a", "w"])


def _cut_out(path: str, keep: list[str]):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        want = handed(path, part)
        cols = None
        if want is not None:
            row_of, sums_of, start, n, z = (want.column(c).to_numpy() for c in ("row", "t", "start", "n", "z"))
            many = pc.list_value_length(want.column("a")).to_numpy()
            a, b = (pc.list_flatten(want.column(c)).to_numpy() + np.repeat(start, many) for c in ("a", "b"))
            order = np.lexsort((a, np.repeat(row_of, many)))
            sums_of, *whole = (np.repeat(c, many)[order] for c in (sums_of, start, n, z))
            cols = np.repeat(row_of, many)[order], np.stack((a[order], b[order]), 1)
        for batch in batches:
            texts, n_removed, n_spans, sums, n_bytes, left, spans = batch.column(1).to_pylist(), [], [], [], [], [], []
            lo = np.searchsorted(cols[0], np.arange(row, row + len(texts) + 1)) if cols else np.zeros(len(texts) + 1, np.int64)
            for i, x in enumerate(texts):
                data = (x or "").encode("utf-8", "surrogatepass")
                found = []
                if lo[i + 1] > lo[i]:
                    same_text([data], np.zeros(1, np.int64), sums_of[lo[i] : lo[i] + 1])
                    for s, n, z in set(zip(*(c[lo[i] : lo[i + 1]].tolist() for c in whole), strict=True)):
                        if digest(data[s : s + n + LENGTH - 1]) != z:
                            raise ValueError("two different super-windows have one name")
                    found = covered(cols[1][lo[i] : lo[i + 1]])
                rest = data if not found else b"".join(data[a:b] for a, b in zip([0, *(e for _, e in found)], [*(s for s, _ in found), len(data)], strict=True))
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(rest))
                n_spans.append(len(found))
                sums.append(hashlib.sha256(rest).hexdigest())
                left.append(rest.decode("utf-8", "ignore") if x is not None else None)
                spans.append([{"start": a, "end": b} for a, b in found])
            row += len(texts)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_pydict(
                dict(zip(keep, batch.columns[2:], strict=True)) | {"doc_id": batch.column(0), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sums, pa.string()), "spans": pa.array(spans, kind), "kept_text": pa.array(left, pa.string())}
            )

    return step


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept_text string"


def dedup(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A row for each document: what is removed (byte runs), and the text that is left (a character that loses a byte goes whole).  keep: other columns to pass on."""
    keep = keep or []
    spark = docs.sparkSession
    small_batches(spark)
    texts = stable(docs, keep)
    bare = texts.select("doc_id", "text")
    found = cut(in_arrow(bare, _scan, SW), "super-windows")
    often = found.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("own")).where("c > 1 or own").select(F.col("h").alias("h2"))
    often = cut(often, "often")  # a written side lets Spark split a hot minimizer's rows
    shared = cut(found.join(often, F.col("h") == F.col("h2"), "left_semi"), "shared-windows")
    drop(found)
    drop(often)
    kinds = shared.groupBy("h", "d").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("part", "row", "t", "start", "n", "anchor")).alias("r"))
    kinds = cut(kinds.select("h", "d", "copies", "r.*"), "kinds")
    hot = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT).select(F.col("h").alias("h2"), F.lit(True).alias("hot"))
    wanted = hand(kinds.join(hot, F.col("h") == F.col("h2"), "left").select("part", "row", "t", "start", "n", "anchor", "h", "d", "copies", F.coalesce("hot", F.lit(False)).alias("hot")), "wanted")
    pieces = cut(in_arrow(bare, _pieces(wanted), "h long, k2 long, d long, z long, copies long, off int, n int, data binary"), "pieces")
    crowds = pieces.where("k2 <> 0").groupBy("h", "k2").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select(F.col("h").alias("hc"), F.col("k2").alias("kc"))
    crowds = cut(crowds, "crowds")
    same = (F.col("h") == F.col("hc")) & (F.col("k2") == F.col("kc"))
    grouped = pieces.join(crowds, same, "left_anti").repartition(partitions(spark), "h", "k2").sortWithinPartitions("h", "k2", "d", "off")
    repeats = in_arrow(grouped, _collections(new_folder(spark, "columns")), FOUND).select(F.col("h").alias("h2"), F.col("d").alias("d2"), "z", F.explode(F.arrays_zip("a", "b")).alias("s"))
    single = cut(in_arrow(pieces.join(crowds, same, "left_semi"), _windows, "h long, d long, z long, copies long, a int, w binary"), "crowded")
    twice = single.groupBy("w").agg(F.count(F.lit(1)).alias("c"), F.max("copies").alias("m")).where("c > 1 or m > 1").select(F.col("w").alias("w2"))
    single = single.join(twice, F.col("w") == F.col("w2"), "left_semi").select(F.col("h").alias("h2"), F.col("d").alias("d2"), "z", F.struct("a", (F.col("a") + 1).alias("b")).alias("s"))
    # All of a super-window's runs are one row, so each place that it stands in is met once, however many runs there are.
    runs_of = repeats.union(single).groupBy("h2", "d2", "z").agg(F.collect_list("s").alias("s"))
    again = shared.join(runs_of, (F.col("h") == F.col("h2")) & (F.col("d") == F.col("d2"))).select("part", "row", "t", "start", "n", "z", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    spans = hand(again, "spans")
    for table in (shared, kinds, pieces, crowds):
        drop(table)
    kinds_of = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes[2:])
    return in_arrow(texts, _cut_out(spans, keep), f"{kinds_of}, {CUT}" if keep else CUT)


def removed_rows(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
