"""Suffix-array dedup (operator 8).

Every byte that a ``WIDTH``-byte string covers which also starts earlier goes.

Method: Burrows-Wheeler transforms of shards are merged by iterative interleave
refinement; the rounds yield common prefixes and thereby the intervals of
suffixes that repeat ``WIDTH`` bytes, without sorting all suffixes again.  One
transform of a whole corpus fits no machine, so the corpus is first dealt by
content: a window of ``WIDTH`` bytes belongs to the bucket of its minimiser, the
``GRAM``-byte string in it with the least hash (the leftmost of equals).  Equal
windows have the same minimiser at the same place and thus meet in one bucket.
Consecutive windows of one minimiser travel as one segment.  Segments with
equal content (128 bits of hashes) need no comparison: all but the earliest
are repeats as a whole, which settles copies and frequent passages, before the
shuffle where they meet in one batch.  Only the earliest occurrences of
*different* segments of one minimiser, mostly the edges of passages, have their
bytes fetched, transformed and merged.

A bucket with more than ``LARGE`` such segments isn't held by one task.  It is
halved by how far its windows begin before the minimiser; the windows of a half
share a longer string, whose hash deals them to smaller buckets, which are
merged like any other or halved again.  A range of one place holds equal
windows only, so this ends.

"Earlier" means smaller doc_id (null last), then, for unequal rows of one
doc_id, the smaller text hash (128 bits), then the earlier start; rows equal in
id and text count as one document and get the same result, so a repeated row
removes nothing from its copy.  An empty table gives an empty result.  Texts are UTF-8 bytes,
null as empty; texts shorter than ``WIDTH`` keep all bytes.  Texts of any length
are read in pieces of ``PIECE`` bytes that overlap, so windows are not cut.
Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.bwt import prefix_classes
from wayfold.llm.store import documents, materialise

WIDTH = 100
GRAM = 32
#: Bytes that are hashed at a time; window places take 24 bits.
PIECE = 1 << 19
#: Bytes of a shard whose transform is built, and of segments that are merged together: what a core's own cache holds.
SHARD_BYTES = 12 << 10
TOGETHER = 24 << 10
#: Rows that a kernel gathers before it hands them on.
ROWS = 1 << 17
#: Segments of one bucket that a task holds; a larger one is halved by where its windows lie.
LARGE = 4096
#: Documents that the filter of marked documents takes, and its bits: a table of a few MB at most.
MOST_MARKED, MOST_BITS = 1 << 21, 23
LAST_ID = (1 << 63) - 1
SEED = 20240607

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= _MIX[0]
    h ^= h >> np.uint64(33)
    h *= _MIX[1]
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Polynomial hashes modulo 2^64 of any slices of a byte array, over random values of the bytes."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 61, 1 << 62)) * 2 + 1
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(self.up) < n:
            grown = lambda b: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]))
            self.up, self.down = grown(self.base), grown(self.inverse)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self.values[data] * self.up[: n - 1], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        """Hashes of data[start:end] for arrays of places, or for slices given as ranges."""
        return (self.sums[end] - self.sums[start]) * self.down[start]


class Segmenter:
    """Cuts byte arrays into segments: consecutive windows with one minimiser."""

    def __init__(self, width: int = WIDTH, gram: int = GRAM):
        self.width, self.gram, self.grams = width, gram, width - gram + 1
        self.first, self.second = Rolling(SEED), Rolling(SEED + 1)

    def place_of(self, gram: int, data: bytes) -> int:
        """Where a segment's minimiser begins in its bytes."""
        values = np.frombuffer(data, np.uint8)
        self.first.load(values)
        n = len(values) - self.gram + 1
        return int(np.flatnonzero(mixed(self.first.of(slice(0, n), slice(self.gram, n + self.gram))).view(np.int64) == gram)[0])

    def cut(self, data: np.ndarray, stops: np.ndarray):
        """start, windows, gram hash and content hash of each segment; ``stops``: where documents end in the data."""
        n = len(data)
        if n < self.width:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        self.first.load(data)
        self.second.load(data)
        k, windows = self.gram, n - self.width + 1
        gram = mixed(self.first.of(slice(0, n - k + 1), slice(k, n + 1)))
        least = (gram & ~np.uint64(0xFFFFFF)) | np.arange(len(gram), dtype=np.uint64)
        span = 1
        while span * 2 <= self.grams:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < self.grams:
            least = np.minimum(least[: windows], least[self.grams - span : self.grams - span + windows])
        where = (least[:windows] & np.uint64(0xFFFFFF)).astype(np.int64)
        # windows that lie in one document: the next stop is far enough
        place = np.arange(windows)
        room = np.repeat(stops, np.diff(np.concatenate([[0], stops])))[:windows] - place >= self.width
        cut = np.ones(windows, bool)
        cut[1:] = (where[1:] != where[:-1]) | (room[1:] != room[:-1])
        start = np.flatnonzero(cut)
        end = np.append(start[1:], windows)
        usable = room[start]
        start, end = start[usable], end[usable]
        return start, end - start, gram[where[start]], mixed(self.second.of(start, end + self.width - 1))


def _pieces(offsets: np.ndarray, piece: int, width: int):
    """(first doc, last doc + 1, from byte, to byte): several whole documents, or an overlapping part of a long one."""
    doc, n = 0, len(offsets) - 1
    while doc < n:
        if offsets[doc + 1] - offsets[doc] > piece:
            for at in range(int(offsets[doc]), int(offsets[doc + 1]) - width + 1, piece):
                yield doc, doc + 1, at, min(int(offsets[doc + 1]), at + piece + width - 1)
            doc += 1
            continue
        last = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + piece, "right")) - 1)
        yield doc, last, int(offsets[doc]), int(offsets[last])
        doc = last


SEGMENTS = "kh long, sh long, doc long, t1 long, t2 long, pn long"
#: pn = place << 8 | windows, with this bit for segments known to be repeats.
REPEAT = 128


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _segments(batches):
    """Segments of the documents of each batch; of equal ones in a batch, all but the earliest are marked as repeats."""
    segmenter = Segmenter()
    for batch in batches:
        data, offsets = _flat(batch.column("text"))
        ids, one, two = (batch.column(c).to_numpy() for c in ("doc", "t1", "t2"))
        found, size = [], 0
        for a, b, start, stop in _pieces(offsets, PIECE, WIDTH):
            stops = np.append(offsets[a + 1 : b], stop) - start
            at, windows, kh, sh = segmenter.cut(data[start:stop], np.unique(stops))
            doc = np.searchsorted(offsets[a + 1 : b + 1], at + start, "right") + a
            found.append((kh.view(np.int64), sh.view(np.int64), ids[doc], one[doc], two[doc], (at + start - offsets[doc]) << 8 | windows))
            size += len(at)
            if size > ROWS:
                yield from _combined(found)
                found, size = [], 0
        yield from _combined(found)


def _combined(found: list[tuple]):
    """Segments of several pieces; of equal ones all but the earliest are marked and may go anywhere."""
    if not found:
        return
    rows = [np.concatenate(c) for c in zip(*found, strict=True)]
    order = np.lexsort(rows[::-1])
    kh, sh, doc, t1, t2, pn = (c[order] for c in rows)
    again = np.zeros(len(kh), bool)
    again[1:] = (kh[1:] == kh[:-1]) & (sh[1:] == sh[:-1])
    # a document that stands there twice doesn't repeat itself
    twice = again.copy()
    twice[1:] &= (doc[1:] == doc[:-1]) & (t1[1:] == t1[:-1]) & (t2[1:] == t2[:-1]) & (pn[1:] == pn[:-1])
    pn = np.where(again, pn | REPEAT, pn)
    kh = np.where(again, doc * np.int64(-7046029254386353131) + pn, kh)  # any key: dealt evenly
    rows = [c[~twice] for c in (kh, sh, doc, t1, t2, pn)] if twice.any() else [kh, sh, doc, t1, t2, pn]
    for at in range(0, len(rows[0]), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 65536]) for c in rows], names=["kh", "sh", "doc", "t1", "t2", "pn"])


MARKS = "doc long, t1 long, t2 long, pn long, kh long"


def _marks(batches):
    """From segments sorted by kh, sh and order: repeats (kh null), and contested segments (kh as key).

    Contested are the earliest occurrences of different segments with one kh.
    What is carried from batch to batch is the last row and the first segment of
    its kh, if that isn't known to be contested yet.
    """
    last, pending = None, None
    names = ["doc", "t1", "t2", "pn"]
    for batch in batches:
        kh, sh, *rows = (batch.column(c).to_numpy() for c in ("kh", "sh", *names))
        out: list[tuple] = []

        def add(some, key=None, rows=None, out=out):
            n = len(some[0])
            out.append((*some, np.zeros(n, np.int64) if key is None else key, np.full(n, key is None)))

        known = rows[3] & REPEAT > 0
        add([*(c[known] for c in rows[:3]), rows[3][known] ^ REPEAT])
        kh, sh, *rows = (c[~known] for c in (kh, sh, *rows))
        if len(kh):
            same_kh, same_sh, twice = (np.zeros(len(kh), bool) for _ in range(3))
            same_kh[1:] = kh[1:] == kh[:-1]
            same_sh[1:] = same_kh[1:] & (sh[1:] == sh[:-1])
            twice[1:] = same_sh[1:] & np.logical_and.reduce([c[1:] == c[:-1] for c in rows])
            if last is not None:
                same_kh[0] = kh[0] == last[0]
                same_sh[0] = same_kh[0] and sh[0] == last[1]
                twice[0] = same_sh[0] and last[2:] == tuple(c[0] for c in rows)
            later = same_sh & ~twice  # a document that stands there twice doesn't repeat itself
            add([c[later] for c in rows])
            first = ~same_sh  # first of its segment
            run = np.cumsum(~same_kh)
            contested_run = np.bincount(run, first & same_kh, minlength=run[-1] + 1) > 0  # another segment of the same kh came before
            contested = first & contested_run[run]
            add([c[contested] for c in rows], kh[contested])
            if pending is not None and same_kh[0] and contested_run[run[0]]:
                add([np.array([c]) for c in pending], np.array([last[0]]))
                pending = None
            elif pending is not None and not same_kh[0]:
                pending = None
            # the last run: its first segment waits unless it has been given out
            a = int(np.searchsorted(run, run[-1]))
            if a or not same_kh[0]:
                pending = None if contested_run[run[-1]] else tuple(c[a] for c in rows)
            last = (kh[-1], sh[-1], *(c[-1] for c in rows))
        *columns, key, none = (np.concatenate(c) for c in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.array(key.astype(np.int64), mask=none)], names=[*names, "kh"])


CONTESTED = "key long, doc long, t1 long, t2 long, place long, gram int, lo int, hi int, bytes binary"
FIELDS = ["key", "doc", "t1", "t2", "place", "gram", "lo", "hi"]
TYPES = [pa.int64()] * 5 + [pa.int32()] * 3


def _contested_batch(columns, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)), pa.array(data, pa.binary())], names=[*FIELDS, "bytes"])


def _fetch(batches):
    """The bytes of the wanted segments of each document; where their minimiser lies is only sought if it is needed (gram -1)."""
    for batch in batches:
        for at in range(batch.num_rows):
            wanted = batch.column("wanted")[at].values
            text = batch.column("text")[at].as_py()
            pn = wanted.field("pn").to_numpy()
            place, size, n = pn >> 8, (pn & 127) + WIDTH - 1, len(pn)
            same = [np.full(n, batch.column(c)[at].as_py()) for c in ("doc", "t1", "t2")]
            yield _contested_batch(
                [wanted.field("kh").to_numpy(), *same, place, np.full(n, -1), np.zeros(n), np.full(n, WIDTH - GRAM)], [text[p : p + m] for p, m in zip(place.tolist(), size.tolist(), strict=True)]
            )


def joined(batches, rows: int = ROWS):
    """Batches of about ``rows`` rows from many small ones."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


SPANS = "doc long, t1 long, t2 long, start long, stop long"


def _spans(doc, t1, t2, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (doc, t1, t2, start, stop)], names=["doc", "t1", "t2", "start", "stop"])


class Segments:
    """Segments as arrays, with their bytes one after the other."""

    def __init__(self, columns: dict[str, np.ndarray], data: np.ndarray, sizes: np.ndarray):
        self.columns, self.data, self.sizes = columns, data, sizes

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Segments:
        data, offsets = _flat(batch.column("bytes"))
        return cls({c: batch.column(c).to_numpy() for c in FIELDS}, data, np.diff(offsets))

    def __len__(self) -> int:
        return len(self.sizes)

    def behind(self, other: Segments | None) -> Segments:
        if other is None or not len(other):
            return self
        return Segments({c: np.concatenate([other.columns[c], self.columns[c]]) for c in FIELDS}, np.concatenate([other.data, self.data]), np.concatenate([other.sizes, self.sizes]))

    def take(self, rows: np.ndarray) -> Segments:
        begin = (np.cumsum(self.sizes) - self.sizes)[rows]
        sizes = self.sizes[rows]
        flat = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return Segments({c: v[rows] for c, v in self.columns.items()}, self.data[flat], sizes)

    def same_as_before(self) -> np.ndarray:
        """Which segments equal the one before them in key and bytes."""
        wide = np.zeros((len(self), int(self.sizes.max(initial=0))), np.uint8)
        wide[np.arange(wide.shape[1]) < self.sizes[:, None]] = self.data
        key = self.columns["key"]
        same = np.zeros(len(self), bool)
        same[1:] = (key[1:] == key[:-1]) & (self.sizes[1:] == self.sizes[:-1]) & (wide[1:] == wide[:-1]).all(1)
        return same


def repeated_windows(rows: Segments, width: int = WIDTH, shard_bytes: int = SHARD_BYTES):
    """(doc, t1, t2, start, stop) of byte ranges whose windows also stand in an earlier segment."""
    doc, t1, t2, place = (rows.columns[c] for c in ("doc", "t1", "t2", "place"))
    rows = rows.take(np.lexsort((place, t2, t1, doc)))
    classes, starts = prefix_classes(rows.data, rows.sizes, width, shard_bytes)
    counts = rows.sizes - width + 1
    of = np.repeat(np.arange(len(rows)), counts)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = rows.columns["place"][of] + offset
    # segments of a document share no window, so windows stand in the order of their places already
    name = classes[starts[of] + offset]
    order = np.argsort(name, kind="stable")
    ordered = name[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(of)), 0))]
    # a repeat is a window that isn't at the same place as the first of its class (equal rows are one document, there twice)
    of_first = of[first]
    elsewhere = place[order] != place[first]
    for c in ("doc", "t1", "t2"):
        elsewhere |= rows.columns[c][of[order]] != rows.columns[c][of_first]
    repeat = np.zeros(len(of), bool)
    repeat[order] = elsewhere
    of, place = of[repeat], place[repeat]
    cut = np.ones(len(of), bool)
    cut[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(cut)
    end = np.append(at[1:], len(of)) - 1 if len(of) else at
    return *(rows.columns[c][of[at]] for c in ("doc", "t1", "t2")), place[at], place[end] + width


def halves(rows: Segments, segmenter: Segmenter) -> pa.RecordBatch:
    """Segments of a large bucket, cut in two by where their windows lie to the minimiser.

    Windows that begin ``a`` bytes before the minimiser, with ``a`` from lo to
    hi, all hold the bytes from lo before it to WIDTH - hi behind its start.
    Halving that range makes this common string longer, and its hash is the new
    key; for a single ``a`` it is the window.
    """
    out: list[list] = [[] for _ in FIELDS]
    data = []
    begin = np.cumsum(rows.sizes) - rows.sizes
    whole = rows.data.tobytes()
    for i in range(len(rows)):
        key, doc, t1, t2, place, gram, lo, hi = (int(rows.columns[c][i]) for c in FIELDS)
        text = whole[begin[i] : begin[i] + rows.sizes[i]]
        if gram < 0:
            gram = segmenter.place_of(key, text)
        mid = (lo + hi) // 2
        for a, b in ((lo, mid), (mid + 1, hi)):
            first, last = max(0, gram - b), min(len(text) - WIDTH, gram - a)  # of the windows
            if first > last or a > b:
                continue
            core = text[gram - a : gram - b + WIDTH]
            for to, value in zip(out, (xxhash.xxh64_intdigest(core, a * WIDTH + b) - (1 << 63), doc, t1, t2, place + first, gram - first, a, b), strict=True):
                to.append(value)
            data.append(text[first : last + WIDTH])
    return _contested_batch(out, data)


def _merger(large: int, equal: bool):
    """The kernel that merges the segments of each bucket, which come sorted by key (and by their bytes, if equal ones may come).

    It gives spans of repeats (key null), and what a bucket of more than
    ``large`` segments is cut to, for the next round.
    """

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        """A batch of spans in the columns of both."""
        n = batch.num_rows
        columns = {"key": pa.nulls(n, pa.int64()), "doc": batch.column("doc"), "t1": batch.column("t1"), "t2": batch.column("t2"), "place": batch.column("start"), "stop": batch.column("stop")}
        return pa.RecordBatch.from_arrays([columns.get(f.name, None) if f.name in columns else pa.nulls(n, f.type) for f in BOTH], schema=BOTH)

    def cut(rows: Segments, segmenter: Segmenter):
        for at in range(0, len(rows), large):
            batch = halves(rows.take(np.arange(at, min(len(rows), at + large))), segmenter)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.int64())], schema=BOTH)

    def run(batches):
        segmenter = Segmenter()
        held: Segments | None = None  # the open bucket
        over, last = None, None  # key of a bucket that is known to be large; the last segment seen
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = Segments.of(batch)
            if equal:
                rows, extra = rows.behind(last), 0 if last is None else 1
                same = rows.same_as_before()
                # the first of equal segments in a row; its place is known, as equal rows (one document twice) are no repeats
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(rows))))
                again = same & np.logical_or.reduce([rows.columns[c] != rows.columns[c][head] for c in ("doc", "t1", "t2", "place")])
                again[:extra] = False
                if again.any():
                    r = rows.take(np.flatnonzero(again))
                    yield found(_spans(*(r.columns[c] for c in ("doc", "t1", "t2", "place")), r.columns["place"] + r.sizes))
                last = rows.take(head[-1:])
                fresh = ~same
                fresh[:extra] = False
                rows = rows.take(np.flatnonzero(fresh))
                if not len(rows):
                    continue
            if over is not None:
                more = rows.columns["key"] == over
                if more.any():
                    yield from cut(rows.take(np.flatnonzero(more)), segmenter)
                    rows = rows.take(np.flatnonzero(~more))
                    if not len(rows):
                        continue
                over = None
            rows = rows.behind(held)
            key = rows.columns["key"]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            held = rows.take(np.arange(begin[-1], len(rows)))
            yield from merged(rows, begin[:-1], begin[1:], segmenter)
            if len(held) > large:
                yield from cut(held, segmenter)
                held, over = None, int(key[-1])
        if held is not None:
            yield from merged(held, np.zeros(1, np.int64), np.array([len(held)]), segmenter)

    def merged(rows: Segments, begin: np.ndarray, end: np.ndarray, segmenter: Segmenter):
        count = end - begin
        for b, e in zip(begin[count > large], end[count > large], strict=True):
            yield from cut(rows.take(np.arange(b, e)), segmenter)
        some = (count > 1) & (count <= large)
        inside = np.repeat(some, count)  # buckets stand side by side from row 0 on
        begin, end = begin[some], end[some]
        bytes_before = np.concatenate([[0], np.cumsum(rows.sizes)])
        size = np.cumsum(bytes_before[end] - bytes_before[begin])
        at = 0
        while at < len(begin):  # whole buckets, merged together
            upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER, "right")))
            b, e = begin[at], end[upto - 1]
            yield found(_spans(*repeated_windows(rows.take(np.flatnonzero(inside[b:e]) + b))))
            at = upto

    return run


BOTH = pa.schema([*(pa.field(c, t) for c, t in zip(FIELDS, TYPES, strict=True)), pa.field("bytes", pa.binary()), pa.field("stop", pa.int64())])


def _cut(batches):
    """doc_id, counts, digest and kept bytes' hash from text and its spans."""
    for batch in batches:
        out = [[], [], [], []]
        spans = batch.column("spans") if "spans" in batch.schema.names else None
        for i in range(batch.num_rows):
            text = batch.column("text")[i].as_py()
            kept, removed = removed_spans(text, spans[i].as_py() if spans is not None else None)
            out[0].append(len(text))
            out[1].append(sum(b - a for a, b in removed))
            out[2].append(len(removed))
            out[3].append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_spans(text: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    """The kept bytes, and the maximal removed runs."""
    merged: list[list[int]] = []
    for s in sorted((s["start"], s["stop"]) for s in spans or []):
        if merged and s[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s[1])
        else:
            merged.append(list(s))
    pieces, at = [], 0
    for a, b in merged:
        pieces.append(text[at:a])
        at = b
    return b"".join([*pieces, text[at:]]), [(a, b) for a, b in merged]


class Marked:
    """A filter of the documents that ``rows`` names: no false negatives; false positives only cost a shuffled row.

    It is a table of words of 32 bits, sized by the number of documents and
    joined by broadcast, so that only texts it holds are shuffled.  For more than
    ``MOST_MARKED`` documents the table would be too large to send: then all
    texts are held, and the join by key sorts them out.
    """

    def __init__(self, rows: DataFrame):
        n = rows.count()
        self.words = None
        if n <= MOST_MARKED:
            bits = min(MOST_BITS, max(16, (8 * n).bit_length()))
            self.bit = f"(xxhash64(doc, t1, t2) & {(1 << bits) - 1})"
            bit = F.expr(self.bit)
            words = rows.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 31 AS int)))").alias("_bits"))
            self.words = F.broadcast(materialise(words, "filter", 1))

    def _join(self, rows: DataFrame, how: str) -> DataFrame:
        return rows.join(self.words, F.expr(f"shiftright({self.bit}, 5) = _word AND (shiftright(_bits, cast({self.bit} & 31 AS int)) & 1) = 1"), how)

    def held(self, rows: DataFrame) -> DataFrame:
        """Rows that may be marked."""
        return rows if self.words is None else self._join(rows, "left_semi")

    def free(self, rows: DataFrame) -> DataFrame:
        """The others."""
        return rows.where(F.lit(False)) if self.words is None else self._join(rows, "left_anti")


KEY = ["doc", "t1", "t2"]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, its place in the order (doc: the id, null last; t1 and t2: 128 bits of the text's hash) and the text as bytes."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2"), "text")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """doc, t1, t2 and spans (array of start, stop, unmerged) of the documents with repeated bytes."""
    rows = keyed(docs, id_col, text_col)
    segments = rows.select(*KEY, "text").mapInArrow(_segments, SEGMENTS)
    marks = segments.repartition("kh").sortWithinPartitions("kh", "sh", *KEY, "pn").mapInArrow(_marks, MARKS)
    marks = materialise(marks, "marks")  # its shuffle, the largest, can go
    contested = marks.where(F.col("kh").isNotNull())
    wanted = contested.groupBy(*KEY).agg(F.collect_list(F.struct("kh", "pn")).alias("wanted"))  # within one text's size
    texts = Marked(contested.select(*KEY)).held(rows.select(*KEY, "text"))
    todo = texts.join(wanted, KEY).mapInArrow(lambda batches: joined(_fetch(batches), 8192), CONTESTED)
    place = F.shiftright("pn", 8)
    spans = marks.where(F.col("kh").isNull()).select(*KEY, place.alias("start"), (place + F.col("pn").bitwiseAND(F.lit(127)) + (WIDTH - 1)).alias("stop"))
    order, equal = ["key", *KEY, "place"], False
    while True:  # a round for each halving that large buckets need; seven halve a range to one window
        merged = materialise(todo.repartition("key").sortWithinPartitions(*order).mapInArrow(_merger(large, equal), CONTESTED + ", stop long"), "merged")
        spans = spans.unionByName(merged.where(F.col("key").isNull()).select(*KEY, F.col("place").alias("start"), "stop"))
        todo = merged.where(F.col("key").isNotNull()).drop("stop")
        if todo.isEmpty():
            break
        order, equal = ["key", "bytes", *KEY, "place"], True
    return materialise(spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kernel=_cut, schema: str = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", large: int = LARGE) -> DataFrame:
    """One row per document; only texts that lose bytes are shuffled."""
    rows, spans = keyed(docs, id_col, text_col), repeats(docs, id_col, text_col, large)
    marked = Marked(spans)
    clean = marked.free(rows).select("doc_id", "text").mapInArrow(kernel, schema)
    touched = marked.held(rows).join(spans, KEY, "left").select("doc_id", "text", "spans").mapInArrow(kernel, schema)
    return clean.unionByName(touched)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the bytes that stay."""

    def run(batches):
        for batch in batches:
            spans = batch.column("spans") if "spans" in batch.schema.names else None
            kept = [removed_spans(batch.column("text")[i].as_py(), spans[i].as_py() if spans is not None else None)[0] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary())], names=["doc_id", "kept"])

    return deduplicate(docs, id_col, text_col, run, "doc_id long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir))
