"""Removal of repeated passages by a blockwise suffix sort with a difference cover.

All 100-byte strings of the corpus are suffix heads to be sorted; equal ones have to meet.
They are dealt into suffix buckets and one bucket is sorted at a time:

1. Each string belongs to the anchor that it holds: of its 32-byte windows, the one with the
   smallest hash. Consecutive strings share an anchor, so a document has one record for
   about 35 bytes: the anchor's hash, and a hash of the context that its strings cover.
   Records are bucketed by the anchor's hash. An anchor that occurs once has no repeated
   string; of equal contexts all but the first are repeats, without a look at their bytes:
   contexts are equal if two independent 64-bit hashes, seeded anew in each run, agree.
2. Only the first contexts of anchors with several different contexts are left. Their bytes
   are dealt into buckets by anchor, and each bucket's suffixes are sorted with the ranks
   of a difference cover (``cover_sort``), bounded by the bucket, whatever the corpus.
3. The repeats found in both ways are joined back to their documents.

A frequent passage would send the contexts around it, which all differ, to one bucket. So an
anchor with many contexts in one block, or in its bucket, is hot: its strings are dealt one by
one, by a hash of the whole string (128 bits as well), after each block has reduced equal ones
to the first.

There are as many buckets as the text needs, FAN groups of buckets at most are dealt out at
once: with more buckets a second pass deals each group into its buckets. So a block is never
cut into more pieces than FAN, and memory and work stay in proportion to the text.
"""

from __future__ import annotations

import pickle
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import materialize
from millrace.llm.cover_sort import PADDING, equal_classes

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1


@dataclass(frozen=True)
class Limits:
    """Sizes that bound memory; results don't depend on them."""

    #: Records that a mapper gathers before it deals them out, and bytes of contexts likewise.
    block: int = 400_000
    block_bytes: int = 16 << 20
    #: Suffixes that are sorted at once, and bytes of text for each bucket of records.
    bucket: int = 1_000_000
    bucket_text: int = 20 << 20
    #: Pieces that a block is cut into at most; more buckets are dealt in two passes.
    fan: int = 4096
    #: Different contexts of one anchor in a block, and in a bucket, beyond which the anchor is hot.
    hot_in_block: int = 64
    hot: int = 20_000


#: What a record is: a first context, a repeat, a context of a hot anchor, a mark that an anchor is hot.
FIRST, REPEAT, SINGLY, MARK = 0, 1, 2, 3
#: Longer texts are read in parts of so many bytes that overlap by a string.
PART = 1 << 22
_POSITION = np.uint64(PART * 2 - 1)
def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Two independent polynomial hashes of byte strings, made from a run's seed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.bytes = rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
        self.bases = [int(x) * 2 + 1 for x in rng.integers(0, 1 << 62, 2)]
        self._powers: list[list[np.ndarray]] = [[], []]

    def powers(self, k: int, n: int) -> list[np.ndarray]:
        """Powers of a hash's base and of its inverse modulo 2**64."""
        if not self._powers[k] or len(self._powers[k][0]) < n:
            size = max(n, 1 << 17)
            found = (self.bases[k], pow(self.bases[k], -1, 1 << 64))
            self._powers[k] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(x), dtype=np.uint64)]) for x in found]
        return self._powers[k]

    def sums(self, k: int, data: np.ndarray) -> np.ndarray:
        """From these the hash of any part of ``data`` is read."""
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.bytes[k][data] * self.powers(k, len(data) + 1)[0][: len(data)], out=out[1:])
        return out

    def anchors(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(anchor hash, context hash, other context hash, first start, last start)`` for each anchor of a text.

        The context of an anchor reaches from the first to the end of the last of the strings
        that it is the anchor of.
        """
        sums = self.sums(0, data)
        down = self.powers(0, len(data) + 1)[1]
        grams = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
        low = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = SPAN - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        at = (low & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:] - 1, len(at) - 1]
        shape = ((at[first] - first) << 8 | (last - first)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        contexts = []
        for k in (0, 1):
            sums, down = (sums, down) if k == 0 else (self.sums(1, data), self.powers(1, len(data) + 1)[1])
            contexts.append(_mix((sums[last + LENGTH] - sums[first]) * down[first] + shape))
        return grams[at[first]], *contexts, first, last

    def strings(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Both hashes of the string at each place."""
        out = []
        for k in (0, 1):
            sums, down = self.sums(k, data), self.powers(k, len(data) + 1)[1]
            out.append(_mix((sums[at + LENGTH] - sums[at]) * down[at]))
        return out


_HASHERS: dict[int, Hasher] = {}


def _hasher(seed: int) -> Hasher:
    if seed not in _HASHERS:
        _HASHERS.clear()
        _HASHERS[seed] = Hasher(seed)
    return _HASHERS[seed]


def parts(data: bytes, size: int = PART) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text that together hold each of its strings once."""
    for at in range(0, max(1, len(data) - LENGTH + 1), size):
        yield at, np.frombuffer(data, dtype=np.uint8)[at : at + size + LENGTH - 1]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, compressed."""
    head = pickle.dumps([(a.dtype.str, len(a)) for a in arrays])
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + planes)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    size = int.from_bytes(data[:4], "little")
    out, at = [], 4 + size
    for kind, n in pickle.loads(data[4:at]):
        dtype = np.dtype(kind)
        planes = np.frombuffer(data, dtype=np.uint8, count=n * dtype.itemsize, offset=at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += n * dtype.itemsize
    return out


@dataclass(frozen=True)
class Buckets:
    """How hashes are dealt into ``n`` buckets: straight, or by ``fan`` groups of buckets first."""

    n: int
    fan: int

    @property
    def two_passes(self) -> bool:
        return self.n > self.fan

    def of(self, hashes: np.ndarray, last: bool = False) -> np.ndarray:
        bucket = (hashes >> np.uint64(33)).astype(np.int64) % self.n
        return bucket % self.fan if self.two_passes and not last else bucket


def _present(labels: np.ndarray, *within: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each label that occurs, with its rows in the order of ``within``."""
    order = np.lexsort((*within[::-1], labels))
    found, first = np.unique(labels[order], return_index=True)
    for label, a, b in zip(found.tolist(), first, np.r_[first[1:], len(order)]):
        yield label, order[a:b]


def _deal(hashes: np.ndarray, docs: np.ndarray, ids: np.ndarray, tids: np.ndarray, labels: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A blob of records for each label, with a table of their documents."""
    for label, rows in _present(labels, hashes):
        held, index = np.unique(docs[rows], return_inverse=True)
        yield label, pack(ids[held], tids[held], hashes[rows], index.astype(np.uint32), *[c[rows] for c in columns])


def _deal_contexts(hashes: np.ndarray, docs: np.ndarray, ids: np.ndarray, tids: np.ndarray, labels: np.ndarray, first: np.ndarray, extent: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The same for contexts, whose bytes stand one after the other in ``text``."""
    lengths = extent.astype(np.int64) + LENGTH
    begins = np.cumsum(lengths) - lengths
    for label, rows in _present(labels, hashes):
        held, index = np.unique(docs[rows], return_inverse=True)
        n = lengths[rows]
        take = np.repeat(begins[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield label, pack(ids[held], tids[held], hashes[rows], index.astype(np.uint32), first[rows].astype(np.uint32), extent[rows].astype(np.uint8), text[take])


def _place_of(ids: np.ndarray, tids: np.ndarray) -> np.ndarray:
    return _mix(tids.view(np.uint64) ^ ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _deal_told(columns: list[np.ndarray], labels: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for label, rows in _present(labels, columns[0], columns[1], columns[3]):
        yield label, pack(*[c[rows] for c in columns])


def _blob_rows(dealt: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    found = list(dealt)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["bucket", "blob"])


def _redeal(batches: Iterator[pa.RecordBatch], buckets: Buckets, limits: Limits) -> Iterator[pa.RecordBatch]:
    """The second pass: blobs of a group of buckets as blobs of its buckets."""

    def rows(found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for size in sorted({len(f) for f in found}):
            own = [f for f in found if len(f) == size]
            if size == TOLD_COLUMNS:
                columns = [np.concatenate([f[i] for f in own]) for i in range(size)]
                yield _blob_rows(_deal_told(columns, buckets.of(_place_of(*columns[:2]), True)))
                continue
            ids, tids, hashes, docs, *columns = _joined(own)
            deal = _deal_contexts if size == CONTEXT_COLUMNS else _deal
            yield _blob_rows(deal(hashes, docs, ids, tids, buckets.of(hashes, True), *columns))

    for blobs in _by_bucket(batches):
        found, count = [], 0
        for blob in blobs:
            found.append(unpack(blob))
            count += sum(x.nbytes for x in found[-1])
            if count >= limits.block_bytes:
                yield from rows(found)
                found, count = [], 0
        if found:
            yield from rows(found)


def _record_blobs(docs: DataFrame, buckets: Buckets, limits: Limits, seed: int) -> DataFrame:
    """``(bucket, blob)``: anchors' records. Within a block only the first of equal contexts is sent; repeats are sent as such."""

    def flush(found: list, ids: list, tids: list) -> Iterator[tuple[int, bytes]]:
        hashes, contexts, others, first, last = (np.concatenate([f[i] for f in found]) for i in range(5))
        docs = np.repeat([f[5] for f in found], [len(f[0]) for f in found])
        ids, tids = np.array(ids, dtype=np.int64), np.array(tids, dtype=np.int64)
        order = np.lexsort((tids[docs], first, ids[docs], others, contexts, hashes))
        h, c, o = hashes[order], contexts[order], others[order]
        again = np.r_[False, (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (o[1:] == o[:-1])]
        lead = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
        # Rows repeated in the table are neither of them earlier.
        same = again & (ids[docs[order]] == ids[docs[lead]]) & (tids[docs[order]] == tids[docs[lead]]) & (first[order] == first[lead])
        anchor = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
        hot = np.bincount(anchor, weights=~again)[anchor] > limits.hot_in_block
        kind = np.where(again, REPEAT, np.where(hot, SINGLY, FIRST)).astype(np.uint8)
        marks = np.flatnonzero(hot & np.r_[True, h[1:] != h[:-1]])
        take = np.r_[np.flatnonzero(~same), marks]
        kind = np.r_[kind[~same], np.full(len(marks), MARK, dtype=np.uint8)]
        rows = order[take]
        # What its bucket only passes on goes by its document, so that no anchor gathers it.
        passed = (kind == REPEAT) | (kind == SINGLY)
        place = np.where(passed, _mix(tids[docs[rows]].view(np.uint64) + first[rows].astype(np.uint64)), hashes[rows])
        yield from _deal(place, docs[rows], ids, tids, buckets.of(place), contexts[rows], others[rows], first[rows].astype(np.uint32), (last - first)[rows].astype(np.uint8), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ids, tids, count = [], [], [], 0
        anchors = _hasher(seed).anchors
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                data = text.encode("utf-8", "replace") if text else b""
                if len(data) < LENGTH:
                    continue
                for at, part in parts(data):
                    h, c, o, first, last = anchors(part)
                    found.append((h, c, o, first + at, last + at, len(ids)))
                    count += len(h)
                ids.append(batch.column(0)[i].as_py())
                tids.append(batch.column(1)[i].as_py())
                if count >= limits.block:
                    yield _blob_rows(flush(found, ids, tids))
                    found, ids, tids, count = [], [], [], 0
        if found:
            yield _blob_rows(flush(found, ids, tids))

    return docs.mapInArrow(run, "bucket int, blob binary")


#: What buckets say to a document: ranges of starts of repeated strings, contexts whose bytes are
#: wanted, and contexts whose strings are wanted one by one.
_SAID = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("tid", T.LongType()),
    *[T.StructField(name, T.BinaryType()) for name in ("repeats", "wanted", "singly")],
])


class _Told:
    """Gathers what buckets say and deals it out by document, in blobs: a row for each part of the documents, not for each document.

    There are as many parts of the documents as buckets.
    """

    def __init__(self, parts: Buckets):
        self.parts, self.found, self.count = parts, [], 0

    def add(self, ids: np.ndarray, tids: np.ndarray, repeats: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        self.found.append((ids, tids, repeats.astype(np.uint8), starts.astype(np.uint32), (ends - starts).astype(np.uint32), hashes))
        self.count += len(ids)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.count:
            return
        columns = [np.concatenate([f[i] for f in self.found]) for i in range(TOLD_COLUMNS)]
        yield _blob_rows(_deal_told(columns, self.parts.of(_place_of(*columns[:2]))))
        self.found, self.count = [], 0


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document that is told something."""
    for blobs in _by_bucket(batches):
        found = [unpack(b) for b in blobs]
        ids, tids, repeats, starts, extents, hashes = (np.concatenate([f[i] for f in found]) for i in range(6))
        order = np.lexsort((starts, repeats, tids, ids))
        ids, tids, repeats, hashes = ids[order], tids[order], repeats[order], hashes[order]
        ranges = np.column_stack([starts[order], starts[order] + extents[order]]).astype(np.int32)
        bounds = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (tids[1:] != tids[:-1]), True])
        said: list[list] = [[], [], []]
        for a, b in zip(bounds[:-1], bounds[1:]):
            x, y = a + np.searchsorted(repeats[a:b], [REPEAT, SINGLY])
            said[0].append(ranges[x:y].tobytes() if x < y else None)
            said[1].append(hashes[a:x].tobytes() + ranges[a:x].tobytes() if a < x else None)
            said[2].append(ranges[y:b].tobytes() if y < b else None)
        yield pa.RecordBatch.from_arrays([pa.array(ids[bounds[:-1]]), pa.array(tids[bounds[:-1]]), *[pa.array(x, pa.binary()) for x in said]], _SAID.names)


#: Arrays in a blob of what documents are told, of contexts with their bytes, of single strings.
TOLD_COLUMNS, CONTEXT_COLUMNS, STRING_COLUMNS = 6, 7, 8


def _later(h: np.ndarray, o: np.ndarray, ids: np.ndarray, at: np.ndarray, tids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by both hashes and place, and in it which strings have an equal one before."""
    order = np.lexsort((tids, at, ids, o, h))
    h, o, ids, at, tids = h[order], o[order], ids[order], at[order], tids[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])][: len(h)]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return order, (ids != ids[lead]) | (at != at[lead]) | (tids != tids[lead])


def _gather(blobs: list[bytes]) -> list[np.ndarray]:
    return _joined([unpack(b) for b in blobs])


def _joined(found: list[list[np.ndarray]]) -> list[np.ndarray]:
    """One bucket's blobs as one: ids and tids of all documents, then the records' columns."""
    shift = np.cumsum([0] + [len(f[0]) for f in found])
    out = [np.concatenate([f[i] for f in found]) for i in range(len(found[0]))]
    out[3] = np.concatenate([f[3].astype(np.int64) + s for f, s in zip(found, shift)])
    return out


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blobs of one bucket after the other; the rows are sorted by bucket."""
    now, blobs = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if bucket != now and blobs:
                yield blobs
                blobs = []
            now = bucket
            blobs.append(blob.as_py())
    if blobs:
        yield blobs


def _sort_records(batches: Iterator[pa.RecordBatch], parts: Buckets, limits: Limits) -> Iterator[pa.RecordBatch]:
    out = _Told(parts)
    for blobs in _by_bucket(batches):
        ids, tids, h, doc, c, o, first, extent, kind = _gather(blobs)
        first = first.astype(np.int64)
        last = first + extent
        on = (kind == REPEAT) | (kind == SINGLY)
        out.add(ids[doc[on]], tids[doc[on]], kind[on], first[on], last[on], np.zeros(on.sum(), dtype=np.uint64))
        marked = np.unique(h[kind == MARK])
        own = np.flatnonzero(kind == FIRST)
        order = own[np.lexsort((tids[doc[own]], first[own], ids[doc[own]], o[own], c[own], h[own]))]
        h, doc, c, o, first, last = h[order], doc[order], c[order], o[order], first[order], last[order]
        start = np.r_[True, h[1:] != h[:-1]][: len(h)]
        other = (np.r_[True, (c[1:] != c[:-1]) | (o[1:] != o[:-1])][: len(h)]) | start
        group = np.cumsum(start) - 1
        lead = np.maximum.accumulate(np.where(other, np.arange(len(h)), 0))
        same = (ids[doc] == ids[doc[lead]]) & (tids[doc] == tids[doc[lead]]) & (first == first[lead])
        many = np.bincount(group, weights=other)[group] if len(h) else np.zeros(0)
        hot = np.isin(h, marked) | (many > limits.hot)
        kind = np.where(~other, REPEAT, np.where(hot, SINGLY, FIRST))
        told = (~other & ~same) | (other & ((many > 1) | hot))
        out.add(ids[doc[told]], tids[doc[told]], kind[told], first[told], last[told], np.where(kind[told] == FIRST, h[told], np.uint64(0)))
        if out.count >= limits.block:
            yield from out.rows()
    yield from out.rows()


def _context_blobs(batches: Iterator[pa.RecordBatch], buckets: Buckets, limits: Limits, seed: int) -> Iterator[pa.RecordBatch]:
    """``(bucket, blob)``: the bytes of wanted contexts, by anchor; hashes of single strings, by themselves."""
    expand = zstandard.ZstdDecompressor().decompress
    string_hashes = _hasher(seed).strings
    ids, tids, docs, hashes, ranges, texts, size = [], [], [], [], [], [], 0
    single: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

    def strings() -> pa.RecordBatch:
        """Of equal strings of the block the first; the others are repeats, which go by their document."""
        d = np.repeat([x[0] for x in single], [len(x[1]) for x in single])
        at, h, o = (np.concatenate([x[k] for x in single]) for k in (1, 2, 3))
        i, t = np.array(ids, dtype=np.int64), np.array(tids, dtype=np.int64)
        order, repeat = _later(h, o, i[d], at, t[d])
        d, at, h, o = d[order], at[order], h[order], o[order]
        place = np.where(repeat, _mix(t[d].view(np.uint64) + at.astype(np.uint64)), h)
        return _blob_rows(_deal(place, d, i, t, buckets.of(place), h, o, at.astype(np.uint32), repeat.astype(np.uint8)))

    def rows() -> pa.RecordBatch:
        h, r = np.concatenate(hashes), np.concatenate(ranges)
        i, t = np.array(ids, dtype=np.int64), np.array(tids, dtype=np.int64)
        return _blob_rows(_deal_contexts(h, np.repeat(docs, [len(x) for x in hashes]), i, t, buckets.of(h), r[:, 0], r[:, 1] - r[:, 0], np.concatenate(texts)))

    for batch in batches:
        for row in batch.to_pylist():
            data = np.frombuffer(expand(row["payload"]), dtype=np.uint8)
            if row["singly"]:
                r = np.frombuffer(row["singly"], dtype=np.int32).reshape(-1, 2).astype(np.int64)
                n = r[:, 1] - r[:, 0] + 1
                at = np.repeat(r[:, 0] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                single.append((len(ids), at, *string_hashes(data, at)))
                size += 24 * len(at)
            said = row["wanted"] or b""
            n = len(said) // 16
            r = np.frombuffer(said, dtype=np.int32, offset=8 * n).reshape(n, 2).astype(np.int64)
            hashes.append(np.frombuffer(said, dtype=np.uint64, count=n))
            ranges.append(r)
            docs.append(len(ids))
            lengths = r[:, 1] - r[:, 0] + LENGTH
            take = np.repeat(r[:, 0] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            texts.append(data[take])
            size += len(take)
            ids.append(row["id"])
            tids.append(row["tid"])
            if size >= limits.block_bytes:
                yield from (f() for f, x in ((rows, ranges), (strings, single)) if any(map(len, x)))
                ids, tids, docs, hashes, ranges, texts, single, size = [], [], [], [], [], [], [], 0
    yield from (f() for f, x in ((rows, ranges), (strings, single)) if any(map(len, x)))


def _sort_contexts(batches: Iterator[pa.RecordBatch], parts: Buckets, limits: Limits) -> Iterator[pa.RecordBatch]:
    out = _Told(parts)
    for found in _by_bucket(batches):
        blobs = [unpack(b) for b in found]
        single = [b for b in blobs if len(b) == STRING_COLUMNS]
        if single:
            ids, tids, _, doc, h, o, at, repeat = _joined(single)
            at = at.astype(np.int64)
            on = repeat == 1
            own = np.flatnonzero(~on)
            order, later = _later(h[own], o[own], ids[doc[own]], at[own], tids[doc[own]])
            gone = np.r_[np.flatnonzero(on), own[order][later]]
            out.add(ids[doc[gone]], tids[doc[gone]], np.full(len(gone), REPEAT), at[gone], at[gone], np.zeros(len(gone), dtype=np.uint64))
        blobs = [b for b in blobs if len(b) != STRING_COLUMNS]
        if not blobs:
            continue
        ids, tids, h, doc, first, extent, text = _joined(blobs)
        first, extent = first.astype(np.int64), extent.astype(np.int64)
        lengths = extent + LENGTH
        begins = np.cumsum(lengths) - lengths
        order = np.argsort(h, kind="stable")
        edges = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1], True])
        upto = np.r_[0, np.cumsum(extent[order] + 1)]
        at = 0
        while at < len(edges) - 1:  # one suffix bucket: whole anchors, about limits.bucket suffixes
            stop = max(at + 1, int(np.searchsorted(upto[edges], upto[edges[at]] + limits.bucket, side="right")) - 1)
            own = order[edges[at] : edges[stop]]
            at = stop
            n, size = extent[own] + 1, lengths[own]
            base = np.cumsum(size) - size
            data = np.zeros(size.sum() + PADDING, dtype=np.uint8)
            data[: size.sum()] = text[np.repeat(begins[own] - base, size) + np.arange(size.sum())]
            starts = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ranked, number = equal_classes(data, int(size.sum()), starts, LENGTH)
            context = own[np.searchsorted(base, ranked, side="right") - 1]
            offset = ranked - base[np.searchsorted(base, ranked, side="right") - 1] + first[context]
            d = doc[context]
            order2 = np.lexsort((tids[d], offset, ids[d], number))
            d, offset, number = d[order2], offset[order2], number[order2]
            lead = np.maximum.accumulate(np.where(np.r_[True, number[1:] != number[:-1]], np.arange(len(number)), 0))
            repeat = (ids[d] != ids[d[lead]]) | (tids[d] != tids[d[lead]]) | (offset != offset[lead])
            d, offset = d[repeat], offset[repeat]
            order2 = np.lexsort((offset, d))
            d, offset = d[order2], offset[order2]
            begin = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(d) else np.zeros(0, dtype=np.int64)
            end = np.r_[begin[1:] - 1, len(d) - 1] if len(d) else begin
            if len(begin):
                out.add(ids[d[begin]], tids[d[begin]], np.full(len(begin), REPEAT), offset[begin], offset[end], np.zeros(len(begin), dtype=np.uint64))
            if out.count >= limits.block:
                yield from out.rows()
    yield from out.rows()


@F.arrow_udf(T.BinaryType())
def _payload(texts: pa.Array) -> pa.Array:
    press = zstandard.ZstdCompressor(level=1).compress
    return pa.array([press((t.as_py() or "").encode("utf-8", "replace")) for t in texts], pa.binary())


def removed_spans(length: int, said: list[bytes]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by repeated strings that start in the given ranges."""
    if not said:
        return []
    ranges = np.concatenate([np.frombuffer(s, dtype=np.int32) for s in said]).reshape(-1, 2).astype(np.int64)
    edges = np.zeros(length + 1, dtype=np.int64)
    np.add.at(edges, ranges[:, 0], 1)
    np.add.at(edges, ranges[:, 1] + LENGTH, -1)
    covered = np.r_[False, np.cumsum(edges)[:-1] > 0, False]
    changes = np.flatnonzero(covered[1:] != covered[:-1])
    return list(zip(changes[::2].tolist(), changes[1::2].tolist()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_bytes``, ``spans``, ``kept``.

    A byte is removed if a string of LENGTH bytes covers it that also starts earlier: in a row
    with a smaller id, or before in the same text. ``spans`` are the maximal removed runs
    (start, end), ``kept`` the bytes that are left. A null text counts as empty; texts below
    LENGTH bytes lose nothing; texts beyond PART bytes are hashed and sorted in parts that overlap
    by a string. A null id counts as the smallest integer. Different texts under one id are
    ordered by a hash of the text; rows repeated as a whole all keep what one of them would
    keep. Ids are integers; other columns are not read. An empty table gives an empty one.
    """
    nothing = -(1 << 63)
    missing = F.col(id_col).isNull()
    keyed = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(nothing)).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit("")), missing).alias("tid"), missing.alias("missing"), F.col(text_col).alias("text"))
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = Buckets(max(1, -(-total // limits.bucket_text)), limits.fan)
    tasks = min(buckets.n, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    seed = secrets.randbits(63)

    def by_bucket(blobs: DataFrame) -> DataFrame:
        if buckets.two_passes:
            groups = blobs.repartition(tasks, "bucket").sortWithinPartitions("bucket")
            blobs = groups.mapInArrow(lambda it: _redeal(it, buckets, limits), "bucket int, blob binary")
        return blobs.repartition(tasks, "bucket").sortWithinPartitions("bucket")

    blob = "bucket int, blob binary"
    records = by_bucket(_record_blobs(keyed.filter(F.octet_length("text") >= LENGTH).select("id", "tid", "text"), buckets, limits, seed))
    told = by_bucket(records.mapInArrow(lambda it: _sort_records(it, buckets, limits), blob))
    said = materialize(told.mapInArrow(_by_document, _SAID), "repeats")

    texts = keyed.select("id", "tid", "missing", _payload(F.col("text")).alias("payload"))
    contexts = said.filter("wanted is not null or singly is not null").join(texts, ["id", "tid"]).select("id", "tid", "payload", "wanted", "singly")
    contexts = by_bucket(contexts.mapInArrow(lambda it: _context_blobs(it, buckets, limits, seed), blob))
    told = by_bucket(contexts.mapInArrow(lambda it: _sort_contexts(it, buckets, limits), blob))
    more = materialize(told.mapInArrow(_by_document, _SAID), "repeats")

    repeats = said.select("id", "tid", "repeats").unionAll(more.select("id", "tid", "repeats")).filter("repeats is not null")
    repeats = repeats.groupBy("id", "tid").agg(F.collect_list("repeats").alias("repeats"))
    schema = T.StructType([
        T.StructField(id_col, T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.BinaryType()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                ids, sizes, spans, kept = [], [], [], []
                for row in batch.slice(at, 200).to_pylist():
                    data = expand(row["payload"])
                    runs = removed_spans(len(data), row["repeats"] or [])
                    ids.append(None if row["missing"] else row["id"])
                    sizes.append(len(data))
                    spans.append([{"start": a, "end": b} for a, b in runs])
                    bounds = [0, *[x for run in runs for x in run], len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2])))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], schema.names)

    return texts.join(repeats, ["id", "tid"], "left").select("id", "missing", "payload", "repeats").mapInArrow(cut, schema)
