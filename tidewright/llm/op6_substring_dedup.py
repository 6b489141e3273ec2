"""Exact substring deduplication by suffix arrays.

A byte is removed if a string of ``LENGTH`` bytes over it also starts in a document of a smaller id.
The strings of the whole corpus are dealt into shards so that equal ones meet: each string of
LENGTH bytes has an anchor, the part of ``ANCHOR`` bytes whose hash is smallest (the leftmost of
these), and goes to the shard of its anchor's hash, with what is around the anchor: a segment.

1. Anchors of all documents are counted in shards. Those that occur once are of no interest, and
   they are most; a Bloom filter of the others is broadcast. Its size is bounded by ``MOST_BITS``;
   beyond that more segments are looked at in vain, and none is missed.
2. Segments of the anchors in the filter are dealt by anchor, equal ones of a batch once. Each shard
   sorts its distinct segments' suffixes by induced sorting and computes permuted common prefixes:
   suffixes in a run of common prefixes of LENGTH bytes or more start with the same string, and
   the run's smallest document id says in which documents the string goes.
3. A shard packs its spans by bucket of rows, so their number of rows does not follow that of the
   documents; a bucket gathers them by row, a hash of id and text, and they are cut out.

Texts of names are sorted by the same induction again, over the digits of the names. Where these would
be more than half as long as the text that was reduced, ranks of names are doubled instead.

Defined results
---------------
* null text is empty. Rows of one id are one document: they do not remove each other's bytes.
  A null id counts as larger than any other, and null ids as one document. Each row loses its own
  spans only, whatever other rows of its id hold.
* bytes are removed wherever they are, also inside a character; ``kept_sha256`` is over bytes.
* texts of any length are worked on in pieces of bounded size and are never cut short; texts shorter than
  LENGTH lose nothing.
* repeated rows are alike, and ties between equal ids remove nothing of each other.
* an empty table gives an empty table; columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.shared import shards_of, text_bytes, written
from tidewright.llm.suffixes import permuted_common_prefixes, prefix_hashes, substring_hashes, suffix_array
from tidewright.llm.tokens import VALUES, blob, bytes_of, joined, mix, packed, powers, runs, shard_of
from tidewright.sources.tables import table

#: Bytes of a string that counts as repeated, and of an anchor.
LENGTH, ANCHOR = 50, 26
REACH = LENGTH - ANCHOR  # bytes of a segment on either side of the anchor
WIDTH = LENGTH + REACH
#: Bits of the filter for each repeated anchor, and in all (128 MB).
BITS, MOST_BITS = 12, 1 << 30
#: Bytes of segments that are sorted at once, and strings that are looked at at once.
SORTED, STEP = 1 << 19, 1 << 19
#: Bytes of text whose anchors or segments a task holds at once.
PORTION = 1 << 23
#: Bytes of all texts for each shard of anchors, and for each bucket of rows in which spans are gathered.
PER_SHARD, PER_BUCKET = 1 << 22, 1 << 26
NO_ID = (1 << 63) - 1
OUT = 255  # outside of the document; in no UTF-8 text


def _anchors_in(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of the strings that start at places ``first`` of ``data``."""
    n = len(data) - ANCHOR + 1
    at = np.arange(n)
    h = substring_hashes(prefix_hashes(data), at, at + ANCHOR)
    low = (h & ~np.uint64((1 << 20) - 1)) | at.astype(np.uint64)
    for w in (1, 2, 4, 8):
        low = np.minimum(low[:-w], low[w:])
    low = np.minimum(low[: n - REACH], low[REACH - 15 :][: n - REACH])  # 16 places, and the last 16
    place = (low[first] & np.uint64((1 << 20) - 1)).astype(np.int64)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    return place, h[place]


def anchors(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place in data, hash) of the anchors of all strings of the rows ``offs``, in parts."""
    for i, j in runs(offs, STEP):
        for at in range(offs[i], offs[j], STEP):
            end = min(at + STEP + LENGTH - 1, offs[j])
            start = np.arange(at, min(at + STEP, offs[j] - LENGTH + 1))
            row = np.searchsorted(offs, start, "right") - 1
            start = start[start + LENGTH <= offs[row + 1]] - at
            if len(start):
                place, h = _anchors_in(data[at:end], start)
                yield np.searchsorted(offs, place + at, "right") - 1, place + at, h


def anchor_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each anchor. An anchor's hash is the smallest of many, so it is mixed again: most would lie in the first shards."""
    return shard_of(mix(h), shards)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy()


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, row keys, bytes, row starts) of parts of a batch of (id, text, row key)."""
    ids, keys = _ids(batch.column(0)), batch.column(2).to_numpy()
    data, offs = bytes_of(batch.column(1))
    for i, j in runs(offs, PORTION):
        yield ids[i:j], keys[i:j], data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def _seen(shards: int):
    """Packed hashes of a batch's anchors by shard: those of one document, and those of several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, data, offs in (p for batch in batches for p in _portions(batch)):
            found = [(ids[row], h) for row, _, h in anchors(data, offs)]
            if not found:
                continue
            doc, h = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            doc, h = doc[order], h[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            many = np.maximum.reduceat(doc, new) != np.minimum.reduceat(doc, new)
            h = h[new]
            rows = list(packed(np.arange(len(h)), anchor_shard(h, shards), shards))
            yield pa.record_batch(
                [pa.array([k for k, _ in rows], pa.int32()), pa.array([blob(h[p]) for _, p in rows], pa.binary()), pa.array([blob(h[p][many[p]]) for _, p in rows], pa.binary())],
                names=["shard", "h", "many"],
            )

    return run


def _repeated(group: pa.Table) -> pa.Table:
    h, n = np.unique(joined(group.column("h"), np.uint64), return_counts=True)
    h = np.union1d(h[n > 1], joined(group.column("many"), np.uint64))
    return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "h": pa.array([blob(h)], pa.binary()), "n": [len(h)]})


class Filter:
    """A Bloom filter in slices by shard, three bits an anchor."""

    def __init__(self, slices: list[np.ndarray]):
        self.size = np.array([len(s) for s in slices], np.uint64)
        self.start = np.concatenate([[0], np.cumsum([len(s) for s in slices])]).astype(np.int64)
        self.words = np.concatenate(slices)

    @staticmethod
    def places(h: np.ndarray, words: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
        x = h * np.uint64(0x9E3779B97F4A7C15)
        mask = np.zeros(len(h), np.uint64)
        for k in (20, 26, 8):
            mask |= np.uint64(1) << ((x >> np.uint64(k)) & np.uint64(63))
        return (((x >> np.uint64(32)) * words) >> np.uint64(32)).astype(np.int64), mask

    @classmethod
    def slice(cls, h: np.ndarray, bits: float) -> np.ndarray:
        out = np.zeros(max(1, int(np.ceil(len(h) * bits / 64))), np.uint64)
        word, mask = cls.places(h, np.uint64(len(out)))
        np.bitwise_or.at(out, word, mask)
        return out

    def has(self, h: np.ndarray) -> np.ndarray:
        own = anchor_shard(h, len(self.size))
        word, mask = self.places(h, self.size[own])
        return (self.words[self.start[own] + word] & mask) == mask


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    up = powers(rows.shape[1])[0][: rows.shape[1]]
    return np.concatenate([np.zeros(0, np.uint64), *[mix((VALUES[rows[i : i + (1 << 13)]] * up).sum(axis=1)) for i in range(0, len(rows), 1 << 13)]])


def chains(kind: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of equal segments of a row that follow within LENGTH bytes.

    What is removed of one of them is LENGTH bytes or more, so what is removed of all is one span:
    text that repeats one word gives a few runs instead of a segment for each word.
    """
    order = np.lexsort((place, row, kind))
    k, r, p = kind[order], row[order], place[order]
    new = np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1]) | (p[1:] - p[:-1] > LENGTH))
    return order[new], order[np.append(np.flatnonzero(new)[1:] - 1, len(order) - 1)]


def _segments(shards: int, shared):
    """By shard: a batch's distinct segments, and where they are (segment, document, row, place, how far runs reach)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        around = np.arange(-REACH, LENGTH)
        for ids, keys, data, offs in (p for batch in batches for p in _portions(batch)):
            found = []
            for row, place, h in anchors(data, offs):
                keep = known.has(h)
                found.append((row[keep], place[keep], h[keep]))
            row, place, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            if not len(row):
                continue
            parts = []
            for i in range(0, len(row), 1 << 13):
                at = place[i : i + (1 << 13), None] + around
                r = row[i : i + (1 << 13), None]
                parts.append(np.where((at >= offs[r]) & (at < offs[r + 1]), data[np.clip(at, 0, len(data) - 1)], OUT).astype(np.uint8))
            segment = np.concatenate(parts)
            del parts
            kinds, inv = np.unique(row_hashes(segment), return_inverse=True)
            first = np.zeros(len(kinds), np.int64)
            first[inv] = np.arange(len(inv))
            head, last = chains(inv, row, place)
            row, start, h, inv = row[head], place[head], h[head], inv[head]
            reach = (place[last] - start).astype(np.int32)
            start = (start - offs[row]).astype(np.int32)
            out = []
            for k, p in packed(np.arange(len(row)), anchor_shard(h, shards), shards):
                local, at = np.unique(inv[p], return_inverse=True)
                out.append((k, blob(segment[first[local]]), blob(at.astype(np.int32)), blob(ids[row[p]]), blob(keys[row[p]]), blob(start[p]), blob(reach[p])))
            del segment
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 6), strict=True)], names=["shard", "segments", "which", "doc", "row", "place", "reach"])

    return run


def first_owners(segments: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each string of each segment the smallest owner of a segment that has it; NO_ID where it leaves the document.

    Segments with the same anchor must come together; they are sorted in parts of bounded size. An
    anchor with one segment has each of its strings once, and needs no sorting.
    """
    outside = np.zeros((len(segments), WIDTH + 1), np.int16)
    np.cumsum(segments == OUT, axis=1, out=outside[:, 1:])
    inside = outside[:, LENGTH:] == outside[:, : REACH + 1]
    out = np.where(inside, owner[:, None], NO_ID)
    anchor = row_hashes(segments[:, REACH:LENGTH])
    new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    several = np.repeat(np.diff(np.append(new, len(segments))) > 1, np.diff(np.append(new, len(segments))))
    rows = np.flatnonzero(several)
    if len(rows):
        out[rows] = _sorted_owners(segments[rows], owner[rows], inside[rows], anchor[rows])
    return out


def _sorted_owners(segments: np.ndarray, owner: np.ndarray, inside: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    out = np.full((len(segments), REACH + 1), NO_ID, np.int64)
    new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    bounds = np.append(new, len(segments))
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SORTED // (WIDTH + 1), "right")) - 1)
        lo, hi = bounds[i], bounds[j]
        i = j
        m = hi - lo
        text = np.full((m, WIDTH + 1), OUT, np.uint8)
        own = segments[lo:hi]
        text[:, :WIDTH] = np.where(own == OUT, OUT, own + np.uint8(1))
        valid = np.zeros((m, WIDTH + 1), bool)
        valid[:, : REACH + 1] = inside[lo:hi]
        flat = np.append(text.ravel(), 0).astype(np.uint8)
        sa = suffix_array(flat, LENGTH)
        sa = sa[np.append(valid.ravel(), False)[sa]].astype(np.int64)
        if not len(sa):
            continue
        same = permuted_common_prefixes(flat, sa, LENGTH)[sa] >= LENGTH
        run = np.flatnonzero(~same)
        least = np.minimum.reduceat(owner[lo:hi][sa // (WIDTH + 1)], run)
        out[lo + sa // (WIDTH + 1), sa % (WIDTH + 1)] = np.repeat(least, np.diff(np.append(run, len(sa))))
    return out


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order, those that touch or overlap as one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def merged_by_row(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in order by row, those of a row that touch or overlap as one."""
    if not len(row):
        return row, start, stop
    keys, at = np.unique(row, return_inverse=True)
    base = at.astype(np.int64) << 32  # no text is as long, so rows stay apart
    a, b = merged(base + start, base + stop)
    return keys[a >> 32], a & 0xFFFFFFFF, b & 0xFFFFFFFF


def _spans(group: pa.Table, buckets: int) -> pa.Table:
    """Spans to remove, of one shard, packed by bucket of rows."""
    per_row = [len(x.as_buffer()) // WIDTH for x in group.column("segments").cast(pa.large_binary()).combine_chunks()]
    base = np.concatenate([[0], np.cumsum(per_row)])
    counts = [len(x.as_buffer()) // 4 for x in group.column("which").cast(pa.large_binary()).combine_chunks()]
    which = joined(group.column("which"), np.int32) + np.repeat(base[:-1], counts)
    doc, place, reach = joined(group.column("doc"), np.int64), joined(group.column("place"), np.int32), joined(group.column("reach"), np.int32)
    row = joined(group.column("row"), np.int64)
    segments = joined(group.column("segments"), np.uint8).reshape(-1, WIDTH)
    # Equal segments of different batches as one, those of an anchor together.
    a, h = row_hashes(segments[:, REACH:LENGTH]), row_hashes(segments)
    order = np.lexsort((h, a))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (a[order][1:] != a[order][:-1]))
    first, inv = order[new], np.zeros(len(order), np.int64)
    inv[order] = np.cumsum(new) - 1
    which = inv[which]
    owner = np.full(len(first), NO_ID, np.int64)
    np.minimum.at(owner, which, doc)
    least = first_owners(segments[first], owner)
    pieces = []
    for i in range(0, len(which), 1 << 17):
        gone = np.pad(least[which[i : i + (1 << 17)]] < doc[i : i + (1 << 17), None], ((0, 0), (1, 1)))
        k, s = np.nonzero(gone[:, 1:-1] & ~gone[:, :-2])  # runs of strings as one span each
        e = np.nonzero(gone[:, 1:-1] & ~gone[:, 2:])[1]
        at = i + k
        pieces.append(np.stack([row[at], place[at] - REACH + s, place[at] + reach[at] - REACH + e + LENGTH]))
    found = np.stack(merged_by_row(*np.concatenate(pieces, axis=1)), axis=1)
    rows = list(packed(found, shard_of(mix(found[:, 0].astype(np.uint64)), buckets), buckets))
    return pa.table({"bucket": pa.array([k for k, _ in rows], pa.int32()), "spans": pa.array([blob(x) for _, x in rows], pa.binary())})


def _by_row(group: pa.Table) -> pa.Table:
    """Of one bucket the spans of all shards, a row for each row of the documents that has any."""
    of, start, stop = merged_by_row(*joined(group.column("spans"), np.int64).reshape(-1, 3).T)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    ends = np.append(first[1:], len(of))
    cut = lambda x: pa.array([blob(x[i:j]) for i, j in zip(first, ends, strict=True)], pa.binary())
    return pa.table({"of": pa.array(of[first], pa.int64()), "start": cut(start), "stop": cut(stop)})


def _row() -> Column:
    """Key of a row: rows of one id and text are alike, and lose the same."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(of, start, stop): packed spans of bytes to remove of each row (by key) that has any."""
    spark = docs.sparkSession
    size = text_bytes(docs)
    shards, buckets = shards_of(spark, 2, size, PER_SHARD), shards_of(spark, 1, size, PER_BUCKET)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row()).where(F.octet_length("text") >= LENGTH)
    seen = docs.mapInArrow(_seen(shards), "shard int, h binary, many binary")
    again = written(seen.groupBy("shard").applyInArrow(_repeated, "shard int, h binary, n long"), "substrings-anchors")
    total = again.agg(F.sum("n")).first()[0] or 0
    bits = min(BITS, MOST_BITS / max(1, total))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [blob(Filter.slice(np.frombuffer(h.as_buffer(), np.uint64), bits)) for h in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], names=["shard", "slice"])

    made = {r.shard: np.frombuffer(r.slice, np.uint64) for r in again.select("shard", "h").mapInArrow(slices, "shard int, slice binary").collect()}
    shared = spark.sparkContext.broadcast(Filter([made.get(k, np.zeros(1, np.uint64)) for k in range(shards)]))
    segments = docs.mapInArrow(_segments(shards, shared), "shard int, segments binary, which binary, doc binary, row binary, place binary, reach binary")
    spans = segments.groupBy("shard").applyInArrow(lambda group: _spans(group, buckets), "bucket int, spans binary")
    return written(spans.groupBy("bucket").applyInArrow(_by_row, "of long, start binary, stop binary"), "substrings-spans")


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left)."""
    spans = repeated_spans(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row())
    rows = rows.join(spans, F.col("row") == F.col("of"), "left").select("doc_id", "text", "start", "stop")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = bytes_of(batch.column(1))
            out = []
            for r, (start, stop) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                text, n = data[offs[r] : offs[r + 1]], 0
                kept = text.tobytes()
                if start.is_valid:
                    a, b = (np.frombuffer(x.as_buffer(), np.int64) for x in (start, stop))
                    a, b = a[a < len(text)], np.minimum(b[a < len(text)], len(text))
                    n = len(a)
                    kept = b"".join(kept[x:y] for x, y in zip(np.append(0, b), np.append(a, len(text)), strict=True)) if n else kept
                out.append((len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([batch.column(0), *[pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)]], names=[f.split()[0] for f in DIGEST.split(", ")])

    return rows.mapInArrow(cut, DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what is removed of them."""
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
