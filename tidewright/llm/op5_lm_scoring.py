"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Training counts words and word pairs of all training texts, in hash shards. Each shard turns its
counts into levels (counts up to 8 are exact, above that there are four levels an octave) and
sets, for an n-gram of level q, bits for each of the levels 1 to q in its slice of the filter. The
slices are put together and broadcast. A scorer finds a count again by probing level after level
until one is missing.

The score of a word w after u is interpolated with absolute discounting,

    p(w|u) = max(c(u,w) - D, 0) / C(u)  +  D T(u) / C(u) * p(w),     p(w) = (c(w) + 0.5) / (N' + 0.5 (V + 1))

where T(u) is the number of distinct words seen after u, D = n1 / (n1 + 2 n2) follows from the
numbers of pairs seen once and twice, and N' sums the quantised counts. Pair counts and T are
taken at the lower, C at the upper end of their level, so the sum over w stays at or below 1 but
for false positives of the filter.

A document's probability is the mean of four experts: all words by p(w), all by p(w|u), each by the
mean of both, and each segment of ``SEGMENT`` words by either as a whole. So fresh text loses next
to nothing against word counts, and copied passages gain within documents that are otherwise fresh.

The filter follows the corpus at ``BITS`` bits a stored level, whatever its size. Up to ``MOST_BITS`` it is
broadcast. A larger one stays in its slices, by shard, and the probes are taken there: texts are put
into units of bounded size, each unit's distinct n-grams go to the slices and their levels come back to
the unit. Either way gives the same score.

The exact base score needs exact counts: words at the head, at most ``HEAD`` of them, are
broadcast; all others are looked up by a join of the shards.

Defined results
---------------
* null text is empty: it has one token, its end. Texts are scored row by row, repeated rows alike (up to the
  order of a sum).
* a text may be of any length; it is scored whole, in memory of some 100 bytes a word.
* a null id is not held out: its text is learned from. There are no ties: nothing is ranked.
* an empty table gives an empty table, and a model of nothing scores by smoothing alone; columns other than
  id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.shared import shards_of, text_bytes, written
from tidewright.llm.tokens import blob, bytes_of, each_run, joined, mix, packed, shard_of
from tidewright.sources.tables import table

#: Bits a stored level; most bits of a filter that is broadcast (256 MB); most words whose exact counts are broadcast.
BITS, MOST_BITS, HEAD = 12, 1 << 31, 1 << 20
#: Bytes of texts for each shard of counts; tokens that are counted or sent at once; bytes and rows of a unit.
PER_SHARD, PORTION, UNIT, UNIT_ROWS = 1 << 25, 1 << 20, 1 << 22, 1 << 16
#: Bits that number a partition's units; with 16 for a unit's rows, there is room for 2**27 partitions.
UNIT_BITS = 20
#: Smoothing of the word probabilities.
ADD = 0.5
SEGMENT = 64
END, BEGIN = (mix(np.array([x], np.uint64))[0] for x in (0xE0D, 0xBE61))
_STEP, _PAIR, _KIND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x27D4EB2F165667C5)
_SIX = np.uint64(63)

#: Lower ends of the levels; level q holds counts from LOW[q - 1] to LOW[q] - 1.
LOW = np.unique(np.concatenate([np.arange(1, 9), np.floor(8 * 2 ** (np.arange(1, 200) / 4))])).astype(np.int64)


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LOW, counts, "right")


def lower(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, LOW[np.maximum(q, 1) - 1], 0)


def upper(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, LOW[q] - 1, 0)


def pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(u * _PAIR + np.uint64(1)) + w)


def _mean(*logs: np.ndarray) -> np.ndarray:
    """log10 of the mean of probabilities given by their log10."""
    top = np.maximum.reduce(logs)
    return top + np.log10(sum(10 ** (x - top) for x in logs) / len(logs))


def _experts(p1: np.ndarray, p2: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 of each document's probability, of its tokens' probabilities under two models."""
    a, b = np.log10(p1), np.log10(p2)
    lengths = np.diff(np.append(starts, len(p1)))
    segments = np.flatnonzero((np.arange(len(p1)) - np.repeat(starts, lengths)) % SEGMENT == 0)
    parts = _mean(np.add.reduceat(a, segments), np.add.reduceat(b, segments))
    each = (a, b, np.log10((p1 + p2) / 2))
    return _mean(*(np.add.reduceat(x, starts) for x in each), np.add.reduceat(parts, np.searchsorted(segments, starts)))


def _places(h: np.ndarray, q: np.ndarray | int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Word of a slice, and the five bits of it, that stand for level q of the n-gram h."""
    x = mix(h + _STEP * np.asarray(q, np.uint64))
    word = ((x >> np.uint64(32)) * np.asarray(words, np.uint64)) >> np.uint64(32)
    bits = np.zeros(len(h), np.uint64)
    for k in range(5):
        bits |= np.uint64(1) << ((x >> np.uint64(6 * k)) & _SIX)
    return word.astype(np.int64), bits


def slice_of(h: np.ndarray, q: np.ndarray, bits: float) -> np.ndarray:
    """The filter of n-grams ``h`` of levels ``q``, as 64-bit words."""
    out = np.zeros(max(1, int(np.ceil(q.sum() * bits / 64))), np.uint64)
    for lv in range(1, int(q.max(initial=0)) + 1):
        word, mask = _places(h[q >= lv], lv, len(out))
        np.bitwise_or.at(out, word, mask)
    return out


class Filter:
    """All slices one after another."""

    def __init__(self, slices: list[np.ndarray]):
        self.size = np.array([len(s) for s in slices], np.uint64)
        self.start = np.concatenate([[0], np.cumsum([len(s) for s in slices])]).astype(np.int64)
        self.words = np.concatenate(slices) if slices else np.zeros(0, np.uint64)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Level of each n-gram, by probes from level 1 until the first that misses."""
        out = np.zeros(len(h), np.int64)
        if not len(self.words):
            return out
        own = shard_of(h, len(self.size))
        start, size, left = self.start[own], self.size[own], np.arange(len(h))
        for q in range(1, len(LOW)):
            word, mask = _places(h[left], q, size[left])
            left = left[(self.words[start[left] + word] & mask) == mask]
            if not len(left):
                break
            out[left] = q
        return out


def _streams(column: pa.Array, piece: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i to j with all their tokens (each row's words and its end), what is before each, and row starts."""
    for i, j, w, at in each_run(column, piece):
        ends = at[1:] + np.arange(j - i)
        token = np.empty(len(w) + j - i, np.uint64)
        is_word = np.ones(len(token), bool)
        is_word[ends] = False
        token[is_word], token[ends] = w, END
        before = np.empty_like(token)
        before[1:] = token[:-1]
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
        before[starts] = BEGIN
        yield i, j, token, before, starts


def _counted(shards: int, pairs: bool):
    """Packed counts of words, or of pairs, by shard."""

    def packed_counts(parts: list[tuple]) -> pa.RecordBatch:
        h, u, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, first, inv = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(inv, weights=n).astype(np.uint32)
        if pairs:  # pairs of one first word together: runs of it take next to nothing when compressed
            order = np.argsort(u[first], kind="stable")
            h, first, n = h[order], first[order], n[order]
        rows = list(packed(np.arange(len(h)), shard_of(h, shards), shards))
        return pa.record_batch(
            [
                pa.array([k for k, _ in rows], pa.int32()),
                pa.array([blob(h[p]) for _, p in rows], pa.binary()),
                pa.array([blob(u[first[p]]) if pairs else b"" for _, p in rows], pa.binary()),
                pa.array([blob(n[p]) for _, p in rows], pa.binary()),
            ],
            names=["shard", "h", "u", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], 0
            for i, j, token, before, _ in _streams(batch.column(0), 1 << 19):
                for k in range(0, len(token), PORTION):
                    w, u = token[k : k + PORTION], before[k : k + PORTION]
                    if pairs:
                        h, first, n = np.unique(pair(u, w), return_index=True, return_counts=True)
                        parts.append((h, u[first], n))
                    else:
                        h, n = np.unique(w, return_counts=True)
                        parts.append((np.append(h, BEGIN), h[:0], np.append(n, j - i if k == 0 else 0)))
                    held += len(h)
                    if held >= PORTION:
                        yield packed_counts(parts)
                        parts, held = [], 0
            if parts:
                yield packed_counts(parts)

    return run


COUNTED = "shard int, h binary, u binary, n binary"


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct h, a place of each, and sums of n."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[new], order[new], np.add.reduceat(n[order].astype(np.int64), new)


def _pairs_shard(shards: int):
    def run(group: pa.Table) -> pa.Table:
        """A shard's slice and, by shard of u, the numbers of distinct words after u."""
        h, first, n = _summed(joined(group.column("h"), np.uint64), joined(group.column("n"), np.uint32))
        u, t = np.unique(joined(group.column("u"), np.uint64)[first], return_counts=True)
        rows = list(packed(np.arange(len(u)), shard_of(u, shards), shards))
        k = len(rows)
        keys = pa.array([group.column("shard")[0].as_py()] + [s for s, _ in rows], pa.int32())
        return pa.table(
            {
                "shard": keys,
                "h": pa.array([blob(h)] + [blob(u[p]) for _, p in rows], pa.binary()),
                "n": pa.array([blob(level(n).astype(np.uint8))] + [blob(t[p].astype(np.uint32)) for _, p in rows], pa.binary()),
                "part": pa.array([0] + [1] * k, pa.int32()),
                "once": pa.array([int((n == 1).sum())] + [0] * k, pa.int64()),
                "twice": pa.array([int((n == 2).sum())] + [0] * k, pa.int64()),
                "levels": pa.array([int(level(n).sum())] + [0] * k, pa.int64()),
            }
        )

    return run


PAIRS = "shard int, h binary, n binary, part int, once long, twice long, levels long"


def _words_shard(group: pa.Table) -> pa.Table:
    """A shard's words with counts and distinct followers, its sums, and how many words each level has."""
    follow = group.column("part").to_numpy() == 1
    both = {}
    for name, pick in (("n", ~follow), ("t", follow)):
        rows = group.filter(pa.array(pick))
        h, c = joined(rows.column("h"), np.uint64), joined(rows.column("n"), np.uint32)
        both[name] = _summed(h, c) if len(h) else (h, h, c.astype(np.int64))
    (h, _, n), (u, _, t) = both["n"], both["t"]
    after = np.zeros(len(h), np.int64)
    after[np.searchsorted(h, u)] = t
    word = h != BEGIN
    q = level(n)
    return pa.table(
        {
            "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()),
            "h": pa.array([blob(h)], pa.binary()),
            "n": pa.array([blob(n)], pa.binary()),
            "t": pa.array([blob(after)], pa.binary()),
            "tokens": [int(n[word].sum())],
            "types": [int(word.sum())],
            "quantised": [int(lower(q)[word].sum())],
            "levels": [int(q.sum() + level(after).sum())],
            "by_level": pa.array([np.bincount(q, minlength=len(LOW) + 1).tolist()], pa.list_(pa.int64())),
        }
    )


WORDS = "shard int, h binary, n binary, t binary, tokens long, types long, quantised long, levels long, by_level array<long>"


@dataclass
class Model:
    """What scoring needs: ``words`` (the sharded exact counts), the head, sums, and the filter.

    ``filters`` (of words and pairs) are set where the filter is broadcast, else ``slices`` (shard, words, pairs).
    """

    words: DataFrame
    shards: int
    tokens: int
    types: int
    quantised: int
    discount: float
    head: tuple[np.ndarray, np.ndarray]
    filters: tuple[Filter, Filter] | None
    slices: DataFrame | None


def _slices(rows: DataFrame, shards: int) -> Filter:
    """The filter of slices that tasks have made; only called where they have ``MOST_BITS`` together at most."""
    sizes = np.ones(shards, np.int64)
    found = {}
    for r in rows.toLocalIterator():  # a partition at a time
        found[r.shard] = np.frombuffer(bytes(r.slice), np.uint64)
        sizes[r.shard] = len(found[r.shard])
    out = Filter([])
    out.size, out.start = sizes.astype(np.uint64), np.concatenate([[0], np.cumsum(sizes)])
    out.words = np.zeros(out.start[-1], np.uint64)
    for k in list(found):
        out.words[out.start[k] : out.start[k + 1]] = found.pop(k)
    return out


def train(texts: DataFrame) -> Model:
    """Counts of ``texts`` (one column, text) as a model."""
    spark = texts.sparkSession
    shards = shards_of(spark, 2, text_bytes(texts), PER_SHARD)
    pair_rows = texts.mapInArrow(_counted(shards, True), COUNTED).groupBy("shard").applyInArrow(_pairs_shard(shards), PAIRS)
    pairs = written(pair_rows, "lm-pairs")
    word_rows = texts.mapInArrow(_counted(shards, False), COUNTED).selectExpr("shard", "h", "n", "0 as part")
    words = written(
        word_rows.union(pairs.where("part = 1").select("shard", "h", "n", "part")).groupBy("shard").applyInArrow(_words_shard, WORDS), "lm-words"
    )
    p = pairs.where("part = 0").agg(F.sum("once"), F.sum("twice"), F.sum("levels")).first()
    w = words.agg(F.sum("tokens"), F.sum("types"), F.sum("quantised"), F.sum("levels")).first()
    once, twice, pair_levels = (int(x or 0) for x in p)
    tokens, types, quantised, word_levels = (int(x or 0) for x in w)
    def pair_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [blob(slice_of(np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint8).astype(np.int64), BITS)) for h, q in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["shard", "slice"])

    def word_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, n, t in zip(*batch.columns[1:], strict=True):
                h, n, t = np.frombuffer(h.as_buffer(), np.uint64), *(np.frombuffer(x.as_buffer(), np.int64) for x in (n, t))
                out.append(blob(slice_of(np.concatenate([h, h ^ _KIND_OF(h)]), np.concatenate([level(n), level(t)]), BITS)))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["shard", "slice"])

    kind = "shard int, slice binary"
    pair_rows = pairs.where("part = 0").select("shard", "h", "n").mapInArrow(pair_slices, kind)
    word_rows = words.select("shard", "h", "n", "t").mapInArrow(word_slices, kind)
    filters = slices = None
    if (pair_levels + word_levels) * BITS <= MOST_BITS:
        filters = _slices(word_rows, shards), _slices(pair_rows, shards)
    else:
        slices = written(word_rows.withColumnRenamed("slice", "words").join(pair_rows.withColumnRenamed("slice", "pairs"), "shard", "full"), "lm-slices")
    # The head: words of the highest levels, as many whole levels as fit.
    spread = words.select(F.posexplode("by_level").alias("q", "k")).groupBy("q").agg(F.sum("k").alias("k")).orderBy(F.desc("q")).collect()
    lowest, total = len(LOW) + 1, 0
    for r in spread:  # at most one row a level
        total += r.k
        if total > HEAD:
            break
        lowest = r.q

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = joined(batch.column(0), np.uint64), joined(batch.column(1), np.int64)
            keep = level(n) >= max(1, lowest)
            yield pa.record_batch([pa.array([blob(h[keep])], pa.binary()), pa.array([blob(n[keep])], pa.binary())], names=["h", "n"])

    top = words.select("h", "n").mapInArrow(head, "h binary, n binary").collect()  # at most HEAD words in all
    h = np.frombuffer(b"".join(r.h for r in top), np.uint64)
    n = np.frombuffer(b"".join(r.n for r in top), np.int64)
    order = np.argsort(h)
    discount = once / (once + 2 * twice) if once else 0.5
    return Model(words, shards, tokens, types, quantised, discount, (h[order], n[order]), filters, slices)


def _KIND_OF(h: np.ndarray) -> np.ndarray:
    """What turns a word's key into that of its followers; the upper half stays, so the slice does."""
    return mix(h * _KIND) & np.uint64(0xFFFFFFFF)


SCORED = "row long, id long, held_out boolean, n_tokens long, n_known long, base double, score double, shard int, h binary, rows binary"


_KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
_SCHEMA = pa.schema([(f.split()[0], k) for f, k in zip(SCORED.split(", "), _KINDS, strict=True)])
#: Levels of words' own keys, of their followers' keys, and of pairs.
Levels = Callable[[np.ndarray], np.ndarray]


class Scorer:
    """Scores texts from the levels of their n-grams."""

    def __init__(self, model: Model):
        self.shards, self.discount = model.shards, model.discount
        self.total = model.tokens + ADD * (model.types + 1)
        self.quantised = model.quantised + ADD * (model.types + 1)

    def rows(self, batch: pa.RecordBatch | pa.Table, row: int, head: tuple[np.ndarray, np.ndarray], words: Levels, pairs: Levels) -> Iterator[pa.RecordBatch]:
        """Of rows (id, text, held_out), numbered from ``row``: their scores, and the words to be looked up."""
        head_h, head_n = head
        cols, tail_h, tail_row = [], [], []
        for i, j, token, before, starts in _streams(batch.column(1), 1 << 19):
            word, inv = np.unique(token, return_inverse=True)
            at = np.searchsorted(head_h, word)
            at[at == len(head_h)] = 0
            exact = np.where(head_h[at] == word, head_n[at], 0) if len(head_h) else np.zeros(len(word), np.int64)
            after = np.append(word, np.array([BEGIN]))
            q = words(after)
            t = lower(words(after ^ _KIND_OF(after)))
            p1 = np.minimum((lower(q[:-1]) + ADD) / self.quantised, 1.0)
            # u is the token before, or the beginning, whose place is last
            u = np.concatenate([[len(word)], inv[:-1]])
            u[starts] = len(word)
            c, t, p1 = upper(q)[u], t[u], p1[inv]
            q2 = lower(pairs(pair(before, token)))
            with np.errstate(divide="ignore", invalid="ignore"):
                p2 = (np.maximum(q2 - self.discount, 0) + self.discount * t * p1) / c
            p2 = np.where((c > 0) & (t > 0), np.minimum(p2, 1.0), p1)
            known = exact > 0
            base = np.where(known, np.log10((exact + ADD) / self.total), 0.0)
            tail = ~known[inv]
            lengths = np.diff(np.append(starts, len(token)))
            tail_h.append(token[tail])
            tail_row.append(row + np.repeat(np.arange(i, j), lengths)[tail])
            cols.append((np.arange(i, j) + row, lengths, np.add.reduceat(known[inv].astype(np.int64), starts), np.add.reduceat(base[inv], starts), _experts(p1, p2, starts)))
        if not cols:
            return
        number, n, known, base, lp = (np.concatenate(x) for x in zip(*cols, strict=True))
        nul = [pa.nulls(len(number), k) for k in _KINDS[7:]]
        own = [_one(batch.column(0)).cast(pa.int64()), _one(batch.column(2))]
        yield pa.record_batch([pa.array(number), *own, pa.array(n), pa.array(known), pa.array(base), pa.array(lp), *nul], schema=_SCHEMA)
        h, r = np.concatenate(tail_h), np.concatenate(tail_row)
        rows = list(packed(np.stack([h.view(np.int64), r], axis=1), shard_of(h, self.shards), self.shards))
        nul = [pa.nulls(len(rows), k) for k in _KINDS[:7]]
        yield pa.record_batch([*nul, pa.array([k for k, _ in rows], pa.int32()), pa.array([blob(x[:, 0]) for _, x in rows], pa.binary()), pa.array([blob(x[:, 1]) for _, x in rows], pa.binary())], schema=_SCHEMA)


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _by_broadcast(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``SCORED``, with the whole filter in every task."""
    shared, scorer = docs.sparkSession.sparkContext.broadcast((model.filters, model.head)), Scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (word_filter, pair_filter), head = shared.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            yield from scorer.rows(batch, row, head, word_filter.levels, pair_filter.levels)
            row += len(batch)

    return docs.mapInArrow(run, SCORED)


def _probed(asked: pa.Table, slices: pa.Table) -> pa.Table:
    """Levels of what the units ask of one shard's slices."""
    out = {"unit": [], "pair": [], "h": [], "q": []}
    for name in ("words", "pairs"):
        stored = [np.frombuffer(x, np.uint64) for x in slices.column(name).to_pylist() if x] if len(slices) else []
        own = Filter(stored[:1])
        for unit, pairs, h in zip(*(asked.column(c).to_pylist() for c in ("unit", "pair", "h")), strict=True):
            if pairs == (name == "pairs"):
                h = np.frombuffer(h, np.uint64)
                for c, x in zip(out, (unit, pairs, blob(h), blob(own.levels(h).astype(np.uint8))), strict=True):
                    out[c].append(x)
    return pa.table([pa.array(x, k) for x, k in zip(out.values(), (pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=list(out))


def _by_shuffle(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``SCORED``, with the filter in its slices: units of texts send their n-grams there and get levels back."""
    shards, scorer = model.shards, Scorer(model)
    shared = docs.sparkSession.sparkContext.broadcast(model.head)
    fields = "unit long, id long, text string, held_out boolean"

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unit, size, rows = TaskContext.get().partitionId() << UNIT_BITS, 0, 0
        for batch in batches:
            units = np.zeros(len(batch), np.int64)
            for r, n in enumerate(np.diff(bytes_of(batch.column(1))[1])):
                if rows and (size + n > UNIT or rows >= UNIT_ROWS):
                    if (unit + 1) >> UNIT_BITS != unit >> UNIT_BITS:
                        raise OverflowError("a partition holds more units than there are numbers for")
                    unit, size, rows = unit + 1, 0, 0
                units[r], size, rows = unit, size + int(n), rows + 1
            yield pa.record_batch([pa.array(units), batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), batch.column(2)], names=["unit", "id", "text", "held_out"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(units)) + 1, [len(units)]]) if len(units) else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                found = [[np.array([BEGIN, BEGIN ^ _KIND_OF(np.array([BEGIN]))[0]])], []]
                for _, _, token, before, _ in _streams(batch.column(2).slice(i, j - i), 1 << 19):
                    word = np.unique(token)
                    found[0] += [word, word ^ _KIND_OF(word)]
                    found[1].append(np.unique(pair(before, token)))
                distinct = [np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in found]
                rows = [(k, p, h) for p, own in enumerate(distinct) for k, h in packed(own, shard_of(own, shards), shards)]
                yield pa.record_batch([pa.array([k for k, _, _ in rows], pa.int32()), pa.array(np.full(len(rows), units[i])), pa.array([bool(p) for _, p, _ in rows]), pa.array([blob(h) for *_, h in rows], pa.binary())], names=["shard", "unit", "pair", "h"])

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        known = {}
        for p in (False, True):
            part = answers.filter(pa.compute.equal(answers.column("pair"), p))
            h, q = joined(part.column("h"), np.uint64), joined(part.column("q"), np.uint8)
            order = np.argsort(h)
            known[p] = h[order], q[order].astype(np.int64)
        find = lambda p: lambda h: known[p][1][np.searchsorted(known[p][0], h)]  # noqa: E731  all were asked for
        out = list(scorer.rows(own.select(["id", "text", "held_out"]), own.column("unit")[0].as_py() << 16, shared.value, find(False), find(True))) if len(own) else []
        return pa.Table.from_batches(out, _SCHEMA)

    units = written(docs.mapInArrow(dealt, fields), "lm-units")
    requests = units.mapInArrow(asked, "shard int, unit long, pair boolean, h binary")
    answers = requests.groupBy("shard").cogroup(model.slices.groupBy("shard")).applyInArrow(_probed, "unit long, pair boolean, h binary, q binary")
    return units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(run, SCORED)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (id, text, held_out): n_tokens, n_known, base_score, score."""
    total = Scorer(model).total

    def lookup(asked: pa.Table, counts: pa.Table) -> pa.Table:
        """Exact counts of the words that are not in the head, summed by row."""
        h, row = joined(asked.column("h"), np.uint64), joined(asked.column("rows"), np.int64)
        own, n = joined(counts.column("h"), np.uint64), joined(counts.column("n"), np.int64)
        at = np.searchsorted(own, h)
        at[at == len(own)] = 0
        c = np.where(own[at] == h, n[at], 0) if len(own) else np.zeros(len(h), np.int64)
        row, inv = np.unique(row, return_inverse=True)
        base = np.bincount(inv, weights=np.log10((c + ADD) / total), minlength=len(row)).astype(float)
        known = np.bincount(inv, weights=c > 0, minlength=len(row)).astype(np.int64)
        return pa.table({"row": row, "base": base, "n_known": known})

    found = written((_by_broadcast if model.filters else _by_shuffle)(docs, model), "lm-scored")
    asked = found.where("shard is not null").select("shard", "h", "rows")
    tail = asked.groupBy("shard").cogroup(model.words.select("shard", "h", "n").groupBy("shard")).applyInArrow(lookup, "row long, base double, n_known long")
    tail = tail.groupBy("row").agg(F.sum("base").alias("more"), F.sum("n_known").alias("also"))
    return found.where("row is not null").join(tail, "row", "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id, as text, is 1 modulo 5."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    model = train(docs.where("not held_out").select("text"))
    out = score(docs, model)
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long")).withColumnRenamed("id", "doc_id")
