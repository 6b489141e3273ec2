"""Benchmark decontamination: BM25 search of every passage in an index of test items.

Words are runs of letters and digits in lower case. The index holds for each word the items it is
in with its BM25 weight, as a part of the item's score against itself. A passage is a window of
two strides of words, and a stride is no shorter than the longest item, so an item lies whole in
some passage. A passage queries with its distinct words and retrieves every item of which it
reaches ``SCORE``.

Items are in blocks, with the largest weight of each word in a block. As in block-max WAND, each passage
has a pivot among its words, only the lists from the pivot on are walked, and a block is skipped if
its maxima cannot reach the threshold (``Index.candidates``). What is left is scored
exactly, and verified: the item's question and its answer must each be found in the passage, by
shares of their word n-grams.

Defined results
---------------
* the answer of an item is its last line, or its last sentence where it has one line; an item
  of one sentence is question and answer at once.
* null, empty or blank texts and items match nothing. Repeated rows match alike; results are by
  (doc_id, item_id), so rows of one id are one document there, and the best passage counts.
* weights, mean length and width of a passage follow all items. Their index is broadcast in parts of
  about ``PART_BYTES`` of text, one after the other, and the documents are searched once for each part.
* ties: of passages of one document that hold an item alike, that of the higher BM25 counts. A text may be of any
  length, in passages. Columns besides those named are not read, or kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.shared import written
from tidewright.llm.tokens import BREAKS, each_run, mix, words
from tidewright.sources.tables import table

#: BM25's parameters; part of an item's own score that a passage must reach.
K1, B, SCORE = 1.2, 0.75, 0.5
#: Shares of question and answer that must be found, and the words of the n-grams compared.
QUESTION, ANSWER, NGRAM = 0.6, 0.6, 3
#: Items of a block, fewest words of a stride, bytes of items that are broadcast at once.
BLOCK, STRIDE, PART_BYTES = 8, 64, 16 << 20


def _hashes(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words(data, np.array([0, len(data)]), BREAKS)[0]


def _ngrams(w: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of word n-grams."""
    h = np.zeros(max(0, len(w) - n + 1), np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(31) + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def parts(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    lines = [x for x in text.strip().split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    sentences = re.split(r"(?<=[.!?])\s+", text.strip())
    return (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, text)


def _check(text: str) -> tuple[np.ndarray, int]:
    """The n-grams of a question or an answer, and n: less than ``NGRAM`` where it is shorter."""
    w = _hashes(text)
    n = max(1, min(NGRAM, len(w)))
    return _ngrams(w, n), n


def _shares(checks: tuple, passage: np.ndarray) -> list[float]:
    """Parts of question and answer that are in a passage; one without words counts as found."""
    return [float(np.isin(g, _ngrams(passage, n)).mean()) if len(g) else 1.0 for g, n in checks]


class Statistics:
    """What BM25 takes from all items: their number, mean length, the words of the longest, and items by word."""

    def __init__(self, items: int, mean: float, longest: int, terms: np.ndarray, df: np.ndarray):
        self.items, self.mean, self.longest, self.terms, self.df = items, mean, longest, terms, df

    @classmethod
    def of(cls, found: list[np.ndarray]) -> "Statistics":
        """Of the words of all items."""
        terms, df = np.unique(np.concatenate([np.unique(w) for w in found] or [np.zeros(0, np.uint64)]), return_counts=True)
        return cls(len(found), float(np.mean([len(w) for w in found])) if found else 1.0, max(map(len, found), default=0), terms, df)


class Index:
    """Inverted index of items, or of a part of them, with bounds by block."""

    def __init__(self, items: list[tuple[int, str]], whole: Statistics | None = None):
        found = [(i, t, _hashes(t)) for i, t in items]
        found = sorted((x for x in found if len(x[2])), key=lambda x: (len(x[2]), x[0]))
        whole = whole or Statistics.of([w for *_, w in found])
        self.items = [x[0] for x in found]
        self.checks = [tuple(_check(p) for p in parts(t)) for _, t, _ in found]
        counts = [np.unique(w, return_counts=True) for _, _, w in found]
        self.terms = np.unique(np.concatenate([c[0] for c in counts] or [np.zeros(0, np.uint64)]))
        df = whole.df[np.searchsorted(whole.terms, self.terms)]
        idf = np.log(1 + (whole.items - df + 0.5) / (df + 0.5))
        self.stride = max(STRIDE, whole.longest)
        self.weights, owner, block = [], [], []
        for k, ((_, _, w), (terms, tf)) in enumerate(zip(found, counts, strict=True)):
            t = np.searchsorted(self.terms, terms)
            x = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / whole.mean))
            self.weights.append((t, x / x.sum(), x.sum()))
            owner.append(t)
            block.append(np.full(len(t), k // BLOCK))
        self.blocks = -(-len(found) // BLOCK)
        t, b, x = (np.concatenate(v) if v else np.zeros(0) for v in (owner, block, [w[1] for w in self.weights]))
        # The largest weight of each word in each block, by word; and of each word in all.
        order = np.lexsort((b, t))
        t, b, x = t[order].astype(np.int64), b[order].astype(np.int64), x[order]
        new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (b[1:] != b[:-1])])) if len(t) else np.zeros(0, np.int64)
        x = np.maximum.reduceat(x, new) if len(new) else x
        t, b = t[new], b[new]
        self.start = np.searchsorted(t, np.arange(len(self.terms) + 1))
        self.block_of, self.bound, self.cells = b, x, t * self.blocks + b
        self.largest = np.maximum.reduceat(x, self.start[:-1]) if len(x) else x
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def candidates(self, span: np.ndarray, t: np.ndarray, spans: int) -> np.ndarray:
        """Cells (passage times blocks plus block) that may reach ``SCORE``, of the distinct words ``t`` of passages ``span``.

        A passage's words are put in order of their largest weight. Up to its pivot, the word at which these
        sum up to the threshold, they cannot reach it on their own: so an item that does holds the pivot or a word
        after it, and only the lists of these are walked. A block they lead to is skipped if it falls short
        with the largest weights of the words before the pivot, and then with their maxima in this block.
        """
        order = np.lexsort((self.largest[t], span))
        span, t = span[order], t[order]
        most = self.largest[t]
        start = np.searchsorted(span, np.arange(spans + 1))
        sums = np.concatenate([[0.0], np.cumsum(most)])
        before = sums[1:] - sums[start[span]] < SCORE - 1e-5
        n_before = np.bincount(span[before], minlength=spans)
        rest = np.bincount(span[before], weights=most[before], minlength=spans)
        s, w = span[~before], t[~before]
        n = self.start[w + 1] - self.start[w]
        post = np.repeat(self.start[w] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
        cell, inv = np.unique(np.repeat(s, n) * self.blocks + self.block_of[post], return_inverse=True)
        bound = np.bincount(inv, weights=self.bound[post], minlength=len(cell))
        keep = bound + rest[cell // self.blocks] >= SCORE - 1e-5
        cell, bound = cell[keep], bound[keep]
        own = cell // self.blocks
        n = n_before[own]
        which = np.repeat(np.arange(len(cell)), n)
        low = t[np.repeat(start[own] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]
        want = low * self.blocks + (cell % self.blocks)[which]
        at = np.minimum(np.searchsorted(self.cells, want), len(self.cells) - 1)
        bound = bound + np.bincount(which, weights=np.where(self.cells[at] == want, self.bound[at], 0.0), minlength=len(cell))
        return cell[bound >= SCORE - 1e-5]

    def term_of(self, w: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where no item has it."""
        out = np.full(len(w), -1, np.int64)
        at = np.flatnonzero(self.maybe[(w & np.uint64(0xFFFF)).astype(np.int64)])
        t = np.searchsorted(self.terms, w[at])
        ok = (t < len(self.terms)) & (self.terms[np.minimum(t, len(self.terms) - 1)] == w[at])
        out[at[ok]] = t[ok]
        return out

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item, BM25, question share, answer share) of each passage that holds an item."""
        if not self.items:
            return
        for i, _, w, at in each_run(column, gaps=BREAKS):
            strides = -(-np.diff(at) // self.stride)
            first = np.concatenate([[0], np.cumsum(strides)])
            row = np.repeat(np.arange(len(strides)), strides)
            within = np.arange(first[-1]) - first[row]
            begin = at[row] + within * self.stride
            term = self.term_of(w)
            hit = np.flatnonzero(term >= 0)
            span = np.searchsorted(begin, hit, "right") - 1
            pair = np.unique(span * len(self.terms) + term[hit])
            # A passage is a stride and the next: its words are those of both, each counted once.
            span, t = np.divmod(pair, max(1, len(self.terms)))
            before = within[span] > 0
            pair = np.unique(np.concatenate([pair, (span[before] - 1) * len(self.terms) + t[before]]))
            span, t = np.divmod(pair, max(1, len(self.terms)))
            have, last = np.zeros(len(self.terms), bool), -1
            for k, b in zip(*np.divmod(self.candidates(span, t, len(row)), self.blocks), strict=True):
                lo = begin[k]
                hi = min(lo + 2 * self.stride, at[row[k] + 1])
                if k != last:
                    have[:] = False
                    own = term[lo:hi]
                    have[own[own >= 0]] = True
                    last = k
                for item in range(b * BLOCK, min((b + 1) * BLOCK, len(self.items))):
                    t, x, whole = self.weights[item]
                    score = x[have[t]].sum()
                    if score < SCORE:
                        continue
                    q, a = _shares(self.checks[item], w[lo:hi])
                    if q >= QUESTION and a >= ANSWER:
                        yield i + int(row[k]), self.items[item], float(score * whole), q, a


def _terms(items: DataFrame) -> DataFrame:
    """(n_words, word) of the distinct words of each item that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                w = _hashes(text.as_py())
                if len(w):
                    terms = np.unique(w).view(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(terms), len(w))), pa.array(terms), pa.array(np.arange(len(terms)) == 0)], names=["n_words", "word", "first"])

    return items.select("text").mapInArrow(run, "n_words long, word long, first boolean")


def _indexes(benchmark: DataFrame):
    """The index of each part of the items, to be broadcast; a part's bytes are bounded, and weights follow all items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").dropDuplicates()
    spark = items.sparkSession
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= PART_BYTES:
        yield spark.sparkContext.broadcast(Index([tuple(r) for r in items.collect()]))
        return
    n = int(size // PART_BYTES * 2 + 1)
    items = written(items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(n))), "benchmark-items")
    terms = written(_terms(items), "benchmark-terms")
    df = written(terms.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "benchmark-words")
    count, mean, longest = terms.where("first").agg(F.count(F.lit(1)), F.avg("n_words"), F.max("n_words")).first()
    for k in range(n):
        own = items.where(F.col("part") == k)
        words = sorted((r.word & (1 << 64) - 1, r.df) for r in df.join(_terms(own).select("word").distinct(), "word").collect())  # of a part
        whole = Statistics(count, mean or 1.0, longest or 0, np.array([w for w, _ in words], np.uint64), np.array([c for _, c in words], np.int64))
        yield spark.sparkContext.broadcast(Index([tuple(r) for r in own.select("item_id", "text").collect()], whole))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, bm25, question_overlap, answer_overlap) of each document that holds an item."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def finder(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(index.value.search(batch.column(1)))
                rows, *rest = zip(*found, strict=True) if found else ([], [], [], [], [])
                kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, k) for x, k in zip(rest, kinds, strict=True)]],
                    names=["doc_id", "item_id", "bm25", "question_overlap", "answer_overlap"],
                )

        return docs.mapInArrow(run, "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double")

    out = _by_part(benchmark, lambda index, found: finder(index) if found is None else found.union(finder(index)))
    best = F.max(F.struct("question_overlap", "answer_overlap", "bm25")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.bm25", "best.question_overlap", "best.answer_overlap")


def _by_part(benchmark: DataFrame, step) -> DataFrame:
    """``step`` from part to part. What it makes of a part is written before the next one's index is broadcast; the last one's stays."""
    out = held = None
    for index in _indexes(benchmark):
        if held is not None:
            out = written(out, "benchmark-part")
            held.unpersist()
        out, held = step(index, out), index
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item, in one pass for each part of the items, without a shuffle."""
    at = docs.columns.index("text")

    def keeper(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for row, *_ in index.value.search(batch.column(at)):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        return run

    return _by_part(benchmark, lambda index, left: (docs if left is None else left).mapInArrow(keeper(index), docs.schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
