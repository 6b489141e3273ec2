"""Periodic runs of words: stretches that repeat one phrase, by a suffix automaton with link-cut access.

Each row's words are appended one by one to a suffix automaton. The states on the path of suffix links
from the newest prefix to the root are its suffixes; each state has a colour, the place where its words
ended last. States of one colour on a path form a segment, kept as a splay tree, and an appended word
recolours its whole path: it walks over the old segments and makes one of them. A segment with longest
length L and colour e, met when the word at i is appended, says that the L words that end at i also end
at e and, if they are at least p = i - e words, that the square of period p ends here; its run began at
i - p - L + 1, as L is the longest. A run of period p is met at each of its places from the second period
on, so its end is the last place at which it is met. No period found is a multiple of a smaller one: the
smaller period's occurrence would have been the later one.

Only words that can lie in a run are appended. A run of length 6 or more and four periods or more holds
each of its groups of up to five words again within one period. So words are cut, for all rows of a
portion at once, where a group of five words does not come again in what is left, or not near enough;
this is done until nothing changes, at most ``ROUNDS`` times. It cuts no run: what it leaves only takes longer.

Words are runs of anything but space and bytes 0x09 to 0x0D, compared byte by byte.

Defined results: a null or empty text has no words, no runs and an empty collapsed text. Whole texts are
searched, at any length; memory is proportional to a text's words. Null ids, repeated rows and further
columns are kept; columns called ``runs`` or ``collapsed`` in any case are replaced. Runs may overlap;
each is listed once, by start, then period. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.shared import without
from tidewright.llm.tokens import bytes_of, mix, runs
from tidewright.sources.tables import table

#: A run has at least so many words and so many periods.
LEAST, TIMES = 6, 4
#: Words of a group that must come again; LEAST - 1 is the most that a run of one repeated word allows.
GROUP = LEAST - 1
#: Rounds of cutting, so that texts which lose a word a round take no square time.
ROUNDS = 8
_RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def squares(ids: list[int]) -> dict[tuple[int, int], int]:
    """(start, period) of every run of ``ids`` of at least two periods, and the place of its last word."""
    found: dict[tuple[int, int], int] = {}
    # The automaton: state 0 is none, 1 the root. Splay trees by left, right and up; colour is kept at a tree's root,
    # whose up is the state above the segment.
    link, size, goes = [0, 0], [0, 0], [{}, {}]
    left, right, up, colour = [0, 0], [0, 0], [0, 0], [0, -1]

    def splay(x: int) -> None:
        while (p := up[x]) and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                first = p if (left[g] == p) == (left[p] == x) else x
                turn(first)
                turn(x)
            else:
                turn(x)
                return

    def turn(x: int) -> None:
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
                return
            if right[g] == p:
                right[g] = x
                return
        colour[x] = colour[p]  # x is the root of its tree now

    last = 1
    for i, c in enumerate(ids):
        new = len(link)
        link.append(0)
        size.append(i + 1)
        goes.append({})
        left.append(0)
        right.append(0)
        up.append(0)
        colour.append(i)
        p = last
        while p and c not in (step := goes[p]):
            step[c] = new
            p = link[p]
        if not p:
            parent = 1
        else:
            q = goes[p][c]
            if size[q] == size[p] + 1:
                parent = q
            else:  # split q: its shorter words are a state of their own, in the same segment right above it
                parent = len(link)
                link.append(link[q])
                size.append(size[p] + 1)
                goes.append(goes[q].copy())
                splay(q)
                above = left[q]
                left.append(above)
                right.append(0)
                up.append(q)
                colour.append(-1)
                if above:
                    up[above] = parent
                left[q] = parent
                link[q] = parent
                while p and goes[p].get(c) == q:
                    goes[p][c] = parent
                    p = link[p]
        link[new] = last_up = parent
        up[new] = last_up
        # Access: the path from the new state to the root becomes one segment of colour i.
        below, x = new, parent
        while x:
            splay(x)
            period = i - colour[x]
            if period <= size[x] and x != 1:
                found[i - period - size[x] + 1, period] = i
            if r := right[x]:
                colour[r] = colour[x]  # what hangs below stays a segment of the old colour; its up is x
            right[x] = below
            below, x = x, up[x]
        colour[below] = i
        last = new
    return found


def periodic(ids: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``ids``, by start, then period."""
    out = [(s, e - s + 1, p) for (s, p), e in squares(ids).items() if e - s + 1 >= max(LEAST, TIMES * p)]
    return sorted(out)


def stretches(ids: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of ``ids`` outside of which no run lies; ``offs`` are the starts of the rows.

    Equal numbers in different rows need not mean equal words.
    """
    n = len(ids)
    group = np.zeros(max(0, n - GROUP + 1), np.uint64)
    for k in range(GROUP):
        group = mix(group + ids[k : k + len(group)].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    starts, ends = offs[:-1], offs[1:]
    for left in reversed(range(ROUNDS)):
        long = ends - starts >= LEAST
        starts, ends = starts[long], ends[long]
        count = ends - starts - GROUP + 1
        total = int(count.sum())
        if not total:
            return
        part = np.repeat(np.arange(len(starts)), count)
        at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + starts[part]
        # Equal groups of one range next to each other, by place.
        key = mix(group[at] + mix(part.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        key, place = key[order], at[order]
        far = np.iinfo(np.int64).max
        gap = np.where(key[1:] == key[:-1], place[1:] - place[:-1], far)
        near = np.minimum(np.append(gap, far), np.insert(gap, 0, far))
        # A run within a range has a period of at most a fourth of it.
        again = np.empty(total, bool)
        again[order] = near <= (ends - starts)[part[order]] // TIMES
        if not left or again.all():
            yield from zip(starts.tolist(), ends.tolist(), strict=True)
            return
        edge = again.copy()
        edge[1:] &= ~(again[:-1] & (part[1:] == part[:-1]))
        close = again.copy()
        close[:-1] &= ~(again[1:] & (part[1:] == part[:-1]))
        starts, ends = at[edge], at[close] + GROUP


def searched(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """The runs of each text, and its words without those that repeat a run's first period."""
    words = [x.split() for x in texts]
    numbers: dict[bytes, int] = {}
    for w in words:
        for x in w:
            numbers.setdefault(x, len(numbers))
    offs = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=offs[1:])
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(offs[-1]))
    found: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in stretches(ids, offs):
        if here := periodic(ids[a:b].tolist()):
            row = int(np.searchsorted(offs, a, "right")) - 1
            found.setdefault(row, []).extend((s + a - int(offs[row]), m, p) for s, m, p in here)
    for k, w in enumerate(words):
        here = sorted(found.get(k, ()))
        if here:
            gone = np.zeros(len(w) + 1, np.int64)
            np.add.at(gone, [s + p for s, _, p in here], 1)
            np.add.at(gone, [s + m for s, m, _ in here], -1)
            w = [x for x, drop in zip(w, np.cumsum(gone)[:-1].tolist(), strict=True) if not drop]
        yield here, b" ".join(w)


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period, in words) and ``collapsed``, the text without repeats.

    Rows stay where they are: there is no shuffle.
    """
    docs = without(docs, "runs", "collapsed")
    schema = T.StructType([*docs.schema.fields, T.StructField("runs", _RUN), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for batch in batches:
            raw, offs = bytes_of(batch.column(batch.schema.get_field_index(text)))
            for i, j in runs(offs):
                found, kept = zip(*searched([raw[offs[k] : offs[k + 1]].tobytes() for k in range(i, j)]), strict=True)
                lists = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in found], kind)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, lists, pa.array(kept, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "runs", "collapsed"])

    return docs.mapInArrow(run, schema)


def planted(text: Column, doc_id: Column) -> Column:
    """``text``, for every tenth id with a tail that repeats: words from a on become the words a + (i - a) % p."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        more = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.element_at(w, (1 + a + i % p).cast("int")))
        return F.array_join(F.concat(F.slice(w, 1, a), more), " ")

    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(text))[0]
    return F.when(h % 10 == 0, changed).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, every tenth with a planted tail."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    out = with_runs(docs)
    rank = lambda r: F.struct(-r["start"], -r["period"])
    better = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"]) | ((b["length"] * a["period"] == a["length"] * b["period"]) & (rank(b) > rank(a)))
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("listed"), "collapsed")
    return out.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
