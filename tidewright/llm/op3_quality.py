"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes (A to Z and punctuation as they are), of order ``ORDER``. Training counts the n-grams of
trusted texts, in shards by n-gram; continuation counts, discounts, backoff weights and
probabilities of each order follow from aggregations and joins of these count tables. Scoring
counts each document's n-grams and joins them with the tables of all orders: the sum of log
probabilities gives the perplexity per byte.

An n-gram g of w after context h has

    p(w|h) = max(c(g) - D(c(g)), 0) / C(h) + gamma(h) p(w|h'),   gamma(h) = (D1 N1 + D2 N2 + D3 N3) / C(h)

with h' the context less its first byte, counts below the top order being numbers of distinct
bytes in front, and a uniform distribution over 256 bytes at the bottom.

A document is rejected if its perplexity is above that of the quantile ``QUANTILE`` of the trusted
documents of its language, times ``SLACK``. It is also rejected if it is toxic: a few words tell, and
are lost in a perplexity over all of them, so it is as toxic as its most telling word. A word tells
by the likelihood ratio (G2) of being in toxic-labelled and in trusted documents, if it is in a larger
share of the toxic ones; what is above the quantile ``QUANTILE`` of trusted documents is toxic.

Defined results
---------------
* the model learns from at most ``TRAIN_DOCS`` trusted documents, those of the smallest hash;
  thresholds come from all trusted documents. Words are counted in these and in at most as many
  toxic ones.
* trusted is quality 1 and not toxic; a document with several labels is toxic if one is. Labels
  without a column ``toxic`` have no toxic documents, and then, or without trusted ones, none is found.
* null or empty text has no perplexity and is kept. A null language is a language of its own;
  a language without trusted documents takes the quantile over all languages. Without any
  trusted document nothing is rejected.
* equal texts get the same score; those of a batch are counted once, and a key's sums are means over its copies, so
  a text that a third of all rows have is summed in parts; a document with several labels has quality 1 if one has. A tie with a threshold is kept.
* texts may be of any length; they are counted whole, in pieces. An empty table gives an empty table. Other
  columns are not read, or kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.shared import written
from tidewright.llm.tokens import bytes_of, runs
from tidewright.sources.tables import table

#: Order of the model, bound of the training sample, and what is rejected.
ORDER, TRAIN_DOCS, QUANTILE, SLACK = 3, 20_000, 0.99, 1.15
SEED = 29
#: Bytes of a text that are counted at once.
PIECE = 1 << 20


def grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, gram, n): how often each n-gram is in a piece of a text of ``texts`` (key, text); sum over the pieces of a key.

    The first bytes are counted after a context filled up with byte 0, the end is a byte 0 more;
    so a text has one n-gram for each byte and one for its end, each as a number of 8 bits a byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).cast(pa.int64()).to_numpy()
            once = np.zeros(len(key), bool)
            once[np.unique(key, return_index=True)[1]] = True  # copies in a batch have the same n-grams
            data, offs = bytes_of(batch.column(1))
            for i, j in runs(offs):
                keys, found, counts = [], [], []
                for r, at in ((r, at) for r in range(i, j) if once[r] for at in range(int(offs[r]), int(offs[r + 1]), PIECE)):
                    # A piece of a text with the bytes before it; the last one also has the end.
                    text = data[at : min(at + PIECE, offs[r + 1])]
                    last = at + PIECE >= offs[r + 1]
                    head = data[max(offs[r], at - order + 1) : at]
                    padded = np.zeros(len(text) + order - 1 + last, np.int64)
                    padded[order - 1 - len(head) : order - 1] = head
                    padded[order - 1 : order - 1 + len(text)] = text
                    size = len(text) + last
                    code = padded[:size].copy()
                    for k in range(1, order):
                        code = (code << 8) | padded[k : k + size]
                    g, n = np.unique(code, return_counts=True)
                    keys.append(np.full(len(g), key[r]))
                    found.append(g)
                    counts.append(n)
                if keys:
                    yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in (keys, found, counts)], names=["key", "gram", "n"])

    return texts.mapInArrow(run, "key long, gram long, n long")


def _levels(top: DataFrame, order: int) -> list[DataFrame]:
    """Count tables (gram, c) of orders 1 to ``order``: continuation counts below the top."""
    out = [top]
    for k in range(order - 1, 0, -1):
        out.append(out[-1].groupBy((F.col("gram") % (1 << 8 * k)).alias("gram")).agg(F.count(F.lit(1)).alias("c")))
    return out[::-1]


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ from the numbers of n-grams that were counted one to four times."""
    n = dict(counts.where("c <= 4").groupBy("c").count().collect())  # at most four rows
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]


def train(trusted: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: tables (gram, p) and (context, gamma) of texts ``trusted`` (key, text)."""
    top = written(grams(trusted, order).groupBy("gram").agg(F.sum("n").alias("c")), "kn-counts")
    model: list[tuple[DataFrame, DataFrame]] = []
    for k, counts in enumerate(_levels(top, order), 1):
        d1, d2, d3 = _discounts(counts)
        counts = counts.withColumn("context", F.shiftright("gram", 8))
        d = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        contexts = counts.groupBy("context").agg(F.sum("c").alias("total"), (F.sum(d) / F.sum("c")).alias("gamma"))
        p = (F.col("c") - d) / F.col("total")
        if k == 1:
            below = F.lit(1 / 256)
            joined = counts.join(contexts, "context")
        else:
            below = F.col("p")
            lower = model[-1][0].select(F.col("gram").alias("suffix"), "p")
            joined = counts.join(contexts, "context").withColumn("suffix", F.col("gram") % (1 << 8 * (k - 1))).join(lower, "suffix")
        grams_p = written(joined.select("gram", (p + F.col("gamma") * below).alias("p")), f"kn-{k}")
        model.append((grams_p, written(contexts.select("context", "gamma"), f"kn-backoff-{k}")))
    return model


#: Rows, of two numbers, up to which a table of the model is broadcast (some 50 MB); a larger one is joined by shuffling.
BROADCAST_ROWS = 1 << 20


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def perplexities(texts: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(key, perplexity) of each text of ``texts`` (key, text) that has bytes."""
    order = len(model)
    rows = grams(texts, order)
    p = F.lit(1 / 256)
    for k, (found, backoff) in enumerate(model, 1):
        # p of order k: the table's if the n-gram is in it, else backed off from below.
        rows = rows.withColumn("own", F.col("gram") % (1 << 8 * k)).withColumn("ctx", F.shiftright("own", 8))
        rows = rows.join(_side(found.select(F.col("gram").alias("own"), F.col("p").alias(f"p{k}"))), "own", "left")
        rows = rows.join(_side(backoff.select(F.col("context").alias("ctx"), F.col("gamma").alias(f"g{k}"))), "ctx", "left")
        p = F.coalesce(f"p{k}", F.coalesce(f"g{k}", F.lit(1.0)) * p)
    return (
        rows.select("key", "n", (F.col("n") * F.log(p)).alias("log"))
        .groupBy("key")
        .agg((F.sum("log") / F.sum("n")).alias("mean"))
        .select("key", F.exp(-F.col("mean")).alias("perplexity"))
    )


def _key(text: str = "text"):
    return F.xxhash64(text, F.lit(SEED))


def _words(texts: DataFrame) -> DataFrame:
    """(key, word) of the distinct words, as hashes, of ``texts`` (key, text): lower case, letters and digits."""
    words = F.array_remove(F.split(F.lower("text"), "[\\x00-/:-`{-\\x7F]+"), "")
    return texts.select("key", F.explode(F.array_distinct(words)).alias("word")).select("key", F.xxhash64("word").alias("word"))


def telling_words(toxic: DataFrame, trusted: DataFrame) -> DataFrame:
    """(word, tells) of words that a larger share of texts ``toxic`` than of ``trusted``, both (key, text), has."""
    n_toxic, n_trusted = toxic.count(), trusted.count()
    each = _words(toxic).withColumn("x", F.lit(1)).unionByName(_words(trusted).withColumn("x", F.lit(0)))
    counts = each.groupBy("word").agg(F.sum("x").alias("a"), F.sum(1 - F.col("x")).alias("b")).where(F.col("a") * n_trusted > F.col("b") * n_toxic)
    a, b, n = F.col("a"), F.col("b"), n_toxic + n_trusted
    cells = [(a, (a + b) * n_toxic / n), (b, (a + b) * n_trusted / n), (n_toxic - a, (n - a - b) * n_toxic / n), (n_trusted - b, (n - a - b) * n_trusted / n)]
    tells = sum((F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0) for seen, expected in cells), F.lit(0.0)) * 2
    return written(counts.select("word", tells.alias("tells")), "quality-words")


def toxicities(texts: DataFrame, telling: DataFrame) -> DataFrame:
    """(key, toxicity) of each text of ``texts`` (key, text) that has a telling word."""
    return _words(texts).join(_side(telling), "word").groupBy("key").agg(F.max("tells").alias("toxicity"))


#: Bins to a unit of log(1 + value), and finer ones in each of them.
BINS, FINER = 1 << 10, 1 << 16


def quantiles(rows: DataFrame, quantile: float) -> DataFrame:
    """(of, value): for each group ``of`` of ``rows`` (of, value) its smallest value that the part ``quantile`` of its rows does not exceed.

    Values are 0 or more; rows without one are left out. The rank is looked for among the counts of bins, then of finer
    bins in the one that holds it, then of the values in that: exact at any size, and no window takes more than the bins.
    """
    counts = written(rows.where("value is not null").groupBy("of", "value").agg(F.count(F.lit(1)).alias("n")), "quality-values")
    at = F.log1p("value") * BINS
    finer = F.floor((at - F.floor(at)) * FINER)
    rank = counts.groupBy("of").agg(F.greatest(F.ceil(F.sum("n") * F.lit(quantile)), F.lit(1)).alias("rank"))

    def holding(counts: DataFrame, step: Column, rank: DataFrame) -> DataFrame:
        # (of, at, rank): the first step at which a group's rank is reached, and the rank among that step's rows.
        sums = counts.groupBy("of", step.alias("at")).agg(F.sum("n").alias("n"))
        sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("of").orderBy("at")) - F.col("n"))
        rank = rank.select(F.col("of").alias("whose"), "rank")
        found = sums.join(rank, F.col("of").eqNullSafe(F.col("whose"))).where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("n")))
        return found.select("of", "at", (F.col("rank") - F.col("before")).alias("rank"))

    for step in (F.floor(at), finer):
        rank = holding(counts, step, rank)
        whose = rank.select(F.col("of").alias("whose"), F.col("at").alias("there"))
        counts = counts.join(whose, F.col("of").eqNullSafe(F.col("whose")) & (step == F.col("there")), "left_semi")
    return written(holding(counts, F.col("value"), rank).select("of", F.col("at").alias("value")), "quality-quantiles")


def _toxic(keyed: DataFrame, bad: DataFrame, trusted: DataFrame, first: DataFrame, docs: int, quantile: float) -> DataFrame | None:
    """(key) of toxic texts of ``keyed`` (key, text); None if labels show none. ``bad``, ``trusted`` and ``first`` are keys."""
    some = written(bad.orderBy(F.xxhash64("key"), "key").limit(docs), "quality-toxic-keys")
    if some.isEmpty() or trusted.isEmpty():
        return None
    texts = lambda keys: written(keyed.join(keys, "key", "left_semi").dropDuplicates(["key"]), "quality-labelled")
    telling = telling_words(texts(some), texts(first))
    # The threshold needs all words of trusted texts, all others only the few words that tell more than it. Words that
    # can be broadcast are looked up in all texts at once where these are read, so no text is shuffled.
    at_once = telling.count() <= BROADCAST_ROWS
    known = written(toxicities(keyed if at_once else keyed.join(trusted.select("key").distinct(), "key", "left_semi"), telling), "quality-toxicities")
    values = trusted.join(known, "key", "left").select(F.lit(0).alias("of"), F.coalesce("toxicity", F.lit(0.0)).alias("value"))
    most = quantiles(values, quantile).first()["value"]
    if at_once:
        return known.where(F.col("toxicity") > most).select("key")
    return written(toxicities(keyed, written(telling.where(F.col("tells") > most), "quality-telling")).select("key"), "quality-toxic")


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, train_docs: int = TRAIN_DOCS, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, lang, key, perplexity, threshold, keep.

    ``labels`` has doc_id, quality (1 for good) and toxic (1 for toxic; may be absent). ``key`` is a
    hash of the text.
    """
    ids = written(docs.select("doc_id", "lang", F.when(F.octet_length("text") > 0, _key()).alias("key")), "quality-ids")
    toxic = F.col("toxic") if "toxic" in labels.columns else F.lit(0)
    labels = labels.groupBy(F.col("doc_id").alias("of")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(toxic == 1, F.lit(False))).alias("bad"))
    labelled = ids.join(labels, ids.doc_id == labels.of).where("key is not null")
    bad = written(labelled.where("bad").select("key").distinct(), "quality-bad")
    trusted = labelled.where("good and not bad").join(bad, "key", "left_anti").select("doc_id", "lang", "key")
    first = written(trusted.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(train_docs), "quality-first")
    keyed = docs.select(_key().alias("key"), "text").where("octet_length(text) > 0")
    model = train(keyed.join(first, "key", "left_semi").dropDuplicates(["key"]), order)
    scored = written(perplexities(keyed, model), "quality-scores")
    if scored.limit(1).isEmpty():
        scored = scored.limit(0)
    of = trusted.join(scored, "key")
    by_lang = quantiles(of.select(F.col("lang").alias("of"), F.col("perplexity").alias("value")), quantile).select(F.col("of").alias("of_lang"), F.col("value").alias("own"))
    overall = quantiles(of.select(F.lit(0).alias("of"), F.col("perplexity").alias("value")), quantile).first()
    overall = overall["value"] if overall else None
    out = ids.join(scored, "key", "left").join(by_lang, F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    out = out.withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")) * slack)
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    found = _toxic(keyed, bad, trusted, first, train_docs, quantile)
    if found is not None:
        out = out.join(found.withColumn("toxic", F.lit(True)), "key", "left")
        keep = keep & F.col("toxic").isNull()
    return out.select("doc_id", "lang", "key", "perplexity", "threshold", keep.alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its perplexity and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return classify(docs, table(spark, sf_dir, "labels")).drop("key")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    rejected = classify(docs.select("doc_id", "text", "lang"), labels).where("not keep").select(F.col("key").alias("_key"), F.col("lang").alias("_lang")).distinct()
    at = (_key() == rejected["_key"]) & docs["lang"].eqNullSafe(rejected["_lang"])  # docs may have columns of these names
    return docs.join(rejected, at, "left_anti")
