"""A quality classifier: perplexity under a modified Kneser-Ney model of trusted text.

The model is an interpolated trigram model of words with modified Kneser-Ney
discounts (Chen and Goodman, 1998), trained on a bounded sample of the labelled rows
that are trusted: of those with an even hash of their id the first ``train_docs``, of at
most ``train_bytes`` bytes each and ``train_words`` words together.

Counts, continuation counts, context sums and discounts are tables that Spark joins
and sums; an n-gram is one number there, the places of its words in the sample's
vocabulary.  An interpolated model is a sum of logs over the n-grams of a text: a known
n-gram weighs what its probability exceeds the one from lower orders by, and a context
what it leaves over.  So the model ends as one table (n-gram, weight), dealt into shards by
the n-gram, and a document's log probability is the sum of its n-grams' weights: each
text's distinct n-grams are counted where the text is and joined with the shards.  Three
things of bounded size spare most of that shuffle: the vocabulary, as an n-gram of an
unknown word weighs nothing; a bitmap of the model's n-grams, behind which unknown ones
stay; and the n-grams that are the most frequent in the sample, which are weighed in
place.  The latter are also the ones that a join by key would run hot on.

A document's score is its mean log probability per token, drawn to its language's
mean as if by PRIOR more tokens, so that a few words decide nothing.  A language's
threshold lies below its mean by a quantile of the distances of all its trusted
documents outside the sample, drawn to that of all languages by ENOUGH more documents,
and is widened where the mean comes from a few documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm import common

TRAIN_DOCS = 3000
TRAIN_WORDS = (1 << 21) - 3
#: Documents of more bytes stay out of the sample.
TRAIN_BYTES = 1 << 16
PRIOR = 25.0
#: The share of trusted documents below the threshold, before the margin.
QUANTILE = 0.005
#: How far below that quantile the threshold lies, in units of the distance from the language's mean to it.
MARGIN = 0.15
#: The distance of all languages counts as much as this many trusted documents of a language: enough to have one below the quantile.
ENOUGH = 200
#: N-grams of the model that are weighed without a join, at most.
FREQUENT = 1 << 18
#: Bits of a word's number in an n-gram; the vocabulary is never larger than the sample.
ID_BITS = 21
#: Bits of the map of the model's n-grams: 16 MB, for at most 2 * TRAIN_WORDS of them.
MAP_BITS = 27
#: Numbers of words: unknown, begin and end come first.
UNKNOWN, BOS, EOS, FIRST = 0, 1, 2, 3


@dataclass
class Model:
    """The vocabulary's hashes, sorted, the weights of its words by number, and the table (k, x, c) of longer n-grams: weight and occurrences."""

    words: np.ndarray
    x: np.ndarray
    weights: DataFrame


def numbered(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's words by number, between two begins and an end, and the rows."""
    first, length, row = common.words(data, offsets)
    h, rows = common.word_hashes(data, first, length), len(offsets) - 1
    at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
    number = np.where(vocabulary[at] == h, at + FIRST, UNKNOWN) if len(vocabulary) else np.zeros(len(h), np.int64)
    sizes = np.bincount(row, minlength=rows)
    starts = np.cumsum(sizes + 3) - (sizes + 3)
    out = np.full(int((sizes + 3).sum()), EOS, np.int64)
    out[starts] = out[starts + 1] = BOS
    out[np.arange(len(h)) + 3 * row + 2] = number
    return out, np.repeat(np.arange(rows), sizes + 3)


def packed(s: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of known words as one number each, and their rows."""
    end = max(0, len(s) - n + 1)
    out, inside = np.zeros(end, np.int64), row[:end] == row[n - 1 :]
    for k in range(n):
        out = out << ID_BITS | s[k : end + k]
        inside = inside & (s[k : end + k] != UNKNOWN)
    return out[inside], row[:end][inside]


def _vocabulary(docs: DataFrame) -> np.ndarray:
    def make(batch: pa.RecordBatch):
        for _, _, data, offsets in common.chunks(batch.column(0)):
            first, length, _ = common.words(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(common.signed(np.unique(common.word_hashes(data, first, length))))], ["h"])

    (h,) = common.arrays(common.per_batch(docs, make, "h long").distinct())  # at most as many as the sample has words
    return np.sort(h.astype(np.int64).view(np.uint64))


def _discounted(n1: int, n2: int, n3: int, n4: int):
    """What modified Kneser-Ney takes from a count c, by the numbers of n-grams that occur once to four times."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    d = [min(max(k - (k + 1) * y * b / a, 0.1 * k), 0.95 * k) if a else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def train(docs: DataFrame, scratch: common.Scratch) -> Model:
    """The model of a bounded table (text); tables go to the scratch folder.

    Without any rows every word has probability 1 and no n-gram weighs anything.
    """
    vocabulary = _vocabulary(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make(batch: pa.RecordBatch):
        for _, _, data, offsets in common.chunks(batch.column(0)):
            k, _ = packed(*numbered(data, offsets, shared.value), 3)
            yield pa.RecordBatch.from_arrays([pa.array(k)], ["k"])

    low = lambda k, n: F.col(k).bitwiseAND((1 << n * ID_BITS) - 1)
    high = lambda k: F.shiftright(k, ID_BITS)
    three = scratch.table(common.per_batch(docs, make, "k long").groupBy("k").agg(F.count("*").alias("c")))
    # lower orders count the words before: begins have none, and keep their counts
    begin = high("k") == BOS
    two = three.groupBy(low("k", 2).alias("k")).agg(F.count("*").alias("kinds"), F.sum("c").alias("seen"))
    two = scratch.table(two.select("k", F.when(begin, F.col("seen")).otherwise(F.col("kinds")).alias("c"), "seen"))
    one = two.groupBy(low("k", 1).alias("w")).agg(F.count("*").alias("c"))
    orders = reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("n"), "c") for n, t in ((1, one), (2, two), (3, three))])
    found = {r["n"]: r for r in orders.groupBy("n").agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)], F.count("*").alias("rows")).collect()}
    cut = {n: _discounted(*(found[n][f"n{k}"] if n in found else 0 for k in (1, 2, 3, 4))) for n in (1, 2, 3)}
    total, left = one.agg(F.sum("c"), F.sum(cut[1])).first()
    unseen = left / total / (found[1]["rows"] + 1) if found else 1.0
    one = one.select("w", ((F.col("c") - cut[1]) / F.lit(float(total or 1)) + F.lit(unseen)).alias("p1"))
    rest = lambda n, of: F.sum(cut[n]).over(of) / F.sum("c").over(of)
    own = lambda n, of: (F.col("c") - cut[n]) / F.sum("c").over(of)
    of = Window.partitionBy("v")
    two = two.withColumn("v", high("k")).withColumns({"g": rest(2, of), "own": own(2, of), "w": low("k", 1)}).join(one, "w")
    two = scratch.table(two.select("k", "v", "seen", "g", "p1", (F.col("own") + F.col("g") * F.col("p1")).alias("p2")))
    of = Window.partitionBy("uv")
    three = three.withColumn("uv", high("k")).withColumns({"g": rest(3, of), "own": own(3, of), "vw": low("k", 2)}).join(two.select(F.col("k").alias("vw"), "p2"), "vw")
    three = scratch.table(three.select("k", "uv", "c", "g", "p2", (F.col("own") + F.col("g") * F.col("p2")).alias("p3")))
    over = lambda p, *less: reduce(lambda a, b: a - F.log10(b), less, F.log10(p)).alias("x")
    pairs = two.select("k", over("p2", "g", "p1"), F.col("seen").alias("c")).unionByName(three.groupBy(F.col("uv").alias("k")).agg(F.log10(F.first("g")).alias("x"), F.sum("c").alias("c")))
    weights = scratch.table(three.select("k", over("p3", "g", "p2"), "c").unionByName(pairs.groupBy("k").agg(F.sum("x").alias("x"), F.max("c").alias("c"))))
    x = np.zeros(len(vocabulary) + FIRST)
    x[UNKNOWN] = log10(unseen)
    for t in (one.select("w", F.log10("p1").alias("x")), two.groupBy("v").agg(F.log10(F.first("g")).alias("x"))):
        at, value = common.arrays(t)
        x[at.astype(np.int64)] += value
    return Model(vocabulary, x, weights)


def sample(docs: DataFrame, trusted: DataFrame, most: int, words: int, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, text): the first trusted documents with an even hash of their id, up to a number of documents and of words."""
    ids = trusted.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.where(F.octet_length("text") <= most_bytes).join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sized = common.settled(rows.select("doc_id", "text", F.regexp_count("text", F.lit(common.WORD)).alias("n")))
    # at most ``most`` rows, so one task may sum them up
    before = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = sized.select("doc_id", before.alias("n")).where(F.col("n") <= words).select("doc_id")
    return sized.join(F.broadcast(inside), "doc_id", "left_semi").select("doc_id", "text")


def log_probabilities(docs: DataFrame, model: Model, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, lang, t, n_tokens, log10_prob) from (doc_id, text, lang, t): the sums of the weights of all n-grams of each text."""
    first = common.most_frequent(model.weights, frequent, "c")
    keys, values = common.arrays(first.select("k", "x"))
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.x, keys[order].astype(np.int64), values[order].astype(float), common.hash_map(model.weights, F.xxhash64("k"), MAP_BITS)))

    def make(batch: pa.RecordBatch):
        words, x, top, weight, bits = shared.value
        for at, end, data, offsets in common.chunks(batch.column(1)):
            rows = end - at
            s, of = numbered(data, offsets, words)
            n_tokens = np.bincount(of, minlength=rows) - 2
            log = np.bincount(of, x[s], rows) - x[BOS]  # of the two begins one is a context
            k, r = (np.concatenate(y) for y in zip(packed(s, of, 2), packed(s, of, 3), strict=True))
            known = common.in_map(bits, common.xxhash64(k), MAP_BITS)
            k, r = k[known], r[known]
            if len(top):
                place = np.minimum(np.searchsorted(top, k), len(top) - 1)
                here = top[place] == k
                log += np.bincount(r[here], weight[place[here]], rows)
                k, r = k[~here], r[~here]
            # the distinct others of each text, counted
            order = np.lexsort((k, r))
            k, r = k[order], r[order]
            new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])))) if len(k) else np.zeros(0, np.int64)
            starts = pa.array(np.searchsorted(r[new], np.arange(rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(v)) for v in (k[new], np.diff(new, append=len(k)).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i)[at:end] for i in (0, 2, 3, 4)), pa.array(n_tokens), pa.array(log), *lists], ["doc_id", "lang", "t", "r", "n_tokens", "log", "k", "n"])

    rows = common.per_batch(docs.select("doc_id", "text", "lang", "t", F.monotonically_increasing_id().alias("r")), make, "doc_id long, lang string, t long, r long, n_tokens long, log double, k array<long>, n array<int>")
    # one row for each n-gram that is looked up; the first one of a text, or a row without any, carries what the text has so far
    names = ["doc_id", "lang", "t", "n_tokens", "log"]
    items = rows.select(*names, "r", F.posexplode_outer(F.arrays_zip("k", "n")).alias("pos", "y"))
    head = F.coalesce("pos", F.lit(0)) == 0
    items = items.select("r", *[F.when(head, F.col(c)).alias(c) for c in names], F.coalesce("y.k", -F.col("r") - 1).alias("k"), "y.n")
    rest = model.weights.join(first.select("k"), "k", "left_anti").select("k", "x")
    sums = items.join(rest, "k", "left").groupBy("r").agg(*[F.max(c).alias(c) for c in names], F.sum(F.coalesce(F.col("n") * F.col("x"), F.lit(0.0))).alias("more"))
    return common.settled(sums.select(*names[:4], (F.col("log") + F.col("more")).alias("log10_prob")), shared)


def quality(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_words: int = TRAIN_WORDS, quantile: float = QUANTILE, margin: float = MARGIN, prior: float = PRIOR, enough: int = ENOUGH, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, lang, t, n_tokens, log10_prob, perplexity, score, threshold, keep), one row for each row of docs.

    labels has (doc_id, quality, toxic); a document is trusted if some row of it has
    quality 1 and none has quality 0 or toxic 1.  A null text or id is scored too: a null or wordless text is
    its end alone and, like every text of a few words, stays near its language's mean
    and is kept.  A null language is a language of its own; one without trusted
    documents outside the sample takes the mean and the threshold of all languages.
    Without any trusted document, or with none that differs from its language's mean,
    everything is kept, as is a score that equals its threshold.  Repeated rows get a row each.
    t is the xxhash64 of the text.  Other columns are not read.
    """
    if train_words > TRAIN_WORDS:
        raise ValueError(f"the sample has at most {TRAIN_WORDS} words")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.xxhash64("text").alias("t"))
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    trusted = common.settled(labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce(good, F.lit(False))).alias("t")).where("t").select("doc_id"))
    chosen = common.settled(sample(docs, trusted, train_docs, train_words, train_bytes))
    scratch = common.Scratch(docs.sparkSession)
    scored = log_probabilities(docs, train(chosen.select("text"), scratch))
    scratch.clear()
    rest = trusted.join(chosen.select("doc_id"), "doc_id", "left_anti")
    held = common.settled(scored.join(rest, "doc_id", "left_semi"))
    mean = F.sum("log10_prob") / F.sum("n_tokens")
    overall = held.agg(mean).first()[0]
    # a mean of few documents or tokens is itself uncertain, which widens the distance
    by_lang = held.groupBy("lang").agg(mean.alias("mean"), F.sqrt(1 + 1 / F.count("*") + prior / F.sum("n_tokens")).alias("wide"))
    drawn = (F.col("log10_prob") + prior * F.col("mean")) / (F.col("n_tokens") + prior)
    low = lambda c: F.percentile_approx(c, F.lit(quantile), F.lit(10000))
    with_mean = held.alias("a").join(by_lang.alias("b"), F.expr("a.lang <=> b.lang")).select("a.*", "b.mean", "b.wide")
    q, usual = with_mean.agg(low(drawn), -low(drawn - F.col("mean"))).first()
    some = usual is not None and usual > 1e-9  # else no distance is known
    all_limit = q - margin * (overall - q) if some else None
    own = (-F.count("*") * low(drawn - F.col("mean")) + F.lit(enough) * F.lit(usual if some else None).cast("double")) / (F.count("*") + enough)
    limits = with_mean.groupBy("lang", "mean", "wide").agg((F.col("mean") - (1 + margin) * F.col("wide") * own).alias("threshold"))
    out = scored.alias("a").join(limits.alias("b"), F.expr("a.lang <=> b.lang"), "left")
    out = out.select("a.*", F.coalesce("b.mean", F.lit(overall).cast("double")).alias("mean"), F.coalesce("b.threshold", F.lit(all_limit).cast("double")).alias("threshold"))
    score = (F.col("log10_prob") + prior * F.col("mean")) / (F.col("n_tokens") + prior)
    return out.select("doc_id", "lang", "t", "n_tokens", "log10_prob", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens")).alias("perplexity"), score.alias("score"), "threshold").withColumn("keep", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(True)))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).drop("t")


def without_rejected(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The rows of docs (doc_id, text, lang and any others) that quality() keeps.

    Null and wordless texts, null ids and languages are kept or go as quality() says;
    without trusted documents all rows stay, repeated ones too, and a score that equals the threshold is kept.
    """
    bad = quality(docs, labels, **kw).where("not keep").select(F.col("doc_id").alias("__d"), F.col("lang").alias("__l"), F.col("t").alias("__t")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("lang").eqNullSafe(F.col("__l")) & (F.xxhash64("text") == F.col("__t")), "left_anti")
