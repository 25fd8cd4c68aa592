"""Removal of long word sequences that an earlier document has, by compacting a de Bruijn graph.

The graph is that of order ``SPAN``: each window of 50 words is a token k-mer, an edge
from its first to its last 49 words, and a text is a path of such edges.

* Edges are dealt out by their minimizer, the one of their sequences of ``K`` words with
  the least hash: equal edges have equal minimizers, and consecutive edges with one
  minimizer are a piece of path.  Only these pieces (one for some thirteen words) are
  shuffled, not the k-mers.
* A minimizer whose pieces all say the same has no branch: joined with the earliest
  place of that piece, each later one is a repeat.  Where it branches, the same holds for
  each of its distinct pieces, and the earliest of these are taken apart into their edges,
  which are grouped by themselves.
* Pieces of a text that follow each other and repeat a source at one shift are compacted
  to one long span (document, words, source, words of the source).
* Every span is verified at its coordinates in both source texts, by a digest of the words
  themselves.  The edges of spans that fail, which takes a collision of 64-bit hashes, are
  grouped again by such digests.

Pieces and documents without repeats are kept out of the joins by bitmaps whose size
follows a count, behind which the joins are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm import common

SPAN = 50
K = 24
_BASE = 0x9E6C63D0876A9A47
_INVERSE = pow(_BASE, -1, 1 << 64)


def _hashes(data: np.ndarray, first: np.ndarray, length: np.ndarray, bits: int) -> np.ndarray:
    h = common.word_hashes(data, first, length)
    return h if bits == 64 else h >> np.uint64(64 - bits)


def edges(h: np.ndarray, row: np.ndarray, span: int, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, content, row, first window, last window, windows) of the pieces of a chunk; windows by their first word in the chunk.

    Equal pieces in a row are one, which has the windows of each of them.
    """
    none = np.zeros(0, np.int64)
    if len(h) < span:
        return none, none, none, none, none, none
    nodes = common.gram_hashes(h, k)
    view = np.lib.stride_tricks.sliding_window_view(nodes, span - k + 1)
    at = view.argmin(axis=1) + np.arange(len(view))
    windows = np.flatnonzero(row[: len(view)] == row[span - 1 :])
    if not len(windows):
        return none, none, none, none, none, none
    at = at[windows]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)))
    s0 = windows[new]
    s1 = windows[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(windows) - 1]))]
    # polynomial of the words from s0 to s1 + span, moved to the origin
    n = len(h)
    one = np.ones(1, np.uint64)
    power = np.cumprod(np.concatenate((one, np.full(n, _BASE, np.uint64))))
    back = np.cumprod(np.concatenate((one, np.full(n, _INVERSE, np.uint64))))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[:n])))
    content = (total[s1 + span] - total[s0]) * back[s0]
    anchor = at[new]
    content = common.mix(content + (anchor - s0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (s1 - s0).astype(np.uint64))
    a = nodes[anchor]
    # equal pieces in a row, as a repeated word makes them, are one
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (content[1:] != content[:-1]) | (s0[1:] != s1[:-1] + 1)))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(a) - 1]))
    return a[new], content[new], row[s0[new]], s0[new], s1[last], (s1 - s0 + 1)[new]


def windows_of(h: np.ndarray, s0: np.ndarray, s1: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows from s0 to s1 each, by the words themselves."""
    n = s1 - s0 + 1
    start = np.repeat(s0, n) + common.segments(n)[1]
    out = np.zeros(len(start), np.uint64)
    for i in range(span):
        out = out * np.uint64(_BASE) + h[start + i]
    return start, common.mix(out)


def kept_text(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, length: np.ndarray, row: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """For each row its kept words, joined by one space."""
    first, length, row = first[keep], length[keep], row[keep]
    step = np.zeros(len(data) + 1, np.int8)
    step[first] += 1
    step[first + length] -= 1
    mask = np.cumsum(step[:-1], dtype=np.int8) > 0
    out = data.copy()
    later = first[np.concatenate(([False], row[1:] == row[:-1]))] - 1 if len(first) else first
    out[later] = 0x20
    mask[later] = True
    ends = np.concatenate(([0], np.cumsum(mask)))[offsets]
    raw = out[mask].tobytes()
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _tag(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """64 bits of each text, which tell rows with one doc_id apart."""
    raw = data.tobytes()
    return pa.array([int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little", signed=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64())


def _lists(values: np.ndarray, row: np.ndarray, rows: int, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.array(values, kind))


def profiles(docs: DataFrame, span: int, k: int, bits: int = 64) -> DataFrame:
    """Each document's words, the digest of all of them, and its edges (numbered by its own words)."""

    def make(batch: pa.RecordBatch):
        for at, end, data, offsets in common.chunks(batch.column(1)):
            first, length, row = common.words(data, offsets)
            h = _hashes(data, first, length, bits)
            sizes = np.bincount(row, minlength=end - at)
            a, c, of, s0, s1, n = edges(h, row, span, k)
            start = (np.cumsum(sizes) - sizes)[of]
            whole = [common.sha256(x) for x in kept_text(data, offsets, first, length, row, np.ones(len(first), bool))]
            lists = [_lists(common.signed(a), of, end - at, pa.int64()), _lists(common.signed(c), of, end - at, pa.int64()), _lists((s0 - start).astype(np.int32), of, end - at, pa.int32()), _lists((s1 - start).astype(np.int32), of, end - at, pa.int32()), _lists(n.astype(np.int32), of, end - at, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], _tag(data, offsets), pa.array(sizes.astype(np.int64)), pa.array(whole), *lists], ["doc_id", "t", "n_words", "sha", "a", "c", "s0", "s1", "n"])

    return common.per_batch(docs, make, "doc_id long, t long, n_words long, sha string, a array<long>, c array<long>, s0 array<int>, s1 array<int>, n array<int>")


def _only(profiles: DataFrame, anchors: DataFrame) -> tuple[DataFrame, Broadcast]:
    """(a, c, doc_id, t, s0, s1, n): the pieces whose anchor a bitmap of the given anchors lets through."""
    bits = common.map_bits(anchors.count())
    bitmap = anchors.sparkSession.sparkContext.broadcast(common.hash_map(anchors, "a", bits))

    def make(batch: pa.RecordBatch):
        rows = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
        a, c, s0, s1, n = (batch.column(i).flatten() for i in range(2, 7))
        ok = common.in_map(bitmap.value, a.to_numpy(zero_copy_only=False).view(np.uint64), bits)
        of = pa.array(rows[ok])
        ok = pa.array(ok)
        yield pa.RecordBatch.from_arrays([a.filter(ok), c.filter(ok), batch.column(0).take(of), batch.column(1).take(of), s0.filter(ok), s1.filter(ok), n.filter(ok)], ["a", "c", "doc_id", "t", "s0", "s1", "n"])

    return common.per_batch(profiles.where("doc_id is not null and size(a) > 0").select("doc_id", "t", "a", "c", "s0", "s1", "n"), make, "a long, c long, doc_id long, t long, s0 int, s1 int, n int"), bitmap


def _at(docs: DataFrame, places: DataFrame, make, schema: str) -> DataFrame:
    """Runs make(batch of doc_id, text, t, lo, hi, gone) on the documents that have places (doc_id, t, s0, s1, gone)."""
    per_doc = common.settled(places.groupBy("doc_id", "t").agg(F.collect_list(F.struct("s0", "s1", "gone")).alias("x")).select("doc_id", "t", F.col("x.s0").alias("lo"), F.col("x.s1").alias("hi"), F.col("x.gone").alias("gone")))
    found, size = common.id_filter(per_doc, "doc_id")
    bitmap = docs.sparkSession.sparkContext.broadcast(found)

    def tagged(batch: pa.RecordBatch):
        batch = batch.filter(pa.array(common.passes(bitmap.value, batch.column(2).to_numpy(zero_copy_only=False))))
        for at, end, data, offsets in common.chunks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], batch.column(1)[at:end], _tag(data, offsets)], ["doc_id", "text", "t"])
        if not batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.int64())], ["doc_id", "text", "t"])

    rows = common.per_batch(docs.where("doc_id is not null").select("doc_id", "text", common.slot_column("doc_id", size).alias("slot")), tagged, "doc_id long, text string, t long")
    return common.settled(common.per_batch(rows.dropDuplicates(["doc_id", "t"]).join(per_doc, ["doc_id", "t"]).select("doc_id", "text", "t", "lo", "hi", "gone"), make, schema), bitmap)


def _placed(batch: pa.RecordBatch):
    """For each chunk of texts: its rows, words and places, these as numbers of words in the chunk."""
    for at, end, data, offsets in common.chunks(batch.column(1)):
        first, length, row = common.words(data, offsets)
        part = batch.slice(at, end - at)
        of = np.repeat(np.arange(end - at), part.column(3).value_lengths().to_numpy(zero_copy_only=False))
        sizes = np.bincount(row, minlength=end - at)
        start = np.cumsum(sizes) - sizes
        lo, hi = (part.column(i).flatten().to_numpy() + start[of] for i in (3, 4))
        yield part, data, offsets, first, length, row, start, of, lo, hi


def _edges_at(span: int, exact: bool, bits: int = 64):
    """The windows at the places, by a hash of 64 bits or by a digest of their words."""

    def make(batch: pa.RecordBatch):
        for part, data, offsets, first, length, row, start, _, lo, hi in _placed(batch):
            s, w = windows_of(_hashes(data, first, length, bits), lo, hi, span)
            each = pa.array(row[s])
            if exact:
                texts = kept_text(data, offsets, first, length, row, np.ones(len(first), bool))
                ends = np.cumsum(length + 1)
                begin = (ends - length - 1) - (ends - length - 1)[np.minimum(start[row], len(first) - 1)] if len(first) else ends
                key = pa.array([hashlib.blake2b(texts[row[i]][begin[i] : begin[i + span - 1] + length[i + span - 1]], digest_size=16).digest() for i in s], pa.binary())
            else:
                key = pa.array(common.signed(w))
            yield pa.RecordBatch.from_arrays([key, part.column(0).take(each), part.column(2).take(each), pa.array((s - start[row[s]]).astype(np.int32))], ["w", "doc_id", "t", "s"])

    return make, f"w {'binary' if exact else 'long'}, doc_id long, t long, s int"


def _read(span: int, with_text: bool):
    """At the places: a digest of the words of each, and the text without those that go."""

    def make(batch: pa.RecordBatch):
        for part, data, offsets, first, length, row, start, of, lo, hi in _placed(batch):
            gone = part.column(5).flatten().to_numpy(zero_copy_only=False)
            texts = kept_text(data, offsets, first, length, row, np.ones(len(first), bool))
            ends = np.cumsum(length + 1)
            begin = (ends - length - 1) - (ends - length - 1)[start[row]]
            digests = [hashlib.blake2b(texts[r][begin[a] : begin[b + span - 1] + length[b + span - 1]], digest_size=16).digest() for r, a, b in zip(of, lo, hi, strict=True)]
            step = np.zeros(len(first) + 1, np.int64)
            np.add.at(step, lo[gone], 1)
            np.add.at(step, hi[gone] + span, -1)
            out = np.cumsum(step[:-1]) > 0
            kept = kept_text(data, offsets, first, length, row, ~out)
            counts = np.bincount(row[out], minlength=part.num_rows).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(part.num_rows + 1)), pa.int32()), pa.array(digests, pa.binary()))
            text = [pa.array([x.decode() for x in kept])] if with_text else []
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), part.column(4), lists, pa.array(counts), pa.array(list(map(common.sha256, kept))), *text], ["doc_id", "t", "lo", "hi", "digest", "n_removed", "kept_sha"] + ["kept"] * with_text)

    return make, "doc_id long, t long, lo array<int>, hi array<int>, digest array<binary>, n_removed long, kept_sha string" + ", kept string" * with_text


def _source(*place: str):
    """The earliest of places."""
    return F.min(F.struct(*[F.col(x).alias(y) for x, y in zip(place, ("m", "mt", "ms"), strict=True)])).alias("src")


def repeats(docs: DataFrame, prof: DataFrame, span: int, bits: int = 64) -> DataFrame:
    """(doc_id, t, s0, s1, m, mt, ms): windows s0 to s1 of a text that are, by their hashes, those from ms on of an earlier document m."""
    a = prof.where("doc_id is not null").select("doc_id", "t", F.explode(F.arrays_zip("a", "c", "s0")).alias("x")).select("doc_id", "t", "x.a", "x.c", "x.s0")
    nodes = a.groupBy("a").agg(_source("doc_id", "t", "s0"), F.max("doc_id").alias("last"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("src.m < last")
    nodes = common.settled(nodes.select("a", "src", (F.col("c0") < F.col("c1")).alias("branches")))
    only, spent = _only(prof, nodes)
    of = common.settled(only.join(nodes, "a"), spent)
    later = F.col("doc_id") > F.col("src.m")
    each = lambda df: df.select("doc_id", "t", "n", "src", F.explode(F.sequence("s0", "s1", "n")).alias("s0")).select("doc_id", "t", "s0", (F.col("s0") + F.col("n") - 1).alias("s1"), "src.*")
    paths = each(of.where(~F.col("branches") & later))
    branches = of.where("branches").drop("src")
    known = common.settled(branches.join(branches.groupBy("a", "c").agg(_source("doc_id", "t", "s0")), ["a", "c"]).select("doc_id", "t", "s0", "s1", "n", "src", later.alias("later")))
    edges = _at(docs, known.where("not later").withColumn("gone", F.lit(False)), *_edges_at(span, False, bits))
    first = edges.groupBy("w").agg(_source("doc_id", "t", "s"), F.max("doc_id").alias("last")).where("src.m < last").select("w", "src")
    single = edges.join(common.settled(first), "w").where(later).select("doc_id", "t", F.col("s").alias("s0"), F.col("s").alias("s1"), "src.*")
    return paths.unionByName(each(known.where("later"))).unionByName(single)


def compacted(repeated: DataFrame) -> DataFrame:
    """Repeats that follow each other in both texts as one, the longest possible."""
    w = Window.partitionBy("doc_id", "t").orderBy("s0")
    goes_on = (F.lag("s1").over(w) + 1 == F.col("s0")) & (F.lag("m").over(w) == F.col("m")) & (F.lag("mt").over(w) == F.col("mt")) & (F.lag(F.col("ms") - F.col("s0")).over(w) == F.col("ms") - F.col("s0"))
    number = F.sum(F.when(goes_on, 0).otherwise(1)).over(w)
    return repeated.withColumn("path", number).groupBy("doc_id", "t", "m", "mt", "path").agg(F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.min("ms").alias("ms")).drop("path")


def _exact(docs: DataFrame, prof: DataFrame, failed: DataFrame, span: int) -> DataFrame:
    """(doc_id, t, s0, s1): the repeated windows among those that share a minimizer with a window of the failed spans, by digests."""
    pieces = prof.where("doc_id is not null").select("doc_id", "t", F.explode(F.arrays_zip("a", "s0", "s1")).alias("x")).select("doc_id", "t", "x.*")
    anchors = pieces.alias("p").join(failed.alias("f"), F.expr("p.doc_id = f.doc_id and p.t = f.t and p.s0 <= f.s1 and p.s1 >= f.s0")).select("p.a").distinct()
    edges = _at(docs, pieces.join(common.settled(anchors), "a").select("doc_id", "t", "s0", "s1", F.lit(False).alias("gone")), *_edges_at(span, True))
    first = edges.groupBy("w").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("last")).where("m < last").select("w", "m")
    return edges.join(first, "w").where("doc_id > m").select("doc_id", "t", F.col("s").alias("s0"), F.col("s").alias("s1"))


def substring_dedup(docs: DataFrame, span: int = SPAN, k: int = K, key: str = "doc_id", text: str = "text", with_text: bool = True, hash_bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept), one row for each row of docs.

    Removed are the words of every window of ``span`` words that also starts in a
    document with a smaller id, judged on the texts given.  A null text has no words;
    texts shorter than a window lose none.  Rows that repeat an id are one document
    for this: none of them is smaller than the other.  A null id neither removes nor
    loses words.  ``kept`` is the text left where words were removed, else null.  Repeats
    are judged by their words: hashes (of ``hash_bits`` for a word, fewer only to try what
    collisions do) only find them.
    Other columns are not read.
    """
    docs = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    prof = common.settled(profiles(docs, span, k, hash_bits))
    spans = common.settled(compacted(repeats(docs, prof, span, hash_bits)))
    here = spans.select("doc_id", "t", "s0", "s1", F.lit(True).alias("gone"))
    there = spans.select(F.col("m").alias("doc_id"), F.col("mt").alias("t"), F.col("ms").alias("s0"), F.expr("ms + s1 - s0").cast("int").alias("s1"), F.lit(False).alias("gone"))
    places = here.unionByName(there).groupBy("doc_id", "t", "s0", "s1").agg(F.max("gone").alias("gone"))
    cut = _at(docs, places, *_read(span, with_text))
    said = cut.select("doc_id", "t", F.explode(F.arrays_zip("lo", "hi", "digest")).alias("x")).select("doc_id", "t", F.col("x.lo").alias("s0"), F.col("x.hi").alias("s1"), "x.digest")
    pair = spans.withColumn("me", F.expr("ms + s1 - s0").cast("int")).join(said, ["doc_id", "t", "s0", "s1"], "left")
    source = said.select(F.col("doc_id").alias("m"), F.col("t").alias("mt"), F.col("s0").alias("ms"), F.col("s1").alias("me"), F.col("digest").alias("own"))
    failed = common.settled(pair.join(source, ["m", "mt", "ms", "me"], "left").where(~F.col("digest").eqNullSafe(F.col("own"))).select("doc_id", "t", "s0", "s1"))
    if not failed.isEmpty():
        sure = spans.join(failed, ["doc_id", "t", "s0", "s1"], "left_anti").select("doc_id", "t", "s0", "s1")
        exact = _exact(docs, prof, failed, span)
        again = sure.unionByName(exact).join(exact.unionByName(failed).select("doc_id", "t").distinct(), ["doc_id", "t"]).withColumn("gone", F.lit(True))
        others = cut.join(exact.unionByName(failed).select("doc_id", "t").distinct(), ["doc_id", "t"], "left_anti")
        cut = others.unionByName(_at(docs, again, *_read(span, with_text)))
    cut = cut.where("n_removed > 0").select("doc_id", "t", "n_removed", "kept_sha", *(["kept"] if with_text else []))
    out = prof.select("doc_id", "t", "n_words", "sha").join(cut, ["doc_id", "t"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"), *(["kept"] if with_text else []))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(common.table(spark, sf_dir, "documents"), with_text=False)


SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT r, doc_id, w, unnest(range(1, len(w) - {SPAN - 2})) AS i FROM d WHERE len(w) >= {SPAN}),
x AS (SELECT r, doc_id, i, md5(array_to_string(list_slice(w, i, i + {SPAN - 1}), ' ')) AS x FROM i),
m AS (SELECT x, min(doc_id) AS m FROM x GROUP BY x HAVING min(doc_id) < max(doc_id)),
h AS (SELECT r, list(i) AS s FROM x JOIN m ON x.x = m.x AND x.doc_id > m.m GROUP BY r),
p AS (SELECT r, unnest(s) AS i FROM h),
g AS (SELECT DISTINCT r, unnest(range(i, i + {SPAN})) AS k FROM p),
u AS (SELECT r, w[k] AS v, k FROM (SELECT d.r, d.w, unnest(range(1, len(d.w) + 1)) AS k FROM d)),
kept AS (SELECT u.r, string_agg(u.v, ' ' ORDER BY u.k) AS s FROM u LEFT JOIN g ON u.r = g.r AND u.k = g.k WHERE g.r IS NULL GROUP BY u.r),
c AS (SELECT r, count(*)::BIGINT AS n FROM g GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN kept ON d.r = kept.r
"""
