"""Self-join of documents on the Jaccard similarity of their word shingles.

Prefix join of classes.  Shingles are put in one global order (those of many documents
last, else by hash).  Two sets of similarity t share a shingle among the first
n - ceil(t n) + 1 of either, so only these prefixes are compared:

1. documents with the same set are one class; every class goes on to the lists, as an
   equal prefix alone proves no similarity;
2. prefixes become postings; those of a shingle that one class alone has are dropped;
3. each list (shingle, class of sizes) pairs its members with its first one, pairs
   are verified on whole sets, and components are formed;
4. lists of three or more that still hold more than one component pair their members
   across components, and these pairs are verified too.

Lists with the same members, as the shingles of one passage have, are one list.

Step 4 leaves out only pairs that are connected already, so the components are those
of all links, while a group of near copies costs about as many pairs as it has
members.  No list is gathered in a task: lists are joined, and sums precede them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import common

SHINGLE = 5
#: Similarity as a whole number of hundredths.
LEAST = 80
#: Shingles known to be in many documents, at most; they only set the order.
FREQUENT = 1 << 20
#: A shingle counts as frequent from this many documents on ...
FREQUENT_FROM = 32
#: ... and is reported by a chunk of texts from this many of its documents on.
SEEN_IN_CHUNK = 2
#: Lists of more members are compared in blocks ...
SHORT_LIST = 64
#: ... of about this many.
BLOCK = 2048
#: Rounds that form the components which spare step 4 its pairs.
FIRST_ROUNDS = 2
_TOP = np.uint64(1 << 63)
_LOW = np.uint64((1 << 63) - 1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(63-bit hash, row) of every shingle of a chunk, in order of the rows, repeats included."""
    first, length, row = common.words(data, offsets)
    h = common.word_hashes(data, first, length, common.LOWER)
    rows = len(offsets) - 1
    sizes = np.bincount(row, minlength=rows)
    out, of = [], []
    if len(h) >= width:
        whole = row[: len(row) - width + 1] == row[width - 1 :]
        out.append(common.gram_hashes(h, width)[whole])
        of.append(row[: len(row) - width + 1][whole])
    starts = np.cumsum(sizes) - sizes
    for k in range(1, width):
        short = np.flatnonzero(sizes == k)
        if len(short):
            out.append(common.gram_hashes(h, k)[starts[short]] ^ np.uint64(k))
            of.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out, of = np.concatenate(out) & _LOW, np.concatenate(of)
    if len(out):
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def sets(data: np.ndarray, offsets: np.ndarray, width: int, frequent: np.ndarray | None = None) -> list[np.ndarray]:
    """The distinct shingles of each row in the global order; frequent ones have their top bit set."""
    h, row = shingles(data, offsets, width)
    if frequent is not None and len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        h = np.where(frequent[at] == h, h | _TOP, h)
    ends = np.searchsorted(row, np.arange(len(offsets)))
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        x = np.sort(h[a:b])
        out.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x)
    return out


def frequent_shingles(docs: DataFrame, width: int, most: int) -> np.ndarray:
    """Hashes of the shingles of the most documents: at most ``most``, sorted. The result of the join doesn't depend on them."""

    def make(batch: pa.RecordBatch):
        for _, _, data, offsets in common.chunks(batch.column(0), 4 * common.CHUNK_BYTES):
            h, row = shingles(data, offsets, width)
            if len(h):
                value, n = common.distinct(h)
                value, n = value[n >= SEEN_IN_CHUNK], n[n >= SEEN_IN_CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array(common.signed(value)), pa.array(n)], ["h", "n"])

    seen = common.per_batch(docs.select("text"), make, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    (h,) = common.arrays(common.most_frequent(common.settled(seen), most).select("h"))
    return np.sort(h.astype(np.int64)).astype(np.uint64)


def prefix_length(n: int, least: int) -> int:
    return n - (least * n + 99) // 100 + 1


def _longs(lists: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(common.signed(np.concatenate(lists)) if lists else np.zeros(0, np.int64)))


def bitmap_of(x: np.ndarray) -> bytes:
    """One bit for each shingle, in at least twice as many bits (a power of two): its low bits' place."""
    bits = max(64, 1 << (2 * len(x) - 1).bit_length())
    flags = np.zeros(bits, bool)
    flags[(x & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def may_link(a: bytes, b: bytes, n: int, m: int, least: int) -> bool:
    """False only if the bitmaps prove that sets of n and m shingles aren't similar.

    A bit that one bitmap alone has stands for a shingle that its set alone has.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    both = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return 100 * both >= least * (n + m - both)


def profiles(docs: DataFrame, frequent, width: int, least: int) -> DataFrame:
    """(doc_id, n, f1, f2, bits, prefix): the size of each document's set, a hash of the set, its bitmap and its prefix."""

    def make(batch: pa.RecordBatch):
        hot = frequent.value
        for at, end, data, offsets in common.chunks(batch.column(1)):
            size, f1, f2, bits, prefix = [], [], [], [], []
            for x in sets(data, offsets, width, hot):
                head = x[: prefix_length(len(x), least)] if len(x) else x
                f = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                size.append(len(x))
                f1.append(int.from_bytes(f[:8], "little", signed=True))
                f2.append(int.from_bytes(f[8:], "little", signed=True))
                bits.append(bitmap_of(x))
                prefix.append(head)
            yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], *(pa.array(v, pa.int64()) for v in (size, f1, f2)), pa.array(bits, pa.binary()), _longs(prefix)], ["doc_id", "n", "f1", "f2", "bits", "prefix"])

    return common.per_batch(docs, make, "doc_id long, n long, f1 long, f2 long, bits binary, prefix array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, f, s): the sets of the wanted (id, f), read from the texts again.

    A bitmap of fixed size spares the other documents the work; the join is exact.
    """
    found, size = common.id_filter(wanted, "id")
    bitmap = docs.sparkSession.sparkContext.broadcast(found)
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), _longs([])], ["id", "f", "s"])

    def make(batch: pa.RecordBatch):
        batch = batch.filter(pa.array(common.passes(bitmap.value, batch.column(2).to_numpy(zero_copy_only=False))))
        if not batch.num_rows:
            yield empty
            return
        for at, end, data, offsets in common.chunks(batch.column(1)):
            found = sets(data, offsets, width)
            f = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=16).digest()[:8], "little", signed=True) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], pa.array(f, pa.int64()), _longs(found)], ["id", "f", "s"])

    rows = common.per_batch(docs.where("doc_id is not null").select("doc_id", "text", common.slot_column("doc_id", size).alias("slot")), make, "id long, f long, s array<long>")
    return common.settled(rows.join(wanted.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "f"]), bitmap)


def _postings(prof: DataFrame, classes: DataFrame) -> tuple[DataFrame, Broadcast]:
    """(h, g, n): the prefixes of the first documents of the classes, and of the few others that the bitmap of their ids lets through."""
    found, size = common.id_filter(classes, "class_id")
    bitmap = prof.sparkSession.sparkContext.broadcast(found)

    def make(batch: pa.RecordBatch):
        batch = batch.filter(pa.array(common.passes(bitmap.value, batch.column(3).to_numpy(zero_copy_only=False))))
        of = pa.array(np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([batch.column(2).flatten(), batch.column(0).take(of), batch.column(1).take(of)], ["h", "g", "n"])

    return common.per_batch(prof.where("n > 0 and doc_id is not null").select("doc_id", "n", "prefix", common.slot_column("doc_id", size).alias("slot")), make, "h long, g long, n long"), bitmap


def links(docs: DataFrame, pairs: DataFrame, bits: DataFrame, width: int, least: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar; sets are fetched only where the bitmaps (id, n, bits) allow it."""
    x, y = (bits.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")

    def make(batch: pa.RecordBatch):
        keep = [may_link(*r, least) for r in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(keep))

    pairs = common.per_batch(pairs.join(y, "b").join(x, "a").select("a", "b", "bitsa", "bitsb", "na", "nb"), make, "a long, b long")
    pairs = common.settled(pairs.distinct())
    wanted = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id")), F.struct(F.col("b").alias("id")))).alias("x")).select("x.id").distinct()
    found = whole_sets(docs, wanted, width)
    a, b = found.select(F.col("id").alias("a"), F.col("s").alias("sa")), found.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(b, "b").join(a, "a").where(100 * both >= least * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def size_ratio(least: int) -> float:
    """A class of sizes spans a little more than the ratio of similar sets' sizes; these are in one class or in neighbours."""
    return 1.0 + 1.02 * (100.0 / least - 1)


def size_class_column(n: str, least: int):
    return F.floor(F.log(n) / F.log(F.lit(size_ratio(least)))).cast("int")


def size_classes(n: np.ndarray, least: int) -> np.ndarray:
    return np.floor(np.log(n.astype(float)) / np.log(size_ratio(least))).astype(np.int64)


def _in_blocks(lists: DataFrame, bits: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) across components of lists of any length that the bitmaps allow.

    A list's members are dealt into blocks, and two blocks at a time are held against
    each other, so that a task holds two blocks and only pairs that may link are made,
    each in the first list that both documents are in.
    """
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    own_lists = lists.groupBy("g", "c").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    lists = lists.join(own_lists, ["g", "c"])
    member = lists.join(bits.withColumnRenamed("id", "g"), ["g", "n"]).withColumn("own", F.pmod(F.xxhash64("g"), blocks).cast("int"))
    dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})

    def pairs(key, pdf):
        import pandas as pd

        width = min(map(len, pdf["bits"]))
        rows = []
        for b in pdf["bits"]:
            x = np.frombuffer(b, np.uint8)
            while len(x) > width:
                x = x[: len(x) // 2] | x[len(x) // 2 :]
            rows.append(x)
        grid = np.stack(rows).view(np.uint64)
        g, n, comp, own = (pdf[c].to_numpy() for c in ("g", "n", "component", "own"))
        size = size_classes(n, least)
        hs = [np.asarray(x) for x in pdf["hs"]]
        h, c, p, q = key
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        a, b = [], []
        for i in left:
            j = right[(g[right] > g[i]) & (comp[right] != comp[i])] if p == q else right[comp[right] != comp[i]]
            both = np.minimum(n[i] - np.bitwise_count(grid[i] & ~grid[j]).sum(axis=1, dtype=np.int64), n[j] - np.bitwise_count(grid[j] & ~grid[i]).sum(axis=1, dtype=np.int64))
            j = j[(100 * both >= least * (n[i] + n[j] - both)) & (np.maximum(size[j], size[i]) == c)]
            j = np.array([x for x in j if np.intersect1d(hs[i], hs[x], True)[0] == h], np.int64)
            a.append(np.minimum(g[j], g[i]))
            b.append(np.maximum(g[j], g[i]))
        out = pd.DataFrame({"a": np.concatenate(a or [g[:0]]), "b": np.concatenate(b or [g[:0]])})
        return out[out["a"] != out["b"]]

    common.findable(lists.sparkSession)
    return dealt.select("h", "c", "p", "q", "g", "n", "component", "own", "bits", "hs").groupBy("h", "c", "p", "q").applyInPandas(pairs, "a long, b long")


def jaccard_components(docs: DataFrame, width: int = SHINGLE, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id), one row for each row of docs.

    class_id is the smallest id with the same set.  A null or wordless text has an
    empty set, is linked with nothing and is its own component; a document with
    fewer than ``width`` words has one shingle, all of it.  Rows that repeat an id are
    the same document: they share its component, through whichever of their texts
    links.  A null id gets null component and class.  Other columns are not read.
    """
    docs = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, width, FREQUENT))
    prof = common.settled(profiles(docs, frequent, width, least), frequent)
    bits = prof.where("n > 0 and doc_id is not null").select(F.col("doc_id").alias("id"), "n", "bits")
    classes = prof.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("class_id"))
    classes = common.settled(classes)
    # postings of classes, without the shingles of a single class
    postings, spent = _postings(prof, classes)
    shared = common.settled(postings.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    listed = common.settled(postings.join(shared, "h"), spent)
    size_class = size_class_column("n", least)
    listed = listed.select("h", "g", "n", F.explode(F.array(size_class, size_class + 1)).alias("c"))
    # lists with the same members are one
    alike = listed.groupBy("h", "c").agg(F.count("*").alias("k"), F.min(F.struct("g", "n")).alias("x"), F.bit_xor(F.xxhash64("g")).alias("s1"), F.bit_xor(F.xxhash64("g", F.lit(1))).alias("s2")).where("k > 1")
    kept = common.settled(alike.groupBy("c", "k", "x", "s1", "s2").agg(F.min("h").alias("h")).select("h", "c", "k", F.col("x.g").alias("a"), F.col("x.n").alias("m")))
    near = (100 * F.least("n", "m") >= least * F.greatest("n", "m")) & (F.col("a") != F.col("b"))
    listed = common.settled(listed.join(kept, ["h", "c"]))
    pairs = listed.withColumnRenamed("g", "b").where(near).select("a", "b")
    pairs = common.settled(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    linked = common.settled(links(docs, pairs, bits, width, least))
    # a few rounds join nearly all; what they leave apart only costs pairs
    comps = common.joined_components(linked, rounds=FIRST_ROUNDS, whole=False)
    # what may still link across components; a list of two has had its only pair
    of = listed.where("k > 2").select("h", "c", "g", "n", "k").join(comps.withColumnRenamed("node", "g"), "g", "left").withColumn("component", F.coalesce("component", "g"))
    open_lists = of.groupBy("h", "c").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h", "c")
    left = common.settled(of.join(open_lists, ["h", "c"]).select("h", "c", "g", "n", "k", "component"))
    large, left = left.where(F.col("k") > SHORT_LIST), left.where(F.col("k") <= SHORT_LIST)
    one = left.select("h", "c", F.col("g").alias("a"), "n", F.col("component").alias("ca"))
    two = left.select("h", "c", F.col("g").alias("b"), F.col("n").alias("m"), F.col("component").alias("cb"))
    last = F.greatest(size_class_column("n", least), size_class_column("m", least)) == F.col("c")
    cross = one.join(two, ["h", "c"]).where(last & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near).select("a", "b").distinct()
    cross = cross.unionByName(_in_blocks(large, bits, least)).distinct()
    cross = common.settled(cross.join(pairs, ["a", "b"], "left_anti"))
    more = links(docs, cross, bits, width, least)
    comps = common.joined_components(linked.unionByName(more))
    by_class = classes.join(comps.withColumnRenamed("node", "class_id"), "class_id", "left").select("n", "f1", "f2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    narrow = prof.select("doc_id", "n", "f1", "f2").alias("p")
    out = narrow.join(by_class.alias("c"), (F.col("p.n") == F.col("c.n")) & (F.col("p.f1") == F.col("c.f1")) & (F.col("p.f2") == F.col("c.f2")), "left")
    known = F.col("p.doc_id").isNotNull()
    return out.select("p.doc_id", F.col("p.n").alias("n_shingles"), F.when(known, F.coalesce("component_id", "p.doc_id")).alias("component_id"), F.when(known, F.coalesce("class_id", "p.doc_id")).alias("class_id"))


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs (doc_id, text and any others) without those that link to a document with a smaller id.

    One row of each component stays: that of its smallest id, and the least one if
    rows repeat that id, by the columns that have an order (maps have none).  Rows with a
    null id all stay, as do null and empty texts of an id of their own; an empty table gives no rows.
    """
    first = jaccard_components(docs, **kw).where("doc_id = component_id").select(F.col("doc_id").alias("__d")).distinct()
    kept = docs.join(first, docs["doc_id"].cast("long") == F.col("__d"), "left_semi")
    rest = [c for c in docs.columns if c != "doc_id"]
    ordered = [c for c, kind in docs.dtypes if c != "doc_id" and "map<" not in kind and "variant" not in kind]
    one = kept.groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(f"`{c}`") for c in ordered])).alias("__x")).select("doc_id", *[F.col("__x")[c].alias(c) for c in rest])
    return one.select(docs.columns).unionByName(docs.where("doc_id is null"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT r, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS g FROM i),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS ra, b.r AS rb, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT da.doc_id AS a, db.doc_id AS b FROM p JOIN n na ON ra = na.r JOIN n nb ON rb = nb.r JOIN d da ON ra = da.r JOIN d db ON rb = db.r WHERE 100 * shared >= {LEAST} * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT a AS node, a AS reached FROM e UNION SELECT c.node, e.b FROM c JOIN e ON c.reached = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.low, d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN (SELECT node, min(reached) AS low FROM c GROUP BY node) m ON d.doc_id = m.node
"""
