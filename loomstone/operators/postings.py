"""A stored index of trigrams with positions, and ranked search from its postings alone.

A posting is one trigram of one chunk with all its places.  Postings lie with their
source, so an ingest writes the buckets of its own sources only, and inside a bucket by
a hash of the trigram and in its order, so a search reads its terms' parts only, and
skips the row groups whose trigrams are others.  A term
occurs where all its trigrams stand one behind the other, which its postings tell
without the text.  Places are kept as the steps from one to the next, in bytes of
seven bits.  What BM25 needs besides, the number of chunks and the sum of their
lengths, is a fact of the store's version, kept by what each change adds and takes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.search import K1, B
from loomstone.session import collected, findable
from loomstone.sources.store import Change, Keyed, Store, settled

#: The key of a chunk's source inside its uid.
TAG = "substring(uid, 1, 12)"
SPLITS = 8
POSTINGS = Keyed("postings", "gram long, uid string, dl int, at binary", TAG, split=f"(gram ^ shiftright(gram, 21) ^ shiftright(gram, 42)) & {SPLITS - 1}")
#: Empty places between the content and the path, so that no term runs from one into the other.
GAP = 3
#: How many chunks one task indexes, and up to how many changed sources go to all tasks at once.
PER_PART, FEW = 2048, 1 << 20


def code(gram: str) -> int:
    """A trigram as a number: 21 bits for each code point."""
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def length(content: Column, path: Column) -> Column:
    """How many trigrams a chunk has, in its content and in its path."""
    return F.greatest(F.length(content) - 2, F.lit(0)) + F.greatest(F.length(path) - 2, F.lit(0))


def _grams(texts: pa.Array, paths: pa.Array, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, trigram, first place, number of places) of each posting, in the order in which they are stored: of bucket, split and trigram, then row; and all places."""
    parts, owner, place = [], [], []
    for k, (text, path) in enumerate(zip(texts.to_pylist(), paths.to_pylist(), strict=True)):
        for t, start in ((text or "", 0), (path or "", len(text or "") + GAP)):
            c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(c) > 2:
                parts.append(c)
                owner.append(k)
                place.append(start)
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    size = np.array([len(c) - 2 for c in parts])
    chars, mine = np.unique(np.concatenate(parts), return_inverse=True) if sum(map(len, parts)) < 1 << 12 else _numbered(np.concatenate(parts))
    at = np.arange(size.sum()) + np.repeat(2 * np.arange(len(size)), size)  # where trigrams begin
    owner, place = np.repeat(owner, size), np.arange(size.sum()) + np.repeat(np.array(place) - np.cumsum(size) + size, size)
    code = chars.astype(np.int64)
    split = code & SPLITS - 1
    split = split[mine[at]] ^ split[mine[at + 1]] ^ split[mine[at + 2]]
    fields = [buckets[owner], split, mine[at], mine[at + 1], mine[at + 2], owner, place]
    widths = [int(f.max()).bit_length() for f in fields]
    if sum(widths) < 64:  # all of a posting as one number
        x = np.zeros(len(at), np.int64)
        for f, w in zip(fields, widths, strict=True):
            x = x << w | f
        x.sort()
        fields = []
        for w in reversed(widths):
            fields.append(x & (1 << w) - 1)
            x = x >> w
        place, owner, third, second, one = fields[:5]
    else:
        order = np.lexsort(fields[::-1])
        one, second, third, owner, place = (f[order] for f in fields[2:])
    gram = code[one] << 42 | code[second] << 21 | code[third]
    first = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    return owner[first], gram[first], np.append(first, len(gram)), place


def _numbered(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique() of many code points, with the inverse."""
    there = np.zeros(int(c.max()) + 1, bool)
    there[c] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[c]


def _packed(place: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Lists of rising places, which begin at ``starts``, as bytes: the first place and the steps, seven bits a byte, the low ones first."""
    x = np.diff(place, prepend=0)
    x[starts[:-1]] = place[starts[:-1]]
    n = 1 + sum((x >= 1 << s).astype(np.int64) for s in (7, 14, 21, 28))
    end = np.r_[0, np.cumsum(n)]
    out = np.zeros(end[-1], np.uint8)
    for k in range(5):
        has = n > k
        out[end[:-1][has] + k] = x[has] >> 7 * k & 127 | np.where(n[has] > k + 1, 128, 0)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(end[starts].astype(np.int32)), pa.py_buffer(out)])


def _unpacked(at: pa.Array) -> pa.Array:
    """The lists of places of _packed()."""
    off = np.frombuffer(at.buffers()[1], np.int32)[at.offset : at.offset + len(at) + 1].astype(np.int64)
    b = np.frombuffer(at.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].astype(np.int64)
    last = np.flatnonzero(b < 128)
    first = np.r_[0, last[:-1] + 1][: len(last)]
    shift = 7 * (np.arange(len(b)) - np.repeat(first, last - first + 1))
    step = np.add.reduceat((b & 127) << shift, first) if len(b) else b
    row = np.searchsorted(last, off - off[0])  # numbers before each row
    total = np.r_[0, np.cumsum(step)]
    return pa.ListArray.from_arrays(pa.array(row, pa.int32()), pa.array(total[1:] - np.repeat(total[row[:-1]], np.diff(row)), pa.int32()))


def placed(rows: DataFrame) -> DataFrame:
    """Rows of postings, with whatever columns, whose ``at`` is a list of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([_unpacked(c) if n == "at" else c for n, c in zip(b.schema.names, b.columns, strict=True)], b.schema.names)

    findable(rows.sparkSession)
    return rows.mapInArrow(run, ", ".join(f"{n} {'array<int>' if n == 'at' else kind}" for n, kind in rows.dtypes))


def postings(chunks: DataFrame) -> DataFrame:
    """(gram, uid, dl, at) of chunks (uid, content, source_path); a chunk is a row of its own task's batch, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                row, gram, starts, place = _grams(batch.column(1), batch.column(2), batch.column(4).to_numpy())
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(gram), batch.column(0).take(pa.array(row)), batch.column(3).take(pa.array(row)), _packed(place, starts)], ["gram", "uid", "dl", "at"])

    findable(chunks.sparkSession)
    return chunks.select("uid", F.lower("content").alias("c"), F.lower("source_path").alias("p"), length(F.col("content"), F.col("source_path")).alias("dl"), POSTINGS.bucket(F.expr(TAG)).alias("b")).mapInArrow(run, POSTINGS.schema)


def facts(chunks: DataFrame, keys: DataFrame | None = None) -> dict[str, int]:
    """The number of chunks and the sum of their lengths; of those with one of the keys (k) only, if any are given."""
    rows = chunks.select(F.expr(TAG).alias("k"), length(F.col("content"), F.col("source_path")).alias("n"))
    rows = rows if keys is None else rows.join(keys, "k", "left_semi")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return {"chunks": n, "length": total}


def _by_bucket(chunks: DataFrame, n: int) -> DataFrame:
    """Chunks (n of them) so dealt that a task's lie in one or two buckets: texts are shuffled, which is a small part of their postings."""
    return chunks.repartitionByRange(n // PER_PART + 1, POSTINGS.bucket(F.expr(TAG)), "uid")


def indexed(change: Change, table: Keyed, new: DataFrame | None, gone: DataFrame | None) -> list[int]:
    """Chunks, their postings and the facts after a change: the sources of ``new`` and the tags of ``gone`` lose what they had, then new's are added.

    Texts of ``new`` are dealt by bucket once, and postings are never shuffled: new ones come from those texts, old
    ones lie so, and the keys go to all tasks, for some buckets at a time if they are many.
    """
    keys = [x for x in (new.select(F.expr(TAG).alias("k")) if new is not None else None, gone.select(F.col(gone.columns[0]).alias("k")) if gone is not None else None) if x is not None]
    keys = settled((keys[0].unionByName(keys[1]) if len(keys) > 1 else keys[0]).distinct())
    new = settled(_by_bucket(new, new.count())) if new is not None else None
    after = facts(new) if new is not None else {"chunks": 0, "length": 0}
    if after["chunks"] > PER_PART:
        collected(change.store.spark)  # what dealt the texts is as large as they are
    had = {**{"chunks": 0, "length": 0}, **change.base["facts"], **change.facts}
    alike = (POSTINGS.buckets, POSTINGS.key) == (table.buckets, table.key)
    runs = change.runs(table, keys, FEW)
    for buckets, mine in runs:
        before = facts(change.read(table, buckets), mine)
        had = {k: had[k] - before[k] for k in before}
        part = new if new is None or len(runs) == 1 else new.where(table.bucket(F.expr(table.key)).isin(buckets))
        change.replace(POSTINGS, None if part is None else postings(part), mine, buckets if alike else None, mine, True)
        change.replace(table, part, mine, buckets, mine, alike)
    change.facts |= {k: had[k] + after[k] for k in after}
    return sorted(b for buckets, _ in runs for b in buckets)


def matches(store: Store, terms: list[str], version: int | None = None) -> DataFrame:
    """(term, uid, dl, tf): how often each chunk has each distinct term of three characters or more, overlapping ones counted."""
    spark, terms = store.spark, sorted({t.lower() for t in terms if len(t) >= 3})
    pieces = [(t, code(t[k : k + 3]), k, len(t) - 2) for t in terms for k in range(len(t) - 2)]
    if not pieces:
        return spark.createDataFrame([], "term string, uid string, dl int, tf int")
    grams = sorted({p[1] for p in pieces})
    wanted = spark.createDataFrame(pieces, "term string, gram long, k int, m int")  # as long as the query
    splits = [r[0] for r in wanted.select(F.expr(POSTINGS.split)).distinct().collect()]
    found = store.read(POSTINGS, version).where(F.col("split").isin(splits) & F.col("gram").isin(grams)).join(F.broadcast(wanted), "gram")
    starts = placed(found.select("term", "uid", "dl", "k", "m", "at")).select("term", "uid", "dl", "m", F.transform("at", lambda p: p - F.col("k")).alias("at"))
    # a chunk counts where it has all trigrams of a term, at places that fit
    whole = starts.groupBy("term", "uid", "dl", "m").agg(F.collect_list("at").alias("all")).where(F.size("all") == F.col("m"))
    tf = F.size(F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.element_at("all", 1), lambda a, b: F.array_intersect(a, b)))
    return whole.select("term", "uid", "dl", tf.alias("tf")).where("tf > 0")


def search(store: Store, terms: list[str], top: int, version: int | None = None) -> DataFrame:
    """(uid, score) of the best chunks by trigram BM25, from the postings of one version; the same as a scan of its chunks gives."""
    version = store.version() if version is None else version
    known = {**{"chunks": 0, "length": 0}, **store.manifest(version)["facts"]}
    n, mean = known["chunks"], known["length"] / max(known["chunks"], 1)
    often = Counter(t.lower() for t in terms if len(t) >= 3)
    rows = matches(store, terms, version)
    df = rows.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term
    weight = F.coalesce(*[F.when(F.col("term") == t, F.lit(float(c))) for t, c in often.items()], F.lit(0.0))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = F.when(idf <= 0, 1e-6).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
    return rows.join(F.broadcast(df), "term").groupBy("uid").agg(F.sum(weight * score).alias("score")).orderBy(F.desc("score"), "uid").limit(top)


def _terms(queries: DataFrame) -> DataFrame:
    """(term, gram, k, m) of all terms of queries (id, query): each trigram, its place and their number."""

    def run(frames):
        for pdf in frames:
            rows = [(t, code(t[k : k + 3]), k, len(t) - 2) for t in dict.fromkeys(pdf["term"]) for k in range(len(t) - 2)]
            yield pd.DataFrame(rows, columns=["term", "gram", "k", "m"])

    findable(queries.sparkSession)
    return queries.select("term").distinct().mapInPandas(run, "term string, gram long, k int, m int")


def search_many(store: Store, queries: DataFrame, top: int, version: int | None = None) -> DataFrame:
    """(id, uid, score, rank) of the best chunks for each of many queries (id, query), as search() gives them one by one.

    All queries are one join: their distinct terms meet the postings once, and what
    a term found is shared by the queries that have it.
    """
    version = store.version() if version is None else version
    known = {**{"chunks": 0, "length": 0}, **store.manifest(version)["facts"]}
    n, mean = known["chunks"], known["length"] / max(known["chunks"], 1)
    words = F.split(F.trim(F.regexp_replace(F.lower("query"), r'["*()^:{}]', " ")), r"\s+")
    asked = queries.select("id", F.explode(words).alias("term")).where("length(term) >= 3").groupBy("id", "term").agg(F.count("*").alias("often"))
    asked = settled(asked)
    found = store.read(POSTINGS, version).join(_terms(asked), "gram")
    whole = placed(found.select("term", "uid", "dl", "k", "m", "at")).select("term", "uid", "dl", "m", F.transform("at", lambda p: p - F.col("k")).alias("at")).groupBy("term", "uid", "dl", "m").agg(F.collect_list("at").alias("all")).where(F.size("all") == F.col("m"))
    tf = F.size(F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.element_at("all", 1), lambda a, b: F.array_intersect(a, b)))
    rows = settled(whole.select("term", "uid", "dl", tf.alias("tf")).where("tf > 0"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = rows.join(rows.groupBy("term").agg(F.count("*").alias("df")), "term").select("term", "uid", (F.when(idf <= 0, 1e-6).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))).alias("s"))
    score = asked.join(weight, "term").groupBy("id", "uid").agg(F.sum(F.col("often") * F.col("s")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "uid"))
    return score.withColumn("rank", rank).where(F.col("rank") <= top)
