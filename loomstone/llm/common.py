"""Helpers that the operators of this subpackage share.

Texts reach Python as Arrow batches.  A batch is cut into chunks of a quarter of a
megabyte of UTF-8 and every step below works on whole chunks with numpy, so the
memory of a worker follows the chunk (or the one document that is longer than a
chunk) and never the table.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.session import collected

CHUNK_BYTES = 1 << 18
#: Words are runs of anything but space and the control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[ord("A") : ord("Z") + 1] += 32
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: the session's own, or a temporary one where none is set and all runs in one process (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def settled(df: DataFrame, *spent: Broadcast) -> DataFrame:
    """The same rows, read from the shared checkpoint folder; a lost executor costs no recomputation.

    ``spent`` are broadcast values that nothing needs once the rows are written; they are
    dropped everywhere.
    """
    ready(df.sparkSession)
    collected(df.sparkSession)
    out = df.checkpoint(eager=True)
    for b in spent:
        b.destroy()
    return out


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows, written as Parquet below the shared checkpoint folder, over what was there, and read again."""
    ready(df.sparkSession)
    collected(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{path or uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """Tables below the shared checkpoint folder that are needed for a while: Parquet takes a third of what checkpoint() writes."""

    def __init__(self, spark: SparkSession):
        ready(spark)
        self.spark, self.folder, self.schemas = spark, f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}", []

    def table(self, df: DataFrame) -> DataFrame:
        collected(self.spark)
        path = f"{self.folder}/{len(self.schemas)}"
        self.schemas.append(df.schema)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Empties all tables; nothing may read them afterwards."""
        for k, schema in enumerate(self.schemas):
            self.spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{k}")
        self.schemas = []


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def xxhash64(x: np.ndarray) -> np.ndarray:
    """Spark's function of one column of longs (xxHash by Yann Collet, public domain; seed 42)."""
    h = _rotated(x.astype(np.int64, copy=False).view(np.uint64) * _P2, 31) * _P1 ^ np.uint64(42 + 8 + int(_P5))
    h = _rotated(h, 27) * _P1 + _P4
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of the result depends on every bit given."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0xD6E8FEB86659FD93)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
LONG_WORD = 128


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in the bytes); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length in bytes, row) of every word of a chunk."""
    inside = ~space[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    first = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = np.flatnonzero(inside & (~after | edge[1:]))
    return first, last - first + 1, np.searchsorted(offsets, first, "right") - 1


def word_hashes(data: np.ndarray, first: np.ndarray, length: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64 bits for each word, from its folded bytes and its length, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data if fold is None else fold[data]
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, left, who = first, length, None
    while len(at):
        value = eight[at] & _MASK[np.minimum(left, 8)]
        h = ((out if who is None else out[who]) ^ value) * _BASE
        h ^= h >> np.uint64(32)
        if who is None:
            out = h
            more = np.flatnonzero((length > 8) & (length <= LONG_WORD))
        else:
            out[who] = h
            more = np.flatnonzero(left > 8)
        who = more if who is None else who[more]
        at, left = at[more] + 8, left[more] - 8
    out = mix(out)
    for k in np.flatnonzero(length > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(padded[first[k] : first[k] + length[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and their counts."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(at, append=len(x))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One for each n consecutive hashes, whatever their rows: the caller drops those that cross rows."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + h[k : len(h) - n + 1 + k]
    return mix(out)


def segments(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row starts and, for each element, its place within its row."""
    starts = np.cumsum(sizes) - sizes
    return starts, np.arange(int(sizes.sum())) - np.repeat(starts, sizes)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def sha256(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def findable(spark: SparkSession) -> None:
    """Lets local Python workers import this package where the driver found it only by its own path."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH", ""))))


def arrays(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of bounded length, brought to the driver as Arrow batches."""
    collected(df.sparkSession)
    return [c.combine_chunks().to_numpy(zero_copy_only=False) if c.num_chunks else np.zeros(0) for c in df.toArrow().columns]


def most_frequent(counts: DataFrame, most: int, count: str = "n") -> DataFrame:
    """The rows with the highest counts, at most ``most``, by a threshold.

    Counts are put into some 64 classes for each factor of e; the classes' sizes, a
    table of a few thousand rows at most, give the lowest class that still fits.  A
    top-k would send k rows of each task to one place.
    """
    level = F.floor(F.log(F.col(count)) * 64).cast("int")
    sizes = sorted(((r["level"], r["rows"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    low, total = None, 0
    for k, n in sizes:
        total += n
        if total > most:
            break
        low = k
    return counts.where(level >= low) if low is not None else counts.limit(0)


def per_batch(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from make(batch)

    findable(df.sparkSession)
    return df.mapInArrow(run, schema)


#: A bitmap has some this many bits for each entry, within these bounds (128 KB and 64 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 12, 20, 29


def map_bits(n: int) -> int:
    """The size, as a power of two, of a bitmap for n entries; beyond the bound more rows pass it and the joins behind do the work."""
    return min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * max(n, 1) - 1).bit_length()))


def _bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """From a column ``slot``; built with Spark's bitmap aggregates, so the driver gets pieces of 4 KB, as many as the size says."""
    pieces = slots.select((F.col("slot") / 32768).cast("int").alias("piece"), F.pmod("slot", F.lit(32768)).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    collected(slots.sparkSession)
    for batch in pieces.toArrow().to_batches():
        for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = np.frombuffer(raw.as_buffer(), np.uint8)
            out[piece * 4096 : piece * 4096 + len(found)] = found
    return out


def hash_map(hashes: DataFrame, column, bits: int) -> np.ndarray:
    """A bitmap of the top bits of 64-bit hashes."""
    return _bitmap(hashes.select(F.shiftrightunsigned(column, 64 - bits).alias("slot")), bits)


def in_map(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    return passes(bitmap, (h >> np.uint64(64 - bits)).astype(np.int64))


def id_filter(ids: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A bitmap that covers the given ids, and its size (a superset passes; a join afterwards is exact)."""
    bits = map_bits(ids.count())
    return _bitmap(ids.select(slot_column(column, bits).alias("slot")), bits), bits


def slot_column(column: str, bits: int):
    """Where id_filter() looks an id up."""
    return F.shiftrightunsigned(F.xxhash64(F.col(column).cast("long")), 64 - bits).cast("int")


def passes(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def joined_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, whole: bool = True) -> DataFrame:
    """(node, component): the smallest node that each node of the edges reaches.

    Rounds of large-star and small-star (Kiveris and others, 2014) on a table of
    edges that is checkpointed each round; nothing is collected but a sum.  If not
    ``whole``, it ends after the rounds given, and a component may still be in several parts.
    """
    links = settled(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    last = None
    for _ in range(rounds):
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        links = settled(small)
        if not whole:
            continue
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    else:
        if whole:
            raise RuntimeError("components did not settle")
    nodes = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
