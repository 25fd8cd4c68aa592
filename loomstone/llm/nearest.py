"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Fitted on a bounded sample (SAMPLE rows, by the hash of id and vector): coarse centroids,
codebooks for the residuals, and the number of lists to search, the least that finds
RECALL of the sample's own nearest rows.  Every row is indexed.  Lists are packed
into blocks of about BLOCK rows, a long list is dealt into several; a query goes to
the blocks of its lists, where distance tables give each row of those lists an
asymmetric score and the best RERANK are scored again on their original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstone.llm import common

SAMPLE = 16_384
LISTS = 1024
CODES = 256
#: Dimensions of one code.
PART = 2
RECALL = 0.97
CALIBRATION = 256
BLOCK = 4096
#: Queries that meet a block in one task.
QUERIES = 2048
RERANK = 512
NEAREST = 20
EVERY = 20


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of the rows; a centroid that loses all its rows moves to the row that is farthest from its own."""
    r = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[r.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = (c * c).sum(axis=1) - 2 * x @ c.T
        own = d.argmin(axis=1)
        n = np.bincount(own, minlength=k)
        for j in range(x.shape[1]):
            c[:, j] = np.where(n, np.bincount(own, x[:, j], k) / np.maximum(n, 1), c[:, j])
        if (n == 0).any():
            far = np.argsort(-(d[np.arange(len(x)), own] + (x * x).sum(axis=1)), kind="stable")[: int((n == 0).sum())]
            c[n == 0] = x[far]
    return c


class Index:
    """What is fitted: centroids, codebooks and the number of lists to search."""

    def __init__(self, x: np.ndarray, rows: int, nearest: int):
        self.dim = x.shape[1]
        self.parts = [np.arange(i, min(i + PART, self.dim)) for i in range(0, self.dim, PART)]
        self.lists = kmeans(x, max(1, min(LISTS, round(rows**0.5))), 8, 1)
        # lists that are near each other get near numbers, so that a query's lists share blocks
        axis = np.linalg.svd(self.lists - self.lists.mean(axis=0), full_matrices=False)[2][0] if len(self.lists) > 1 else np.zeros(self.dim)
        self.lists = self.lists[np.argsort(self.lists @ axis, kind="stable")]
        own = self.assign(x)
        rest = x - self.lists[own]
        self.books = [kmeans(rest[:, p], CODES, 6, 2 + i) for i, p in enumerate(self.parts)]
        q = x[:CALIBRATION]
        s = q @ x.T
        s[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(nearest, max(1, len(x) - 1))
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-(q @ self.lists.T), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(len(self.lists))[None], axis=1)
        need = np.sort(np.take_along_axis(rank, own[top], axis=1).ravel())
        self.probes = int(need[min(len(need) - 1, int(np.ceil(RECALL * len(need))))]) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        return ((self.lists * self.lists).sum(axis=1) - 2 * x @ self.lists.T).argmin(axis=1)

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        rest = x - self.lists[own]
        return np.stack([((b * b).sum(axis=1) - 2 * rest[:, p] @ b.T).argmin(axis=1) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """For each query which lists it searches."""
        order = np.argsort(-(q @ self.lists.T), axis=1, kind="stable")[:, : self.probes]
        out = np.zeros((len(q), len(self.lists)), bool)
        np.put_along_axis(out, order, True, axis=1)
        return out

    def search(self, ids: np.ndarray, own: np.ndarray, codes: np.ndarray, x: np.ndarray, queries: np.ndarray, q: np.ndarray, nearest: int) -> tuple[np.ndarray, ...]:
        """(query, id, score) of the best rows of a block, by ids in order, for each query."""
        order = np.argsort(ids, kind="stable")
        ids, own, x, codes = ids[order], own[order], x[order], np.ascontiguousarray(codes[order].T)
        probed, coarse = self.probed(q), q @ self.lists.T
        tables = [q[:, p] @ b.T for p, b in zip(self.parts, self.books, strict=True)]
        found: list[tuple[np.ndarray, ...]] = []
        for k in range(len(q)):
            rows = np.flatnonzero(probed[k][own] & (ids != queries[k]))
            if not len(rows):
                continue
            whole = len(rows) == len(ids)
            s = coarse[k][own[rows]]
            for t, c in zip(tables, codes, strict=True):
                s += t[k][c if whole else c[rows]]
            if len(rows) > RERANK:
                cut = np.partition(s, len(s) - RERANK)[len(s) - RERANK]
                above = np.flatnonzero(s > cut)
                rows = rows[np.concatenate((above, np.flatnonzero(s == cut)[: RERANK - len(above)]))]
            exact = (x[rows] * q[k]).sum(axis=1)
            best = np.lexsort((ids[rows], -exact))[:nearest]
            found.append((np.full(len(best), queries[k]), ids[rows][best], exact[best]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (ids[:0], ids[:0], np.zeros(0))


def nearest_neighbours(vectors: DataFrame, every: int = EVERY, nearest: int = NEAREST, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its nearest other rows by inner product.

    Vectors that are null, empty, zero or hold a null or a number that is not finite
    take no part, nor does a null id; nor do vectors of another length than the first
    id's.  A repeated id is one query, with the least of its vectors, and is never its
    own neighbour; as a neighbour each of its rows counts.  Ties go to the smaller
    id.  Fewer candidates than ``nearest`` are all returned.  Other columns are not read.
    """
    spark = vectors.sparkSession
    v = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = v.where("vec_id is not null and size(v) > 0").where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    out = "query_id long, rank int, vec_id long, score double"
    head = v.agg(F.count("*").alias("n"), F.min_by(F.size("v"), "vec_id").alias("d")).first()
    rows, dim = head["n"], head["d"]
    if not rows:
        return spark.createDataFrame([], out)
    v = v.where(F.size("v") == dim)
    h = F.pmod(F.xxhash64("vec_id", "v", F.lit("sample")), F.lit(1 << 30))
    part = v.withColumn("h", h).where(F.col("h") < int(min(1.0, 1.2 * SAMPLE / rows) * (1 << 30)) + 1).orderBy("h", "vec_id", "v").limit(SAMPLE).toPandas()
    index = Index(np.stack(part["v"].to_numpy()).astype(float), rows, nearest)
    shared = spark.sparkContext.broadcast(index)

    def encode(batch: pa.RecordBatch):
        x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, dim)
        own = shared.value.assign(x)
        codes = shared.value.encode(x, own)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], ["vec_id", "list", "codes", "v"])

    coded = common.settled(common.per_batch(v, encode, "vec_id long, list int, codes binary, v array<double>"))
    # lists are packed into blocks in their order; a list above a block is dealt into several by the number of the row
    sizes = {r["list"]: r["n"] for r in coded.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most LISTS rows
    block, deals, at, load = [], [], 0, 0
    for k in range(len(index.lists)):
        n = sizes.get(k, 0)
        if load and load + n > BLOCK:
            at, load = at + 1, 0
        block.append(at)
        deals.append(max(1, -(-n // BLOCK)))
        at, load = (at + deals[-1], 0) if n > BLOCK else (at, load + n)
    first = F.array(*map(F.lit, block))
    deal = F.array(*map(F.lit, deals))
    of = F.col("list") + 1
    placed = coded.withColumn("block", (F.element_at(first, of) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.element_at(deal, of))).cast("int"))
    spans = [(a, a + d) for a, d in zip(block, deals, strict=True)]

    def route(batch: pa.RecordBatch):
        q = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, dim)
        to = [sorted({b for k in np.flatnonzero(p) for b in range(*spans[k])}) for p in shared.value.probed(q)]
        each = pa.array(np.repeat(np.arange(batch.num_rows), list(map(len, to))))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(each), batch.column(1).take(each), pa.array([b for t in to for b in t], pa.int32())], ["query_id", "q", "block"])

    queries = v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    routed = common.settled(common.per_batch(queries, route, "query_id long, q array<double>, block int"))
    parts = common.settled(routed.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")))
    asked = routed.alias("a").join(parts.alias("b"), F.expr("a.block = b.block")).select("query_id", "q", F.col("a.block").alias("to"), F.expr("cast(pmod(xxhash64(query_id), parts) as int)").alias("turn"))
    offered = placed.alias("a").join(parts.alias("b"), F.expr("a.block = b.block")).select("vec_id", "list", "codes", "v", F.col("a.block").alias("block"), F.expr("explode(sequence(0, parts - 1))").alias("part"))

    def search(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
        a, b, s = shared.value.search(rows["vec_id"].to_numpy(), rows["list"].to_numpy(), codes, np.stack(rows["v"].to_numpy()), asks["query_id"].to_numpy(), np.stack(asks["q"].to_numpy()), nearest)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    common.findable(spark)
    found = offered.groupBy("block", "part").cogroup(asked.groupBy("to", "turn")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(common.table(spark, sf_dir, "embeddings"))
