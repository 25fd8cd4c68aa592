"""Clustering around centroids on exact integers, with an annulus search for the nearest one.

Centroids are sorted by norm.  For a vector x and any centroid at distance u, only
centroids whose norm lies within u of the norm of x can be as near (the triangle
inequality), ties included.  So the centroid next in norm gives u, two binary searches
give the annulus, and the candidates inside are compared by exact squared distances,
the smaller number winning ties.  What travels each round is one partial sum for each
centroid and task; vectors stay where they were read.
"""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import common

DIM, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Below this size of a component all products and sums of one distance are exact in doubles, or in longs.
IN_DOUBLES, IN_LONGS = 1 << 22, 1 << 27
#: Candidate pairs compared at once.
PAIRS = 1 << 15


def whole(embedding: Column, dim: int = DIM) -> Column:
    """Whether a vector has the right number of components, none null or non-finite."""
    return F.coalesce((F.size(embedding) == dim) & F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def vectors(column: pa.Array, dim: int, scale: int = SCALE) -> np.ndarray:
    """The integers floor(scale * x) of a list column without nulls, as doubles."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.floor(flat * scale).reshape(-1, dim)
    if len(out) and np.abs(out).max() >= IN_LONGS:
        raise OverflowError(f"a component of {IN_LONGS // scale} or more in size: squared distances would not fit a long")
    return out


class Annulus:
    """The centroids in order of their norms."""

    def __init__(self, centroids: np.ndarray):
        self.norms = np.sqrt((centroids.astype(object) ** 2).sum(axis=1).astype(float))
        self.order = np.argsort(self.norms, kind="stable")
        self.norms, self.sorted = self.norms[self.order], centroids[self.order]
        self.exact_in_doubles = not centroids.size or int(np.abs(centroids).max()) < IN_DOUBLES

    def distances(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows to the sorted centroids named."""
        if self.exact_in_doubles and (not x.size or np.abs(x).max() < IN_DOUBLES):
            d = x - self.sorted[which]
            return np.einsum("ij,ij->i", d, d).astype(np.int64)  # below 64 * 2^46
        d = x.astype(np.int64) - self.sorted[which]
        return np.einsum("ij,ij->i", d, d)  # below 64 * 2^56

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance, candidates compared) of each row."""
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        near = np.clip(np.searchsorted(self.norms, norm), 1, max(len(self.norms) - 1, 1))
        near = np.minimum(near, len(self.norms) - 1)
        near -= (near > 0) & (np.abs(self.norms[near - 1] - norm) <= np.abs(self.norms[near] - norm))
        bound = np.sqrt(self.distances(x, near).astype(float))
        slack = 1e-9 * (norm + bound + self.norms[-1]) + 1e-9  # above the rounding of the norms, so that ties on the edge stay inside
        low = np.searchsorted(self.norms, norm - bound - slack, "left")
        size = np.searchsorted(self.norms, norm + bound + slack, "right") - low
        own, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < len(x):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            starts, within = common.segments(size[at:end])
            rows = np.repeat(np.arange(at, end), size[at:end])
            which = low[rows] + within
            d = self.distances(x[rows], which)
            least[at:end] = np.minimum.reduceat(d, starts)
            number = np.where(d == least[rows], self.order[which], len(self.order))
            own[at:end] = np.minimum.reduceat(number, starts)
            at = end
        return own, least, int(size.sum())


def _parts(rows: DataFrame, centroids: np.ndarray, dim: int, sums: bool) -> DataFrame:
    """Each task's sums: (cluster, n, d, s), the number of vectors, their distances and, if asked, their components."""

    def make(batches):
        search = Annulus(centroids)
        k = len(centroids)
        n, d, s = np.zeros(k, np.int64), [0] * k, np.zeros((k, dim), object if sums else np.int64)
        for batch in batches:
            x = vectors(batch.column(1), dim)
            if not len(x):
                continue
            own, least, _ = search.nearest(x)
            n += np.bincount(own, minlength=k)
            order = np.argsort(own, kind="stable")
            first = np.flatnonzero(np.diff(own[order], prepend=-1))
            for c, low in zip(own[order][first], np.split(least[order], first[1:]), strict=True):
                d[c] += sum(low.tolist())
            if sums:
                s[own[order][first]] += np.add.reduceat(x[order].astype(np.int64), first, axis=0).astype(object)
        found = np.flatnonzero(n)
        if len(found):
            money = pa.decimal128(38, 0)
            d = pa.array([decimal.Decimal(d[c]) for c in found], money)
            lists = pa.array([[decimal.Decimal(int(v)) for v in s[c]] if sums else [] for c in found], pa.list_(money))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n[found]), d, lists], ["cluster", "n", "d", "s"])

    common.findable(rows.sparkSession)
    return rows.mapInArrow(make, "cluster int, n long, d decimal(38,0), s array<decimal(38,0)>")


def _moved(rows: DataFrame, centroids: np.ndarray, dim: int) -> np.ndarray:
    """Every centroid at the floor of its vectors' mean; what reaches the driver is one row for each centroid."""
    parts = _parts(rows, centroids, dim, True)
    sums = [F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(dim)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
        out[r["cluster"]] = [int(r[f"s{j}"]) // r["n"] for j in range(dim)]
    return out


def clusters(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each vector of ``dim`` finite components.

    Vectors that are null, of another length or hold a null or a non-finite component
    have no row.  Repeated rows are vectors of their own; where ids repeat among the
    first centroids, smaller components come first, and a null id has no hash and comes
    last.  Fewer than ``k`` vectors start as many centroids; no vectors give no rows.
    Components of 2^21 or more in size raise an error, as their distances do not fit a
    long.  Other columns are not read.
    """
    spark = table.sparkSession
    kind = table.schema[key].dataType.simpleString()
    rows = table.select(table[key].alias("k"), table[embedding].alias("x")).where(whole(F.col("x"), dim))
    first = rows.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("k").cast("string")), 256).asc_nulls_last(), F.transform("x", lambda v: F.floor(v.cast("double") * SCALE))).limit(k).select("x")
    start = first.toArrow().column(0).combine_chunks()
    centroids = vectors(start, dim).astype(np.int64) if len(start) else np.zeros((0, dim), np.int64)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(rows, centroids, dim)
    inertia = {r["cluster"]: int(r["d"]) for r in _parts(rows, centroids, dim, False).groupBy("cluster").agg(F.sum("d").alias("d")).collect()} if len(centroids) else {}
    total = sum(inertia.values())
    hashes = [common.sha256(",".join(map(str, c.tolist()))) for c in centroids]

    def assign(batch: pa.RecordBatch):
        own, least, _ = Annulus(centroids).nearest(vectors(batch.column(1), dim))
        of = np.array([inertia.get(c, 0) for c in range(len(centroids))], np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(own, pa.int32()), pa.array(least), pa.array(of[own]), pa.array(np.full(len(own), total, np.int64)), pa.array(hashes).take(pa.array(own))],
            ["k", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
        )

    return common.per_batch(rows, assign, f"k {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").withColumnRenamed("k", key)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(common.table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT p, vec_id, x, arg_min(c, (d, c)) AS cluster, min(d) AS distance
  FROM (SELECT v.p, v.vec_id, v.x, z.c, list_sum(list_transform(range(1, {DIM + 1}), lambda j: (v.x[j] - z.x[j]) * (v.x[j] - z.x[j])))::BIGINT AS d FROM v, c{r} AS z)
  GROUP BY p, vec_id, x)""")
        if r < ROUNDS:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT z.c, coalesce(m.x, z.x) AS x
  FROM c{r} AS z LEFT JOIN (
    SELECT c, list(q ORDER BY j) AS x
    FROM (SELECT cluster AS c, j, ((sum(x[j]) - ((sum(x[j]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS q
          FROM a{r}, range(1, {DIM + 1}) AS t(j) GROUP BY cluster, j) GROUP BY c) AS m ON m.c = z.c)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS p, vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * {SCALE})::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE))) = {DIM}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, x) - 1 AS c, x FROM v
  QUALIFY c < {CENTROIDS}),{",".join(steps)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(z.x, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} AS z ON z.c = cluster"""


SQL = _sql()
