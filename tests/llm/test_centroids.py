"""Centroid clustering against brute force in Python integers and against its SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from loomstone.llm import centroids

SCHEMA = "label int, vec_id long, embedding array<double>, cluster int, k string, x double, distance long"


def brute(rows, k, rounds, dim):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(64 * x) for x in e]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    start = sorted(kept, key=lambda v: (v[0] is None, sha(f"1:{v[0]}"), v[1]))[:k]
    c = [list(x) for _, x in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, z, strict=True)), j) for j, z in enumerate(c)) for _, x in kept]

    for _ in range(rounds):
        own = [j for _, j in assign()]
        for j in range(len(c)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    last = assign()
    total = sum(d for d, _ in last)
    return sorted(((i, j, d, sum(a for a, b in last if b == j), total, sha(",".join(map(str, c[j])))) for (i, _), (d, j) in zip(kept, last, strict=True)), key=str)


def rows_like(r, n, dim):
    base = [[r.gauss(0, 1) * (1 + 5 * (k % 3)) for _ in range(dim)] for k in range(5)]
    out = [(i, [x + r.gauss(0, 0.3) for x in r.choice(base)]) for i in range(n)]
    out += [(n, base[0])] * 3 + [(n + 1, base[0]), (None, base[1]), (n + 2, [0.0] * dim), (n + 3, [-0.0] * dim), (3, [1.5] * dim)]
    return out + [(n + 4, None), (n + 5, []), (n + 6, [1.0] * (dim - 1)), (n + 7, [None] + [1.0] * (dim - 1)), (n + 8, [float("nan")] * dim), (n + 9, [float("inf")] + [0.0] * (dim - 1)), (n + 10, [1.0] * (dim + 1))]


def table(spark, rows):
    return spark.createDataFrame([(1, i, e, 9, "k", 0.5, 7) for i, e in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = rows_like(random.Random(seed), 60, 8)
    got = centroids.clusters(table(spark, rows), k=7, dim=8)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 7, 3, 8)


def test_equals_its_sql(spark):
    rows = rows_like(random.Random(3), 40, centroids.DIM)
    docs = table(spark, rows)
    con = duckdb.connect()
    frame = docs.select("vec_id", "embedding").toArrow()
    con.register("embeddings", frame)
    got = sorted(map(tuple, centroids.clusters(docs).collect()), key=str)
    assert got == sorted(con.sql(centroids.SQL).fetchall(), key=str) == brute(rows, 16, 3, 64)


def test_few_or_no_vectors_and_ties(spark):
    assert centroids.clusters(table(spark, [])).count() == 0
    assert centroids.clusters(table(spark, [(1, None), (2, [1.0])])).count() == 0
    few = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (3, [0.0, 0.0])]
    got = centroids.clusters(table(spark, few), k=16, dim=2)
    assert sorted(map(tuple, got.collect()), key=str) == brute(few, 16, 3, 2)
    same = [(i, [0.25, -0.25]) for i in range(40)]  # all centroids are one point: the smallest number takes all, the others stay
    got = centroids.clusters(table(spark, same), dim=2).collect()
    assert {(r["cluster"], r["distance"]) for r in got} == {(0, 0)} and len(got) == 40


def test_annulus_skips_and_never_misses():
    r = np.random.default_rng(5)
    c = r.integers(-50, 50, (40, 6)) * r.integers(1, 30, (40, 1))
    x = np.concatenate((r.integers(-900, 900, (500, 6)), c, c + 1)).astype(float)
    own, least, compared = centroids.Annulus(c).nearest(x)
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (own == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
    assert compared < 0.9 * d.size
    large = np.array([[1 << 26, 0], [-(1 << 26), 3]])
    own, least, _ = centroids.Annulus(large).nearest(np.array([[1 << 26, 5.0], [-5.0, 0]]))
    assert own.tolist() == [0, 1] and least.tolist() == [25, ((1 << 26) - 5) ** 2 + 9]
    with pytest.raises(OverflowError):
        import pyarrow as pa

        centroids.vectors(pa.array([[1e9, 0.0]]), 2)
