"""Clusters against plain Python that compares every vector with every centroid."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import centroids


def plain(rows, k=8, dims=64, rounds=10):
    """[(vec_id, cluster, distance)] and the centroids, vector by vector."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    now = [v for _, v in sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(now))
    for _ in range(rounds):
        own = [[] for _ in now]
        for _, v in kept:
            own[near(v)[1]].append(v)
        now = [[sum(x) // len(o) for x in zip(*o)] if o else c for o, c in zip(own, now)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], now


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def rounded(values):
    return [float(np.float32(x)) for x in values]


@pytest.mark.parametrize("n", [3, 8, 300])
def test_against_plain(spark, n):
    r = np.random.default_rng(n)
    rows = [(i, rounded(r.normal(0, 0.1, 64) + i % 5)) for i in range(n)]
    rows += [(7, rows[0][1]), (None, rows[1][1]), (901, None), (902, rows[0][1][:-1]), (903, [*rows[0][1][:-1], None]), (904, [*rows[0][1][:-1], float("nan")]), (905, [*rows[0][1][:-1], float("-inf")])]
    frame = vectors(spark, rows).withColumns({"cluster": F.lit("x"), "v": F.lit(1), "distance": F.lit(None)}).repartition(3)
    got, now = centroids.cluster(frame)
    want, at = plain(rows)
    assert now.tolist() == at
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted(want, key=key)
    rest = centroids.digest(got, now).collect()
    assert {x.inertia for x in rest} == {sum(w[2] for w in want)}
    assert all(x.cluster_inertia == sum(w[2] for w in want if w[1] == x.cluster) for x in rest)
    assert all(x.centroid_sha256 == hashlib.sha256(",".join(map(str, at[x.cluster])).encode()).hexdigest() for x in rest)


def test_empty(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        assert centroids.digest(*centroids.cluster(vectors(spark, rows))).collect() == []


def test_walk_with_ties():
    """Small whole numbers, so that distances and list values tie; the nearest and the smallest number, always."""
    r = np.random.default_rng(4)
    for dims, k in ((1, 5), (2, 9), (3, 40), (64, 8)):
        rows, x = r.integers(-3, 4, (k, dims)), r.integers(-5, 6, (500, dims))
        who, far = centroids.Centroids(rows).nearest(x)
        want = ((x[:, None] - rows) ** 2).sum(axis=2)
        assert (who == want.argmin(axis=1)).all() and (far == want.min(axis=1)).all()


def test_walk_ends_early():
    """Far centroids are never compared."""
    rows = np.arange(100).reshape(-1, 1) * 1000
    lists = centroids.Centroids(np.repeat(rows, 4, axis=1))
    lists.rows[5:95] = -1  # wrong values, which a comparison would notice
    who, far = lists.nearest(np.full((1, 4), 2010))
    assert who[0] == 2 and far[0] == 400


def test_sql(spark, tmp_path):
    import duckdb

    r = np.random.default_rng(1)
    rows = [(i, rounded(r.normal(0, 1, 64))) for i in range(60)] + [(3, rounded(r.normal(0, 1, 64))), (None, rounded(r.normal(0, 1, 64))), (70, None), (71, [1.0])]
    vectors(spark, rows).write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = con.execute(centroids.SQL).fetchall()
    got = [tuple(x) for x in centroids.digest(*centroids.cluster(vectors(spark, rows))).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
