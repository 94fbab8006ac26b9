"""Centroid clustering in exact integers; each vector finds its nearest centroid by the threshold algorithm.

Every dimension has the centroids in a sorted list. From a vector's own value the list is walked outward, in all
dimensions at once: a centroid met in any of them is compared with the vector exactly. What no dimension has met yet is,
in each, at least as far as the last step there, so the walk ends when the sum of the squared last steps strictly
exceeds the best exact distance; a centroid that ties with the best has then been met, and the smaller number wins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise

#: Components lie below this in size: squared distances of up to 64 dimensions, and sums of 2**36 vectors, fit in 64 bits.
REACH = 1 << 27
#: Vectors that a worker compares at a time.
BLOCK = 2048


class Centroids:
    """Centroids as rows of 64-bit integers, with the sorted list of each dimension."""

    def __init__(self, rows: np.ndarray):
        self.rows = np.ascontiguousarray(rows, np.int64)
        self.order = np.argsort(self.rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.rows, self.order, axis=0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row; of several as near, the smallest number."""
        found, far = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
        for a in range(0, len(vectors), BLOCK):
            found[a : a + BLOCK], far[a : a + BLOCK] = self._walk(vectors[a : a + BLOCK])
        return found, far

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, dims = self.rows.shape
        who, best = np.full(len(x), k, np.int64), np.full(len(x), np.iinfo(np.int64).max)
        right = np.empty(x.shape, np.int64)  # the first in each list that is not below the vector's value
        for d in range(dims):
            right[:, d] = np.searchsorted(self.sorted[:, d], x[:, d])
        left, live, seen = right - 1, np.arange(len(x)), np.zeros((len(x), k), bool)
        every, beyond = np.arange(dims), np.int64(4 * REACH)
        for _ in range(k):
            own = x[live]
            below = np.where(left >= 0, own - self.sorted[np.maximum(left, 0), every], beyond)
            above = np.where(right < k, self.sorted[np.minimum(right, k - 1), every] - own, beyond)
            down = below <= above
            met = self.order[np.where(down, np.maximum(left, 0), np.minimum(right, k - 1)), every]
            step = np.where(down, below, above)
            left, right = left - down, right + ~down
            new = np.zeros((len(live), k), bool)
            new[np.arange(len(live))[:, None], met] = True
            new &= ~seen
            seen |= new
            for c in np.flatnonzero(new.any(axis=0)):
                at = np.flatnonzero(new[:, c])
                exact = ((own[at] - self.rows[c]) ** 2).sum(axis=1)
                rows = live[at]
                nearer = (exact < best[rows]) | ((exact == best[rows]) & (c < who[rows]))
                who[rows[nearer]], best[rows[nearer]] = c, exact[nearer]
            on = (step**2).sum(axis=1) <= best[live]
            if not on.any():
                break
            live, left, right, seen = live[on], left[on], right[on], seen[on]
        return who, best


def whole(vectors: DataFrame, dims: int, scale: int, column: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that count, each component x as the integer floor(scale * x).

    Left out: null vectors, those of another number of components, and those with a null or non-finite component or one
    whose integer is not below REACH in size (their squared distances would pass 64 bits). Null and repeated ids keep
    their rows.
    """
    x = F.col(column).cast("array<double>")
    fits = F.forall(x, lambda y: F.coalesce(~F.isnan(y) & (F.abs(y) * scale < REACH), F.lit(False)))
    kept = vectors.where(F.coalesce((F.size(x) == dims) & fits, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda y: F.floor(y * scale).cast("int")).alias("v"))


def seeds(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The first centroids: k vectors with the smallest sha256 of salt and id, in that order; a null id is the empty text.

    Of rows with one id the one that is smaller, component by component, comes first.
    """
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in kept.orderBy(name, "v").limit(k).collect()], np.int64)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.int64)


def _round(kept: DataFrame, now: np.ndarray) -> np.ndarray:
    """Every centroid moved to floor(sum / count) of its vectors; those without vectors stay.

    Tasks send one row for each centroid that they have met; what reaches the driver is as large as the centroids.
    """
    lists = Centroids(now)

    def sums(batches):
        total, n = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
        for batch in batches:
            x = _matrix(batch)
            who = lists.nearest(x)[0]
            n += np.bincount(who, minlength=len(now))
            for c in np.unique(who):
                total[c] += x[who == c].sum(axis=0)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"c": pa.array(met, pa.int32()), "n": pa.array(n[met], pa.int64()), "s": pa.array(list(total[met]), pa.list_(pa.int64()))})

    parts = kept.select("v").mapInArrow(sums, "c int, n long, s array<long>")
    moved = parts.select("c", "n", F.posexplode("s").alias("d", "s")).groupBy("c", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = now.copy()
    for r in moved.collect():
        out[r.c, r.d] = r.s // r.n
    return out


def cluster(vectors: DataFrame, k: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024, salt: str = "3:", column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector that counts, final centroids); see ``whole`` and ``seeds``.

    With fewer than k vectors there are as many centroids as vectors; without any, and for an empty table, no rows.
    Equal vectors are in one cluster. Other columns, of any name, are not looked at. The whole numbers are written once
    in the shared folder and read in each round.
    """
    kept = materialise(whole(vectors, dims, scale, column), "vectors")
    now = seeds(kept, k, salt)
    if not len(now):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), now.reshape(0, dims)
    for _ in range(rounds):
        moved = _round(kept, now)
        if (moved == now).all():  # further rounds would change nothing
            break
        now = moved
    lists = Centroids(now)

    def assign(batches):
        for batch in batches:
            who, far = lists.nearest(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(who, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(assign, "vec_id long, cluster int, distance long"), now


def digest(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows of ``cluster`` with each cluster's inertia, the whole inertia and the centroid's digest.

    Sums beyond 64 bits are null.
    """
    rows = materialise(rows, "clusters")
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    held = [int(sums.get(c) or 0) for c in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    fits = lambda n: F.lit(n if n < 1 << 63 else None).cast("long")
    pick = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1) if len(values) else F.lit(None)
    return rows.select(
        "vec_id", "cluster", "distance", pick([fits(n) for n in held]).cast("long").alias("cluster_inertia"),
        fits(sum(held)).alias("inertia"), pick([F.lit(n) for n in names]).cast("string").alias("centroid_sha256"),
    )


def _sql(k: int = 8, dims: int = 64, rounds: int = 10) -> str:
    """DuckDB SQL: every vector against every centroid, a CTE for each round."""
    steps = [
        f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(CAST(x AS DOUBLE)) * 1024 < {REACH})) = {dims}
),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v
  FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k})
)"""
    ]
    nearest = """
a{n} AS MATERIALIZED (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (
    SELECT r, c, CAST(list_sum(list_transform(list_zip(kept.v, c{n}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM kept CROSS JOIN c{n}
  )
  GROUP BY r
)"""
    move = """
s{n} AS (
  SELECT c, d, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x
  FROM (
    SELECT c, d, sum(x) AS s, count(*) AS n
    FROM (SELECT a{n}.c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept JOIN a{n} USING (r))
    GROUP BY c, d
  )
),
c{m} AS MATERIALIZED (
  SELECT c{n}.c, coalesce(s.v, c{n}.v) AS v
  FROM c{n} LEFT JOIN (SELECT c, list(x ORDER BY d) AS v FROM s{n} GROUP BY c) s USING (c)
)"""
    for n in range(rounds):
        steps += [nearest.format(n=n), move.format(n=n, m=n + 1)]
    steps.append(nearest.format(n=rounds))
    return f"""WITH {",".join(steps)}
SELECT vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.c = a.c"""


SQL = _sql()
