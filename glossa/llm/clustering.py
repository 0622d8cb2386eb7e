"""Centroid clustering with filtering in rotated coordinates.

Vectors are integers (floor of ``scale`` times each component).  Their scatter
matrix, summed over all of them, gives a rotation whose first axes carry most
of the variance.  Each vector is stored with its first ``LEADING`` rotated
coordinates and the norm of what is left; so is each centroid of a round.  The
squared distance of the leading coordinates plus the squared difference of the
two residual norms never exceeds the true squared distance.  A vector's
centroid with the smallest bound is measured first; only centroids whose bound
does not exceed that distance survive and are verified in integers.  Bounds
are lowered by a margin for the rounding of doubles, so the result is exact
for any rotation.

Sums of a round are exact: each task adds up its vectors by centroid and ships
one row for each (centroid, component, 40-bit limb); the new centroids are the
floors of the quotients.  The driver holds the centroids, the scatter matrix
and one row of sums for each (centroid, component): sizes set by the number of
centroids and the dimension.

Edge cases: vectors that are null, of another length, with null or non-finite
components, or beyond a double after scaling are left out; components of any
other size are exact (wide ones in Python integers; a distance beyond a long is
returned as the largest long); rows that repeat an id are vectors of their own
(equal hashes: the smaller vector starts first); a null id hashes like an empty
one; with fewer vectors than centroids each starts one; no vector, no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, written

#: Rotated coordinates kept of each vector.
LEADING = 16
#: Components up to here are added and squared in 64-bit integers.
NARROW = 1 << 26
#: Bits of a limb of the exact sums.
LIMB = 40
#: Groups in which partial scatter matrices meet.
MERGES = 64
TOP = (1 << 63) - 1


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, scale: int = 256) -> DataFrame:
    """(vec_id, vec): usable vectors as whole numbers (doubles)."""
    scaled = F.transform(F.col(f"`{vec_col}`"), lambda x: F.lit(float(scale)) * x.cast("double"))
    whole = df.select(F.col(f"`{id_col}`").alias("vec_id"), scaled.alias("x")).filter(
        (F.size("x") == dim) & ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # beyond 2**53 every double is whole; floor() would make a long of it
    floor = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    return whole.select("vec_id", F.transform("x", floor).alias("vec"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def rotation(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): the mean and the principal axes as columns, the widest
    first.  Vectors with wide components are left to the bounds."""
    def partial(batches):
        n, total, scatter = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column(0), dim)
            x = x[np.abs(x).max(axis=1, initial=0) <= NARROW]
            n, total, scatter = n + len(x), total + x.sum(axis=0), scatter + x.T @ x
        at = int(total.sum()) % MERGES  # any number will do
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.concatenate(([n], total, scatter.ravel())).tobytes()])], ["at", "sums"])

    def merged(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py(), dtype=np.float64) for s in part.column("sums"))
        return pa.table({"sums": pa.array([total.tobytes()])})

    parts = vectors.select("vec").mapInArrow(partial, "at bigint, sums binary").groupBy("at").applyInArrow(merged, "sums binary")
    total = sum(np.frombuffer(r["sums"], dtype=np.float64) for r in parts.collect())  # MERGES rows at most
    if np.isscalar(total) or not total[0]:
        return np.zeros(dim), np.eye(dim)
    n, mean, scatter = total[0], total[1:dim + 1] / total[0], total[dim + 1:].reshape(dim, dim)
    _, axes = np.linalg.eigh(scatter / n - np.outer(mean, mean))
    return mean, axes[:, ::-1]


def rotated(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading coordinates of each row and the norm of the rest."""
    y = (x - mean) @ axes
    return y[:, :leading], np.sqrt((y[:, leading:] ** 2).sum(axis=1))


def stored(vectors: DataFrame, mean: np.ndarray, axes: np.ndarray, dim: int, leading: int) -> DataFrame:
    """Vectors with their leading rotated coordinates and residual norm."""
    def run(batches):
        for b in batches:
            with np.errstate(over="ignore", invalid="ignore"):  # a bound of a wide vector may overflow: it then prunes nothing
                lead, rest = rotated(_matrix(b.column(1), dim), mean, axes, leading)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(lead.ravel()), leading).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat, pa.array(rest)], ["vec_id", "vec", "lead", "rest"])

    return vectors.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, vec array<double>, lead array<double>, rest double")


class Centroids:
    """The centroids of a round (lists of Python integers) and their images."""

    def __init__(self, rows: list, mean: np.ndarray, axes: np.ndarray, leading: int):
        self.rows = rows
        self.narrow = np.array([max(map(abs, r), default=0) <= NARROW for r in rows], dtype=bool)
        self.ints = np.array([r if ok else [0] * len(r) for r, ok in zip(rows, self.narrow, strict=True)], dtype=np.int64)
        wide = np.array([[float(v) for v in r] for r in rows])
        with np.errstate(over="ignore", invalid="ignore"):
            self.lead, self.rest = rotated(wide, mean, axes, leading)
            self.norm = np.sqrt((wide ** 2).sum(axis=1)) + np.sqrt((mean ** 2).sum())

    def distances(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact squared distances of the rows of ``x`` to centroids ``which``, of the same length."""
        fits = self.narrow[which] & (np.abs(x).max(axis=1, initial=0) <= NARROW)
        out = np.zeros(len(x), dtype=object if not fits.all() else np.int64)
        at = np.flatnonzero(fits)
        for i in range(0, len(at), 1 << 14):
            p = at[i:i + (1 << 14)]
            out[p] = ((x[p].astype(np.int64) - self.ints[which[p]]) ** 2).sum(axis=1)
        for p in np.flatnonzero(~fits):
            out[p] = sum((int(a) - b) ** 2 for a, b in zip(x[p].tolist(), self.rows[which[p]], strict=True))
        return out

    def nearest(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, exact squared distance) of each row's nearest centroid, and how many distances were taken."""
        n = len(x)
        with np.errstate(over="ignore", invalid="ignore"):
            bound = ((lead ** 2).sum(axis=1)[:, None] - 2 * lead @ self.lead.T + (self.lead ** 2).sum(axis=1)[None, :]
                     + (rest[:, None] - self.rest[None, :]) ** 2)
            size = np.sqrt((x ** 2).sum(axis=1))[:, None] + self.norm[None, :]
            bound = bound - 1e-10 * size ** 2
        bound[~np.isfinite(bound)] = -np.inf
        first = bound.argmin(axis=1)
        best = self.distances(x, first)
        limit = np.array([float(d) for d in best]) if best.dtype == object else best.astype(np.float64)
        r, c = np.nonzero(bound <= (limit * (1 + 1e-12))[:, None])
        other = c != first[r]
        r, c = r[other], c[other]
        d = self.distances(x[r], c)
        number, taken = first.copy(), n + len(r)
        if best.dtype != d.dtype:
            best, d = best.astype(object), d.astype(object)
        # for each row the smallest (distance, number) of all survivors
        for i in (range(len(r)) if d.dtype == object else []):
            if (d[i], c[i]) < (best[r[i]], number[r[i]]):
                best[r[i]], number[r[i]] = d[i], c[i]
        if d.dtype != object and len(r):
            rows, dist, num = np.concatenate((np.arange(n), r)), np.concatenate((best, d)), np.concatenate((first, c))
            order = np.lexsort((num, dist, rows))
            head = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
            best, number = dist[head], num[head]
        return number, best, taken


def limbs(value: int) -> list[tuple[int, int]]:
    """(place, limb) with sum limb * 2**(LIMB * place) = value."""
    sign, value, out, place = (-1 if value < 0 else 1), abs(value), [], 0
    while value:
        if value & ((1 << LIMB) - 1):
            out.append((place, sign * (value & ((1 << LIMB) - 1))))
        value, place = value >> LIMB, place + 1
    return out


def cluster_sums(vectors: DataFrame, centroids: Centroids, dim: int) -> dict[int, tuple[int, list[int]]]:
    """{centroid: (vectors, exact sums of their components)}."""
    def run(batches):
        k = len(centroids.rows)
        count, total, big = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64), {}
        for b in batches:
            x = _matrix(b.column(0), dim)
            who, _, _ = centroids.nearest(x, _matrix(b.column(1), centroids.lead.shape[1]), b.column(2).to_numpy())
            count += np.bincount(who, minlength=k)
            fits = np.abs(x).max(axis=1, initial=0) <= NARROW
            for c in np.unique(who):
                total[c] += x[fits & (who == c)].astype(np.int64).sum(axis=0)
            for i in np.flatnonzero(~fits):
                old = big.setdefault(int(who[i]), [0] * dim)
                big[int(who[i])] = [a + int(v) for a, v in zip(old, x[i].tolist(), strict=True)]
        rows = [(c, -1, 0, int(count[c])) for c in np.flatnonzero(count).tolist()]
        for c in np.flatnonzero(count).tolist():
            extra = big.get(c, [0] * dim)
            for j in range(dim):
                rows += [(c, j, p, v) for p, v in limbs(int(total[c, j]) + extra[j])]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], ["c", "j", "place", "v"])

    parts = vectors.select("vec", "lead", "rest").mapInArrow(run, "c bigint, j bigint, place bigint, v bigint")
    out: dict = {}
    for r in parts.groupBy("c", "j", "place").agg(F.sum("v").alias("v")).collect():
        n, sums = out.setdefault(r["c"], [0, [0] * dim])
        if r["j"] < 0:
            out[r["c"]][0] = r["v"]
        else:
            sums[r["j"]] += r["v"] << (LIMB * r["place"]) if r["v"] >= 0 else -(-r["v"] << (LIMB * r["place"]))
    return {c: (n, sums) for c, (n, sums) in out.items()}


def assigned(vectors: DataFrame, centroids: Centroids, dim: int) -> DataFrame:
    """(vec_id, cluster, distance, n_verified) of every vector."""
    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), dim)
            who, dist, _ = centroids.nearest(x, _matrix(b.column(2), centroids.lead.shape[1]), b.column(3).to_numpy())
            dist = [min(int(d), TOP) for d in dist]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(who.astype(np.int32)), pa.array(dist, type=pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of their ids."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [[int(v) for v in r["vec"]] for r in vectors.select("vec", h.alias("h")).orderBy("h", "vec").limit(k).collect()]


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, k: int = 40, rounds: int = 5, seed: int = 2,
            scale: int = 256, leading: int = LEADING) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance), centroids) after ``rounds`` rounds."""
    spark = df.sparkSession
    small_batches(spark)
    leading = min(leading, dim)
    vectors = written(integer_vectors(df, id_col, vec_col, dim, scale), "vectors")
    mean, axes = rotation(vectors, dim)
    vectors = written(stored(vectors, mean, axes, dim, leading), "rotated")
    rows = first_centroids(vectors, k, seed)
    if not rows:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter("false"), []
    for _ in range(rounds):
        sums = cluster_sums(vectors, Centroids(rows, mean, axes, leading), dim)
        rows = [[s // sums[c][0] for s in sums[c][1]] if c in sums else old for c, old in enumerate(rows)]
    return written(assigned(vectors, Centroids(rows, mean, axes, leading), dim), "clusters"), rows


def op11_centroid_clusters(spark, sf_dir):
    """Clusters of all 64-dimensional ``embeddings`` with their inertia."""
    found, rows = cluster(table(spark, sf_dir, "embeddings"))
    wide = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    per = {r["cluster"]: int(r["d"]) for r in wide.collect()}  # a row a cluster
    digest = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in rows]
    every = spark.createDataFrame([(c, min(per.get(c, 0), TOP), min(sum(per.values()), TOP), digest[c]) for c in range(len(rows))],
                                  "c int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(every), F.col("cluster") == F.col("c")).drop("c")


def _sql(k: int = 40, rounds: int = 5) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, vec, c, d FROM (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS o FROM (
      SELECT r, vec_id, v.vec, c, CAST(list_sum(list_transform(list_zip(v.vec, k.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
      FROM v, c{i} k)) WHERE o = 1
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.vec, old.vec) AS vec FROM c{i} old LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS vec FROM (
      SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(vec) AS x, generate_subscripts(vec, 1) AS j FROM a{i}) GROUP BY c, j)
    GROUP BY c) m USING (c)
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), vec) - 1 AS c, vec FROM v
  ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), vec LIMIT {k}
), {', '.join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.vec, ',')) AS centroid_sha256
FROM a{rounds} JOIN (SELECT c, vec FROM c{rounds}) k USING (c)
"""


OP11_SQL = _sql()
