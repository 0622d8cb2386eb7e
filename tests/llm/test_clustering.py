"""Centroid clustering against plain integer rounds."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from llm_fixtures import tuples  # noqa: E402

from glossa.llm import clustering  # noqa: E402


def plain(vectors, k, rounds, seed=2):
    """(vec_id, ints) -> (assignments, centroids)."""
    h = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(vectors, key=lambda x: (h(x[0]), x[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(cents))[::-1]
    for _ in range(rounds):
        who = [near(v)[0] for _, v in vectors]
        for j in range(len(cents)):
            mine = [v for (_, v), w in zip(vectors, who) if w == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, *near(v)) for i, v in vectors], cents


def made(dim, n, seed, wide=False):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(7)]
    rows = [(i, [c + r.gauss(0, 0.3) for c in r.choice(centres)]) for i in range(n)]
    rows += [(900, [0.5] * dim), (901, [0.5] * dim), (900, [0.5] * dim), (None, [-0.25] * dim)]
    if wide:
        rows += [(910, [1e30] + [0.0] * (dim - 1)), (911, [-1e25] * dim), (912, [3e5] * dim), (913, [3e5] * (dim - 1) + [3e5 + 1])]
    return rows


@pytest.mark.parametrize("dim,k,wide,leading", [(8, 6, False, 3), (8, 6, True, 3), (5, 9, True, 5), (8, 500, False, 2)])
def test_clusters(spark, dim, k, wide, leading):
    rows = made(dim, 160, dim, wide)
    bad = [(950, None), (951, [0.1] * (dim - 1)), (952, [None] + [0.1] * (dim - 1)), (953, [float("nan")] * dim), (954, [float("inf")] * dim), (955, [1e307] * dim), (956, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).repartition(3)
    got, cents = clustering.cluster(df, dim=dim, k=k, rounds=3, leading=leading)
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want, want_cents = plain(ints, k, 3)
    assert cents == want_cents
    want = [(i, c, min(d, clustering.TOP)) for i, c, d in want]
    assert tuples(got) == sorted(want, key=lambda t: tuple((x is not None, x if x is not None else 0) for x in t))


def test_bounds_prune():
    r = np.random.default_rng(0)
    x = np.floor(256 * (r.normal(size=(3000, 64)) * np.geomspace(2, 0.02, 64) + r.integers(-3, 3, (3000, 1))))
    mean = x.mean(axis=0)
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
    cents = clustering.Centroids([[int(v) for v in row] for row in x[:40]], mean, axes, 16)
    lead, rest = clustering.rotated(x, mean, axes, 16)
    who, dist, taken = cents.nearest(x, lead, rest)
    full = ((x[:, None, :] - x[None, :40, :]) ** 2).sum(axis=2)
    assert (who == full.argmin(axis=1)).all() and (dist == full.min(axis=1)).all()
    assert taken < 0.1 * full.size  # of 40 distances a vector


def test_limbs():
    for v in (0, 1, -1, 2**39, 2**40, -(2**90) - 5, 10**60):
        assert sum(x << (40 * p) if x >= 0 else -(-x << (40 * p)) for p, x in clustering.limbs(v)) == v


def test_query(spark, tmp_path):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    empty.write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert clustering.op11_centroid_clusters(spark, f"{tmp_path}/none").collect() == []
    rows = made(64, 90, 4)
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/some/embeddings.parquet")
    want, cents = plain([(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows], 40, 5)
    key = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    per = [sum(d for _, c, d in want if c == j) for j in range(len(cents))]
    out = clustering.op11_centroid_clusters(spark, f"{tmp_path}/some").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert tuples(out) == sorted(((i, c, d, per[c], sum(per), sha[c]) for i, c, d in want), key=key)
