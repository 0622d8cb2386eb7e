"""Exact top-k inner-product search by tiled matrix products.

Queries and candidates are dealt into blocks; a tile is one query block and
one candidate shard, brought together by an equi-join on both numbers, so
work and memory per task are bounded by the tile whatever the table or the
most frequent vector.  Each tile multiplies matrices, selects every query's k
best by partial selection, and the short lists merge in a tree.

Vectors are integers; products run in float32 or float64 while the largest
possible sum is exact there, and in int64 beyond.

Edge cases: vectors that are null, hold null or non-finite components take no
part; vectors of different length are not compared; a query's own row is
known by its id, so rows which repeat an id are no candidates of it; repeated
candidate rows are listed each; repeated query rows count once; ties go to
the smaller id; fewer candidates than k give a shorter list.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: Bytes of one side of a tile (8-byte components).
TILE_BYTES = 4 << 20
#: Short lists merged in one step of the tree.
FAN_IN = 32
OUT = "dim int, query_id bigint, qkey bigint, shard bigint, vec_id bigint, score bigint"


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, vec): floor(scale * component) as integers, usable rows only."""
    parts = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    return df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), parts.alias("x")).filter(
        ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).select(
        "vec_id", F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x)).alias("vec"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, dim)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    top = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1]
    if top >= 1 << 53:
        return q @ c.T
    kind = np.float32 if top < 1 << 24 else np.float64
    return (q.astype(kind) @ c.T.astype(kind)).astype(np.int64)


def _tile(k: int):
    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            dim, shard = left.column("dim")[0].as_py(), right.column("shard")[0].as_py()
            ids = right.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")  # equal scores then go to the smaller id
            ids, c = ids[order], _matrix(right.column("vec"), dim)[order]
            qid, qkey, q = left.column("query_id").to_numpy(), left.column("qkey").to_numpy(), _matrix(left.column("vec"), dim)
            for i in range(0, len(q), 256):
                s = products(q[i:i + 256], c)
                for r in range(len(s)):
                    row, own = s[r], ids == qid[i + r]
                    others = np.flatnonzero(~own) if own.any() else None
                    if others is not None:
                        row = row[others]
                    if not len(row):
                        continue
                    cut = np.partition(row, -k)[-k] if len(row) > k else row.min()
                    at = np.concatenate((np.flatnonzero(row > cut), np.flatnonzero(row == cut)[:k]))
                    at = at[np.lexsort((at, -row[at]))][:k]
                    who = ids[at if others is None else others[at]]
                    rows += [(dim, qid[i + r], qkey[i + r], shard, v, x) for v, x in zip(who, row[at], strict=True)]
        names = ["dim", "query_id", "qkey", "shard", "vec_id", "score"]
        cols = np.array(rows, dtype=np.int64).reshape(-1, 6)
        return pa.table([pa.array(cols[:, 0].astype(np.int32)), *[pa.array(cols[:, i]) for i in range(1, 6)]], names=names)

    return one


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for integer vectors (vec_id, vec)."""
    if k < 1:
        raise ValueError("k must be positive")
    candidates = written(candidates.withColumn("dim", F.size("vec")), "candidates")
    queries = written(queries.select(F.col("vec_id").alias("query_id"), "vec", F.size("vec").alias("dim"), F.xxhash64("vec").alias("qkey"))
                      .dropDuplicates(["query_id", "qkey"]), "queries")

    def blocks(df, name):
        n = df.groupBy("dim").agg(F.count(F.lit(1)).alias("c")).withColumn(
            name, F.ceil(F.col("c") * 8 * F.greatest("dim", F.lit(1)) / TILE_BYTES).cast("long"))
        return n.select("dim", name)  # one row for each vector length

    plan = blocks(candidates, "ns").join(blocks(queries, "nq"), "dim").select(F.col("dim").alias("d"), "ns", "nq")

    def dealt(df, own, n, other, m, *key):
        return df.join(plan, F.col("dim") == F.col("d")).withColumn(own, F.pmod(F.xxhash64(*key), F.col(n))).withColumn(
            other, F.explode(F.expr(f"sequence(cast(0 as bigint), {m} - 1)"))).drop("d", "ns", "nq")

    left = dealt(queries, "qb", "nq", "shard", "ns", "query_id", "qkey")
    right = dealt(candidates.withColumn("u", F.monotonically_increasing_id()), "shard", "ns", "qb", "nq", "vec_id", "u").drop("u")
    lists = left.groupBy("dim", "qb", "shard").cogroup(right.groupBy("dim", "qb", "shard")).applyInArrow(_tile(k), OUT)
    shards = plan.agg(F.max("ns")).first()[0] or 1
    order = [F.desc("score"), F.asc("vec_id")]
    for _ in range(max(0, math.ceil(math.log(shards, FAN_IN)) - 1) if shards > 1 else 0):
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN))
        lists = lists.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "qkey", "shard").orderBy(*order))).filter(F.col("r") <= k).drop("r")
    last = Window.partitionBy("query_id", "qkey").orderBy(*order)
    return lists.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark, sf_dir):
    """Five best vectors for each vector whose id is divisible by 50."""
    vectors = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return exact_topk(vectors.filter("vec_id % 50 = 0"), vectors, 5)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
