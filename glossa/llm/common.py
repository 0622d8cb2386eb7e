"""Small Spark helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.session import materialise, scratch_path


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the session;
    ``glossa.session.release_scratch`` removes it when results are saved."""
    return scratch_path(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and
    a lost executor costs no more than the tasks that read it."""
    return materialise(df, name)


def small_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Arrow batches of at most ``limit`` bytes, so that a batch of long texts
    does not set what a Python worker needs.  A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower().rstrip("b")
    units = {"k": 10, "m": 20, "g": 30}
    size = int(now[:-1]) << units[now[-1]] if now[-1] in units else int(now)
    if size > limit or size <= 0:
        spark.conf.set(key, str(limit))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tkey, text): only the named columns, under fixed names.

    ``tkey`` hashes the text, so that rows which repeat a doc_id stay apart;
    a null doc_id is kept as null.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.xxhash64(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has long columns u, v.  Returns (node, component) with the
    smallest reachable node; nodes without an edge do not appear.  Each step
    is a minimum per node (pre-aggregated) and an equi-join, so a node with
    very many neighbours is never gathered in one task; lineage is cut by a
    written table after each step.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("x"), F.least("u", "m").alias("m"))
        j = both.join(low, both.u == low.x)
        if large:
            out = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                low.select(F.col("x").alias("u"), F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    cur = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .filter("u <> v").distinct(), "cc")
    seen = None
    for _ in range(rounds):
        cur = written(star(star(cur, True), False), "cc")
        now = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def annotated(df: DataFrame, text_col: str, make, fields: str, keep=None) -> DataFrame:
    """``row`` (a struct of the columns ``keep``, all by default) and the
    columns ``fields``, which ``make()(texts)`` computes from each Arrow batch.

    The struct keeps the caller's columns apart from the new ones, whatever
    their names; ``select("row.*")`` gives them back.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    small_batches(df.sparkSession)
    keep = df.columns if keep is None else list(keep)
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    new = T._parse_datatype_string(fields)
    schema = T.StructType([src.schema["row"], *new.fields])
    names = schema.names

    def run(batches):
        fn = make()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *fn(b.column(1))], names)

    return src.mapInArrow(run, schema)


def prefix_sums(df: DataFrame, group: list[str], key: str, value: str, out: str, fan: int = 4096) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group with a
    smaller ``key`` (integers from 0, one row each).  Summed in two levels, so
    that no window holds more than about ``fan`` neighbouring keys, or one row
    per ``fan`` of them."""
    high = F.floor(F.col(key) / fan)
    tops = df.groupBy(*group, high.alias("_high")).agg(F.sum(value).alias("_sum"))
    whole = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_high")
    tops = tops.select(*[F.col(g).alias(f"_{g}") for g in group], "_high", (F.sum("_sum").over(whole) - F.col("_sum")).alias("_before"))
    near = Window.partitionBy(*group, "_high").orderBy(key)
    inner = df.withColumn("_high0", high)
    on = [F.col("_high0") == F.col("_high"), *[F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]]
    both = inner.join(tops, on)
    return both.withColumn(out, (F.col("_before") + F.sum(value).over(near) - F.col(value)).cast("long")).select(*df.columns, out)


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``name`` = 1, 2, 3... in ``order``, which should tell all rows
    apart (equal ones share a range).  Rows are dealt out by ranges and
    numbered inside each; a range starts after the rows of those before it."""
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = prefix_sums(sizes, [], "_part", "_n", "_before").select("_part", "_before")  # one row for each partition
    return dealt.withColumn("_in", part).join(before, F.col("_in") == F.col("_part")).withColumn(
        name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).select(*df.columns, name)
