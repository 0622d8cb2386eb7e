"""Session helpers: a tuned local session for tests/bench, and the
checkpoint folder rule (use the cluster's ``spark.checkpoint.dir``; only a
local master may fall back to a scratch folder)."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app_name: str = "glossa", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("GLOSSA_DRIVER_MEMORY", "16g"))
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder; we read
    it from the session.  Only a local master (tests, bench) may get a fresh
    scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):  # local-cluster has executors of its own
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a shared folder for reliable checkpoints")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="glossa-ckpt-"))
    return sc.getCheckpointDir()


#: Folders that this process made in the shared folder, by application.
_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder (shared on a cluster)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Deletes what this application wrote to the shared folder so far, and
    returns the number of folders.  Models and results that were not saved
    elsewhere read from there: call it when they are no longer needed."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        n += bool(p.getFileSystem(conf).delete(p, True))
    for table in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return n


def materialise(df, name: str):
    """``df`` written once as Parquet into the shared folder and read back: the
    lineage ends there, a lost executor costs no more than the tasks that read
    it, and nothing stays cached on the executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Names under which this process opened bucketed tables, by application.
_TABLES: dict[str, list[str]] = {}


def _table_name(spark: SparkSession, name: str) -> str:
    table = f"glossa_{name}_{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(table)
    return table


def bucketed(df, name: str, keys: list[str], order: list[str], path: str | None = None):
    """``df`` written as a table of ``spark.sql.shuffle.partitions`` buckets of
    ``keys``, one sorted file each: joins and groups on the keys read it where
    it lies.  The table is a name for the files at ``path`` (the shared folder
    by default)."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = _table_name(spark, name)
    (df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*order).format("parquet")
     .option("path", path or scratch_path(spark, name)).saveAsTable(table))
    return spark.table(table)


def open_bucketed(spark: SparkSession, path: str, name: str, keys: list[str], order: list[str], buckets: int):
    """The table that ``bucketed`` wrote to ``path``, in any session."""
    table = _table_name(spark, name)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    names = lambda cs: ", ".join(f"`{c}`" for c in cs)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({names(keys)}) SORTED BY ({names(order)}) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)
