"""Model persistence: parquet tables (the stored form), plus headerless
int CSV export/import for the n-gram tables.

A save writes a fresh version folder and, last, its meta table: a version is
complete when that has its _SUCCESS marker, and the newest complete version
is the model.  A crash in between leaves the model as it was.  N-gram tables
are range-partitioned and sorted by context, so a scan for one context prunes
files and row groups by min/max.  What predictions read is stored beside them
in buckets of the keys it is joined on (``operators/serving.py``), so a loaded
model predicts without moving its tables.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.operators.encode import DEFAULT_BROADCAST_MAX_WORDS
from glossa.operators.serving import LAYOUT, PLAIN, Serving, serving
from glossa.plans.build import NGramModel, ranged
from glossa.session import bucketed, open_bucketed

TABLES = ("vocab", "bigrams", "trigrams")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest complete version below ``path``."""
    fs, _ = _fs(spark, path)
    for name in _versions(spark, path):
        if fs.exists(_fs(spark, f"{path}/{name}/meta/_SUCCESS")[1]):
            return f"{path}/{name}"
    return None


def model_exists(spark: SparkSession, path: str) -> bool:
    return current_version(spark, path) is not None


def save_model(model: NGramModel, path: str) -> str:
    """Writes a new version and returns its folder."""
    spark = model.vocab.sparkSession
    out = f"{path}/v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for name in TABLES:
        ranged(getattr(model, name), name).write.parquet(f"{out}/{name}")
    ready = serving(model)
    for name, (keys, order) in LAYOUT.items():
        bucketed(getattr(ready, name), name, keys, order, f"{out}/serving/{name}")
    for name in PLAIN:
        getattr(ready, name).write.parquet(f"{out}/serving/{name}")
    meta = dict(nb=model.nb, vocab_size=model.vocab_size, vocab_total=model.vocab_total,
                params=model.params, broadcast_max_words=model.broadcast_max_words, n_words=ready.n_words,
                buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.parquet(f"{out}/meta")
    return out


def _versions(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted((s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v-")), reverse=True) if fs.exists(p) else []


def take_lease(spark: SparkSession, version: str) -> str:
    """Marks a version as read from; returns the mark, which ``release_lease`` removes."""
    mark = f"{version}/_leases/{uuid.uuid4().hex}"
    fs, p = _fs(spark, mark)
    fs.create(p).close()
    return mark


def release_lease(spark: SparkSession, mark: str) -> None:
    fs, p = _fs(spark, mark)
    fs.delete(p, False)


def remove_old_versions(spark: SparkSession, path: str, keep: int = 1, lease_hours: float = 24, grace_hours: float = 24) -> list[str]:
    """Removes complete versions beyond the newest ``keep`` that nobody holds a
    lease on (a lease ends after ``lease_hours``), and incomplete ones begun more
    than ``grace_hours`` ago; returns their folders."""
    if keep < 1:
        raise ValueError("keep must be 1 or more: the newest version is the model")
    now, kept, gone = time.time() * 1000, 0, []
    for name in _versions(spark, path):
        at = f"{path}/{name}"
        fs, folder = _fs(spark, at)
        if fs.exists(_fs(spark, f"{at}/meta/_SUCCESS")[1]):
            kept += 1
            leases = _fs(spark, f"{at}/_leases")[1]
            held = fs.exists(leases) and any(now - s.getModificationTime() < lease_hours * 3.6e6 for s in fs.listStatus(leases))
            if kept <= keep or held:
                continue
        elif now - int(name.split("-")[1]) / 1e6 < grace_hours * 3.6e6:
            continue
        fs.delete(folder, True)
        gone.append(at)
    return gone


_LOADED: dict[tuple[str, str], NGramModel] = {}


def load_model(spark: SparkSession, path: str, override: bool = False, lease: bool = False) -> NGramModel:
    """The newest version of a stored model, read once per application and
    path; ``override`` looks for a newer version and re-reads.  ``lease`` keeps
    ``remove_old_versions`` from the version until ``release_lease(m.lease)``."""
    key = (spark.sparkContext.applicationId, path)
    if not override and key in _LOADED:
        return _LOADED[key]
    at = current_version(spark, path)
    if at is None:
        raise FileNotFoundError(f"no complete model is stored at {path}")
    meta = json.loads(spark.read.parquet(f"{at}/meta").first()["meta"])
    m = NGramModel(*[spark.read.parquet(f"{at}/{t}") for t in TABLES], meta["nb"], meta["vocab_size"],
                   meta["vocab_total"], meta.get("params", {}), meta.get("broadcast_max_words", DEFAULT_BROADCAST_MAX_WORDS))
    if "buckets" in meta:
        tables = {name: open_bucketed(spark, f"{at}/serving/{name}", name, keys, order, meta["buckets"]) for name, (keys, order) in LAYOUT.items()}
        tables |= {name: spark.read.parquet(f"{at}/serving/{name}") for name in PLAIN}
        m._memo(("serving", None), lambda: Serving(**tables, n_words=meta["n_words"]))
    if lease:
        m.lease = take_lease(spark, at)
    if key in _LOADED:
        _LOADED[key].unpersist()
    _LOADED[key] = m
    return m


def build_or_load(spark: SparkSession, path: str, build, rebuild: bool = False) -> NGramModel:
    """The stored model; built and saved first if there is none or ``rebuild``."""
    if rebuild or not model_exists(spark, path):
        save_model(build(), path)
        return load_model(spark, path, override=True)
    return load_model(spark, path)


def write_int_csv(df: DataFrame, path: str) -> None:
    """Headerless CSV of an int table, sorted by its columns."""
    cols = [c for c in df.columns]
    df.orderBy(*cols).write.mode("overwrite").csv(path, header=False)


def read_int_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.LongType() if c == "count" else T.IntegerType())
                           for c in columns])
    return spark.read.schema(schema).csv(path, header=False)


def table_sizes(model: NGramModel) -> DataFrame:
    """(table, rows) for the three model tables."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in (("vocab", model.vocab), ("bigrams", model.bigrams),
                              ("trigrams", model.trigrams))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
