"""Structured Streaming forms of batch jobs.

* Incremental n-gram counts: each micro-batch of new lines is cleaned and
  counted on its own and added to a store merged in tiers (``tiers.py``): the
  work of a batch follows its size, and reading touches a logarithm of the
  batches.
* Windowed n-gram counts: a stateful aggregate by event time, with a watermark
  for late lines; each batch emits the counts that changed.  What is counted
  is the longest n-gram at each position: one row of state, not one an order;
  shorter ones are sums over those that start with them, made when read.
* Prediction per arriving phrase batch: the batch ``predict`` plan against
  the static model tables.

A micro-batch that is retried replaces its own output, and a stream that is
started again with the same ``checkpoint`` goes on where it ended.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.counting import UNFOLDED, line_tokens, ngram_counts, terms_with_order
from glossa.operators.suffixes import line_suffixes
from glossa.plans.predict import predict
from glossa.sources.corpus import document_lines
from glossa.streaming.tiers import FAN, TieredCounts


def document_line_stream(spark: SparkSession, folder: str, table: str = "documents",
                         lang: str | None = "en", max_files_per_trigger: int | None = None,
                         schema=None) -> DataFrame:
    """Stream the parquet files of one table in ``folder`` as text lines."""
    return document_lines(table_stream(spark, folder, table, max_files_per_trigger, schema), lang)


def table_stream(spark: SparkSession, folder: str, table: str, max_files_per_trigger: int | None = None, schema=None) -> DataFrame:
    """Stream the rows of ``folder/table*.parquet``; each may be one file or a folder of files."""
    folder = folder.rstrip("/")
    if schema is None:
        schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(f"{folder}/{table}*.parquet")


#: Keeps state on the executors' disks; the default keeps every row of it in their memory.  A batch
#: saves its changes, not all files of the state, which is packed in large blocks.
ROCKSDB = "spark.sql.streaming.stateStore.rocksdb"
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{ROCKSDB}.changelogCheckpointing.enabled": "true",
    f"{ROCKSDB}.compression": "zstd",
    f"{ROCKSDB}.blockSizeKB": "64",
    f"{ROCKSDB}.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
}


def run_available(stream: DataFrame, checkpoint: str, each_batch, mode: str = "append") -> None:
    """Process everything that is available and new since ``checkpoint`` with
    ``each_batch(batch, epoch)``."""
    q = (stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
         .foreachBatch(each_batch).trigger(availableNow=True).start())
    q.awaitTermination()


def _by_epoch(out: str, rows=lambda b: b):
    """Writes ``rows(batch)`` to ``out/epoch=<n>``, in place of what an earlier try left."""
    return lambda batch, epoch: rows(batch).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/epoch={epoch}")


def stream_ngram_counts(lines: DataFrame, out: str, checkpoint: str, orders=(1, 2, 3), fan: int = FAN) -> DataFrame:
    """Runs the stream and returns the merged (n, term, count) of all batches so far."""
    store = TieredCounts(lines.sparkSession, out, fan)
    run_available(lines, checkpoint, lambda b, epoch: store.add(ngram_counts(line_tokens(b), orders), epoch))
    return merged_counts(lines.sparkSession, out)


def merged_counts(spark: SparkSession, out: str) -> DataFrame:
    found = TieredCounts(spark, out).counts()
    return spark.createDataFrame([], "n int, term string, count bigint") if found is None else found


def windowed_ngram_counts(lines: DataFrame, time_col: str, width: str, orders=(1, 2, 3)) -> DataFrame:
    """(start, n, term, count) by event-time window; for a batch or a stream of lines (doc_id, line_no, line, time)."""
    tokens = line_tokens(lines, keep=(time_col,))
    grams = tokens.select(F.window(time_col, width).alias("w"), F.explode(terms_with_order(orders)).alias("g"))
    return grams.groupBy("w", F.col("g.n").alias("n"), F.col("g.term").alias("term")).agg(F.count(F.lit(1)).alias("count")).select(
        F.col("w.start").alias("start"), "n", "term", "count")


def windowed_suffix_counts(lines: DataFrame, time_col: str, width: str, longest: int) -> DataFrame:
    """(start, w1, rest, count) by event-time window: the n-gram of ``longest`` words, or
    what is left of the line, that starts at each position."""
    at = line_suffixes(line_tokens(lines, keep=(time_col,)), longest, (time_col,))
    return at.groupBy(F.window(time_col, width).alias("w"), "w1", "rest").agg(F.count(F.lit(1)).alias("count")).select(
        F.col("w.start").alias("start"), "w1", "rest", "count")


def ngrams_of_changes(changes: DataFrame, orders=(1, 2, 3)) -> DataFrame:
    """(start, n, term, count) of the newest counts among ``changes`` (start, w1, rest, count, epoch).
    These are dealt once, by the first two words: longer n-grams are summed where they lie, and of
    single words one row a part is sent on."""
    second = F.substring_index("rest", " ", 1)
    parts = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = changes.select("start", "w1", "rest", "count", "epoch").repartition(UNFOLDED * parts, "start", "w1", second)
    newest = dealt.groupBy("start", "w1", second.alias("w2"), "rest").agg(F.max_by("count", "epoch").alias("count"))
    total = F.sum("count").cast("bigint").alias("count")
    words = F.size(F.split("rest", " ")) + 1  # null at the end of the line
    longer = [F.when(words >= n, F.struct(F.lit(n).alias("n"), F.substring_index("rest", " ", n - 1).alias("head"))) for n in orders if n > 1]
    found = [newest.groupBy("start", F.lit(1).alias("n"), F.col("w1").alias("term")).agg(total)] if 1 in orders else []
    if longer:
        cells = newest.select("start", "w1", "w2", "count", F.explode(F.array(*longer)).alias("h")).filter("h is not null")
        sums = cells.groupBy("start", "w1", "w2", F.col("h.n").alias("n"), F.col("h.head").alias("head")).agg(total)
        found.append(sums.select("start", "n", F.concat_ws(" ", "w1", "head").alias("term"), "count"))
    return reduce(DataFrame.unionByName, found)


def stream_windowed_counts(lines: DataFrame, time_col: str, out: str, checkpoint: str, width: str = "1 hour",
                           watermark: str = "2 hours", orders=(1, 2, 3)) -> DataFrame:
    """Runs the stateful count and returns the newest count of every window and
    term.  Totals live in the state store; a window is dropped from it, and
    lines that come later are left out, once the watermark has passed it."""
    counts = windowed_suffix_counts(lines.withWatermark(time_col, watermark), time_col, width, max(orders))
    conf = lines.sparkSession.conf
    before = {name: conf.get(name, None) for name in STATE_ON_DISK}
    for name, value in STATE_ON_DISK.items():
        conf.set(name, value)
    try:
        # sorted: alike rows side by side take a fraction of the room, here and where they are dealt again
        run_available(counts, checkpoint, _by_epoch(out, lambda b: b.sortWithinPartitions("start", "w1", "rest")), "update")
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    return ngrams_of_changes(lines.sparkSession.read.parquet(out), orders)


def stream_predictions(model, phrases: DataFrame, out: str, checkpoint: str, algo: str = "katz",
                       k: int = 10, **kw) -> DataFrame:
    """Runs the stream and returns the predictions of all batches so far."""
    run_available(phrases, checkpoint, _by_epoch(out, lambda b: predict(model, b, algo, k, **kw)))
    return phrases.sparkSession.read.parquet(out).drop("epoch")
