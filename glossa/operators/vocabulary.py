"""Coverage cut, dense ids and vocabulary probabilities.

* The cut walks words by count (desc) until the cumulative count reaches
  ``cutoff * total`` and keeps words with a count strictly above the count
  found there.  Only the count values matter, so we walk the *histogram*
  ``(count, n_types)``: its size is bounded by the number of distinct count
  values (< sqrt(2 * tokens)), never by the vocabulary, and the walk is
  partitioned by log2(count) bucket.
* Dense ids 1..V in byte order of the word are assigned without a
  single-partition window: range-partition by the order, checkpoint (the
  partition and place of each row are then fixed, even after a retry), count
  rows per partition, and add the prefix sums of those P counts to the row's
  number in its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.session import ensure_checkpoint_dir


def count_histogram(unigrams: DataFrame, by=()) -> DataFrame:
    """([by,] count, n_types, mass) -- mass = count * n_types."""
    return (unigrams.groupBy(*by, "count").agg(F.count(F.lit(1)).alias("n_types"))
            .withColumn("mass", F.col("count") * F.col("n_types")))


def coverage_thresholds(unigrams: DataFrame, cutoffs, by=()) -> DataFrame:
    """([by,] cutoff, nb) for each cutoff: the count at which the cumulative
    count of words taken by count desc first reaches ``cutoff * total``; with
    ``by``, for each of its groups apart.

    The histogram is made once and checkpointed, so the counts are computed
    once for all cutoffs.  Its running sum is split by log2(count) bucket: each
    bucket is walked in its own window partition and shifted by the mass of
    the buckets above it (at most 64 a group).
    """
    cutoffs, by = [float(c) for c in cutoffs], list(by)
    if not all(0.0 < c <= 1.0 for c in cutoffs):
        raise ValueError("cutoff must be in (0, 1]")
    ensure_checkpoint_dir(unigrams.sparkSession)
    hist = count_histogram(unigrams, by).withColumn("_b", F.floor(F.log2("count")).cast("int")).checkpoint(eager=True)
    masses = hist.groupBy(*by, "_b").agg(F.sum("mass").alias("_m"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    shifts = masses.select(*by, "_b", (F.sum("_m").over(group.orderBy(F.desc("_b"))) - F.col("_m")).alias("_above"), F.sum("_m").over(group).alias("_total"))
    w_run = Window.partitionBy(*by, "_b").orderBy(F.col("count").desc()).rowsBetween(Window.unboundedPreceding, 0)
    walked = hist.withColumn("running", F.sum("mass").over(w_run)).join(shifts, [*by, "_b"]).withColumn("running", F.col("running") + F.col("_above"))
    each = walked.select("*", F.explode(F.array(*[F.lit(c) for c in cutoffs])).alias("cutoff"))
    return (each.filter(F.col("running") >= F.col("cutoff") * F.col("_total").cast("double"))
            .groupBy(*by, "cutoff").agg(F.max("count").cast("bigint").alias("nb")))


def coverage_threshold(unigrams: DataFrame, cutoff: float) -> DataFrame:
    """One row ``(cutoff, nb)``."""
    return coverage_thresholds(unigrams, [cutoff])


def dense_index(df: DataFrame, order: list[Column], name: str = "idx",
                partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1..N following ``order`` (must be a total order).

    Range partitioning splits the rows evenly (no hot key can form: the order
    is unique) and each partition is sorted; the checkpoint fixes both.  The
    place of a row is then its number within the partition, which Spark's
    increasing id holds in its lower 33 bits, plus the sizes of the partitions
    before: P numbers, no second shuffle.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(p, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    placed = ranged.withColumn("_mid", F.monotonically_increasing_id())
    pid = F.shiftright("_mid", 33).cast("int")
    sizes = {r["_pid"]: r["_n"] for r in placed.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n")).collect()}
    offsets, acc = [], 0
    for i in range(max(sizes, default=-1) + 1):
        offsets.append(acc)
        acc += sizes.get(i, 0)
    base = F.element_at(F.array(*[F.lit(o).cast("bigint") for o in offsets or [0]]), pid + 1)
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, (local + base + 1).cast("int")).drop("_mid")


def cut_vocabulary(unigrams: DataFrame, cutoff: float | None) -> tuple[DataFrame, int]:
    """Words with count > nb and their probability count / sum(kept counts);
    ``cutoff=None`` keeps every word (nb = 0).

    ``nb`` is one number found on the histogram; the kept total is a scalar
    subquery (no cross join).  Returns (kept(word, count, prob), nb).
    """
    if cutoff is None:
        nb = 0
    else:
        nb = coverage_threshold(unigrams, cutoff).first()["nb"]
        nb = int(nb) if nb is not None else 0
    kept = unigrams.filter(F.col("count") > F.lit(nb))
    total = kept.agg(F.sum("count")).scalar()
    kept = kept.withColumn("prob", F.col("count").cast("double") / total.cast("double"))
    return kept, nb


def build_vocabulary(unigrams: DataFrame, cutoff: float | None = 0.9,
                     partitions: int | None = None, with_nb: bool = False):
    """(idx INT, word, count BIGINT, prob DOUBLE), ids in byte order of word
    (and the cut count ``nb`` when ``with_nb``)."""
    kept, nb = cut_vocabulary(unigrams, cutoff)
    vocab = dense_index(kept, [F.col("word")], "idx", partitions)
    vocab = vocab.select("idx", "word", F.col("count").cast("bigint").alias("count"), "prob")
    return (vocab, nb) if with_nb else vocab
