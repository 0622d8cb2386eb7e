"""Places in a sorted order without a window over a group.

Rows are dealt out by ranges of the whole order, so a group of any size is
spread; a row's place is its number in its range plus the sizes of the ranges
before.  The rank inside a group is the difference to the group's first place,
and a request for a rank is a join on the place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.session import materialise


def positions(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Adds ``name`` BIGINT = 1, 2, 3... following ``order`` (a total order),
    written once and sorted by it."""
    dealt = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(F.lit(0)).orderBy("_part")
    before = sizes.select("_part", (F.sum("_n").over(run) - F.col("_n")).alias("_before"))  # a row for each range
    return dealt.withColumn("_in", part).join(F.broadcast(before), F.col("_in") == F.col("_part")).withColumn(
        name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).select(*df.columns, name)


def group_starts(placed: DataFrame, group: list[str], place: str = "place") -> DataFrame:
    """(group, start, members): the first place and the number of rows of each group of a table from ``positions``."""
    return placed.groupBy(*group).agg(F.min(place).alias("start"), F.count(F.lit(1)).alias("members"))


def first_missing(df: DataFrame, group: list[str], number: str, n: int) -> DataFrame:
    """(group, missing): the ``n`` smallest numbers 1, 2, 3... that are not among the
    ``number`` of the group.

    Numbers become bits of blocks of 64, combined in the map tasks already.  What
    a block leaves free counts only if fewer than n are free before it; those
    blocks, the others up to the last of them, which hold no number, and the
    block after have all that is asked.
    """
    at = F.col(number).cast("bigint") - 1
    bits = df.select(*group, F.shiftright(at, 6).alias("_block"), F.expr(f"shiftleft(1L, cast((cast({number} as bigint) - 1) % 64 as int))").alias("_bit"))
    held = bits.groupBy(*group, "_block").agg(F.bit_or("_bit").alias("_held"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.col("_block") * 64 - F.coalesce(F.sum(F.bit_count("_held")).over(before), F.lit(0))
    free = F.expr(f"transform(slice(filter(sequence(0, 63), i -> getbit(_held, i) = 0), 1, {n}), i -> _block * 64 + i + 1)")
    near = held.withColumn("_open", open_).filter(F.col("_open") < n).withColumn("_free", free).groupBy(*group).agg(
        F.flatten(F.collect_list("_free")).alias("_free"), F.collect_list("_block").alias("_blocks"), F.max("_block").alias("_last"))
    others = f"""flatten(transform(filter(sequence(0L, _last + {n // 64 + 1}L), b -> not array_contains(_blocks, b)),
        b -> sequence(b * 64 + 1, b * 64 + {min(n, 64)})))"""
    return near.select(*group, F.expr(f"slice(sort_array(concat(_free, {others})), 1, {n})").alias("missing"))


def all_missing(n: int):
    """What ``first_missing`` would give for a group without rows."""
    return F.array(*[F.lit(t).cast("bigint") for t in range(1, n + 1)])
