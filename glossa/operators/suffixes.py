"""Counts of all orders from one shuffle of suffixes.

Each position of a line ships one row: its word and the words behind it, up to
the largest order.  Rows are dealt by the first word; the n-grams of every
order that start with a word then lie together, and are read off the suffixes
as counts of their prefixes, order by order, without another exchange.

Frequent words are spread: for words whose share in a sample of the lines is
large, the second word takes part in the dealing (orders from 2 on are still
complete where they lie), and for frequent pairs the line does, in which case
the few sums that remain are merged.  The sample decides where rows go, never
what is counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.counting import UNFOLDED

#: Parts over which a frequent word or pair is spread, and the salt of a word that is not.
SPREAD = 64
#: A share of the positions above 1 / (HOT x partitions) is frequent.
HOT = 8
#: Salt of a pair that is spread by line.
BY_LINE = -1
#: Steps of a share of the lines.
SHARES = 1_000_000


def line_suffixes(tokens: DataFrame, longest: int, keep=()) -> DataFrame:
    """(w1, rest, behind[, keep]): one row a position; ``rest`` holds up to ``longest`` - 1
    words after it, ``behind`` of them, joined by a space (null at the end of the line)."""
    # outer: else Spark asks for lines with words below the cleaning, and so cleans them twice
    at = tokens.select(*keep, "tokens", F.posexplode_outer("tokens").alias("pos", "w1")).filter("pos is not null")
    behind = F.least(F.size("tokens") - F.col("pos") - 1, F.lit(longest - 1))
    rest = F.concat_ws(" ", *[F.get("tokens", F.col("pos") + i) for i in range(1, longest)])
    return at.select(*keep, "w1", F.when(behind > 0, rest).alias("rest"), behind.alias("behind"))


def frequent_starts(tokens: DataFrame, sample: float, partitions: int) -> tuple[list[str], list[tuple[str, str]]]:
    """Words and pairs that hold more than their share of a sample (a bounded number of each).
    Lines are drawn by their keys, so the others are not cleaned; one job counts it all."""
    drawn = F.pmod(F.xxhash64(F.lit(7), "doc_id", "line_no"), F.lit(SHARES)) < round(sample * SHARES)
    some = line_suffixes(tokens.filter(drawn), 2).rollup("w1", "rest").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    # the sum, and at most HOT x partitions words and pairs, come before all others
    rows = some.orderBy(F.desc("n")).limit(2 * HOT * partitions + 1).collect()
    least = max([2, *[r["n"] // (HOT * partitions) for r in rows if r["g"] == 3]])
    return ([r["w1"] for r in rows if r["g"] == 1 and r["n"] > least],
            [(r["w1"], r["rest"]) for r in rows if r["g"] == 0 and r["n"] > least and r["rest"] is not None])


def suffix_counts(tokens: DataFrame, orders=(1, 2, 3, 4), sample: float = 0.01, partitions: int | None = None) -> DataFrame:
    """(n, term, count) over all lines (doc_id, line_no, tokens).  Suffixes
    unfold behind their exchange, hence more parts than usual."""
    spark = tokens.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    words, pairs = frequent_starts(tokens, sample, p)
    rows = line_suffixes(tokens, max(orders), ("doc_id", "line_no"))
    second = F.substring_index("rest", " ", 1)
    salt = F.when(F.col("w1").isin(words), F.pmod(F.hash(second), F.lit(SPREAD))) if words else F.lit(None).cast("int")
    if pairs:
        by_line = F.concat_ws(" ", "w1", second).isin([" ".join(x) for x in pairs]) & F.col("rest").isNotNull()
        salt = F.when(by_line, BY_LINE - F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(SPREAD)).cast("int")).otherwise(salt)
    dealt = rows.select("w1", F.coalesce(salt, F.lit(SPREAD)).cast("int").alias("salt"), "rest", "behind").repartition(UNFOLDED * p, "w1", "salt")
    head = lambda n: F.lit(None).cast("string") if n == 1 else F.col("rest") if n == max(orders) else F.substring_index("rest", " ", n - 1)
    heads = F.array(*[F.when(F.col("behind") >= n - 1, F.struct(F.lit(n).alias("n"), head(n).alias("head"))) for n in orders])
    cells = lambda some: some.select("w1", "salt", F.explode(heads).alias("h")).filter("h is not null")
    # below 0: single words that are spread, and pairs dealt by line.  One number of both, since a condition
    # on the salt alone would be moved below the exchange, which the two branches share
    open_ = F.least(F.col("h.n") - 2 + (F.col("salt") == SPREAD).cast("int"), F.col("salt") - BY_LINE - 1)
    n, term, count = F.col("h.n").alias("n"), F.concat_ws(" ", "w1", "head").alias("term"), F.count(F.lit(1)).alias("count")
    whole = cells(dealt).filter(open_ >= 0).groupBy("w1", "salt", n, F.col("h.head").alias("head")).agg(count).select("n", term, "count")
    spread = dealt.filter(F.when(F.spark_partition_id() >= 0, F.col("salt") < SPREAD))  # asked behind the exchange, by way of the part's number
    parts = cells(spread).filter(open_ < 0).select(n, F.concat_ws(" ", "w1", "h.head").alias("term")).groupBy("n", "term").agg(count)
    return whole.unionByName(parts)
