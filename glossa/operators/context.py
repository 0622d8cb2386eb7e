"""Per-context constants, computed once per model by aggregation.

Notation: c2(v,w), c3(u,v,w) kept counts; T2(v) = sum_w c2(v,w);
T3(u,v) = sum_w c3(u,v,w); A2(v), A3(u,v) words seen after the context;
B = the rest of the vocabulary; p(w) = count(w) / N.

* Katz left-over mass: alpha = 1 - sum_{A}(c - d)/T = d * |A| / T (exact
  algebra, no per-word loop); 1 for an unseen context.
* Unseen bigram mass sum_{B2(v)} p = (N - sum_{A2(v)} count(w)) / N, from
  integer counts (no cancellation), instead of a sum over B2.
* Trigram denominator sum_{B3(u,v)} q2(x|v) = S2(v) - sum_{A3(u,v)} q2(x|v),
  where S2(v) = sum over the vocabulary of q2(.|v) = 1, or 1 - alpha2(v)
  when every vocabulary word follows v (B2 empty).  A3 is a subset of A2, so
  with integer sums it is ((T2 - sum_{A3} c2) - d (n2 - n3)) / T2, plus alpha2
  unless B2 is empty.  Trigrams are stored with the count of their bigram and
  in buckets of their context, so this is one aggregate without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def context_totals_2(bigrams: DataFrame) -> DataFrame:
    """(wi_1, total, n_followers)."""
    return bigrams.groupBy("wi_1").agg(F.sum("count").cast("bigint").alias("total"),
                                       F.count(F.lit(1)).alias("n_followers"))


def context_totals_3(contexts: DataFrame) -> DataFrame:
    """(wi_2, wi_1, total, n_followers) of trigrams (u, v, w, c3)."""
    return contexts.groupBy(F.col("u").alias("wi_2"), F.col("v").alias("wi_1")).agg(
        F.sum("c3").cast("bigint").alias("total"), F.count(F.lit(1)).alias("n_followers"))


def katz_bigram_constants(bigrams: DataFrame, vocab: DataFrame, vocab_size: int,
                          vocab_total: int, d: float = 0.5, broadcast_vocab: bool = False) -> DataFrame:
    """(wi_1, t2, n2, alpha2, seen_mass, unseen_mass, s2) per seen context v."""
    v = vocab.select(F.col("idx").alias("wi"), F.col("count").alias("ucount"))
    seen = bigrams.join(F.broadcast(v) if broadcast_vocab else v, "wi")
    agg = seen.groupBy("wi_1").agg(
        F.sum("count").cast("bigint").alias("t2"),
        F.count(F.lit(1)).alias("n2"),
        F.sum("ucount").cast("bigint").alias("seen_count"))
    n = F.lit(float(vocab_total))
    alpha2 = F.lit(d) * F.col("n2") / F.col("t2")
    return agg.select(
        "wi_1", "t2", "n2",
        alpha2.alias("alpha2"),
        (F.col("seen_count") / n).alias("seen_mass"),
        ((n - F.col("seen_count")) / n).alias("unseen_mass"),
        F.when(F.col("n2") < F.lit(vocab_size), F.lit(1.0)).otherwise(1.0 - alpha2).alias("s2"))


def q2_expr(d: float) -> F.Column:
    """Katz bigram probability from joined columns c2, t2, alpha2,
    unseen_mass (context constants NULL when v is unseen) and p."""
    return (F.when(F.col("c2").isNotNull(), (F.col("c2") - F.lit(d)) / F.col("t2"))
            .when(F.col("t2").isNotNull(), F.col("alpha2") * F.col("p") / F.col("unseen_mass"))
            .otherwise(F.col("p")))


def katz_trigram_constants(contexts: DataFrame, k2: DataFrame, vocab_size: int, d: float = 0.5, broadcast: bool = False) -> DataFrame:
    """(wi_2, wi_1, t3, n3, alpha3, denom3) per seen context, from trigrams that
    carry the count of their bigram (u, v, w, c3, c2)."""
    agg = contexts.groupBy("u", "v").agg(
        F.sum("c3").cast("bigint").alias("t3"),
        F.count(F.lit(1)).alias("n3"),
        F.sum("c2").cast("bigint").alias("a3_c2")).withColumnsRenamed({"u": "wi_2", "v": "wi_1"})
    k = k2.select("wi_1", "t2", "n2", "alpha2")
    t = agg.join(F.broadcast(k) if broadcast else k, "wi_1", "left")
    seen = ((F.col("t2") - F.col("a3_c2")) - F.lit(d) * (F.col("n2") - F.col("n3"))) / F.col("t2")
    return t.select("wi_2", "wi_1", "t3", "n3", (F.lit(d) * F.col("n3") / F.col("t3")).alias("alpha3"),
                    (seen + F.when(F.col("n2") < F.lit(vocab_size), F.col("alpha2")).otherwise(F.lit(0.0))).alias("denom3"))
