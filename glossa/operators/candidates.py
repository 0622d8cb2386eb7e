"""Pruned candidate words for top-k prediction, exact (ties included).

For a context (u, v) every word outside A3(u,v) scores a positive constant
times its bigram-level score q(w|v), and every word outside A2(v) a constant
times p(w).  Hence a word of the top k (rank <= k, ties kept) is
  * in A3(u,v); or
  * one of the first k words of A2(v), by count, that are not in A3(u,v), or
    tied with the k-th; or
  * one of the first k words outside A2(v), by p, or tied with the k-th (A3 is
    a subset of A2).
Scoring only these candidates and ranking them per context gives exactly the
dense answer: every word of the answer is a candidate, and each one that is
not keeps more than k better candidates.

Each list is stored in its order (``serving.py``), so a request knows from
counts how deep it has to read and looks the ranks up by equality:
  * A3: the context's own rows.
  * A2: the k-th word not in A3 has rank k + #{rows of A3 with fewer than k
    free ranks before them}; the ranks up to the end of its tie are read.
  * unseen words: the k-th one lies in the gap with the largest ordinal <= k;
    the gaps up to the end of its tie are read.
Candidates carry their evidence (c3, c2, p), so scoring needs the context
constants only.  Nothing is sorted or gathered by v, and the stored tables are
bucketed by the keys of these joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.serving import serving


def prediction_candidates(model, contexts: DataFrame, k: int, stop_idx: DataFrame | None = None,
                          stop_key=None) -> DataFrame:
    """(u, v, w, c3, c2, p) candidates of the distinct contexts (u, v); OOV ids
    are 0.  Counts are null where the word was not found at that level."""
    s = serving(model, stop_idx, stop_key)
    look = F.broadcast if model.broadcast_ok else (lambda df: df)
    c = contexts.select("u", "v").distinct()
    none = F.lit(None)

    a3 = c.join(s.contexts, ["u", "v"])
    held = a3.filter(F.col("free") < k).groupBy("u", "v").agg(F.count(F.lit(1)).alias("held"))
    depth = c.join(look(s.heads), "v").join(held, ["u", "v"], "left").select(
        "u", "v", F.least(F.lit(k) + F.coalesce("held", F.lit(0)), "n2").cast("int").alias("rank"))
    ends = depth.join(s.followers.select("v", "rank", "last"), ["v", "rank"])
    a2 = ends.select("u", "v", F.explode(F.sequence(F.lit(1), "last")).alias("rank")).join(s.followers.select("v", "rank", "w", "c2"), ["v", "rank"])

    vs = c.select("v").distinct().join(look(s.heads), "v", "left")
    near = vs.select("v", F.explode(F.sequence(F.lit(0), F.lit(k.bit_length() - 1))).alias("cls"))
    kth = near.join(s.gaps, ["v", "cls"]).filter(F.col("ordinal") <= k).groupBy("v").agg(F.max(F.struct("ordinal", "first")).alias("g"))
    # no gap: all words follow v; no followers: one gap from the first word on
    kth = vs.join(kth, "v", "left").filter("g is not null or n2 is null").select("v", "n2", F.least(
        F.coalesce(F.col("g.first") + (F.lit(k) - F.col("g.ordinal")), F.lit(k)), F.lit(s.n_words)).cast("int").alias("pos"))
    tie = kth.join(look(s.places.select("pos", "last")), "pos")
    wide = tie.filter("n2 is not null").select("v", "last", F.explode(F.sequence(F.lit(0), F.floor(F.log2("last")).cast("int"))).alias("cls"))
    runs = wide.join(s.gaps, ["v", "cls"]).filter("first <= last").select("v", "first", F.least(F.col("first") + F.col("length") - 1, "last").alias("stop"))
    runs = runs.unionByName(tie.filter("n2 is null").select("v", F.lit(1).cast("bigint").alias("first"), F.col("last").cast("bigint").alias("stop")))
    uk = runs.select("v", F.explode(F.sequence(F.col("first").cast("int"), F.col("stop").cast("int"))).alias("pos")).join(look(s.places.select("pos", "w", "p")), "pos")

    parts = [a3.select("u", "v", "w", "c3", none.cast("bigint").alias("c2"), none.cast("double").alias("p")),
             a2.select("u", "v", "w", none.cast("bigint").alias("c3"), "c2", none.cast("double").alias("p")),
             c.join(uk, "v").select("u", "v", "w", none.cast("bigint").alias("c3"), none.cast("bigint").alias("c2"), "p")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition("u", "v")  # one exchange for merging and ranking
    return out.groupBy("u", "v", "w").agg(F.max("c3").alias("c3"), F.max("c2").alias("c2"), F.max("p").alias("p"))
