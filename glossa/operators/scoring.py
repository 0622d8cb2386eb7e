"""Scoring of (u, v, w) id triples against a model, as left joins plus a
``when`` chain.  NULL ids (out-of-vocabulary words) simply never match a
model row, which gives the back-off behaviour for unknown contexts.

Stupid back-off (a = .4):
  trigram seen: c3/T3; else a * bigram level
  bigram seen: c2/T2; else a * p(w); OOV target: 1/V
Katz back-off (d = .5):
  trigram seen: (c3-d)/T3; else alpha3 * q2(w|v) / denom3
  bigram seen: (c2-d)/T2; else alpha2 * p(w) / sum_{B2} p; unseen v: p(w)
  OOV target: NULL
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.context import q2_expr


def _attach(model, triples: DataFrame, level: int, katz: bool, d: float) -> DataFrame:
    bc = model.broadcast_ok
    # a NULL id never matches: as a negative one that varies by row, it does not gather in one partition either
    ids = ["u", "v", "w"] if level == 3 else ["v", "w"]
    salt = -(F.lit(1) + F.pmod(F.xxhash64(*ids, F.monotonically_increasing_id()), F.lit(1 << 20))).cast("int")
    t = triples.select("*", *[F.coalesce(c, salt).alias(f"_{c}") for c in ids])
    if level == 3:
        tri = model.trigrams.select(F.col("wi_2").alias("_u"), F.col("wi_1").alias("_v"),
                                    F.col("wi").alias("_w"), F.col("count").alias("c3"))
        t = t.join(tri, ["_u", "_v", "_w"], "left")
        if katz:
            k3 = model.katz3(d).select(F.col("wi_2").alias("_u"), F.col("wi_1").alias("_v"),
                                       "t3", "n3", "alpha3", "denom3")
        else:
            k3 = model.ctx3().select(F.col("wi_2").alias("_u"), F.col("wi_1").alias("_v"),
                                     F.col("total").alias("t3"))
        t = t.join(k3, ["_u", "_v"], "left")
    bi = model.bigrams.select(F.col("wi_1").alias("_v"), F.col("wi").alias("_w"),
                              F.col("count").alias("c2"))
    t = t.join(bi, ["_v", "_w"], "left")
    if katz:
        k2 = model.katz2(d).select(F.col("wi_1").alias("_v"), "t2", "alpha2", "unseen_mass", "s2")
    else:
        k2 = model.ctx2().select(F.col("wi_1").alias("_v"), F.col("total").alias("t2"))
    t = t.join(F.broadcast(k2) if bc else k2, "_v", "left")
    voc = model.vocab.select(F.col("idx").alias("_w"), F.col("prob").alias("p"))
    return t.join(F.broadcast(voc) if bc else voc, "_w", "left").drop(*[f"_{c}" for c in ids])


def stupid_scores(model, triples: DataFrame, a: float = 0.4, level: int = 3,
                  out: str = "score") -> DataFrame:
    """Add ``out`` to triples with id columns (u, v, w) [level 3] or (v, w)."""
    t = _attach(model, triples, level, False, 0.0)
    s2 = (F.when(F.col("c2").isNotNull(), F.col("c2") / F.col("t2"))
          .when(F.col("p").isNotNull(), F.lit(a) * F.col("p"))
          .otherwise(F.lit(1.0 / model.vocab_size)))
    s = s2 if level == 2 else F.when(F.col("c3").isNotNull(), F.col("c3") / F.col("t3")) \
        .otherwise(F.lit(a) * s2)
    drop = ["c3", "t3", "c2", "t2", "p"] if level == 3 else ["c2", "t2", "p"]
    return t.withColumn(out, s).drop(*drop)


def katz_scores(model, triples: DataFrame, d: float = 0.5, level: int = 3,
                out: str = "prob") -> DataFrame:
    t = _attach(model, triples, level, True, d)
    q2 = q2_expr(d)
    if level == 2:
        s = q2
        drop = ["c2", "t2", "alpha2", "unseen_mass", "s2", "p"]
    else:
        alpha3 = F.coalesce(F.col("alpha3"), F.lit(1.0))
        denom3 = F.coalesce(F.col("denom3"), F.col("s2"), F.lit(1.0))
        s = F.when(F.col("c3").isNotNull(), (F.col("c3") - F.lit(d)) / F.col("t3")) \
            .otherwise(alpha3 * q2 / denom3)
        drop = ["c3", "t3", "n3", "alpha3", "denom3", "c2", "t2", "alpha2", "unseen_mass", "s2", "p"]
    return t.withColumn(out, s).drop(*drop)


def candidate_scores(model, candidates: DataFrame, algo: str, d: float = 0.5, a: float = 0.4,
                     out: str = "prob") -> DataFrame:
    """(u, v, w, ``out``) for candidates that carry c3, c2 and p: only the
    constants of their contexts are looked up."""
    bc = model.broadcast_ok
    katz = algo == "katz"
    k3 = model.katz3(d) if katz else model.ctx3().withColumnRenamed("total", "t3")
    k2 = model.katz2(d) if katz else model.ctx2().withColumnRenamed("total", "t2")
    k3 = k3.select(F.col("wi_2").alias("u"), F.col("wi_1").alias("v"), "t3", *(["alpha3", "denom3"] if katz else []))
    k2 = k2.select(F.col("wi_1").alias("v"), "t2", *(["alpha2", "unseen_mass", "s2"] if katz else []))
    t = candidates.join(k3, ["u", "v"], "left").join(F.broadcast(k2) if bc else k2, "v", "left")
    if katz:
        score = F.when(F.col("c3").isNotNull(), (F.col("c3") - F.lit(d)) / F.col("t3")).otherwise(
            F.coalesce("alpha3", F.lit(1.0)) * q2_expr(d) / F.coalesce("denom3", "s2", F.lit(1.0)))
    else:
        score = F.when(F.col("c3").isNotNull(), F.col("c3") / F.col("t3")).otherwise(
            F.lit(a) * F.when(F.col("c2").isNotNull(), F.col("c2") / F.col("t2")).otherwise(F.lit(a) * F.col("p")))
    return t.select("u", "v", "w", score.alias(out))
