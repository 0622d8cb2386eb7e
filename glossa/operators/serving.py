"""What a prediction reads, made once for a (model, stop list) and bucketed by
the keys it is asked for, so that a request moves its contexts and never the
model.

contexts    (u, v, w, c3, t3, c2, r2, free)   bucketed by (u, v)
    the followers of (u, v): their count and total, count and rank among the
    followers of v, and how many better ranked followers of v do not follow (u, v)
followers   (v, rank, w, c2, last)            bucketed by (v, rank)
    the followers of v by count; ``last`` is the last rank of equal counts
gaps        (v, cls, ordinal, first, length)  bucketed by (v, cls)
    runs of words that do not follow v: the words of places first, first + 1...
    in order of frequency are the unseen words number ordinal, ordinal + 1...
    of v; cls = floor(log2(ordinal))
heads       (v, n2)                           a row for each v with followers
places      (pos, w, p, last)                 the vocabulary by frequency

Followers of a frequent v are dealt out by ranges, and spread over the buckets
by their rank: no step gathers them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.ranking import group_starts, positions
from glossa.operators.vocabulary import dense_index
from glossa.session import bucketed, materialise

#: Bucket keys and order of the stored tables.
LAYOUT = {"contexts": (["u", "v"], ["u", "v", "r2"]), "followers": (["v", "rank"], ["v", "rank"]), "gaps": (["v", "cls"], ["v", "ordinal"])}
PLAIN = ("heads", "places")


@dataclass
class Serving:
    contexts: DataFrame
    followers: DataFrame
    gaps: DataFrame
    heads: DataFrame
    places: DataFrame
    n_words: int


def without(df: DataFrame, col: str, stop_idx: DataFrame | None, broadcast: bool) -> DataFrame:
    if stop_idx is None:
        return df
    s = stop_idx.select(F.col("idx").alias(col))
    return df.join(F.broadcast(s) if broadcast else s, col, "left_anti")


def vocabulary_places(model, stop_idx: DataFrame | None) -> DataFrame:
    """(pos, w, p, last) of the (filtered) vocabulary in order count desc, idx,
    with the end of each class of equal counts."""
    voc = without(model.vocab, "idx", stop_idx, model.broadcast_ok)
    ordered = dense_index(voc.select(F.col("idx").alias("w"), "count", F.col("prob").alias("p")), [F.col("count").desc(), F.col("w").asc()], "pos")
    ends = ordered.groupBy("count").agg(F.max("pos").alias("last"))
    return materialise(ordered.join(ends, "count").select("pos", "w", "p", "last"), "places")


def ranked_followers(model, stop_idx: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(followers, heads)."""
    bi = without(model.bigrams, "wi", stop_idx, model.broadcast_ok).select(
        F.col("wi_1").alias("v"), F.col("wi").alias("w"), F.col("count").alias("c2"))
    placed = positions(bi, ["v", F.desc("c2"), "w"])
    starts = materialise(group_starts(placed, ["v"]), "heads")
    ranks = placed.join(F.broadcast(starts) if model.broadcast_ok else starts, "v").select(
        "v", (F.col("place") - F.col("start") + 1).cast("int").alias("rank"), "w", "c2")
    ends = ranks.groupBy("v", "c2").agg(F.max("rank").alias("last"))
    followers = bucketed(ranks.join(ends, ["v", "c2"]).select("v", "rank", "w", "c2", "last"), "followers", *LAYOUT["followers"])
    return followers, starts.select("v", F.col("members").cast("int").alias("n2"))


def ranked_contexts(model, followers: DataFrame, stop_idx: DataFrame | None) -> DataFrame:
    """Trigrams by (u, v) with what their bigram says.  A context has at most a
    vocabulary of followers, and its rows are already in its bucket when they
    are numbered."""
    tri = model.trigrams.select(F.col("wi_2").alias("u"), F.col("wi_1").alias("v"), F.col("wi").alias("w"), F.col("count").alias("c3"))
    both = tri.join(followers.select("v", "w", "c2", F.col("rank").alias("r2")), ["v", "w"], "left" if stop_idx is not None else "inner")
    ctx = Window.partitionBy("u", "v")
    seen = both.withColumn("t3", F.sum("c3").over(ctx)).filter("r2 is not null")
    return bucketed(seen.withColumn("free", F.col("r2") - F.row_number().over(ctx.orderBy("r2"))).select(
        "u", "v", "w", "c3", "t3", "c2", "r2", "free"), "contexts", *LAYOUT["contexts"])


def unseen_gaps(model, followers: DataFrame, heads: DataFrame, places: DataFrame, n_words: int) -> DataFrame:
    """Where the words that do not follow v stand.  With the followers' places
    p_1 < p_2 < ..., p_i - i words before p_i do not follow v; followers that
    share this number stand side by side, and the next run tells how many
    words lie between.  A follower at place 0 opens each v."""
    look = F.broadcast if model.broadcast_ok else (lambda df: df)
    at = followers.select("v", "w").join(look(places.select("w", "pos")), "w").select("v", "pos").unionByName(heads.select("v", F.lit(0).alias("pos")))
    placed = positions(at, ["v", "pos"])
    starts = group_starts(placed, ["v"]).select("v", "start")
    runs = placed.join(look(starts), "v").withColumn("before", F.col("pos") - (F.col("place") - F.col("start"))).groupBy("v", "before").agg(F.max("pos").alias("stop"))
    runs = positions(runs, ["v", "before"], "run")
    after = runs.select((F.col("run") - 1).alias("run"), F.col("v").alias("v2"), F.col("before").alias("next"))
    gaps = runs.join(after, "run", "left").withColumn("length", F.when(F.col("v2") == F.col("v"), F.col("next") - F.col("before")).otherwise(
        F.lit(n_words) - F.col("stop"))).filter("length > 0")
    ordinal = F.col("before") + 1
    return bucketed(gaps.select("v", F.floor(F.log2(ordinal)).cast("int").alias("cls"), ordinal.alias("ordinal"),
                                (F.col("stop") + 1).alias("first"), "length"), "gaps", *LAYOUT["gaps"])


def build_serving(model, stop_idx: DataFrame | None = None) -> Serving:
    places = vocabulary_places(model, stop_idx)
    n_words = places.count()
    followers, heads = ranked_followers(model, stop_idx)
    heads = materialise(heads, "heads")
    return Serving(ranked_contexts(model, followers, stop_idx), followers, unseen_gaps(model, followers, heads, places, n_words), heads, places, n_words)


def serving(model, stop_idx: DataFrame | None = None, key=None) -> Serving:
    """The tables of a (model, stop list); a list without a name is not remembered."""
    if stop_idx is not None and key is None:
        return build_serving(model, stop_idx)
    return model._memo(("serving", key), lambda: build_serving(model, stop_idx))
