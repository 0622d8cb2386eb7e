"""Dictionary encoding of n-grams and counting of id tuples.

Two plans give the same tables:

* **broadcast** (vocabulary below a checked size): every token is one row with
  the two words after it, encoded by broadcast hash joins *before* counting.
  OOV n-grams drop out in the map stage and the shuffle carries int keys only;
  bigrams are sums of the counted rows.
* **shuffle** (vocabulary too large to broadcast): a Bloom filter of the
  vocabulary drops most n-grams with unknown words in the map stage
  (``membership.py``); the others are counted as strings (partial aggregation),
  each order apart, then each word position is encoded with a shuffle join on
  the distinct n-grams, which removes what the filter let through.

In both plans an n-gram with any out-of-vocabulary word is dropped whole;
token positions are never compacted, so no false neighbours appear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators.membership import WordFilter, word_filter, word_hash
from glossa.session import materialise

DEFAULT_BROADCAST_MAX_WORDS = 2_000_000


def _gram_structs(tokens: str, n: int) -> Column:
    t = F.col(tokens)
    fields = lambda i: [F.lit(n).alias("n"), F.get(t, i).alias("w1"), F.get(t, i + 1).alias("w2"),
                        (F.get(t, i + 2) if n == 3 else F.lit(None).cast("string")).alias("w3")]
    grams = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.struct(*fields(i)))
    empty = F.array().cast("array<struct<n:int,w1:string,w2:string,w3:string>>")
    return F.when(F.size(t) >= n, grams).otherwise(empty)


def gram_occurrences(tokens: DataFrame, orders=(2, 3), keep=()) -> DataFrame:
    """(n, w1, w2, w3) and the columns ``keep`` per occurrence; w3 is NULL for bigrams."""
    arr = F.concat(*[_gram_structs("tokens", n) for n in orders]) if len(orders) > 1 \
        else _gram_structs("tokens", orders[0])
    g = tokens.select(*keep, F.explode(arr).alias("g"))
    return g.select(*keep, F.col("g.n").cast("int").alias("n"), "g.w1", "g.w2", "g.w3")


def followed_words(tokens: DataFrame, n: int, keep=()) -> DataFrame:
    """(w1..wn) and the columns ``keep``: a row for each token, with the words
    after it in its line (NULL beyond the end)."""
    at = tokens.select(*keep, "tokens", F.posexplode("tokens").alias("pos", "w1"))
    return at.select(*keep, "w1", *[F.get("tokens", F.col("pos") + i).alias(f"w{i + 1}") for i in range(1, n)])


def hashed_occurrences(tokens: DataFrame, n: int, keep=()) -> DataFrame:
    """(w1..wn, h1..hn) and the columns ``keep`` per occurrence of one order.  A
    word is hashed once, where the lines are, for all n-grams that hold it and
    all bits that are asked of a filter."""
    t, h, parts = F.col("tokens"), F.col("_hashes"), range(n)
    grams = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.struct(
        *[F.get(t, i + k).alias(f"w{k + 1}") for k in parts], *[F.get(h, i + k).alias(f"h{k + 1}") for k in parts]))
    lines = tokens.filter(F.size(t) >= n).select(*keep, "tokens", F.transform(t, word_hash).alias("_hashes"))
    return lines.select(*keep, F.explode(grams).alias("g")).select(*keep, "g.*")


def _lookup(vocab: DataFrame, word_col: str, id_col: str, broadcast: bool) -> DataFrame:
    v = vocab.select(F.col("word").alias(word_col), F.col("idx").alias(id_col))
    return F.broadcast(v) if broadcast else v


def encoded_gram_counts(tokens: DataFrame, vocab: DataFrame, broadcast: bool,
                        orders=(2, 3)) -> DataFrame:
    """(n, i1, i2, i3, count) of in-vocabulary n-grams (i3 NULL for n=2), both
    orders from one pass with a broadcast vocabulary, whose counts are written."""
    if not broadcast:
        known = word_filter(vocab, vocab.count())
        parts = [encoded_strings(gram_strings(tokens, n, known=known), vocab, n).select(
            F.lit(n).alias("n"), "i1", "i2", (F.col("i3") if n == 3 else F.lit(None).cast("int")).alias("i3"), "count") for n in orders]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out
    longest = max(orders)
    enc = followed_words(tokens, longest)
    for i in range(1, longest + 1):
        enc = enc.join(_lookup(vocab, f"w{i}", f"i{i}", True), f"w{i}", "left" if i > min(orders) else "inner")
    counts = enc.groupBy(*[f"i{i}" for i in range(1, longest + 1)]).agg(F.count(F.lit(1)).alias("count"))
    if len(orders) > 1:  # a bigram is counted with each word after it, and with none
        counts = materialise(counts, "followed-counts")
    parts = []
    for n in orders:
        ids = [f"i{i}" for i in range(1, n + 1)]
        own = counts.filter(F.col(ids[-1]).isNotNull()) if n == longest else counts.groupBy(*ids).agg(F.sum("count").alias("count"))
        parts.append(own.select(F.lit(n).alias("n"), "i1", "i2", (F.col("i3") if n == 3 else F.lit(None).cast("int")).alias("i3"), "count"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def gram_strings(tokens: DataFrame, n: int, keep=(), counts=None, known: WordFilter | None = None) -> DataFrame:
    """(w1, w2[, w3], count) of the n-grams of one order; ``counts`` may be
    other aggregates, over the columns ``keep`` of the lines.  ``known`` leaves
    out n-grams with a word that is certainly not in the vocabulary."""
    words = [f"w{i + 1}" for i in range(n)]
    grams = known.may_hold(hashed_occurrences(tokens, n, keep), [f"h{i + 1}" for i in range(n)]) if known else gram_occurrences(tokens, (n,), keep)
    return grams.groupBy(*words).agg(*(counts or [F.count(F.lit(1)).alias("count")]))


def encoded_strings(strings: DataFrame, vocab: DataFrame, n: int, broadcast: bool = False) -> DataFrame:
    """Counted n-grams with a word id i1..in for each position; those with a
    word outside the vocabulary drop out.  Every join key is a word, never a
    null, and frequent words are split by the skew join."""
    for i in range(n):
        strings = strings.join(_lookup(vocab, f"w{i + 1}", f"i{i + 1}", broadcast), f"w{i + 1}")
    return strings


def gram_tables(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bigram (wi_1, wi, count) and trigram (wi_2, wi_1, wi, count) tables."""
    bigrams = counts.filter(F.col("n") == 2).select(
        F.col("i1").alias("wi_1"), F.col("i2").alias("wi"), F.col("count").cast("bigint").alias("count"))
    trigrams = counts.filter(F.col("n") == 3).select(
        F.col("i1").alias("wi_2"), F.col("i2").alias("wi_1"), F.col("i3").alias("wi"),
        F.col("count").cast("bigint").alias("count"))
    return bigrams, trigrams


def encode_terms(terms: DataFrame, vocab: DataFrame, n: int, term_col: str = "term",
                 broadcast: bool = False, how: str = "left") -> DataFrame:
    """Split space-joined n-gram terms and look up each word's id (NULL for
    OOV with ``how='left'``).  Adds id columns wi_2/wi_1/wi (trigram) or
    wi_1/wi (bigram)."""
    names = {1: ["wi"], 2: ["wi_1", "wi"], 3: ["wi_2", "wi_1", "wi"]}[n]
    parts = F.split(F.col(term_col), " ")
    df = terms.select("*", *[F.get(parts, j).alias(f"_w{j}") for j in range(n)])
    for j, name in enumerate(names):
        df = df.join(_lookup(vocab, f"_w{j}", name, broadcast), f"_w{j}", how)
    return df.drop(*[f"_w{j}" for j in range(n)])


def decode_ids(df: DataFrame, vocab: DataFrame, id_cols: list[str], out: str = "term",
               broadcast: bool = False) -> DataFrame:
    """Join each id column to its word and paste them with spaces."""
    tmp = df
    for j, c in enumerate(id_cols):
        look = vocab.select(F.col("idx").alias(c), F.col("word").alias(f"_d{j}"))
        tmp = tmp.join(F.broadcast(look) if broadcast else look, c, "left")
    return tmp.withColumn(out, F.concat_ws(" ", *[F.col(f"_d{j}") for j in range(len(id_cols))])) \
              .drop(*[f"_d{j}" for j in range(len(id_cols))])
