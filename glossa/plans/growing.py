"""A model that grows with new lines, without reading the old ones again.

Every word ever seen has an id that stays: new words get the next ids.  N-gram
counts are kept over these ids, of frequent and rare words alike, in tiers
(``streaming/tiers.py``).  A block of new lines is cleaned, counted and encoded
on its own, so its work follows its size; because no id depends on the cut, a
word that crosses the cut changes which n-grams are selected and none is
encoded again.  The dictionary, the counts and the next id are published
together: a block that was cut short leaves no trace, one that is repeated is
skipped.

A model is selected from the merged integer counts: the cut on the histogram of
word counts, then semi-joins of the n-grams with the kept ids.  It equals a
build over all lines up to the numbering of the words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.counting import line_tokens, unigram_counts
from glossa.operators.encode import DEFAULT_BROADCAST_MAX_WORDS, encoded_strings, gram_strings
from glossa.operators.ranking import positions
from glossa.operators.vocabulary import cut_vocabulary
from glossa.plans.build import NGramModel, ranged, vocabulary_size
from glossa.session import materialise
from glossa.streaming.tiers import FAN, TieredCounts

WORDS = "words"


class GrowingModel:
    """Counts and dictionary below ``path``."""

    def __init__(self, spark: SparkSession, path: str, remove_words=None, fan: int = FAN,
                 broadcast_max_words: int = DEFAULT_BROADCAST_MAX_WORDS):
        self.store = TieredCounts(spark, path, fan)
        self.remove_words, self.broadcast_max_words = remove_words, broadcast_max_words

    def dictionary(self) -> DataFrame | None:
        """(word, idx) of all words so far."""
        return self.store.table(WORDS)

    def add(self, lines: DataFrame, block: int) -> bool:
        """Counts a block of new lines (doc_id, line_no, line); blocks are
        numbered upwards.  False if it is already in."""
        state = self.store.manifest()
        if block <= state["epoch"]:
            return False
        known, last = self.dictionary(), state["notes"].get("last_id", 0)
        tokens = materialise(line_tokens(lines, self.remove_words), "block-tokens")
        words = materialise(unigram_counts(tokens), "block-words")
        new = words.select("word") if known is None else words.select("word").join(known, "word", "left_anti")
        fresh = materialise(positions(new, ["word"], "_place").select("word", (F.col("_place") + last).cast("int").alias("idx")), "block-new")
        ids = fresh if known is None else known.unionByName(fresh)
        ids = ids.join(words.select("word"), "word", "left_semi")  # the words of this block alone
        n_words = words.count()
        small = n_words <= self.broadcast_max_words
        counts = words.join(F.broadcast(ids) if small else ids, "word").select(
            F.lit(1).alias("n"), F.col("idx").alias("i1"), F.lit(0).alias("i2"), F.lit(0).alias("i3"), "count")
        for n in (2, 3):
            grams = encoded_strings(gram_strings(tokens, n), ids, n, small)
            counts = counts.unionByName(grams.select(F.lit(n).alias("n"), "i1", "i2", (F.col("i3") if n == 3 else F.lit(0)).alias("i3"), "count"))
        return self.store.add(counts, block, {"last_id": last + fresh.count()}, **{WORDS: fresh})

    def model(self, cutoff: float | None = 0.9, filter_one_freq: bool = True) -> NGramModel:
        """The model of all lines so far, with the dictionary's ids."""
        counts = self.store.counts()
        if counts is None:
            raise ValueError("no lines were added")
        counts = materialise(counts, "grown-counts")
        unigrams = counts.filter("n = 1").select(F.col("i1").alias("idx"), "count")
        kept, nb = cut_vocabulary(unigrams, cutoff)
        kept = kept.join(self.dictionary(), "idx").select("idx", "word", F.col("count").cast("bigint").alias("count"), "prob")
        vocab = materialise(ranged(kept, "vocab"), "vocab")
        size, total = vocabulary_size(vocab)
        tables = []
        for n, name, columns in ((2, "bigrams", ["wi_1", "wi"]), (3, "trigrams", ["wi_2", "wi_1", "wi"])):
            grams = counts.filter((F.col("n") == n) & (F.col("count") > int(filter_one_freq))).select(
                *[F.col(f"i{k + 1}").alias(c) for k, c in enumerate(columns)], "count")
            for c in columns:
                ids = vocab.select(F.col("idx").alias(c))
                grams = grams.join(F.broadcast(ids) if size <= self.broadcast_max_words else ids, c, "left_semi")
            tables.append(materialise(ranged(grams, name), name))
        return NGramModel(vocab, *tables, int(nb or 0), size, total, dict(cutoff=cutoff, filter_one_freq=filter_one_freq), self.broadcast_max_words)
