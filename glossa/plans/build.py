"""Model build: sample -> clean -> tokens -> unigram counts -> coverage cut ->
dense ids -> encoded bigram/trigram counts -> model tables.

The build is an eager "fit".  Unigram counts, vocabulary and n-gram tables
are written as Parquet into the shared folder, the n-grams range-partitioned
and sorted by their context, so every later query starts from materialised
int tables, prunes them by context, and never re-reads the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators import context as ctx
from glossa.operators.counting import line_tokens, unigram_counts
from glossa.operators.encode import DEFAULT_BROADCAST_MAX_WORDS, encoded_gram_counts, gram_tables
from glossa.operators.split import (DEFAULT_PROP, DEFAULT_SEED, sample_blocks, train_lines,
                                    with_blocks)
from glossa.operators.serving import serving
from glossa.operators.vocabulary import build_vocabulary
from glossa.session import bucketed, ensure_checkpoint_dir, materialise

#: Order of the rows of each table; n-grams are range-partitioned by all of it, so that a frequent word is split.
SORT_KEYS = {"vocab": ["idx"], "bigrams": ["wi_1", "wi"], "trigrams": ["wi_2", "wi_1", "wi"]}


def ranged(df: DataFrame, name: str) -> DataFrame:
    keys = SORT_KEYS[name]
    p = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(p, *keys).sortWithinPartitions(*keys)


@dataclass
class NGramModel:
    vocab: DataFrame       # idx INT, word STRING, count BIGINT, prob DOUBLE
    bigrams: DataFrame     # wi_1 INT, wi INT, count BIGINT
    trigrams: DataFrame    # wi_2 INT, wi_1 INT, wi INT, count BIGINT
    nb: int
    vocab_size: int
    vocab_total: int
    params: dict = field(default_factory=dict)
    broadcast_max_words: int = DEFAULT_BROADCAST_MAX_WORDS
    lease: str | None = None
    _cache: dict = field(default_factory=dict, repr=False)

    @property
    def broadcast_ok(self) -> bool:
        """Vocabulary-sized tables (vocab, per-v constants) are broadcast only
        below a checked row count."""
        return self.vocab_size <= self.broadcast_max_words

    def _memo(self, key, fn):
        if key not in self._cache:
            self._cache[key] = fn()
        return self._cache[key]

    def ctx2(self) -> DataFrame:
        return self._memo("ctx2", lambda: materialise(ctx.context_totals_2(self.bigrams), "totals-2"))

    def by_context(self) -> DataFrame:
        """Trigrams (u, v, w, c3, t3, c2, ...) in buckets of their context."""
        return serving(self).contexts

    def ctx3(self) -> DataFrame:
        """Read off the buckets of ``by_context``, without a shuffle."""
        return ctx.context_totals_3(self.by_context())

    def katz2(self, d: float = 0.5) -> DataFrame:
        return self._memo(("katz2", d), lambda: materialise(ctx.katz_bigram_constants(
            self.bigrams, self.vocab, self.vocab_size, self.vocab_total, d, self.broadcast_ok), "katz-2"))

    def katz3(self, d: float = 0.5) -> DataFrame:
        """Kept in the same buckets as ``by_context``."""
        return self._memo(("katz3", d), lambda: bucketed(ctx.katz_trigram_constants(
            self.by_context(), self.katz2(d), self.vocab_size, d, self.broadcast_ok), "katz3", ["wi_2", "wi_1"], ["wi_2", "wi_1"]))

    def unpersist(self):
        """Forgets the tables derived from the model (their files stay until ``release_scratch``)."""
        self._cache.clear()


def training_tokens(lines: DataFrame, ratio: float = 1.0, prop: float = DEFAULT_PROP,
                    seed: int = DEFAULT_SEED, remove_words=None, tokenizer=None) -> DataFrame:
    train = train_lines(lines, prop, seed)
    if ratio < 1.0:
        train = sample_blocks(with_blocks(train, seed), ratio)
    return line_tokens(train, remove_words, tokenizer=tokenizer)


def model_from_tokens(tokens: DataFrame, cutoff: float | None = 0.9, filter_one_freq: bool = True,
                      broadcast_max_words: int = DEFAULT_BROADCAST_MAX_WORDS,
                      unigrams: DataFrame | None = None, params: dict | None = None) -> NGramModel:
    ensure_checkpoint_dir(tokens.sparkSession)
    tokens = materialise(tokens.select("tokens"), "train-tokens")  # cleaned once, read for words and for n-grams
    uni = materialise(unigram_counts(tokens), "unigrams") if unigrams is None else unigrams
    vocab, nb = build_vocabulary(uni, cutoff, with_nb=True)
    vocab = materialise(vocab, "vocab")
    vsize, vtotal = vocabulary_size(vocab)
    counts = encoded_gram_counts(tokens, vocab, broadcast=vsize <= broadcast_max_words)
    if filter_one_freq:
        counts = counts.filter(F.col("count") > 1)
    bigrams, trigrams = gram_tables(materialise(counts, "gram-counts"))
    return NGramModel(vocab, materialise(ranged(bigrams, "bigrams"), "bigrams"),
                      materialise(ranged(trigrams, "trigrams"), "trigrams"), int(nb or 0), vsize, vtotal,
                      dict(params or {}, cutoff=cutoff, filter_one_freq=filter_one_freq), broadcast_max_words)


def vocabulary_size(vocab: DataFrame) -> tuple[int, int]:
    """(words, sum of their counts)."""
    st = vocab.agg(F.count(F.lit(1)).alias("v"), F.sum("count").alias("n")).first()
    return int(st["v"]), int(st["n"] or 0)


def build_model(lines: DataFrame, ratio: float = 1.0, cutoff: float | None = 0.9,
                filter_one_freq: bool = True, prop: float = DEFAULT_PROP, seed: int = DEFAULT_SEED,
                remove_words=None, broadcast_max_words: int = DEFAULT_BROADCAST_MAX_WORDS,
                input_partitions: int | None = None, tokenizer=None) -> NGramModel:
    """Full build from raw lines (doc_id, line_no, line).

    The corpus is scanned and cleaned once; its tokens are written to the
    shared folder and read twice (unigram counts, then encoded n-grams).  ``input_partitions`` spreads the lines of a few
    large files over more tasks before they are cleaned; ``tokenizer`` is that of
    ``line_tokens``.
    """
    if input_partitions:
        lines = lines.repartition(input_partitions)
    tokens = training_tokens(lines, ratio, prop, seed, remove_words, tokenizer)
    return model_from_tokens(tokens, cutoff, filter_one_freq, broadcast_max_words,
                             params=dict(ratio=ratio, prop=prop, seed=seed))
