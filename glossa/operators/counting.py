"""Tokenising and counting.

Counts use ``groupBy(...).count()``: Catalyst plans a partial
(map-side) HashAggregate before the shuffle, so each task ships one row per
distinct key it saw -- the per-block partial counts of the modelled program,
merged by the final aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import clean_text, ngram_terms, tokenize
from glossa.sources.wordlists import profanity_words


#: Parts of lines that unfold behind their exchange, in multiples of Spark's own.
UNFOLDED = 4


def clean_lines(lines: DataFrame, remove_words=None) -> DataFrame:
    words = profanity_words() if remove_words is None else remove_words
    return lines.select("doc_id", "line_no", clean_text("line", words).alias("clean"))


def line_tokens(lines: DataFrame, remove_words=None, keep=(), tokenizer=None) -> DataFrame:
    """(doc_id, line_no[, keep], tokens) -- one row per line, tokens as an array.
    ``tokenizer`` maps the Column of cleaned lines to one of string arrays
    (words between spaces by default); n-grams, counts and models follow it."""
    words = profanity_words() if remove_words is None else remove_words
    return lines.select("doc_id", "line_no", *keep, (tokenizer or tokenize)(clean_text("line", words)).alias("tokens"))


def _tag(n: int):
    # One-argument lambda: ``transform`` passes an index to two-argument ones.
    return lambda t: F.struct(F.lit(n).alias("n"), t.alias("term"))


def terms_with_order(orders) -> F.Column:
    """Array of (n, term) of all n-grams of ``tokens``."""
    parts = []
    for n in orders:
        terms = F.col("tokens") if n == 1 else ngram_terms("tokens", n)
        parts.append(F.transform(terms, _tag(n)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def ngram_occurrences(tokens: DataFrame, orders=(1, 2, 3), keep_line: bool = False) -> DataFrame:
    """One row per n-gram occurrence: (n, term) [+ doc_id, line_no]."""
    keep = ["doc_id", "line_no"] if keep_line else []
    ex = tokens.select(*keep, F.explode(terms_with_order(orders)).alias("g"))
    return ex.select(*keep, F.col("g.n").alias("n"), F.col("g.term").alias("term"))


def ngram_counts(tokens: DataFrame, orders=(1, 2, 3)) -> DataFrame:
    """(n, term, count) over all lines."""
    return (ngram_occurrences(tokens, orders)
            .groupBy("n", "term").agg(F.count(F.lit(1)).alias("count")))


def doc_term_counts(tokens: DataFrame, orders=(1, 2, 3)) -> DataFrame:
    """Long-form document-term matrix: (doc_id, line_no, term, count).

    Lines are dealt out, not their terms: a line unfolds, to some ten times its
    size, where it is counted.  There are more parts than usual for that."""
    parts = UNFOLDED * int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tokens.select("doc_id", "line_no", "tokens").repartition(parts, "doc_id", "line_no")
    return (ngram_occurrences(dealt, orders, keep_line=True)
            .groupBy("doc_id", "line_no", "term").agg(F.count(F.lit(1)).alias("count")))


def merge_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Incremental merge of two count tables (keys missing on one side are
    fine): union then re-aggregate."""
    keys = [c for c in old.columns if c != "count"]
    return (old.unionByName(new.select(*keys, "count"))
            .groupBy(*keys).agg(F.sum("count").cast("bigint").alias("count")))


def unigram_counts(tokens: DataFrame) -> DataFrame:
    """(word, count) from the token arrays."""
    return (tokens.select(F.explode("tokens").alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("count")))
