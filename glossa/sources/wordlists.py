"""Word lists: the packaged profanity list (removed while cleaning) and
stop-word lists (dropped from predictions on request).

The stop-word list is a parameter: callers pass words, a DataFrame with a
``word`` column, or a path to a one-word-per-line file.  ``frequent_words``
derives one from a model, for callers who ask for it.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DATA = os.path.join(os.path.dirname(__file__), "data")
PROFANITY_PATH = os.path.join(_DATA, "profanity.csv")


# The packaged list equals the modelled program's, in its order.
def profanity_words(path: str = PROFANITY_PATH) -> list[str]:
    """The packaged one-column list (no header).  Small and fixed, so it is
    read on the driver and compiled into one regex."""
    with open(path, encoding="utf-8") as fh:
        return [line.strip() for line in fh if line.strip()]


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """A headerless one-column CSV / text file as ``(word STRING)``."""
    return spark.read.schema(T.StructType([T.StructField("word", T.StringType())])).csv(
        path, header=False)


#: A stop list is a small table of the caller's; a longer one is an error.
MAX_STOP_WORDS = 100_000


def stop_word_list(spark: SparkSession, stop_words) -> list[str]:
    """Sorted distinct words of a list, of a DataFrame's first column, or of a
    one-word-per-line file."""
    if isinstance(stop_words, str):
        stop_words = read_word_list(spark, stop_words)
    if isinstance(stop_words, DataFrame):
        rows = stop_words.select(F.col(stop_words.columns[0]).alias("word")).distinct().limit(MAX_STOP_WORDS + 1).collect()
        stop_words = [r["word"] for r in rows]
    words = sorted({w for w in stop_words if w})
    if len(words) > MAX_STOP_WORDS:
        raise ValueError(f"a stop list holds at most {MAX_STOP_WORDS} words")
    return words


def frequent_words(vocab: DataFrame, n: int = 50) -> DataFrame:
    """Rule-built stop list: the ``n`` most frequent vocabulary words
    (count desc, then word).  A top-n report, so the limit is the feature."""
    return vocab.orderBy(F.col("count").desc(), F.col("word")).limit(n).select("word")


def stop_ids(vocab: DataFrame, words: Iterable[str]) -> DataFrame:
    """Vocabulary ids of the stop words (words not in the model drop out)."""
    stop = vocab.sparkSession.createDataFrame([(w,) for w in words], "word string")
    return vocab.join(F.broadcast(stop), "word", "left_semi").select("idx")
