"""A Bloom filter of the kept words, applied before n-grams are shuffled.

For a vocabulary too large to broadcast, a filter of a few bits a word still
fits: a token that it rejects is certainly outside the vocabulary, and an
n-gram with such a token is dropped in the map task.  The few strangers that
it lets through meet no word in the join that follows, so results are the same.

The filter is built as counts are: every word sets bits of a 64-bit cell, cells
are joined by a bit-or that starts in the map tasks, and one row of cells, of a
size set beforehand, goes to the tasks as a scalar subquery.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.session import materialise

#: Most bytes of a filter; beyond, it lets more strangers through.
MAX_BYTES = 16 << 20
BITS_PER_WORD = 16
#: Bits that a word sets, all in one cell: a look at one number answers.  A test
#: of seven spots over the whole filter was more code than Java compiles.
HASHES = 4


def word_hash(word: Column) -> Column:
    return F.xxhash64(word)


def _cell(h: Column, cells: int) -> Column:
    """The cell of a word with the hash ``h``, from its upper half."""
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(cells)).cast("int")


def _mask(h: Column) -> Column:
    """The bits of a word in its cell, each from six bits of the lower half."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(HASHES)]
    return reduce(Column.bitwiseOR, bits)


@dataclass
class WordFilter:
    row: DataFrame  # one row: cells ARRAY<BIGINT>
    cells: int

    def may_contain(self, word: Column) -> Column:
        return self.may_contain_hash(word_hash(word))

    def may_contain_hash(self, h: Column) -> Column:
        found = F.get(self.row.select("cells").scalar(), _cell(h, self.cells))
        return found.bitwiseAND(_mask(h)) == _mask(h)

    def may_hold(self, grams: DataFrame, hashes: list[str]) -> DataFrame:
        """The rows whose words, given by their hashes, may all be known."""
        for h in hashes:
            grams = grams.filter(self.may_contain_hash(F.col(h)))
        return grams


def word_filter(words: DataFrame, n_words: int, column: str = "word", max_bytes: int = MAX_BYTES) -> WordFilter:
    """The filter of ``n_words`` distinct words."""
    cells = max(1, min(max_bytes // 8, math.ceil(n_words * BITS_PER_WORD / 64)))
    h = word_hash(F.col(column))
    set_cells = words.groupBy(_cell(h, cells).alias("cell")).agg(F.bit_or(_mask(h)).alias("bits"))
    every = words.sparkSession.range(cells).join(set_cells, F.col("id") == F.col("cell"), "left").select("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    # one row of at most max_bytes
    row = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("cells"))
    return WordFilter(materialise(row, "word-filter"), cells)
