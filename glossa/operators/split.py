"""Train/test split and training blocks.

The split is a deterministic hash draw per line, so it is stable across
plans, retries and cluster sizes (``rand(seed)`` is not).  The complement
is the negated predicate: train and test are disjoint and cover every line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import block_number, uniform_hash

DEFAULT_PROP = 0.99
DEFAULT_SEED = 42
N_BLOCKS = 100


def split_draw(seed: int = DEFAULT_SEED, keys=("doc_id", "line_no")) -> Column:
    return uniform_hash(seed, *keys)


def with_split(lines: DataFrame, prop: float = DEFAULT_PROP, seed: int = DEFAULT_SEED,
               keys=("doc_id", "line_no")) -> DataFrame:
    if not 0.0 < prop <= 1.0:
        raise ValueError("prop must be in (0, 1]")
    return lines.withColumn("is_train", split_draw(seed, keys) < F.lit(prop))


def train_lines(lines: DataFrame, prop: float = DEFAULT_PROP, seed: int = DEFAULT_SEED,
                keys=("doc_id", "line_no")) -> DataFrame:
    return lines.filter(split_draw(seed, keys) < F.lit(prop))


def test_lines(lines: DataFrame, prop: float = DEFAULT_PROP, seed: int = DEFAULT_SEED,
               keys=("doc_id", "line_no")) -> DataFrame:
    return lines.filter(~(split_draw(seed, keys) < F.lit(prop)))


def with_blocks(lines: DataFrame, seed: int = DEFAULT_SEED, nblocks: int = N_BLOCKS,
                keys=("doc_id", "line_no")) -> DataFrame:
    """Block 1..nblocks per line from the hash, not from a global row order."""
    return lines.withColumn("block", block_number(seed, nblocks, *keys))


def sampled_block_limit(ratio: float) -> int:
    """Blocks kept for a sampling ratio: round(ratio*101), i.e. .20->20,
    .25->25, .30->30, 1->all."""
    if not 0.0 < ratio <= 1.0:
        raise ValueError("ratio must be in (0, 1]")
    return int(round(ratio * 101))


def sample_blocks(lines_with_blocks: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Keep the lines of whole blocks 1..round(ratio*101)."""
    return lines_with_blocks.filter(F.col("block") <= F.lit(sampled_block_limit(ratio)))
