"""Suffix counting and the word filter against plain counts."""

import random

import pytest


from glossa.operators.counting import ngram_counts
from glossa.operators.suffixes import frequent_starts, suffix_counts


@pytest.fixture(scope="module")
def tokens(spark):
    r = random.Random(4)
    lines = [[r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 9))] for _ in range(300)]
    lines += [["the", "same", "line", "again", "and", "again"]] * 200 + [["hot", r.choice("xyz"), r.choice("xyz")] for _ in range(150)] + [["one"], []]
    return spark.createDataFrame([(i // 7, i % 7, t) for i, t in enumerate(lines)], "doc_id long, line_no int, tokens array<string>").repartition(6)


def rows(df):
    return sorted(tuple(x) for x in df.select("n", "term", "count").collect())


@pytest.mark.parametrize("orders,sample", [((1, 2, 3, 4), 1.0), ((1, 2, 3), 0.3), ((2,), 0.0)])
def test_suffix_counts(spark, tokens, orders, sample):
    assert rows(suffix_counts(tokens, orders, sample)) == rows(ngram_counts(tokens, orders))


def test_frequent_starts_are_spread(spark, tokens):
    words, pairs = frequent_starts(tokens, 1.0, 8)
    assert {"the", "hot", "again"} <= set(words) and {("the", "same"), ("same", "line")} <= set(pairs)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = suffix_counts(tokens, (1, 2, 3, 4), 1.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(w1" in x]
    assert len(dealt) == 2 and sum("ReusedExchange" in x for x in dealt) == 1


def test_no_lines(spark, tokens):
    assert suffix_counts(tokens.filter("false")).count() == 0
