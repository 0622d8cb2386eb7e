from pyspark.sql import functions as F

from glossa.operators.counting import line_tokens, ngram_counts, unigram_counts, merge_counts
from glossa.operators.vocabulary import coverage_threshold
from glossa.plans.evaluate import model_stats


def _counts(df, n):
    return {r.term: r["count"] for r in df.filter(F.col("n") == n).collect()}


def test_toy_counts(toy_lines):
    c = ngram_counts(line_tokens(toy_lines))
    uni = _counts(c, 1)
    assert sum(uni.values()) == 24
    assert uni == {"the": 7, "cat": 3, "mat": 3, "on": 3, "sat": 3, "a": 1, "dog": 1, "hat": 1,
                   "ran": 1, "to": 1}
    bi = _counts(c, 2)
    assert bi["on the"] == 3 and bi["cat sat"] == 2 and bi["to the"] == 1 and len(bi) == 11
    tri = _counts(c, 3)
    assert tri["sat on the"] == 3 and tri["the cat ran"] == 1 and len(tri) == 11


def test_cut_values(toy_lines):
    uni = unigram_counts(line_tokens(toy_lines))
    got = {p: coverage_threshold(uni, p).first().nb for p in (0.5, 0.8, 0.9, 1.0)}
    assert got == {0.5: 3, 0.8: 1, 0.9: 1, 1.0: 1}


def test_toy_model_tables(toy_cut):
    v = [(r.idx, r.word, r["count"]) for r in toy_cut.vocab.orderBy("idx").collect()]
    assert v == [(1, "cat", 3), (2, "mat", 3), (3, "on", 3), (4, "sat", 3), (5, "the", 7)]
    probs = {r.word: r.prob for r in toy_cut.vocab.collect()}
    assert abs(probs["the"] - 7 / 19) < 1e-15 and abs(sum(probs.values()) - 1) < 1e-12
    assert sorted(tuple(r) for r in toy_cut.bigrams.collect()) == [
        (1, 4, 2), (3, 5, 3), (4, 3, 3), (5, 1, 3), (5, 2, 3)]
    assert sorted(tuple(r) for r in toy_cut.trigrams.collect()) == [
        (1, 4, 3, 2), (3, 5, 2, 2), (4, 3, 5, 3), (5, 1, 4, 2)]


def test_stats_without_cut(toy_full):
    got = {r.n: (r.observed, r.possible, round(r.proportion, 6)) for r in model_stats(toy_full).collect()}
    assert got == {1: (10, 10.0, 1.0), 2: (11, 100.0, 0.11), 3: (11, 1000.0, 0.011)}


def test_merge_equals_one_shot(spark, toy_lines):
    tok = line_tokens(toy_lines)
    a = ngram_counts(tok.filter("line_no < 2"))
    b = ngram_counts(tok.filter("line_no >= 2"))
    merged = {tuple(r) for r in merge_counts(a, b).collect()}
    assert merged == {tuple(r) for r in ngram_counts(tok).collect()}
