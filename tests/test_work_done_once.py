"""What is done once, or moved small: read off the plans; results are those of plain forms."""

import pytest
from pyspark.sql import functions as F

from glossa.operators.counting import doc_term_counts, line_tokens, ngram_counts, ngram_occurrences
from glossa.operators.encode import encoded_gram_counts, gram_occurrences, gram_strings
from glossa.operators.membership import word_filter
from glossa.operators import ranking, suffixes
from glossa.operators.suffixes import line_suffixes, suffix_counts
from glossa.plans import build, evaluate, grid

LINES = [(1, 0, "a b a b c"), (1, 1, "b c - d's e\u0001f"), (1, 0, "a b twice"), (None, 0, "a b"), (None, 0, "a b"), (2, 0, None), (3, 0, "")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(df.collect(), key=str)


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(LINES, "doc_id long, line_no int, line string")


def test_lines_are_dealt_not_their_terms(lines):
    """F10."""
    tokens = line_tokens(lines)
    got = doc_term_counts(tokens)
    want = ngram_occurrences(tokens, keep_line=True).groupBy("doc_id", "line_no", "term").agg(F.count(F.lit(1)).alias("count"))
    text = plan(got)
    assert text.count("Exchange") == 1 and text.index("Generate") < text.index("Exchange")  # unfolded behind it
    assert rows(got) == rows(want)


def test_a_word_is_hashed_once_and_looked_up_once(lines):
    """F3."""
    tokens = line_tokens(lines)
    words = lines.sparkSession.createDataFrame([("a",), ("b",)], "word string")
    known = word_filter(words, 2)
    for n in (2, 3):
        got = gram_strings(tokens, n, known=known)
        assert plan(got.select("*")).count("xxhash64") == 1
        in_vocabulary = [r for r in rows(gram_strings(tokens, n)) if all(r[i] in ("a", "b") for i in range(n))]
        assert set(in_vocabulary) <= set(rows(got))


def test_open_sums_alone_are_made_again(lines):
    """F9."""
    got = suffix_counts(line_tokens(lines), (1, 2, 3, 4), 1.0)
    filters = [x for x in plan(got).splitlines() if "Filter" in x and "least(" in x]
    assert len(filters) >= 2  # below each sum, not above one that is made twice
    assert rows(got) == rows(ngram_counts(line_tokens(lines), (1, 2, 3, 4)))


def recorded(monkeypatch, module):
    seen, write = {}, module.materialise

    def keeps(df, name):
        seen[name] = plan(df)
        return write(df, name)

    monkeypatch.setattr(module, "materialise", keeps)
    return seen


def test_grid_ships_ids(lines, monkeypatch):
    """F11, F12, F13."""
    seen = recorded(monkeypatch, grid)
    grid.ModelGrid(lines, (0.5, 1.0), (0.8, 0.9), (True, False), prop=1.0)
    for n, first in ((2, "wi_1"), (3, "wi_2")):
        text = seen[f"grid-grams-{n}"]
        assert f"hashpartitioning({first}#" in text and "hashpartitioning(w1#" not in text


def test_build_cleans_once(toy_lines, monkeypatch):
    """F4, F7, F16, F17."""
    seen = recorded(monkeypatch, build)
    build.build_model(toy_lines, prop=1.0)
    assert [name for name, text in seen.items() if "regexp_replace" in text] == ["train-tokens"]


def test_single_characters_are_searched(lines):
    """F14, F18."""
    assert "translate(" not in plan(line_tokens(lines))
    assert [r["tokens"] for r in line_tokens(lines).filter("line_no = 1").collect()] == [["b", "c", "ds", "e-f"]]


def test_a_token_is_one_row_for_both_orders(lines, monkeypatch):
    """F16."""
    from glossa.operators import encode
    seen = recorded(monkeypatch, encode)
    tokens = line_tokens(lines)
    ids = {"a": 1, "b": 2, "twice": 3}
    vocab = lines.sparkSession.createDataFrame([(i, w) for w, i in ids.items()], "idx int, word string")
    want = {}
    for r in gram_occurrences(tokens).collect():
        words = [r["w1"], r["w2"], r["w3"]][:r["n"]]
        if all(w in ids for w in words):
            key = (r["n"], *[ids[w] for w in words], *[None] * (3 - r["n"]))
            want[key] = want.get(key, 0) + 1
    for orders in ((2, 3), (2,), (3,)):
        got = encoded_gram_counts(tokens, vocab, True, orders)
        assert got.columns == ["n", "i1", "i2", "i3", "count"]
        assert {tuple(r)[:4]: r["count"] for r in got.collect()} == {k: v for k, v in want.items() if k[0] in orders}
    text = seen["followed-counts"]
    assert text.count("BroadcastHashJoin") == 3 and "Generate posexplode" in text  # one look-up a word and place


def test_suffixes_clean_a_line_once(lines, monkeypatch):
    """F4 of round 4: lines with words are not asked for below the cleaning, which would clean them twice; the
    sample cleans the lines drawn alone, and words that are not spread are summed where they lie."""
    tokens = line_tokens(lines)
    cleanings = lambda df: plan(df).count("regexp_replace(")
    assert cleanings(line_suffixes(tokens, 4)) == cleanings(tokens)
    drawn = []
    monkeypatch.setattr(suffixes, "line_suffixes", lambda some, *a: drawn.append(plan(some)) or line_suffixes(some, *a))
    suffixes.frequent_starts(tokens, 0.01, 8)
    assert "Sample" not in drawn[0] and drawn[0].index("xxhash64") > drawn[0].index("regexp_replace(")  # below it
    spread = suffix_counts(tokens, (1, 2), 0.0)
    assert "least(" in plan(spread) and rows(spread) == rows(ngram_counts(tokens, (1, 2)))


def test_a_whole_sample_is_one_count(spark):
    """F4 of round 4: the sum, words and pairs of a sample, with lines that have no word and keys that repeat or are null."""
    data = [(None, 0, ["x", "y"])] * 40 + [(1, 0, ["x", "z"])] * 30 + [(2, 0, []), (3, 0, None), (4, 0, ["one"]), (None, 0, ["x"])]
    tokens = spark.createDataFrame(data, "doc_id long, line_no int, tokens array<string>")
    words, pairs = suffixes.frequent_starts(tokens, 1.0, 1)
    assert sorted(words) == ["x", "y", "z"] and sorted(pairs) == [("x", "y"), ("x", "z")]
    assert suffixes.frequent_starts(tokens.filter("false"), 1.0, 1) == ([], [])


def test_a_grid_counts_what_is_asked(lines, monkeypatch):
    """F3 of round 4: the grid of the codes asked for, whose rows are those of the whole one; bigrams are sums of counted rows."""
    seen, made, whole = recorded(monkeypatch, grid), [], evaluate.ModelGrid
    monkeypatch.setattr(evaluate, "ModelGrid", lambda lines, *a, **k: made.append(k) or whole(lines, *a, **k, prop=1.0))
    asked = dict(sampling=(0.3, 0.6, 1.0), cutoff=(0.5, 0.8, 0.9), filter_one_freq=(True, False))
    codes = ("30_50_TRUE", "100_90_FALSE")
    every = {r.code: r for r in evaluate.sweep(lines, lines, **asked).collect()}
    assert "Generate" in seen["grid-grams-3"] and "Generate" not in seen["grid-grams-2"] and len(every) == 18
    some = evaluate.sweep(lines, lines, **asked, only=codes).collect()
    assert made[1]["sampling"] == [0.3, 1.0] and made[1]["cutoff"] == [0.5, 0.9]
    assert [r.code for r in some] == [*codes] and [every[c] for c in codes] == some and some[1].trigrams
    assert evaluate.sweep(lines, lines, only=()).collect() == [] and len(made) == 2


def test_free_numbers_come_from_bits(spark, monkeypatch):
    """F2 of round 4: the smallest numbers not held, without a sort of all numbers by place; they may repeat."""
    seen = recorded(monkeypatch, ranking)
    held = {1: [1, 2, 4, 4, 70], 2: [*range(1, 131), 133], 3: [64, 128], 4: [5000], 5: [*range(1, 64)]}
    df = spark.createDataFrame([(g, x) for g, xs in held.items() for x in xs], "g int, x bigint").repartition(5)
    for n in (1, 3, 64, 70, 150):
        got = ranking.first_missing(df, ["g"], "x", n)
        found = {r.g: r.missing for r in got.collect()}
        for g, xs in held.items():
            assert found.get(g, [*range(1, n + 1)]) == [x for x in range(1, 6000) if x not in xs][:n]
        assert "rangepartitioning" not in plan(got) and not seen
