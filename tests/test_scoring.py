import pytest

from glossa.operators.scoring import katz_scores, stupid_scores
from glossa.plans.predict import predict, predict_one

# FIXTURES 3.3 (no cut, singletons kept, d=.5, a=.4)
KATZ = {
    ("on", "the"): {"mat": .5, "cat": .20833333, "hat": .16666667, "the": .05147059, "on": .02205882,
                    "sat": .02205882, "a": .00735294, "dog": .00735294, "ran": .00735294, "to": .00735294},
    ("the", "cat"): {"sat": .5, "ran": .16666667, "the": .11666667, "cat": .05, "mat": .05, "on": .05,
                     "a": .01666667, "dog": .01666667, "hat": .01666667, "to": .01666667},
    ("zzz", "the"): {"cat": .35714286, "mat": .35714286, "the": .08823529, "hat": .07142857,
                     "on": .03781513, "sat": .03781513, "a": .01260504, "dog": .01260504,
                     "ran": .01260504, "to": .01260504},
    ("zzz", "qqq"): {"the": .29166667, "cat": .125, "mat": .125, "on": .125, "sat": .125,
                     "a": .04166667, "dog": .04166667, "hat": .04166667, "ran": .04166667,
                     "to": .04166667},
}
STUPID = {
    ("on", "the"): {"mat": .66666667, "hat": .33333333, "cat": .17142857, "the": .04666667, "on": .02,
                    "sat": .02, "a": .00666667, "dog": .00666667, "ran": .00666667, "to": .00666667},
    ("the", "cat"): {"sat": .66666667, "ran": .33333333, "the": .04666667, "cat": .02, "mat": .02,
                     "on": .02, "a": .00666667, "dog": .00666667, "hat": .00666667, "to": .00666667},
    ("zzz", "the"): {"cat": .17142857, "mat": .17142857, "hat": .05714286, "the": .04666667,
                     "on": .02, "sat": .02, "a": .00666667, "dog": .00666667, "ran": .00666667,
                     "to": .00666667},
    ("zzz", "qqq"): {"the": .04666667, "cat": .02, "mat": .02, "on": .02, "sat": .02,
                     "a": .00666667, "dog": .00666667, "hat": .00666667, "ran": .00666667,
                     "to": .00666667},
}


def _triples(spark, model, u, v, extra=()):
    ids = {r.word: r.idx for r in model.vocab.collect()}
    rows = [(ids.get(u), ids.get(v), ids[w]) for w in ids] + [(ids.get(u), ids.get(v), None)
                                                            for _ in extra]
    return spark.createDataFrame(rows, "u int, v int, w int"), {i: w for w, i in ids.items()}


@pytest.mark.parametrize("ctx", list(KATZ))
def test_katz_and_stupid_fixture(spark, toy_full, ctx):
    t, inv = _triples(spark, toy_full, *ctx)
    k = {inv[r.w]: r.prob for r in katz_scores(toy_full, t).collect()}
    s = {inv[r.w]: r.score for r in stupid_scores(toy_full, t).collect()}
    for w, p in KATZ[ctx].items():
        assert round(k[w], 8) == pytest.approx(p, abs=1e-8), (ctx, w)
    for w, p in STUPID[ctx].items():
        assert round(s[w], 8) == pytest.approx(p, abs=1e-8), (ctx, w)
    assert sum(k.values()) == pytest.approx(1.0, abs=1e-12)


def test_oov_target(spark, toy_full):
    t = spark.createDataFrame([(1, 5, None)], "u int, v int, w int")
    assert stupid_scores(toy_full, t).first().score == pytest.approx(0.04)
    assert katz_scores(toy_full, t).first().prob is None


def test_ties_kept(spark, toy_full):
    ph = spark.createDataFrame([(1, "on a")], "phrase_id long, phrase string")
    got = {r.word: round(r.prob, 8) for r in predict(toy_full, ph, "stupid", 3).collect()}
    assert got == {"dog": 0.4, "the": 0.04666667, "cat": 0.02, "mat": 0.02, "on": 0.02, "sat": 0.02}
    first = predict(toy_full, ph, "stupid", 3, ties="first").collect()
    assert len(first) == 3


def test_short_phrase_is_error(toy_full):
    with pytest.raises(ValueError):
        predict_one(toy_full, "cat")
