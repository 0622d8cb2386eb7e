"""Pruned candidates + top-k against a dense brute force (pandas) on sf0.001."""

import pytest
from pyspark.sql import functions as F

from brute import DenseModel
from glossa.plans.predict import context_predictions


@pytest.fixture(scope="module")
def dense(sf001_model):
    m = sf001_model
    return DenseModel(m.vocab.toPandas(), m.bigrams.toPandas(), m.trigrams.toPandas())


@pytest.mark.parametrize("algo", ["stupid", "katz"])
@pytest.mark.parametrize("k", [1, 5])
@pytest.mark.parametrize("stop", [False, True])
def test_pruned_equals_dense(spark, sf001_model, dense, algo, k, stop):
    m = sf001_model
    tri = m.trigrams.toPandas()
    ctxs = [(int(r.wi_2), int(r.wi_1)) for r in tri.sample(25, random_state=7).itertuples()]
    ctxs += [(0, int(v)) for v in m.bigrams.toPandas().wi_1.sample(10, random_state=3)] + [(0, 0)]
    cdf = spark.createDataFrame(ctxs, "u int, v int")
    stop_df = m.vocab.orderBy(F.col("count").desc(), "word").limit(50).select("idx") if stop else None
    stopset = [r.idx for r in stop_df.collect()] if stop else ()
    got = {}
    for r in context_predictions(m, cdf, algo, k, stop_idx=stop_df).collect():
        got.setdefault((r.u, r.v), {})[r.w] = r.prob
    for u, v in set(ctxs):
        exp = dense.top(u, v, algo, k, stopset)
        g = got.get((u, v), {})
        assert set(g) == set(exp), (u, v)
        for w in exp:
            assert g[w] == pytest.approx(exp[w], rel=1e-9)
