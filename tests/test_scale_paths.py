"""The plan for large vocabularies, prediction's plan, and sums over contexts."""

import pytest
from pyspark.sql import functions as F

from brute import DenseModel
from conftest import SF001
from glossa.operators.counting import line_tokens, unigram_counts
from glossa.operators.scoring import katz_scores, stupid_scores
from glossa.operators.split import test_lines as held_out
from glossa.operators.split import train_lines
from glossa.operators.vocabulary import coverage_thresholds
from glossa.plans.build import build_model
from glossa.plans.evaluate import accuracy_top_n, perplexity
from glossa.plans.predict import context_predictions, predict
from glossa.sources.corpus import conversation_phrases, document_lines, read_table


@pytest.fixture(scope="module")
def lines(spark):
    return document_lines(read_table(spark, SF001, "documents"))


@pytest.fixture(scope="module")
def large(spark, lines):
    """The same model by the plan that broadcasts nothing."""
    return build_model(lines, broadcast_max_words=0, input_partitions=4)


def same(a, b):
    return a.exceptAll(b.select(a.columns)).count() == 0 and b.select(a.columns).exceptAll(a).count() == 0


def test_no_broadcast_equals_default(spark, sf001_model, large, lines):
    assert not large.broadcast_ok and sf001_model.broadcast_ok
    for t in ("vocab", "bigrams", "trigrams"):
        assert same(getattr(large, t), getattr(sf001_model, t))
    phrases = conversation_phrases(read_table(spark, SF001, "conversations"))
    for algo in ("stupid", "katz"):
        assert same(predict(large, phrases, algo, 10, clean=True), predict(sf001_model, phrases, algo, 10, clean=True))
    test = held_out(lines)
    assert accuracy_top_n(large, test).collect() == accuracy_top_n(sf001_model, test).collect()
    a, b = perplexity(large, test).first(), perplexity(sf001_model, test).first()
    assert a.m == b.m and a.perplexity == pytest.approx(b.perplexity, rel=1e-12)
    triples = spark.createDataFrame([(None, 5, 7), (None, None, 7), (3, None, None), (3, 5, None)], "u int, v int, w int")
    for f in (stupid_scores, katz_scores):
        assert sorted(map(str, f(large, triples).collect())) == sorted(map(str, f(sf001_model, triples).collect()))


def test_second_prediction_leaves_nothing_behind(spark, sf001_model):
    phrases = conversation_phrases(read_table(spark, SF001, "conversations"))
    sc = spark.sparkContext._jsc.sc()
    cached = lambda: (sc.getPersistentRDDs().size(), spark._jsparkSession.sharedState().cacheManager().numCachedEntries())

    def files():
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
        return fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs).__len__()

    kw = dict(include_stop_words=False, stop_words=["the", "of"])
    for extra in ({}, kw):
        predict(sf001_model, phrases, "katz", 10, clean=True, **extra).count()
        before = cached(), files()
        predict(sf001_model, phrases, "katz", 10, clean=True, **extra).count()
        assert (cached(), files()) == before


def test_few_exchanges(spark, sf001_model):
    phrases = conversation_phrases(read_table(spark, SF001, "conversations"))
    df = predict(sf001_model, phrases, "katz", 10, clean=True)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    seen = plan.split("InMemoryRelation")[0]
    assert seen.count("Exchange hashpartitioning") + seen.count("Exchange rangepartitioning") < 18


def test_katz_sums_to_one(spark, sf001_model):
    m = sf001_model
    ctx = m.trigrams.select(F.col("wi_2").alias("u"), F.col("wi_1").alias("v")).distinct().orderBy(F.xxhash64("u", "v")).limit(50)
    dense = ctx.join(m.vocab.select(F.col("idx").alias("w")), F.lit(True))
    sums = katz_scores(m, dense).groupBy("u", "v").agg(F.sum("prob").alias("s"))
    # words outside A3 share alpha3; over the whole vocabulary the probabilities of a context sum to 1
    bad = sums.filter(F.abs(F.col("s") - 1) > 1e-9)
    assert sums.count() == 50 and bad.count() == 0


def test_katz_sums_to_one_when_every_word_follows(spark):
    from glossa.plans.build import model_from_tokens
    text = ["a a b", "a b a", "a a a", "b a b", "b b a", "a c a b", "a a c", "a b c a"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id long, line_no int, line string")
    m = model_from_tokens(line_tokens(df, []), None, False)
    dense = DenseModel(m.vocab.toPandas(), m.bigrams.toPandas(), m.trigrams.toPandas())
    assert any(len(g) == m.vocab_size for g in dense.bi_by_v.values())  # B2 is empty for some context
    ids = [r.idx for r in m.vocab.collect()]
    triples = spark.createDataFrame([(u, v, w) for u in ids for v in ids for w in ids], "u int, v int, w int")
    got = {(r.u, r.v, r.w): r.prob for r in katz_scores(m, triples).collect()}
    for u in ids:
        for v in ids:
            if len(dense.tri_by_ctx.get((u, v), ())) < m.vocab_size:
                want = dense.katz(u, v)
                for w in ids:
                    assert got[u, v, w] == pytest.approx(want[w], abs=1e-12)


@pytest.mark.parametrize("algo", ["stupid", "katz"])
def test_pruned_equals_dense_at_ten(spark, sf001_model, algo):
    m = sf001_model
    dense = DenseModel(m.vocab.toPandas(), m.bigrams.toPandas(), m.trigrams.toPandas())
    tri = m.trigrams.toPandas()
    ctxs = [(int(r.wi_2), int(r.wi_1)) for r in tri.sample(12, random_state=1).itertuples()] + [(0, 17), (0, 0)]
    got = {}
    for r in context_predictions(m, spark.createDataFrame(ctxs, "u int, v int"), algo, 10).collect():
        got.setdefault((r.u, r.v), {})[r.w] = r.prob
    for u, v in set(ctxs):
        assert got[u, v] == pytest.approx(dense.top(u, v, algo, 10), abs=1e-12)


def test_one_scan_for_all_cutoffs(spark, lines):
    got = coverage_thresholds(unigram_counts(line_tokens(train_lines(lines))), (0.8, 0.85, 0.9))
    plan = got._jdf.queryExecution().toString()
    assert "FileScan" not in plan and "Scan parquet" not in plan and got.count() == 3
