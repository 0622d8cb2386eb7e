from pyspark.sql import functions as F

from conftest import SF001
from glossa.operators.split import test_lines as held_out, train_lines, with_split
from glossa.plans.evaluate import model_stats
from glossa.session import scratch_path
from glossa.sources.corpus import document_lines, read_table
from glossa.sources.model_io import load_model, model_exists, read_int_csv, save_model, write_int_csv


def test_split_disjoint_and_total(spark):
    lines = document_lines(read_table(spark, SF001, "documents"))
    n, tr, te = lines.count(), train_lines(lines).count(), held_out(lines).count()
    assert tr + te == n and tr > te > 0
    flags = with_split(lines).groupBy("is_train").count().collect()
    assert sum(r["count"] for r in flags) == n


def test_sf001_sizes(sf001_model):
    # survey figures for sf0.001 (seed 42, prop .99, cutoff .9, singletons dropped)
    assert sf001_model.vocab_size == 4711
    assert sf001_model.bigrams.count() == 6070
    assert sf001_model.trigrams.count() == 5059
    probs = sf001_model.vocab.agg(F.sum("prob")).first()[0]
    assert abs(probs - 1.0) < 1e-9


def test_trigram_subset_of_bigrams(sf001_model):
    m = sf001_model
    orphan = m.trigrams.join(m.bigrams, ["wi_1", "wi"], "left_anti").count()
    assert orphan == 0


def test_katz_context_sums_to_one(sf001_model):
    m = sf001_model
    k2 = m.katz2()
    # seen mass + unseen mass = 1 per context
    bad = k2.filter(F.abs(F.col("seen_mass") + F.col("unseen_mass") - 1) > 1e-9).count()
    assert bad == 0


def test_model_roundtrip(spark, sf001_model):
    path = scratch_path(spark, "t-model")
    assert not model_exists(spark, path)
    save_model(sf001_model, path)
    assert model_exists(spark, path)
    m2 = load_model(spark, path)
    got = {r.n: r.observed for r in model_stats(m2).collect()}
    assert got == {1: 4711, 2: 6070, 3: 5059}
    csv = scratch_path(spark, "t-csv")
    write_int_csv(sf001_model.bigrams, csv)
    back = read_int_csv(spark, csv, ["wi_1", "wi", "count"])
    assert back.exceptAll(sf001_model.bigrams).count() == 0 and back.count() == 6070
