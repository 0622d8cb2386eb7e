"""

Every query reads the given parquet tables (``documents`` for the corpus,
``conversations`` for phrases) over whole tables.  Models are built once
per (session, sf_dir) and reused by the queries that need them.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from importlib.util import find_spec

# The package sits next to this file; make it importable from any cwd.
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.checks.oracle_sql import queries_sql
from glossa.functions.text import ngram_terms, round_half_up
from glossa.operators.counting import (clean_lines, doc_term_counts, line_tokens, merge_counts,
                                       ngram_counts)
from glossa.operators.scoring import katz_scores, stupid_scores
from glossa.operators.split import (sample_blocks, test_lines, train_lines, with_blocks,
                                    with_split)
from glossa.operators.suffixes import suffix_counts
from glossa.operators.vocabulary import coverage_thresholds
from glossa.operators.encode import decode_ids, encode_terms, encoded_gram_counts
from glossa.operators.counting import unigram_counts
from glossa.plans.build import build_model
from glossa.plans.growing import GrowingModel
from glossa.plans.evaluate import (accuracy_top_n, model_stats, perplexity, sweep, top_terms)
from glossa.plans.predict import format_predictions, predict, predict_status
from glossa.session import ensure_checkpoint_dir, scratch_path
from glossa.sources.corpus import (conversation_phrases, document_lines, read_table, text_file_lines,
                                   write_line_files)
from glossa.sources.model_io import (build_or_load, load_model, read_int_csv, save_model, table_sizes,
                                     write_int_csv)
from glossa.sources.wordlists import frequent_words

_MODELS: dict = {}


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return document_lines(read_table(spark, sf, "documents"))


def _model(spark: SparkSession, sf: str):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        ensure_checkpoint_dir(spark)
        _MODELS[key] = build_model(_lines(spark, sf))
    return _MODELS[key]


def _tokens_all(spark, sf):
    return line_tokens(_lines(spark, sf))


def _phrases(spark, sf):
    return conversation_phrases(read_table(spark, sf, "conversations"))


def _test_trigrams(spark, sf, model):
    tok = line_tokens(test_lines(_lines(spark, sf)))
    terms = tok.select(F.explode(ngram_terms("tokens", 3)).alias("term")).distinct()
    enc = encode_terms(terms, model.vocab, 3, broadcast=model.broadcast_ok)
    return enc.select(F.col("wi_2").alias("u"), F.col("wi_1").alias("v"), F.col("wi").alias("w")).distinct()


def _test_bigrams(spark, sf, model):
    tok = line_tokens(test_lines(_lines(spark, sf)))
    terms = tok.select(F.explode(ngram_terms("tokens", 2)).alias("term")).distinct()
    enc = encode_terms(terms, model.vocab, 2, broadcast=model.broadcast_ok)
    return enc.select(F.col("wi_1").alias("v"), F.col("wi").alias("w")).distinct()


def q_corpus_lines(spark, sf):
    return _lines(spark, sf)


def q_split_train_test(spark, sf):
    return with_split(_lines(spark, sf)).select("doc_id", "line_no", "is_train")


def q_block_sample(spark, sf):
    return sample_blocks(with_blocks(train_lines(_lines(spark, sf))), 0.25).select(
        "doc_id", "line_no", "block")


def q_clean_lines(spark, sf):
    return clean_lines(_lines(spark, sf))


def q_tokens(spark, sf):
    return _tokens_all(spark, sf).select(
        "doc_id", "line_no", F.posexplode("tokens").alias("pos", "word")).select(
        "doc_id", "line_no", (F.col("pos") + 1).cast("int").alias("pos"), "word")


def _q_ngrams(n):
    def q(spark, sf):
        return _tokens_all(spark, sf).select(
            "doc_id", "line_no", F.posexplode(ngram_terms("tokens", n)).alias("pos", "term")).select(
            "doc_id", "line_no", (F.col("pos") + 1).cast("int").alias("pos"), "term")
    return q


def q_doc_term_counts(spark, sf):
    return doc_term_counts(_tokens_all(spark, sf))


def _train_tokens(spark, sf):
    return line_tokens(train_lines(_lines(spark, sf)))


def q_ngram_counts(spark, sf):
    return ngram_counts(_train_tokens(spark, sf))


def q_ngram_counts_4(spark, sf):
    """All orders up to four, from one shuffle of suffixes."""
    return suffix_counts(_train_tokens(spark, sf), (1, 2, 3, 4))


def q_merge_counts(spark, sf):
    blocks = with_blocks(train_lines(_lines(spark, sf)))
    first = ngram_counts(line_tokens(blocks.filter(F.col("block") <= 50)))
    second = ngram_counts(line_tokens(blocks.filter(F.col("block") > 50)))
    return merge_counts(first, second)


def q_coverage_cutoff(spark, sf):
    return coverage_thresholds(unigram_counts(_train_tokens(spark, sf)), (0.8, 0.85, 0.9))


def q_vocabulary(spark, sf):
    return _model(spark, sf).vocab


def q_bigram_model(spark, sf):
    return _model(spark, sf).bigrams


def q_bigrams_filtered(spark, sf):
    """The bigram table by the plan for vocabularies that are not broadcast: a
    Bloom filter before the shuffle, joins after it."""
    counts = encoded_gram_counts(_train_tokens(spark, sf), _model(spark, sf).vocab, broadcast=False, orders=(2,))
    return counts.filter("count > 1").select(F.col("i1").alias("wi_1"), F.col("i2").alias("wi"), "count")


def q_trigram_model(spark, sf):
    return _model(spark, sf).trigrams


def q_decode_trigrams(spark, sf):
    m = _model(spark, sf)
    return decode_ids(m.trigrams, m.vocab, ["wi_2", "wi_1", "wi"], "term", m.broadcast_ok).select(
        "term", "count")


def q_context_totals_2(spark, sf):
    m = _model(spark, sf)
    return m.katz2().select("wi_1", F.col("t2").alias("total"), F.col("n2").alias("n_followers"),
                            round_half_up("alpha2", 8).alias("alpha"))


def q_context_totals_3(spark, sf):
    m = _model(spark, sf)
    return m.katz3().select("wi_2", "wi_1", F.col("t3").alias("total"),
                            F.col("n3").alias("n_followers"), round_half_up("alpha3", 8).alias("alpha"),
                            round_half_up("denom3", 8).alias("denom"))


def q_seen_unseen_mass(spark, sf):
    m = _model(spark, sf)
    return m.katz2().select("wi_1", round_half_up("seen_mass", 8).alias("seen_mass"),
                            round_half_up("unseen_mass", 8).alias("unseen_mass"))


def q_model_stats(spark, sf):
    return model_stats(_model(spark, sf))


def _q_top(n):
    return lambda spark, sf: top_terms(_model(spark, sf), n, 20)


def q_stupid_bigram(spark, sf):
    m = _model(spark, sf)
    return stupid_scores(m, _test_bigrams(spark, sf, m), level=2).select(
        F.col("v").alias("wi_1"), F.col("w").alias("wi"), round_half_up("score", 8).alias("score"))


def q_stupid_trigram(spark, sf):
    m = _model(spark, sf)
    return stupid_scores(m, _test_trigrams(spark, sf, m)).select(
        F.col("u").alias("wi_2"), F.col("v").alias("wi_1"), F.col("w").alias("wi"),
        round_half_up("score", 8).alias("score"))


def q_katz_bigram(spark, sf):
    m = _model(spark, sf)
    return katz_scores(m, _test_bigrams(spark, sf, m), level=2).select(
        F.col("v").alias("wi_1"), F.col("w").alias("wi"), round_half_up("prob", 8).alias("prob"))


def q_katz_trigram(spark, sf):
    m = _model(spark, sf)
    return katz_scores(m, _test_trigrams(spark, sf, m)).select(
        F.col("u").alias("wi_2"), F.col("v").alias("wi_1"), F.col("w").alias("wi"),
        round_half_up("prob", 8).alias("prob"))


def _rounded(df):
    return df.withColumn("prob", round_half_up("prob", 8))


def q_predict_stupid(spark, sf):
    return _rounded(predict(_model(spark, sf), _phrases(spark, sf), "stupid", 10, clean=True))


def q_predict_katz(spark, sf):
    return _rounded(predict(_model(spark, sf), _phrases(spark, sf), "katz", 10, clean=True))


def q_predict_no_stopwords(spark, sf):
    model = _model(spark, sf)
    return _rounded(predict(model, _phrases(spark, sf), "stupid", 10, include_stop_words=False,
                            stop_words=frequent_words(model.vocab), clean=True))


def q_predict_raw(spark, sf):
    """The phrases as they are, only lower-cased and split."""
    return _rounded(predict(_model(spark, sf), _phrases(spark, sf), "stupid", 10))


def q_predict_ranked(spark, sf):
    """Predictions with their place in the answer."""
    return predict(_model(spark, sf), _phrases(spark, sf), "stupid", 10, clean=True, rank_col="rank").drop("prob")


def q_file_lines(spark, sf):
    """The corpus written as text files, many for a large source, and its lines
    read back with their places in the source."""
    path = scratch_path(spark, "line-files")
    write_line_files(document_lines(read_table(spark, sf, "documents"), keep_source=True), path)
    return text_file_lines(spark, path, line_sep="\n", source_of="source=([^/]*)/").select("source", "line_no", "line")


def q_grown_model(spark, sf):
    """A model grown block by block, with its words and n-grams as text."""
    lines = with_blocks(train_lines(_lines(spark, sf)))
    grown = GrowingModel(spark, scratch_path(spark, "growing"))
    for k, (first, last) in enumerate(((1, 60), (61, 90), (91, 100))):
        grown.add(lines.filter(F.col("block").between(first, last)), k)
    m = grown.model()
    out = m.vocab.select(F.lit(1).alias("n"), F.col("word").alias("term"), "count")
    for n, grams, ids in ((2, m.bigrams, ["wi_1", "wi"]), (3, m.trigrams, ["wi_2", "wi_1", "wi"])):
        out = out.unionByName(decode_ids(grams, m.vocab, ids, "term", m.broadcast_ok).select(F.lit(n).alias("n"), "term", "count"))
    return out


def q_predict_status(spark, sf):
    return predict_status(_model(spark, sf), _phrases(spark, sf), clean=True)


def q_predict_formatted(spark, sf):
    return format_predictions(predict(_model(spark, sf), _phrases(spark, sf), "katz", 10, clean=True))


def q_accuracy_top_n(spark, sf):
    return accuracy_top_n(_model(spark, sf), test_lines(_lines(spark, sf)), (1, 3, 5))


def q_perplexity(spark, sf):
    p = perplexity(_model(spark, sf), test_lines(_lines(spark, sf)))
    return p.select("m", round_half_up("sum_log2", 6).alias("sum_log2"),
                    round_half_up("perplexity", 6).alias("perplexity"))


def q_model_roundtrip(spark, sf):
    path = scratch_path(spark, "model")
    save_model(_model(spark, sf), path)
    return table_sizes(load_model(spark, path))


def q_model_reloaded(spark, sf):
    """All rows of a model that was saved, replaced by a rebuild, and read back."""
    path = scratch_path(spark, "model")
    build_or_load(spark, path, lambda: _model(spark, sf))
    m = build_or_load(spark, path, lambda: _model(spark, sf), rebuild=True)
    none = F.lit(None).cast("int")
    return (m.vocab.select(F.lit("vocab").alias("table"), none.alias("wi_2"), none.alias("wi_1"), F.col("idx").alias("wi"), "count")
            .unionByName(m.bigrams.select(F.lit("bigrams").alias("table"), none.alias("wi_2"), "wi_1", "wi", "count"))
            .unionByName(m.trigrams.select(F.lit("trigrams").alias("table"), "wi_2", "wi_1", "wi", "count")))


def q_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    write_int_csv(_model(spark, sf).trigrams, path)
    return read_int_csv(spark, path, ["wi_2", "wi_1", "wi", "count"])


def _q_top250(n):
    return lambda spark, sf: top_terms(_model(spark, sf), n, 250, 3)


def q_stream_ngram_counts(spark, sf):
    from glossa.streaming.jobs import document_line_stream, stream_ngram_counts
    lines = document_line_stream(spark, sf, max_files_per_trigger=1)
    return stream_ngram_counts(lines, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state"))


def q_stream_window_counts(spark, sf):
    """Counts by hour from a stateful stream; a document stands for a minute.
    All files are one batch: they are in no order of time, and of files that
    came one by one, lines would be left out as late."""
    from glossa.streaming.jobs import document_line_stream, stream_windowed_counts
    lines = document_line_stream(spark, sf).withColumn("time", F.timestamp_seconds(F.col("doc_id") * 60))
    found = stream_windowed_counts(lines, "time", scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state"))
    return found.select((F.unix_timestamp("start") / 3600).cast("bigint").alias("hour"), "n", "term", "count")


def q_stream_predict_katz(spark, sf):
    from glossa.streaming.jobs import stream_predictions, table_stream
    phr = conversation_phrases(table_stream(spark, sf, "conversations"))
    return _rounded(stream_predictions(_model(spark, sf), phr, scratch_path(spark, "stream-out"),
                                       scratch_path(spark, "stream-state"), "katz", 10, clean=True))


def q_sweep(spark, sf):
    lines = _lines(spark, sf)
    return sweep(lines, test_lines(lines))


def q_sweep_sizes(spark, sf):
    """Table sizes of all 24 configurations."""
    return sweep(_lines(spark, sf), with_accuracy=False)


def q_sweep_accuracy(spark, sf):
    """Sizes and accuracy of two configurations at opposite ends of the grid."""
    lines = _lines(spark, sf)
    return sweep(lines, test_lines(lines), only=("25_80_TRUE", "100_90_FALSE"))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: Katz top-10 next words for every conversation turn, sf0.001."""
    return q_predict_katz(spark, "/root/testdata/sf0.001")


def _training_data():
    """(queries, SQL) of the training-data subpackage; nothing where its folder is absent."""
    if find_spec("glossa.llm") is None or find_spec("glossa.llm.registry") is None:
        return {}, {}
    from glossa.llm import registry
    found, sql = registry.queries(), registry.oracle_sql()
    if find_spec("corpus_pipeline") is not None:
        import corpus_pipeline
        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL is not None:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _reference_queries() | _training_data()[0]


def _reference_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "corpus_lines": q_corpus_lines,
        "file_lines": q_file_lines,
        "split_train_test": q_split_train_test,
        "block_sample": q_block_sample,
        "clean_lines": q_clean_lines,
        "tokens": q_tokens,
        "ngrams_2": _q_ngrams(2),
        "ngrams_3": _q_ngrams(3),
        "ngrams_4": _q_ngrams(4),
        "doc_term_counts": q_doc_term_counts,
        "ngram_counts": q_ngram_counts,
        "ngram_counts_4": q_ngram_counts_4,
        "merge_counts": q_merge_counts,
        "coverage_cutoff": q_coverage_cutoff,
        "vocabulary": q_vocabulary,
        "bigram_model": q_bigram_model,
        "bigrams_filtered": q_bigrams_filtered,
        "trigram_model": q_trigram_model,
        "decode_trigrams": q_decode_trigrams,
        "context_totals_2": q_context_totals_2,
        "context_totals_3": q_context_totals_3,
        "seen_unseen_mass": q_seen_unseen_mass,
        "model_stats": q_model_stats,
        "top_unigrams": _q_top(1),
        "top_bigrams": _q_top(2),
        "top_trigrams": _q_top(3),
        "top250_unigrams": _q_top250(1),
        "top250_bigrams": _q_top250(2),
        "top250_trigrams": _q_top250(3),
        "stupid_bigram": q_stupid_bigram,
        "stupid_trigram": q_stupid_trigram,
        "katz_bigram": q_katz_bigram,
        "katz_trigram": q_katz_trigram,
        "predict_stupid": q_predict_stupid,
        "predict_katz": q_predict_katz,
        "predict_no_stopwords": q_predict_no_stopwords,
        "predict_formatted": q_predict_formatted,
        "predict_raw": q_predict_raw,
        "predict_status": q_predict_status,
        "predict_ranked": q_predict_ranked,
        "accuracy_top_n": q_accuracy_top_n,
        "perplexity": q_perplexity,
        "model_roundtrip": q_model_roundtrip,
        "model_reloaded": q_model_reloaded,
        "csv_roundtrip": q_csv_roundtrip,
        "grown_model": q_grown_model,
        "stream_ngram_counts": q_stream_ngram_counts,
        "stream_window_counts": q_stream_window_counts,
        "stream_predict_katz": q_stream_predict_katz,
        "sweep": q_sweep,
        "sweep_sizes": q_sweep_sizes,
        "sweep_accuracy": q_sweep_accuracy,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query key."""
    return queries_sql() | _training_data()[1]
