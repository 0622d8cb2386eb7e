"""Line files, phrase identity, stored models, streams that resume."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from glossa.operators.counting import doc_term_counts, line_tokens, ngram_counts
from glossa.plans.predict import predict, predict_one, predict_status
from glossa.session import scratch_path
from glossa.sources.corpus import conversation_phrases, document_lines, read_table, text_file_lines
from glossa.sources.model_io import build_or_load, current_version, load_model, model_exists, save_model


def test_file_lines_keep_identity_and_order(spark, tmp_path):
    lines = [f"line {i % 3}" for i in range(400)]
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # several splits of each file
    try:
        df = text_file_lines(spark, str(tmp_path))
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    by = {}
    for r in rows:
        by.setdefault(r.source, {})[r.line_no] = r.line
    assert len(by) == 2 and all([v[i] for i in range(400)] == lines for v in by.values()) and len(rows) == 800
    assert doc_term_counts(line_tokens(df), (1,)).filter("count > 1").count() == 0


def test_phrases_keep_conv_and_turn(spark, toy_full):
    conv = spark.createDataFrame([(1, 1000, "on the"), (2, 0, "the cat"), (3, 0, "cat"), (4, 1, None), (5, 0, "")],
                                 "conv_id long, turn long, text string")
    phrases = conversation_phrases(conv)
    got = predict(toy_full, phrases, "stupid", 1)
    assert {(r.conv_id, r.turn): r.word for r in got.collect()} == {(1, 1000): "mat", (2, 0): "sat"}
    status = {(r.conv_id, r.turn): (r.n_words, r.status, r.n_known) for r in predict_status(toy_full, phrases).collect()}
    assert status == {(1, 1000): (2, "ok", 2), (2, 0): (2, "ok", 2), (3, 0): (1, "too_short", 0), (4, 1): (0, "too_short", 0),
                      (5, 0): (1, "too_short", 0)}


def test_one_phrase(spark, toy_full):
    assert predict_one(toy_full, "on the", k=1).first().word == "mat"
    for text, clean in (("cat", False), ("cat 123", True)):
        with pytest.raises(ValueError):
            predict_one(toy_full, text, clean=clean)


def test_stop_list_is_the_callers(spark, toy_full):
    phrases = spark.createDataFrame([(1, "on the")], "id long, phrase string")
    with pytest.raises(ValueError):
        predict(toy_full, phrases, include_stop_words=False)
    for words in (["mat"], spark.createDataFrame([("mat",), ("mat",)], "x string")):
        got = predict(toy_full, phrases, "stupid", 1, include_stop_words=False, stop_words=words).collect()
        assert [r.word for r in got] == ["hat"]


def test_versions(spark, toy_full, toy_cut):
    path = scratch_path(spark, "t-versions")
    assert not model_exists(spark, path)
    with pytest.raises(FileNotFoundError):
        load_model(spark, path)
    first = build_or_load(spark, path, lambda: toy_full)
    assert build_or_load(spark, path, lambda: toy_cut) is first
    second = build_or_load(spark, path, lambda: toy_cut, rebuild=True)
    assert (first.vocab_size, second.vocab_size) == (10, 5) and load_model(spark, path).vocab_size == 5
    assert first.bigrams.count() == 11 and second.bigrams.exceptAll(toy_cut.bigrams).count() == 0
    newest = current_version(spark, path)
    toy_full.vocab.write.parquet(f"{path}/v-99999999999999999999-cut/vocab")  # a save that was cut short
    assert current_version(spark, path) == newest


def test_stored_tables_are_pruned(spark, sf001_model):
    path = scratch_path(spark, "t-pruned")
    save_model(sf001_model, path)
    plan = load_model(spark, path).bigrams.filter("wi_1 = 5").select("wi")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(wi_1,5)" in plan and "ReadSchema: struct<wi_1:int,wi:int>" in plan


def test_reload_after_a_restart(tmp_path):
    script = textwrap.dedent(f"""
        from glossa.session import get_session
        from glossa.sources.model_io import load_model, save_model
        from glossa.plans.build import build_model
        from glossa.sources.corpus import document_lines, read_table
        for turn in range(2):
            spark = get_session("local[2]", 2)
            if not turn:
                save_model(build_model(document_lines(read_table(spark, "{SF001}", "documents"))), "{tmp_path}/m")
            print("COUNT", load_model(spark, "{tmp_path}/m").bigrams.count())
            spark.stop()
    """)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", script], cwd=root, capture_output=True, text=True, timeout=240,
                         env=os.environ | {"PYTHONPATH": root, "GLOSSA_DRIVER_MEMORY": "2g"})
    assert out.stdout.split() == ["COUNT", "6070"] * 2, out.stderr[-2000:]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    from glossa.streaming.jobs import document_line_stream, stream_ngram_counts, stream_predictions
    docs = read_table(spark, SF001, "documents")
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    os.makedirs(folder)
    for i in range(3):
        docs.filter(F.col("doc_id") % 3 == i).coalesce(1).write.parquet(f"{folder}/tmp{i}")
        part = next(f for f in os.listdir(f"{folder}/tmp{i}") if f.endswith(".parquet"))
        os.replace(f"{folder}/tmp{i}/{part}", f"{folder}/documents{i}.parquet")
        lines = document_line_stream(spark, folder, max_files_per_trigger=1, schema=docs.schema)
        counts = stream_ngram_counts(lines, out, state)
    again = stream_ngram_counts(document_line_stream(spark, folder, schema=docs.schema), out, state)
    want = ngram_counts(line_tokens(document_lines(docs)))
    assert again.exceptAll(want).count() == 0 and want.exceptAll(again).count() == 0 and counts.count() == want.count()


def test_predicting_stream_does_not_repeat(spark, toy_full, tmp_path):
    from glossa.streaming.jobs import stream_predictions
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, "on the"), (2, 0, "the cat")], "conv_id long, turn long, text string").write.parquet(folder)
    for _ in range(2):
        phrases = conversation_phrases(spark.readStream.schema("conv_id long, turn long, text string").parquet(folder))
        got = stream_predictions(toy_full, phrases, str(tmp_path / "out"), str(tmp_path / "state"), "stupid", 1)
    assert got.count() == 2


def test_stored_order(spark, sf001_model):
    """Files in order, and rows within them, follow the context."""
    path = scratch_path(spark, "t-order")
    at = save_model(sf001_model, path)
    for name, keys in (("bigrams", ["wi_1", "wi"]), ("trigrams", ["wi_2", "wi_1", "wi"])):
        rows = spark.read.parquet(f"{at}/{name}").select(F.input_file_name().alias("f"), *keys).collect()
        files = {}
        for r in rows:
            files.setdefault(r.f.rsplit("/", 1)[1], []).append(tuple(r)[1:])
        flat = [x for f in sorted(files) for x in files[f]]
        assert flat == sorted(flat) and len(files) > 1


def test_scratch_is_released(spark, toy_full):
    from glossa.session import _SCRATCH, materialise, release_scratch
    app = spark.sparkContext.applicationId
    others, _SCRATCH[app] = _SCRATCH.get(app, []), []
    materialise(toy_full.vocab, "t-scratch")
    folder = _SCRATCH[app][0].removeprefix("file:")
    assert os.path.isdir(folder) and release_scratch(spark) == 1 and not os.path.exists(folder)
    _SCRATCH[app] = others
