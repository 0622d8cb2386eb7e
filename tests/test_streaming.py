"""Counts that grow: tiers, crashes, event time and late lines."""

import datetime as dt
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from glossa.operators.counting import line_tokens, ngram_counts
from glossa.streaming.jobs import (STATE_ON_DISK, ngrams_of_changes, stream_ngram_counts, stream_windowed_counts,
                                   windowed_ngram_counts)
from glossa.streaming.tiers import TieredCounts

SCHEMA = "doc_id long, line_no int, line string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_tiers_stay_few(spark, tmp_path):
    store = TieredCounts(spark, f"{tmp_path}/s", fan=2)
    assert store.counts() is None and store.vacuum() == 0
    total = {}
    for epoch in range(9):
        batch = [(1, f"w{epoch % 3}", 1 + epoch), (1, "all", 1)]
        for n, t, c in batch:
            total[n, t] = total.get((n, t), 0) + c
        assert store.add(spark.createDataFrame(batch, "n int, term string, count long").coalesce(1), epoch)
        parts = store.manifest()["parts"]
        assert len(parts) == bin(epoch + 1).count("1")  # one a tier: a logarithm of the batches
        assert sorted((p["first"], p["last"]) for p in parts)[0][0] == 0
    assert not store.add(spark.createDataFrame([(1, "all", 99)], "n int, term string, count long"), 8)  # a replay
    want = sorted((n, t, c) for (n, t), c in total.items())
    assert rows(store.counts()) == want
    folders = lambda: sum(len(os.listdir(f"{tmp_path}/s/parts/{t}")) for t in os.listdir(f"{tmp_path}/s/parts"))
    before = folders()
    assert store.vacuum(keep=1) == before - 2 and folders() == 2 and rows(store.counts()) == want


def put(spark, folder, name, data, schema):
    tmp = f"{folder}-{name}"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(tmp)
    os.makedirs(folder, exist_ok=True)
    part = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
    os.replace(f"{tmp}/{part}", f"{folder}/{name}.parquet")


def test_crash_between_merge_and_manifest(spark, tmp_path, monkeypatch):
    folder, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    data = [[(i, 0, f"line {i} of some text"), (i, 1, "the same line")] for i in range(5)]
    publish, fails = TieredCounts._publish, [2]

    def breaks(self, new):
        if new["epoch"] in fails:
            fails.remove(new["epoch"])
            raise RuntimeError("cut off")
        publish(self, new)

    monkeypatch.setattr(TieredCounts, "_publish", breaks)
    got = None
    for i, batch in enumerate(data):
        put(spark, folder, f"f{i}", batch, SCHEMA)
        run = lambda: stream_ngram_counts(spark.readStream.schema(SCHEMA).parquet(folder), out, state, fan=3)
        if i == 2:  # three parts are merged, then the manifest is not written
            with pytest.raises((RuntimeError, PySparkException)):
                run()
            store = TieredCounts(spark, out, 3)
            assert store.manifest()["epoch"] == 1 and os.listdir(f"{out}/parts/counts-1")
            assert rows(store.counts()) == rows(ngram_counts(line_tokens(spark.createDataFrame(data[0] + data[1], SCHEMA))))
        got = run()
    assert rows(got) == rows(ngram_counts(line_tokens(spark.createDataFrame(sum(data, []), SCHEMA))))
    assert len(TieredCounts(spark, out, 3).manifest()["parts"]) == 3 and TieredCounts(spark, out, 3).vacuum(1) >= 2


def test_event_time_with_a_restart_and_a_late_file(spark, tmp_path):
    schema = SCHEMA + ", time timestamp"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    files = [[(1, 0, "a b a", at(0.2)), (1, 1, "b c", at(1.5))],
             [(2, 0, "a b", at(10.1)), (2, 1, "c c c", at(12.0))],
             [(3, 0, "a b", at(11.5)), (3, 1, "late but counted", at(10.2))]]
    too_late = [(4, 0, "a b too late", at(1.2))]
    folder, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    read = lambda: stream_windowed_counts(spark.readStream.schema(schema).parquet(folder), "time", out, state, "1 hour", "2 hours")
    put(spark, folder, "f0", files[0], schema)
    read()
    put(spark, folder, "f1", files[1], schema)
    read()  # the watermark is now 10:00
    put(spark, folder, "f2", files[2] + too_late, schema)
    got = read()  # started again from the checkpoint
    batch = windowed_ngram_counts(spark.createDataFrame(sum(files, []), schema), "time", "1 hour")
    assert rows(got) == rows(batch)
    assert rows(got.filter(F.col("term") == "a b").select("count")) == [(1,), (1,), (1,)]


def test_tables_stored_as_folders(spark, tmp_path):
    """A table of many files in no order of time: no line is missed, none is late."""
    import __spark_entry__ as e
    docs = spark.createDataFrame([(i, f"a b a\nthe line {i % 3} of the text", "en", "x") for i in (500, 501, 502, 0, 1, 2, 3)],
                                 "doc_id long, text string, lang string, source string")
    docs.repartitionByRange(3, -F.col("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, "a b") for i in range(4)], "conv_id long, turn int, text string").repartition(2).write.parquet(
        f"{tmp_path}/conversations.parquet")
    got, (lines, q) = str(tmp_path), (e._lines, e.queries())
    tokens = line_tokens(lines(spark, got).withColumn("time", F.timestamp_seconds(F.col("doc_id") * 60)), keep=("time",))
    assert rows(q["stream_ngram_counts"](spark, got)) == rows(ngram_counts(tokens))
    timed = lines(spark, got).withColumn("time", F.timestamp_seconds(F.col("doc_id") * 60))
    want = windowed_ngram_counts(timed, "time", "1 hour").select((F.unix_timestamp("start") / 3600).cast("bigint").alias("hour"), "n", "term", "count")
    assert rows(q["stream_window_counts"](spark, got)) == rows(want)
    found = rows(q["stream_predict_katz"](spark, got))
    assert found and found == rows(q["predict_katz"](spark, got))


def test_windows_keep_one_row_a_position(spark, tmp_path):
    """F1 of round 4: state and changes hold the longest n-gram at each place, not one row an order; the newest
    counts of two batches are added up to all orders; a batch saves what it changed; settings are as before."""
    schema = SCHEMA + ", time timestamp"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    files = [[(1, 0, "a b c a b c d", at(0.2)), (1, 1, "b", at(0.3)), (1, 2, "", at(0.3)), (2, 0, None, at(0.4))],
             [(1, 0, "a b c a b c d", at(0.5)), (None, 0, "a b", at(0.6)), (None, 0, "a b", at(1.6))]]
    folder, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    conf = {name: spark.conf.get(name, None) for name in STATE_ON_DISK}
    for k, batch in enumerate(files):
        put(spark, folder, f"f{k}", batch, schema)
        got = stream_windowed_counts(spark.readStream.schema(schema).parquet(folder), "time", out, state)
    assert {name: spark.conf.get(name, None) for name in STATE_ON_DISK} == conf
    changes = spark.read.parquet(out)
    assert [r["count"] for r in changes.groupBy("epoch").count().orderBy("epoch").collect()] == [7, 10]  # of 12 and 15 terms
    every = spark.createDataFrame(sum(files, []), schema)
    assert rows(got) == rows(windowed_ngram_counts(every, "time", "1 hour"))
    assert rows(ngrams_of_changes(changes, (2,))) == rows(windowed_ngram_counts(every, "time", "1 hour", (2,)))
    kept = [f for _, _, names in os.walk(state) for f in names]
    assert any(f.endswith(".changelog") for f in kept) and not any(f.endswith((".sst", ".zip")) for f in kept)
