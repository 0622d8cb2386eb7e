"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from llm_fixtures import fixture_rows, frame, tuples  # noqa: E402, F401

from glossa.llm import importance  # noqa: E402

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def plain_features(text, max_n, buckets):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return len(w), [zlib.crc32(b" ".join(w[i:i + n])) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain_scores(rows, target, max_n=1, buckets=10000, seed=2024):
    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for b in plain_features(text, max_n, buckets)[1]:
            s[b] += 1
    for _, text in target:
        for b in plain_features(text, max_n, buckets)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    out = []
    for i, text in rows:
        n, f = plain_features(text, max_n, buckets)
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    return out


def plain_draw(scored, percent, min_words):
    able = sorted((x for x in scored if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    return able[:int(percent * len(able) // 100)]


@pytest.mark.parametrize("max_n,block", [(1, 1 << 19), (1, 64), (3, 1 << 19), (3, 64)])
def test_features_of_any_cut(monkeypatch, fixture_rows, max_n, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    monkeypatch.setattr(importance, "doc_ranges", lambda o: __import__("glossa.llm.textops", fromlist=["x"]).doc_ranges(o, block))
    texts = [t for _, t in fixture_rows] + ["a" * 200 + " b", "x " * 100, "É" * 70 + "-z"]
    got = {}
    for doc, at, _ in importance.features(pa.array(texts), max_n, 97):
        for d, b in zip(doc, at):
            got.setdefault(int(d), []).append(int(b))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted(plain_features(t, max_n, 97)[1]), t


def test_crc_of_all_lengths():
    r = random.Random(1)
    words = [bytes(r.randrange(256) for _ in range(n)) for n in [*range(1, 130), 1, 5, 48, 49]]
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = importance.crc_on(np.zeros(len(words), np.uint32), buf, ends - [len(w) for w in words], ends)
    assert got.tolist() == [zlib.crc32(w) for w in words]


@pytest.mark.parametrize("max_n", [1, 2])
def test_resampling(spark, frame, fixture_rows, max_n):
    rows = fixture_rows + [(None, "one two three " * 9), (3, "again " * 30), (3, "again " * 30)]
    target = [(0, "Alpha x1 e"), (1, None), (2, "")]
    out = importance.resample(frame(rows).withColumn("rank", F.lit("clash")), frame(target, "item_id"), percent=30, min_words=5, max_n=max_n)
    got = out.select("row.doc_id", "n_words", "n_features", "weight", "score", "rank")
    want = plain_scores(rows, target, max_n)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(x)[:5] for x in got.collect()), key=key) == sorted(want, key=key)
    drawn = [tuple(x) for x in got.filter("rank is not null").orderBy("rank").collect()]
    chosen = plain_draw(want, 30, 5)
    assert [x[:5] for x in drawn] == chosen and [x[5] for x in drawn] == list(range(1, len(chosen) + 1))
    assert out.select("row.rank", "row.start").distinct().collect() == [("clash", 7)]


def test_ties_and_repeats(spark):
    ties = spark.createDataFrame([(i, 30, 30, 0, s) for i, s in
                                  [(9, 5), (4, 5), (None, 5), (7, 5), (7, 5), (2, 9), (1, -3), (-2**62, 5), (2**62, 5)]],
                                 "id long, n_words long, n_features long, weight long, score long").withColumn("place", F.monotonically_increasing_id())
    for percent, ids in ((12, [2]), (45, [2, -2**62, 4, 7]), (90, [2, -2**62, 4, 7, 7, 9, 2**62, None])):
        out = importance.draw(ties, percent, 20)
        got = [(r["id"], r["rank"]) for r in out.filter("rank is not null").orderBy("rank").collect()]
        assert got == list(zip(ids, range(1, len(ids) + 1)))
        assert out.count() == 9


def test_nothing_to_draw(spark, frame):
    none = frame([])
    assert importance.resample(none, none).count() == 0
    few = importance.resample(frame([(1, None), (2, ""), (3, "a b")]), none).select("row.doc_id", "n_features", "weight", "rank")
    assert tuples(few) == [(1, 0, 0, None), (2, 0, 0, None), (3, 2, tuples(few)[2][2], None)]


def test_query(spark, tmp_path, fixture_rows):
    rows = [(i, t and (t + " ") * 3) for i, t in fixture_rows]
    bench = [(0, "Alpha beta x1"), (1, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = plain_scores(rows, bench)
    rank = {x[0]: i + 1 for i, x in enumerate(plain_draw(want, 10, 20))}
    got = tuples(importance.op13_importance_resampling(spark, str(tmp_path)))
    assert got == sorted((i, f, w, s, rank.get(i)) for i, _, f, w, s in want) and rank
