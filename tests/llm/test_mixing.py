"""Mixing of sources: targets, permutation, whole mixes."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from llm_fixtures import tuples  # noqa: E402

from glossa.llm import mixing  # noqa: E402

SCHEMA = "doc_id long, text string, source string, shard string, copies int"


def corpus(seed=3):
    r = random.Random(seed)
    words = ["a", "bé", "c-d", "E", "\x85x", "long" * 5]
    text = lambda n: r.choice([" ", "\n", "\t "]).join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randint(0, 60)), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(150)]
    rows += [(200 + i, text(40), None) for i in range(4)] + [(300, "w " * 5000, "big"), (301, "x", "one"), (302, "", "void"), (303, None, "void")]
    rows += [(7, "same text here", "hot")] * 25 + [(7, "other", "hot"), (None, "no id", "s1"), (None, None, None)] + [(304, "é", "é"), (305, "z", "Z")]
    return rows


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight, total, full = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        shares = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and left * weight[s] / shares > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else left * weight[s] / shares for s in order}
        full |= over


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(spark, n):
    df = spark.range(n).withColumn("no", F.lit(3)).withColumn("blocks", F.lit(n).cast("long")).withColumn("keys", mixing._keys(5, F.lit(0)))
    there = df.withColumn("to", mixing.permuted(F.col("id"), F.col("blocks"), F.col("keys"), 5, F.col("no"), F.lit(0)))
    back = there.withColumn("back", mixing.permuted(F.col("to"), F.col("blocks"), F.reverse("keys"), 5, F.col("no"), F.lit(0))).collect()
    assert sorted(r["to"] for r in back) == list(range(n)) and all(r["back"] == r["id"] for r in back)
    if n == 1000:
        assert sum(abs(r["to"] - r["id"]) for r in back) > n * n / 5


@pytest.mark.parametrize("block_words,shard_slots,chunk,piece", [(8, 16, 1 << 16, 1000), (5, 64, 3, 4), (256, 4096, 1 << 12, 1000)])
def test_mix(spark, monkeypatch, block_words, shard_slots, chunk, piece):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    monkeypatch.setattr(mixing, "PIECE", piece)
    rows = corpus()
    df = spark.createDataFrame([(*x, "clash", 9) for x in rows], SCHEMA)
    spans, documents, sources = mixing.mix(df.repartition(5), block_words=block_words, shard_slots=shard_slots)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
    want = plain_targets(sizes)
    found = {r["source"]: r for r in sources.collect()}
    assert {s: (r["source_size"], r["target"]) for s, r in found.items()} == {s: (sizes[s], pytest.approx(want[s], rel=1e-12)) for s in want}

    key = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
    docs = documents.collect()
    no = {s: r["no"] for s, r in found.items()}
    assert sorted(((d["no"], d["doc_id"], d["size"]) for d in docs), key=key) == sorted(((no[s], i, len(words_of(t))) for i, t, s in rows), key=key)
    for n in no.values():  # documents with words lie end to end
        at = 0
        for place, size in sorted((d["place"], d["size"]) for d in docs if d["no"] == n and d["place"] is not None):
            assert place == at
            at += size

    got = spans.collect()
    used, per_doc, slots, shards = Counter(), Counter(), {}, Counter()
    passes = {}
    for r in got:
        used[r["no"]] += r["n_words"]
        per_doc[r["no"], r["place"]] += r["n_words"]
        slots.setdefault((r["shard"], r["slot"]), []).append((r["at"], r["n_words"], r["no"], r["block"], r["pass"]))
    for s, r in found.items():
        assert used[r["no"]] == int(r["target"] + 0.5)
    size = {(d["no"], d["place"]): d["size"] for d in docs if d["place"] is not None}
    assert all(per_doc[k] <= 3 * size[k] for k in per_doc)
    for (shard, slot), parts in slots.items():
        assert shard == slot // shard_slots and len({p[2:] for p in parts}) == 1
        at = 0
        for lo, n, *_ in sorted(parts):
            assert lo == at
            at += n
        assert at <= block_words
        shards[shard] += 1
        assert passes.setdefault((parts[0][2], parts[0][4], parts[0][3]), slot) == slot  # a block once a pass
    assert sorted(s for _, s in slots) == list(range(len(slots)))

    again = mixing.mix(df.repartition(2), block_words=block_words, shard_slots=shard_slots)[0]
    assert tuples(again) == tuples(spans)
    plan = spans._jdf.queryExecution().toString() + documents._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

    texts = {(r["shard"], r["slot"]): r["text"] for r in mixing.slot_texts(spans, df).collect()}
    by_place = {(d["no"], d["place"]): (d["doc_id"], d["digest"]) for d in docs}
    source = {(i, __import__("hashlib").md5((t or "").encode()).hexdigest()): words_of(t) for i, t, _ in rows}
    for key_, parts in slots.items():
        rows_ = sorted((r["at"], r["start"], r["n_words"], r["no"], r["place"]) for r in got if (r["shard"], r["slot"]) == key_)
        assert texts[key_] == " ".join(w for _, a, n, o, p in rows_ for w in source[by_place[o, p]][a:a + n])


def test_shard_counts_follow_the_targets(spark):
    """Shares in the shards scatter as multinomial draws do, and no more."""
    rows = [(i, "w " * 20, f"s{i % 3}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spans, _, sources = mixing.mix(df, block_words=4, shard_slots=500)
    n = Counter((r["shard"], r["no"]) for r in spans.select("shard", "slot", "no").distinct().collect())
    whole = [s for s in range(9)]
    shares = {1: 1 / 6, 2: 2 / 6, 3: 3 / 6}
    for no, p in shares.items():
        seen = [n[s, no] for s in whole]
        assert abs(sum(seen) / len(seen) - 500 * p) < 25 and len(set(seen)) > 3
        assert all(abs(x - 500 * p) < 5 * (500 * p * (1 - p)) ** 0.5 for x in seen)


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, " ", None)]])
def test_nothing_to_mix(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert tuples(mixing.op12_source_mixing(spark, str(tmp_path))) == [(i, 0, 0, 0.0, 0) for i, _, _ in rows]


def test_query(spark, tmp_path):
    rows = corpus(8)
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = mixing.op12_source_mixing(spark, str(tmp_path))
    got = out.collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
    want, key = plain_targets(sizes), lambda t: (t[0] is None, t[0] or 0, t[1:])
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got), key=key) == sorted(
        ((i, len(words_of(t)), sizes[s], round(want[s], 6)) for i, t, s in rows), key=key)
    assert sum(r["taken"] for r in got) == sum(int(t + 0.5) for t in want.values()) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
