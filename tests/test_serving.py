"""Ranked followers, gaps and the joins that read them in place."""

import random
import re

import pytest
from pyspark.sql import functions as F

from brute import DenseModel
from conftest import SF001
from glossa.operators.ranking import all_missing, first_missing, group_starts, positions
from glossa.operators.serving import serving
from glossa.plans.build import model_from_tokens
from glossa.operators.counting import line_tokens
from glossa.plans.predict import context_predictions, predict
from glossa.session import scratch_path
from glossa.sources.corpus import conversation_phrases, read_table
from glossa.sources.model_io import load_model, save_model


def test_positions_and_missing_numbers(spark):
    r = random.Random(2)
    rows = sorted({(g, r.randint(1, 40)) for g in (1, 2, 2, 2, 5) for _ in range(15)} | {(9, i) for i in range(1, 400)} | {(7, 3)})
    df = spark.createDataFrame(rows, "g int, x int").repartition(7)
    placed = positions(df, ["g", F.desc("x")])
    assert [(x.g, x.x) for x in placed.orderBy("place").collect()] == sorted(rows, key=lambda t: (t[0], -t[1]))
    assert [x.place for x in placed.orderBy("place").collect()] == list(range(1, len(rows) + 1))
    starts = {x.g: (x.start, x.members) for x in group_starts(placed, ["g"]).collect()}
    assert starts[9][1] == 399 and starts[1][0] == 1
    got = {x.g: x.missing for x in first_missing(df, ["g"], "x", 4).collect()}
    for g in {g for g, _ in rows}:
        have = {x for h, x in rows if h == g}
        want = [i for i in range(1, 500) if i not in have][:4]
        assert got.get(g, [1, 2, 3, 4]) == want
    assert spark.range(1).select(all_missing(2).alias("m")).first().m == [1, 2]
    assert positions(df.filter("false"), ["g", "x"]).count() == 0


def test_tables_against_plain_ones(spark, sf001_model):
    m = sf001_model
    s = serving(m)
    bi = m.bigrams.toPandas()
    voc = m.vocab.toPandas().sort_values(["count", "idx"], ascending=[False, True])
    pos = {w: i + 1 for i, w in enumerate(voc.idx)}
    foll = s.followers.toPandas()
    assert len(foll) == len(bi)
    some = set(foll.v.value_counts().index[:3]) | set(foll.v.drop_duplicates().sample(40, random_state=1))
    foll_rank = {(r.v, r.w): r.rank for r in foll.itertuples()}
    foll, bi = foll[foll.v.isin(some)], bi[bi.wi_1.isin(some)]
    by_v = {v: g.sort_values(["count", "wi"], ascending=[False, True]) for v, g in bi.groupby("wi_1")}
    for v, g in foll.groupby("v"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, len(g) + 1)) and list(g.w) == list(by_v[v].wi)
        assert list(g["last"]) == [int((g.c2 >= c).sum()) for c in g.c2]
    gaps = s.gaps.toPandas()
    gaps = gaps[gaps.v.isin(some)]
    for v, g in gaps.groupby("v"):
        g = g.sort_values("ordinal")
        unseen = sorted(set(range(1, len(pos) + 1)) - {pos[w] for w in by_v[v].wi})
        assert [p for a, n in zip(g["first"], g.length) for p in range(a, a + n)] == unseen
        assert list(g.ordinal) == [1 + int(x) for x in g.length.cumsum() - g.length]
    for (u, v), g in s.contexts.toPandas().groupby(["u", "v"]):
        ranks = sorted(foll_rank[v, w] for w in g.w)
        assert sorted(g.r2) == ranks and {r.r2: r.free for r in g.itertuples()} == {x: x - i - 1 for i, x in enumerate(ranks)}
        assert (g.t3 == g.c3.sum()).all()


@pytest.mark.parametrize("k,stops", [(1, None), (3, (1, 4))])
def test_every_context_of_a_small_model(spark, k, stops):
    """All contexts, words with all or no followers, ties everywhere."""
    r = random.Random(5)
    text = [" ".join(r.choice("aabcdefg") for _ in range(r.randint(1, 9))) for _ in range(60)] + ["x y", "x y", "a a", "a x"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id long, line_no int, line string")
    m = model_from_tokens(line_tokens(df, []), None, True)
    dense = DenseModel(m.vocab.toPandas(), m.bigrams.toPandas(), m.trigrams.toPandas())
    ids = [0, *range(1, m.vocab_size + 1)]
    ctx = spark.createDataFrame([(u, v) for u in ids for v in ids], "u int, v int")
    stop = stops and spark.createDataFrame([(x,) for x in stops], "idx int")
    got = {}
    for x in context_predictions(m, ctx, "stupid", k, stop_idx=stop).collect():
        got.setdefault((x.u, x.v), {})[x.w] = x.prob
    for u in ids:
        for v in ids:
            assert got[u, v] == pytest.approx(dense.top(u, v, "stupid", k, stops or ()), abs=1e-12), (u, v)


def ancestors_of_scans(plan: str, name: str):
    """For each scan of a stored table, the nodes above it up to the first join or aggregate."""
    lines = [(max(x.rfind("+-"), x.rfind(":-")), x) for x in plan.splitlines() if re.search(r"[:+]-", x)]
    for i, (depth, x) in enumerate(lines):
        if "FileScan" in x and name in x:
            up = []
            for d, y in reversed(lines[:i]):
                if d < depth:
                    depth = d
                    up.append(y)
                    if re.search("Join|Aggregate", y):
                        break
            yield up


def test_the_model_stays_where_it_is(spark, sf001_model):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    path = scratch_path(spark, "t-serving")
    save_model(sf001_model, path)
    m = load_model(spark, path)
    phrases = conversation_phrases(read_table(spark, SF001, "conversations"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = predict(m, phrases, "katz", 10, clean=True)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        constants = m.ctx3()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for name in ("contexts", "followers", "gaps", "katz3"):
        found = list(ancestors_of_scans(plan, f"glossa_{name}_"))
        assert found and not any("Exchange" in y for up in found for y in up), name
    assert "Exchange" not in constants
    windows = re.findall(r"Window \[.*", plan)
    assert windows and all(re.search(r"rank\(.*windowspecdefinition\(u#\d+, v#\d+,", w) for w in windows)
