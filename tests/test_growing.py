"""A model that grew block by block equals one build over all lines."""

from pyspark.sql import functions as F

from conftest import SF001
from glossa.operators.encode import decode_ids
from glossa.operators.split import train_lines, with_blocks
from glossa.plans.growing import GrowingModel
from glossa.session import scratch_path
from glossa.sources.corpus import document_lines, read_table


def words_of(m):
    out = []
    for table, ids in ((m.bigrams, ["wi_1", "wi"]), (m.trigrams, ["wi_2", "wi_1", "wi"])):
        out.append({(r.term, r["count"]) for r in decode_ids(table, m.vocab, ids).select("term", "count").collect()})
    return [{(r.word, r["count"], round(r.prob, 12)) for r in m.vocab.collect()}, *out]


def test_blocks_equal_one_build(spark, sf001_model):
    lines = with_blocks(train_lines(document_lines(read_table(spark, SF001, "documents"))))
    g = GrowingModel(spark, scratch_path(spark, "t-growing"), fan=2)
    ids, tables = {}, None
    for k, (lo, hi) in enumerate([(1, 60), (61, 90), (91, 100)]):
        block = lines.filter(F.col("block").between(lo, hi))
        assert g.add(block, k)
        now = {r.word: r.idx for r in g.dictionary().collect()}
        assert ids.items() <= now.items() and sorted(now.values()) == list(range(1, len(now) + 1))  # ids stay
        ids = now
        tables = words_of(g.model()) if k == 2 else None
    assert not g.add(lines, 2)  # a block that is repeated
    assert tables == words_of(sf001_model)
    assert len([p for p in g.store.manifest()["parts"] if p["table"] == "counts"]) == 2  # three blocks, one merged pair


def test_work_follows_the_block(spark, monkeypatch):
    """A block of known words adds nothing to the dictionary and counts its own lines only."""
    df = lambda text: spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id long, line_no int, line string")
    g = GrowingModel(spark, scratch_path(spark, "t-growing"), remove_words=[], fan=9)
    g.add(df(["a b c a b"] * 50 + ["rare d"]), 0)
    g.add(df(["a b", "d d d"]), 1)
    parts = {(p["table"], p["first"]): spark.read.parquet(f"{g.store.path}/parts/{p['name']}").count() for p in g.store.manifest()["parts"]}
    assert parts["words", 1] == 0 and parts["counts", 1] == 6  # a, b, d; a b, d d; d d d
    before, after = ({r.word for r in g.model(0.99, False).vocab.collect()} for _ in range(2))
    assert before == after
    m = g.model(None, False)
    assert {(r.term, r["count"]) for r in decode_ids(m.bigrams, m.vocab, ["wi_1", "wi"]).select("term", "count").collect()} == {
        ("a b", 101), ("b c", 50), ("c a", 50), ("rare d", 1), ("d d", 2)}
