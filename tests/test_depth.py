"""Large word lists, other tokenizers, sources in many files, versions that go."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from glossa.functions.text import removal_pattern, word_list_pattern
from glossa.operators.counting import line_tokens, ngram_counts
from glossa.plans.build import build_model
from glossa.session import scratch_path
from glossa.sources.corpus import text_file_lines, write_line_files
from glossa.sources.model_io import current_version, load_model, release_lease, remove_old_versions, save_model


def test_tree_of_words_equals_the_list():
    r = random.Random(3)
    for _ in range(300):
        words = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 9))}
        text = "".join(r.choice("abc  -_") for _ in range(60))
        assert re.sub(removal_pattern(words), "#", text) == re.sub(word_list_pattern(words), "#", text), (words, text)
    assert removal_pattern([]) is None and removal_pattern(["", None]) is None


def test_entries_are_removed_as_written(spark):
    p = removal_pattern(["c++", "a.b", "(x", "f(", "$", "it's", "two words", "^"])
    df = spark.createDataFrame([("c++ cc a.b axb (x f(1 f( $ it's two words ^ c+",)], "t string")
    assert df.select(F.regexp_replace("t", p, "#").alias("t")).first().t == "# cc # axb # f(1 # # # # # c+"


def test_fifty_thousand_words(spark):
    r = random.Random(1)
    words = list({"".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(51000)})
    lines = [" ".join(r.choice(words) if r.random() < 0.1 else "w" + str(r.random()) for _ in range(30)) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in lines], "t string").repartition(4).persist()
    df.count()

    def run(some):
        out = df.select(F.regexp_replace("t", removal_pattern(some), "").alias("t"))
        out.agg(F.sum(F.length("t"))).first()
        t = time.time()
        n = out.agg(F.sum(F.length("t"))).first()[0]
        return time.time() - t, n

    few, many = run(words[:500]), run(words)
    df.unpersist()
    whole = set(words)
    assert many[1] == sum(len(re.sub(r"\w+", lambda m: "" if m[0] in whole else m[0], x)) for x in lines)
    assert many[0] < 10 * few[0] + 2  # a hundred times the words


def test_any_tokenizer(spark):
    lines = spark.createDataFrame([(1, i, "ab-cd ef ab") for i in range(3)], "doc_id long, line_no int, line string")
    letters = lambda c: F.filter(F.split(F.translate(c, " ", ""), ""), lambda x: x != "")
    tokens = line_tokens(lines, [], tokenizer=letters)
    assert tokens.first().tokens == list("ab-cdefab")
    assert {r.term: r["count"] for r in ngram_counts(tokens, (2,)).collect()}["a b"] == 6
    m = build_model(lines, cutoff=None, prop=1.0, remove_words=[], tokenizer=lambda c: F.split(c, "[ -]"))
    assert sorted(r.word for r in m.vocab.collect()) == ["ab", "cd", "ef"]


def test_sources_in_many_files(spark):
    rows = [("hot", i // 50, i % 50, f"line {i % 7}") for i in range(1200)] + [("cold", 5, 0, "one"), ("cold", 9, 3, ""), ("s p", 1, 0, "x")]
    path = scratch_path(spark, "t-files")
    write_line_files(spark.createDataFrame(rows, "source string, doc_id long, line_no int, line string").repartition(5), path, partitions=12)
    found = text_file_lines(spark, path, "\n", r"source=([^/]*)/")
    files = spark.read.text(path).select(F.input_file_name().alias("f")).filter("f like '%source=hot%'").distinct().count()
    assert files >= 8
    got = sorted((r.source, r.line_no, r.line) for r in found.collect())
    want, n = [], {}
    for s, _, _, line in sorted(rows):
        s = s.replace(" ", "%20")
        want.append((s, n.get(s, 0), line))
        n[s] = n.get(s, 0) + 1
    assert got == sorted(want)


def test_old_versions_go_and_read_ones_stay(spark, toy_full, toy_cut):
    path = scratch_path(spark, "t-retention")
    first = save_model(toy_full, path)
    reader = load_model(spark, path, lease=True)
    second, third = save_model(toy_cut, path), save_model(toy_cut, path)
    toy_cut.vocab.write.parquet(f"{path}/v-{time.time_ns():020d}-cut/vocab")  # a save under way
    assert remove_old_versions(spark, path) == [second]
    assert reader.bigrams.count() == 11 and current_version(spark, path) == third  # the reader's version is whole
    release_lease(spark, reader.lease)
    assert remove_old_versions(spark, path) == [first]
    assert len(remove_old_versions(spark, path, grace_hours=0)) == 1 and current_version(spark, path) == third
    with pytest.raises(ValueError):
        remove_old_versions(spark, path, keep=0)
