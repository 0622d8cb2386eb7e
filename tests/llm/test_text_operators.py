"""Substrings, near-duplicates, benchmark overlap against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute_llm as brute  # noqa: E402
from llm_fixtures import fixture_rows, frame, tuples  # noqa: E402, F401

from glossa.llm import decontaminate, neardup, substrings, textops  # noqa: E402


def test_words_and_hashes():
    texts = ["a bb a", "", "É x\ty\n", "word " * 5, "x" * 1000]
    buf, offs = textops.text_buffer(pa.array(texts))
    w = textops.Words(buf, offs, textops.PLAIN)
    got = [buf[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)]
    assert got == [x for t in texts for x in brute.PLAIN.findall(t)]
    same = {}
    for word, h in zip(got, w.hashes.tolist()):
        assert same.setdefault(word, h) == h
    assert len(set(same.values())) == len(same)
    grams = textops.gram_hashes(w.hashes, 3)
    seen = {}
    for i in range(len(got) - 2):
        assert seen.setdefault(tuple(got[i:i + 3]), grams[i]) == grams[i]
    a = np.array([5, 3, 8, 1, 9, 2, 7], dtype=np.uint64)
    for k in range(1, 8):
        assert textops.sliding_min(a, k).tolist() == [min(a[i:i + k]) for i in range(len(a) - k + 1)]


def test_fold_and_alnum_classes():
    t = "Ab-c É_x\x00Y 12,Z"
    buf, offs = textops.text_buffer(pa.array([t]))
    w = textops.Words(buf, offs, textops.ALNUM)
    assert [buf[a:b].tobytes().decode().translate(brute.FOLD) for a, b in zip(w.starts, w.ends)] == brute.ALNUM.findall(t.translate(brute.FOLD))
    x, y = (textops.Words(*textops.text_buffer(pa.array([s])), textops.FOLDED).hashes for s in ("AbC", "abc"))
    assert x[0] == y[0]


def test_deep_nodes():
    r = random.Random(1)
    s = np.array([r.randrange(3) for _ in range(300)], dtype=np.uint64)
    for depth in (1, 3, 7, 16):
        node = substrings.deep_leaves(s, depth)
        seen = {}
        for i, x in enumerate(node):
            assert seen.setdefault(tuple(s[i:i + depth]), x) == x
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("group", [1 << 14, 1])
def test_substrings(frame, fixture_rows, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    out = substrings.remove_repeats(frame(fixture_rows), depth=16).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert tuples(out) == sorted(brute.substrings(fixture_rows, 16))


def test_substrings_repeated_rows_and_empty(frame):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (None, "other " + text), (2, text.upper())]
    got = {(d, n) for d, _, n, _ in substrings.remove_repeats(frame(rows)).collect()}
    assert got == {(1, 40), (None, 40), (2, 0)}
    assert substrings.remove_repeats(frame([])).collect() == []


@pytest.mark.parametrize("block", [1024, 2])
def test_near_duplicates(frame, fixture_rows, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    assert tuples(neardup.near_duplicates(frame(fixture_rows))) == sorted(brute.near_duplicates(fixture_rows))


def test_near_duplicates_chain_and_edges(frame):
    base = [f"t{i}" for i in range(200)]
    chain = [(10 + k, " ".join(base[:200 - 0] [3 * k:] + [f"n{k}_{i}" for i in range(3 * k)])) for k in range(12)]
    rows = chain + [(None, chain[0][1]), (3, None), (4, ""), (5, "a b"), (6, "A b"), (7, "a  B")]
    got = tuples(neardup.near_duplicates(frame(rows)))
    want = brute.near_duplicates([x for x in rows if x[0] is not None])
    assert [x for x in got if x[0] is not None] == sorted(want)
    assert [x for x in got if x[0] is None][0][2:] == (None, True)
    assert neardup.near_duplicates(frame([])).collect() == []


def test_registers_merge_and_estimate():
    r = np.random.default_rng(2)
    a, b = (np.unique(r.integers(0, 1 << 63, 400).astype(np.uint64)) for _ in range(2))
    both = np.union1d(a, b)
    x = neardup.registers([a, b, both])
    assert (np.maximum(x[0], x[1]) == x[2]).all()
    near = np.concatenate([a[:380], b[:20]])
    far = np.concatenate([a[:200], b[:200]])
    s = neardup.registers([a, near, far])
    n = np.array([400, 400])
    ok = neardup.credible(np.stack([s[0], s[0]]), s[1:], n, n, 85)
    assert ok.tolist() == [True, False]


def test_common_counts():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 50, 30).astype(np.uint64)) for _ in range(9)]
    got = neardup.common_counts(sets)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(x, y))


@pytest.mark.parametrize("block_bytes", [16 << 20, 300])
def test_overlaps(frame, fixture_rows, block_bytes):
    r = random.Random(9)
    texts = [t for _, t in fixture_rows if t and len(t.split()) > 30]
    items = [(100 + k, " ".join(r.choice(texts).split()[5:5 + n])) for k, n in enumerate((10, 25, 12, 4, 1, 14, 11))]
    items += [(200, None), (201, ""), (None, " ".join(texts[0].split()[2:14])), (100, " ".join(texts[1].split()[:11]))]
    found = decontaminate.find_overlaps(frame(fixture_rows), frame(items, "item_id"), keep=["doc_id"], block_bytes=block_bytes)
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    out = found.select("row.doc_id", "n_words", decontaminate.hit_words(), F.size("items"), F.sha2(F.concat_ws(",", ids), 256), F.size("spans") > 0)
    assert tuples(out) == sorted(brute.overlaps(fixture_rows, items))


def test_overlaps_empty(frame, fixture_rows):
    none = decontaminate.find_overlaps(frame(fixture_rows), frame([], "item_id"))
    assert none.filter(F.size("spans") > 0).count() == 0 and none.count() == len(fixture_rows)
    assert set(none.select("row.*").columns) == {"doc_id", "text", "row", "score", "start"}
    assert decontaminate.find_overlaps(frame([]), frame([(1, "a b")], "item_id")).count() == 0
