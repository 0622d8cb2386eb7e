"""The benchmark side of the join: windows against plain ones, and its cost."""

import random
import re
import subprocess
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_fixtures import fixture_rows, frame, tuples  # noqa: E402, F401

from glossa.llm import decontaminate  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def test_windows_and_their_items(fixture_rows):
    r = random.Random(3)
    items = [(i % 17 if i % 11 else None, t) for i, t in enumerate([t for _, t in fixture_rows] * 2)] + [(5, "one two"), (6, "Two one two")]
    r.shuffle(items)
    w = decontaminate.Windows([t for _, t in items], [i for i, _ in items], 10)
    want: dict = {}
    for i, t in items:
        x = words_of(t)
        k = min(10, len(x))
        for a in range(len(x) - k + 1 if x else 0):
            want.setdefault(tuple(x[a:a + k]), set()).add(i)
    name = {}
    flat = [x for _, t in items for x in words_of(t)]
    for h, x in zip(w.flat.tolist(), flat, strict=True):
        assert name.setdefault(h, x) == x
    got = {tuple(name[h] for h in w.flat[a:a + n].tolist()): w.item[p:q].tolist()
           for a, n, p, q in zip(w.start, w.length, w.first[:-1], w.first[1:], strict=True)}
    assert len(got) == len(w.start) and got == {k: sorted(x for x in v if x is not None) for k, v in want.items()}


@pytest.mark.parametrize("megabytes", [16])
def test_a_whole_block_on_the_driver(megabytes):
    """A block of the largest size, indexed in a process of its own."""
    code = f"""
import random, resource, sys, time
import numpy as np
sys.path.insert(0, {str(Path(__file__).parents[2])!r})
from glossa.llm import decontaminate as d
r = random.Random(1)
vocab = ["w%x" % r.randrange(1 << 20) for _ in range(30000)]
texts = [" ".join(r.choices(vocab, k=180)) for _ in range({megabytes} << 20 >> 10)]
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
d._rarity = lambda docs, col, keys: {{s: (k, (k % np.uint64(9)).astype(np.int64)) for s, k in keys.items()}}
t = time.time()
w, place, parts = d._index(None, "text", texts, list(range(len(texts))), 10)
print(len(w.start), time.time() - t, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200)
    assert out.returncode == 0, out.stderr[-1500:]
    n, seconds, grown = map(float, out.stdout.split())
    print("windows", n, "seconds", seconds, "MB", grown)
    assert n > 100_000 * megabytes and seconds < 60 and grown < 1000, out.stderr


def test_two_blocks_of_some_megabytes(frame):
    r = random.Random(4)
    vocab = [f"v{i}" for i in range(5000)]
    items = [(i, " ".join(r.choices(vocab, k=60))) for i in range(3000)]
    docs = [(i, "pad " * 3 + " ".join(items[i * 7][1].split()[5:5 + 9 + i % 3]) + " pad") for i in range(90)]
    got = decontaminate.find_overlaps(frame(docs), frame(items, "item_id"), block_bytes=600_000, keep=["doc_id"])
    rows = {x["doc_id"]: (x["items"], [tuple(s) for s in x["spans"]]) for x in got.select("row.doc_id", "items", "spans").collect()}
    for i, _ in docs:
        n = 9 + i % 3
        assert rows[i] == (([i * 7], [(3, 3 + n)]) if n >= 10 else ([], []))
