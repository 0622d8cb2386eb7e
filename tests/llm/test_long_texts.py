"""Secret scan of very long texts: memory and time follow the text, and a scan
of nested layers equals a plain one."""

import base64
import gzip
import random
import subprocess
import sys
import urllib.parse
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from glossa.llm import secrets  # noqa: E402

KINDS = {
    "escape": "t = 'plain words of a text 12 ' * (n // 25) + '%41%42 token%3Dabcdef123'",
    "wrapped_text": "t = wrap(('words of prose and more ' * (n // 24) + 'token=abcdef123').encode())",
    "wrapped_binary": "t = wrap(random.Random(1).randbytes(3 * n // 4))",
    "escapes": "t = '%41b%20' * (n // 7) + 'token%3Dabcdef123'",
}


def run(kind, megabytes):
    code = f"""
import base64, random, resource, sys, time
sys.path.insert(0, {str(Path(__file__).parents[2])!r})
from glossa.llm import secrets
n = {megabytes} << 20
def wrap(b):
    x = base64.b64encode(b).decode()
    return "\\n".join(x[i:i + 76] for i in range(0, len(x), 76))
{KINDS[kind]}
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
s = time.time()
found, large = secrets.scan(t)
print(len(t), len(found), time.time() - s, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-1500:]
    size, found, seconds, grown = map(float, out.stdout.split())
    print(kind, megabytes, "MB:", found, "found", round(seconds, 1), "s", round(grown), "MB more")
    return size, found, seconds, grown


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_long_texts(kind):
    small, large = run(kind, 2), run(kind, 12)
    assert kind == "wrapped_binary" or small[1] == large[1] == 1
    assert large[2] < 12 * small[2] + 3  # in proportion to the text
    assert large[3] < 40 * 12 + 60  # bytes for each character


def nested(r, depth):
    """(text, whether it holds the secret in the open) with a secret at some depth."""
    t = r.choice(["", "before "]) + "token=abcdef123456" + r.choice(["", " after"])
    for _ in range(depth):
        raw, k = t.encode(), r.randrange(4)
        t = (urllib.parse.quote(t, safe="") if k == 0 else base64.b64encode(raw).decode() if k == 1 else
             base64.b64encode(gzip.compress(raw)).decode() if k == 2 else "".join(f"\\u{ord(c):04x}" for c in t))
    return t


def test_every_depth_is_found_in_its_place(spark, tmp_path):
    r = random.Random(9)
    rows, want = [], {}
    for i in range(120):
        depth = i % 5
        inner = nested(r, depth)
        text = "x " * r.randint(0, 9) + inner + " y" * r.randint(0, 9)
        rows.append((i, text))
        want[i] = (text.index(inner), text.index(inner) + len(inner), depth)
    rows += [(500, None), (501, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in secrets.op3_secret_scan(spark, str(tmp_path)).collect()}
    for i, text in rows:
        x = got[i]
        if i >= 500:
            assert (x["n_assign"], x["spans"], x["oversized"]) == (0, "", 0)
            continue
        a, b, depth = want[i]
        spans = [tuple(map(int, s.split(":")[1:])) for s in x["spans"].split(",") if s.startswith("assign")]
        assert any(a <= s and e <= b for s, e in spans), (i, text, x["spans"])
        assert (depth > 0) == (x["n_assign"] == 0)
