"""Token ids of every tokenizer file, and the memo's bound."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_fixtures import fixture_rows, frame  # noqa: E402, F401

from glossa.llm import packing  # noqa: E402

ODD = ["hello big world, again", "  two  blanks\n\nand a tab\t.", "a<|endoftext|>b", "don't WE'LL 12 34٣", "漢字かな交じり文", "ﬁ é É ẞ", " lead", "trail ", "\x1c a\x85b"]


def files():
    import public_tokenizers
    folder = Path(public_tokenizers.path("word_bpe_49k.json")).parent
    return sorted(str(p) for p in folder.glob("*.json"))


@pytest.mark.parametrize("path", files())
def test_every_file_gives_the_whole_tokenizers_ids(path, fixture_rows):
    enc = packing.WordEncoder(path)
    for t in ODD + [t for _, t in fixture_rows if t]:
        want = enc.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode([t.encode()])[0], "<u4").tolist() == want, t[:60]
    assert len({Path(p).name for p in files()}) >= 2 and (enc.split is None) == ("byte_bpe" in path)


def test_pieces_of_another_tokenizer(frame):
    path = next(p for p in files() if "byte_bpe" in p)
    out = packing.tokenize(frame([(1, ODD[0]), (2, None), (3, ODD[1])]), path, 4096, 7).collect()
    enc = packing.WordEncoder(path)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in out}
    assert got == {i: enc.tokenizer.encode(t, add_special_tokens=False).ids + [7] for i, t in ((1, ODD[0]), (2, ""), (3, ODD[1]))}


def test_memo_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_BYTES", 40_000)
    enc = packing.WordEncoder(next(p for p in files() if "word_bpe" in p))
    r = random.Random(2)
    for _ in range(30):
        text = " ".join("".join(chr(r.choice([0x4e00, 97]) + r.randrange(20)) for _ in range(r.choice([3, 300, 900]))) for _ in range(40))
        want = enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode([text.encode()])[0], "<u4").tolist() == want
        size = sum(packing.ENTRY + len(k) + len(v) for k, v in enc.items())
        assert size == enc.held <= packing.MEMO_BYTES and all(len(k) <= packing.LONG_WORD for k in enc)
        assert sum(packing.ENTRY + len(k) + len(v) for k, v in enc.parts.items()) <= packing.MEMO_BYTES
