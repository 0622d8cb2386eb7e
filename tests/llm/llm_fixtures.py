"""Fixtures and helpers of this folder."""

import random

import pytest

from pyspark.sql import types as T

EXTRA = [("row", T.StringType()), ("score", T.StringType()), ("start", T.IntegerType())]


def invented(n_docs=60, seed=5, words=40, longest=90):
    """Texts of a small vocabulary with copies, near copies and shared passages."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeÉßñ") for _ in range(r.randint(1, 6))) for _ in range(words)] + ["Alpha", "ALPHA", "x1", "e-f"]
    passage = " ".join(r.choice(vocab) for _ in range(50))
    texts = []
    for i in range(n_docs):
        w = [r.choice(vocab) for _ in range(r.randint(0, longest))]
        kind = i % 6
        if kind == 1 and texts:
            texts.append(texts[r.randrange(len(texts))])
            continue
        if kind == 2 and texts and texts[-1]:
            w = texts[-1].split()
            for _ in range(1 + len(w) // 60):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
        t = r.choice([" ", "  ", "\n", "\t"]).join(w)
        texts.append(t + " " + passage if kind == 3 else t)
    texts += [None, "", "   ", "one", "one two three", "ab " * 400, "  \x85 x", "long " + "y" * 3000]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def fixture_rows():
    return invented()


@pytest.fixture(scope="session")
def frame(spark):
    """DataFrame of (id, text) rows with further columns whose names clash with the operators' own."""
    def make(rows, id_name="doc_id"):
        schema = T.StructType([T.StructField(id_name, T.LongType()), T.StructField("text", T.StringType()),
                               *[T.StructField(n, k) for n, k in EXTRA]])
        return spark.createDataFrame([(i, t, None, "s", 7) for i, t in rows], schema)

    return make


def tuples(df):
    """Sorted rows; nulls first."""
    return sorted(map(tuple, df.collect()), key=lambda t: tuple((x is not None, x if x is not None else 0) for x in t))
