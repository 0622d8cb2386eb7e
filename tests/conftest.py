import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

TOY = ["the cat sat on the mat", "the cat sat on the hat", "the cat ran to the mat",
       "a dog sat on the mat"]
SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from glossa.session import get_session
    s = get_session("local[4]", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def toy_lines(spark):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(TOY)],
                                 "doc_id long, line_no int, line string")


@pytest.fixture(scope="session")
def toy_full(spark, toy_lines):
    """No cut, singletons kept (FIXTURES 3.3 / 3.4)."""
    from glossa.operators.counting import line_tokens
    from glossa.plans.build import model_from_tokens
    return model_from_tokens(line_tokens(toy_lines), None, False)


@pytest.fixture(scope="session")
def toy_cut(spark, toy_lines):
    from glossa.operators.counting import line_tokens
    from glossa.plans.build import model_from_tokens
    return model_from_tokens(line_tokens(toy_lines), 0.8, True)


@pytest.fixture(scope="session")
def sf001_model(spark):
    from glossa.plans.build import build_model
    from glossa.sources.corpus import document_lines, read_table
    return build_model(document_lines(read_table(spark, SF001, "documents")))
