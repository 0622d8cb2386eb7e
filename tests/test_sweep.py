"""The sweep against models built one by one (brute force) on sf0.001."""

from conftest import SF001
from glossa.operators.counting import line_tokens
from glossa.operators.split import sample_blocks, test_lines as held_out, train_lines, with_blocks
from glossa.plans.build import model_from_tokens
from glossa.plans.evaluate import accuracy_top_n, sweep
from glossa.sources.corpus import document_lines, read_table


def test_sweep_matches_single_builds(spark):
    lines = document_lines(read_table(spark, SF001, "documents"))
    test = held_out(lines)
    got = {r.code: r for r in sweep(lines, test, (0.25, 1.0), (0.8,), (True, False)).collect()}
    assert set(got) == {"25_80_TRUE", "100_80_TRUE", "25_80_FALSE", "100_80_FALSE"}
    for s, f in ((0.25, True), (1.0, False)):
        tok = line_tokens(sample_blocks(with_blocks(train_lines(lines)), s))
        m = model_from_tokens(tok, 0.8, f)
        row = got[f"{int(round(100 * s))}_80_{'TRUE' if f else 'FALSE'}"]
        assert (row.unigrams, row.bigrams, row.trigrams) == (
            m.vocab_size, m.bigrams.count(), m.trigrams.count())
        acc = accuracy_top_n(m, test, (3,)).first().accuracy
        assert abs(row.accuracy - acc) < 1e-12
