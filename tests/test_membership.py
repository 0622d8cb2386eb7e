"""The word filter: no word is lost, few strangers pass, fewer rows are shuffled."""

from conftest import SF001
from pyspark.sql import functions as F

from glossa.operators import encode
from glossa.operators.counting import line_tokens
from glossa.operators.encode import encoded_gram_counts, gram_strings
from glossa.operators.membership import word_filter
from glossa.sources.corpus import document_lines, read_table


def test_filter(spark):
    words = spark.range(3000).select(F.concat(F.lit("w"), "id").alias("word"))
    for cap, most in ((1 << 20, 0.03), (1000, 0.6)):
        f = word_filter(words, 3000, max_bytes=cap)
        assert f.row.count() == 1 and f.cells * 8 <= cap
        assert words.filter(f.may_contain(F.col("word"))).count() == 3000
        strangers = spark.range(20000).select(F.concat(F.lit("x"), "id").alias("word"))
        assert strangers.filter(f.may_contain(F.col("word"))).count() < most * 20000
    none = word_filter(words.filter("false"), 0)
    assert words.filter(none.may_contain(F.col("word"))).count() == 0


def test_grams_before_the_shuffle(spark, sf001_model):
    tokens = line_tokens(document_lines(read_table(spark, SF001, "documents")))
    vocab = sf001_model.vocab
    known = word_filter(vocab, vocab.count())
    for n in (2, 3):
        all_rows, left = gram_strings(tokens, n).count(), gram_strings(tokens, n, known=known).count()
        kept = encode.encoded_strings(gram_strings(tokens, n), vocab, n).count()
        assert kept <= left <= kept * 1.1 + 20 and left < all_rows / 1.5, (n, kept, left, all_rows)
        print("n-grams shuffled", n, all_rows, "->", left, "of which known", kept)
    a = encoded_gram_counts(tokens, vocab, broadcast=False)
    b = encoded_gram_counts(tokens, vocab, broadcast=True)
    cols = ["n", "i1", "i2", "i3", "count"]
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0 and b.select(cols).exceptAll(a.select(cols)).count() == 0
