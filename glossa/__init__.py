"""glossa: n-gram language modelling as Spark DataFrame jobs.

Text lines are split, cleaned and tokenised with native column expressions;
n-grams are counted with partial aggregation; the vocabulary is cut by
coverage and dictionary-encoded; scoring (stupid and Katz back-off),
batch next-word prediction and evaluation are joins, aggregates and
windows over the encoded tables.
"""
