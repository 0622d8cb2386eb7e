"""Training-corpus pipeline over ``documents``: five stages, each on all that
the one before kept.

1. toxicity: documents scored 0.3 or more go; the network learns from the
   table ``labels`` (rows outside the held-out share).
2. near_dedup: of each class of near-duplicates (similarity 0.8 on five-word
   shingles) the document with the smallest doc_id stays.
3. decontaminate: documents that hold a window of ten words of ``benchmark``
   go.
4. secrets: findings, also those inside encoded layers, are replaced by their
   kind in brackets; n_chars follows.
5. packing: token pieces in sequences of at most 4096 tokens.

Edge cases: a null or empty text is scored like an empty window, linked with
nothing, never contaminated, without findings, and packed as its end token;
rows that repeat a doc_id are one document for stage 2, which keeps the row
with the smallest hash (one of equal rows); rows with a null doc_id are kept;
further columns are carried along up to stage 4; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm import decontaminate, neardup, packing, secrets, toxicity
from glossa.llm.common import table, written

#: Score from which a document goes.
TOXIC = 0.3
#: Similarity in percent from which documents are near-duplicates.
NEAR = 80
#: No SQL: the first stage trains a network, the last one calls a tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.filter(F.col("score") < TOXIC).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(docs, percent=NEAR)
    kept = written(found.filter("kept").select(F.col("doc_id").alias("id")), "kept")
    ids = kept.distinct().hint("merge")
    out = docs.join(ids, docs.doc_id.eqNullSafe(ids.id), "left_semi")
    if kept.filter("id is not null").groupBy("id").count().filter("count > 1").limit(1).count():
        rank = next(f"rank{i}" for i in range(len(docs.columns) + 1) if f"rank{i}" not in docs.columns)
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[c for c, t in docs.dtypes if not t.startswith("map")]))
        ranked = out.filter("doc_id is not null").withColumn(rank, F.row_number().over(order))
        out = ranked.filter(F.col(rank) == 1).drop(rank).unionByName(out.filter("doc_id is null"))
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("spans") == 0).select("row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.redact_secrets(docs)
    new = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_secrets") > 0, F.length("redacted").cast(kind)).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    pieces = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
