"""Line scans: documents become one row per text line.

``documents(doc_id, text, lang, source)`` stands in for line files; each
text is split on newlines with its position kept as ``line_no`` (0-based).
Plain text files are read with ``spark.read.text``; a line is identified by
its file and its place there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.session import materialise

LINE_COLUMNS = ["doc_id", "line_no", "line"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document_lines(documents: DataFrame, lang: str | None = "en",
                   keep_source: bool = False) -> DataFrame:
    """(doc_id, line_no, line[, source]); embedded NULs dropped.  The filter on
    ``lang`` and the projection reach the parquet scan."""
    docs = documents
    if lang is not None:
        docs = docs.filter(F.col("lang") == lang)
    cols = [F.col("doc_id")]
    if keep_source:
        cols.append(F.col("source"))
    lines = docs.select(*cols, F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "line"))
    out = [F.col("doc_id"), F.col("line_no").cast("int").alias("line_no"),
           F.replace(F.col("line"), F.lit("\u0000"), F.lit("")).alias("line")]
    if keep_source:
        out.append(F.col("source"))
    return lines.select(*out)


def write_line_files(lines: DataFrame, path: str, line_sep: str = "\n", partitions: int | None = None) -> None:
    """Lines (source, doc_id, line_no, line) as text files below ``source=...``
    folders.  Lines are dealt by ranges of their whole order, so a large source
    is many files; the order of the file names is the order of the lines."""
    keys = ["source", "doc_id", "line_no"]
    n = partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("source", "line").write.partitionBy("source").text(path, lineSep=line_sep)


def text_file_lines(spark: SparkSession, paths: list[str] | str, line_sep: str | None = None, source_of: str | None = None) -> DataFrame:
    """Line files as (doc_id, line_no, line, source): ``source`` is the file's
    path, ``doc_id`` a hash of it, ``line_no`` the line's place in the file
    (0-based), so that equal lines stay apart and lines keep their order.
    Lines end at LF, CR LF or CR unless ``line_sep`` says otherwise.  With
    ``source_of``, a pattern whose first group names the source in a path, all
    files of a source are one text, numbered through in the order of their paths.

    A file is read in splits by many tasks.  Rows are written once with their
    place in the split; the lines of the splits before, a number for each
    split, are then added.
    """
    raw = spark.read.text(paths, lineSep=line_sep).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_mid"))
    raw = materialise(raw, "lines")
    name = F.regexp_extract("source", source_of, 1) if source_of else F.col("source")
    splits = raw.groupBy("source", "_start").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")).withColumn("_name", name)
    before = F.sum("_n").over(Window.partitionBy("_name").orderBy("source", "_start")) - F.col("_n")  # a row for each split
    splits = splits.select("source", "_start", "_first", "_name", before.alias("_before"))
    return raw.join(splits, ["source", "_start"]).select(
        F.xxhash64("_name").alias("doc_id"),
        (F.col("_mid") - F.col("_first") + F.col("_before")).alias("line_no"),
        F.translate(F.col("line"), "\u0000", "").alias("line"),
        F.col("_name").alias("source"))


def conversation_phrases(conversations: DataFrame) -> DataFrame:
    """Phrase table from conversation turns: (conv_id, turn, phrase)."""
    return conversations.select("conv_id", "turn", F.col("text").alias("phrase"))
