"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

For every participant of a conversation the whole dialogue is rendered once
with that speaker as ``assistant`` and all others as named users; the mask
marks the content and end mark of the assistant's turns, which are the ones to
learn.  Turns of the system role frame the dialogue and are nobody's
perspective.

A conversation may hold any share of the rows, so it is rendered in chunks of
``CHUNK_TURNS`` turns.  Turns are numbered without gathering a conversation: a
range sort by (conversation, turn, role, text) deals a long one out over many
partitions, turns are numbered inside each, and the counts of the partitions
before are added.

Edge cases: turns are ordered by number (null last), then role and text;
repeated rows are one turn; a null role is the speaker ``unknown``, a null
text is empty; a null conv_id is a conversation of its own; marks inside a
text are escaped, so that no text can close its turn; a conversation of
system turns alone has no perspective and no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

CHUNK_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def numbered_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(key, conv, role, text, no): distinct turns, numbered from 0 in each
    conversation; ``key`` names the conversation and is never null."""
    escaped = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("<\\|"))
    turns = conversations.select(_key(conv_col), F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                                 F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), escaped.alias("text"))
    order = ["key", F.asc_nulls_last("turn"), "role", "text"]
    # equal rows meet in one range, so they merge without another shuffle
    dealt = written(turns.repartitionByRange(*order).distinct().sortWithinPartitions(*order)
                    .withColumn("id", F.monotonically_increasing_id()), "turns")
    part = F.shiftright("id", 33)
    counts = dealt.groupBy("key", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = counts.select(F.col("key").alias("k"), F.col("part").alias("p"), "first", (
        F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")).alias("before"))
    return dealt.withColumn("part", part).join(before, (F.col("key") == F.col("k")) & (F.col("part") == F.col("p"))).select(
        "key", "conv", "role", "text", (F.col("id") - F.col("first") + F.col("before")).alias("no"))


def _key(conv_col: str):
    return F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("null")).alias("key")


def rotate_perspectives(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                        text_col: str = "text", system_role: str = "system") -> DataFrame:
    """(conv_id, perspective, chunk, n_turns, n_learned, rendered, mask): mask
    holds the learned character ranges of ``rendered``."""
    turns = numbered_turns(conversations, conv_col, turn_col, role_col, text_col)
    chunks = turns.groupBy("key", F.floor(F.col("no") / CHUNK_TURNS).cast("int").alias("chunk")).agg(
        F.first("conv").alias("conv"), F.array_sort(F.collect_list(F.struct("no", "role", "text"))).alias("turns"))  # CHUNK_TURNS at most
    speakers = conversations.select(_key(conv_col).alias("k"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("perspective")).filter(
        F.col("perspective") != system_role).distinct()
    both = chunks.join(speakers, F.col("key") == F.col("k"))

    def head(t):
        return F.when(t["role"] == F.col("perspective"), F.lit(f"{OPEN}assistant\n")).when(
            t["role"] == system_role, F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), t["role"], F.lit("\n")))

    body = lambda t: F.concat(t["text"], F.lit(CLOSE))
    parts = both.withColumn("parts", F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), body(t).alias("body"), (t["role"] == F.col("perspective")).alias("own"))))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + 1
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("mask"))
    walked = F.aggregate("parts", state, lambda s, p: F.struct(
        (s["at"] + size(p)).alias("at"),
        F.when(p["own"], F.concat(s["mask"], F.array(F.struct(
            (s["at"] + F.length(p["head"])).alias("start"),
            (s["at"] + size(p) - 1).alias("stop"))))).otherwise(s["mask"]).alias("mask")), lambda s: s["mask"])
    return parts.select(
        F.col("conv").alias("conv_id"), "perspective", "chunk", F.size("turns").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["own"])).alias("n_learned"),
        F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "\n"), F.lit("\n")).alias("rendered"),
        walked.alias("mask"))


def op10_perspective_rotation(spark, sf_dir):
    """All conversations from the perspective of each of their speakers."""
    out = rotate_perspectives(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["stop"].cast("string"))), ",")
    return out.withColumn("mask", mask)


OP10_SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<\\|') AS text FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS no FROM t
), s AS (
  SELECT DISTINCT conv_id AS c, role AS perspective FROM t WHERE role <> 'system'
), p AS (
  SELECT conv_id, perspective, CAST(no // {CHUNK_TURNS} AS INTEGER) AS chunk, no, role = perspective AS own,
         '{OPEN}' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system'
                          ELSE 'user name=' || role END || chr(10) AS head, text || '{CLOSE}' || chr(10) AS body
  FROM n JOIN s ON conv_id IS NOT DISTINCT FROM c
), w AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, chunk ORDER BY no) AS upto FROM p
)
SELECT conv_id, perspective, chunk, CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (own) AS INTEGER) AS n_learned,
       string_agg(head || body, '' ORDER BY no) AS rendered,
       coalesce(string_agg(CAST(upto - length(body) AS VARCHAR) || '-' || CAST(upto - 1 AS VARCHAR), ',' ORDER BY no) FILTER (own), '') AS mask
FROM w GROUP BY conv_id, perspective, chunk
"""
