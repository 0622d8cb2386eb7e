"""Importance resampling of documents towards a target distribution.

Features are the runs of 1 to ``max_n`` words of a text, hashed into
``buckets`` by CRC-32.  Both tables are counted by bucket in full; a bucket's
gain is the scaled log ratio of the two smoothed shares.  The gains are one
array, and a document's weight is the sum of the entries its features point
to.  With a Gumbel draw from the document's id added, the highest scores are
an importance sample without replacement.

The table of scores is written once.  Its cutoff is found by bisection on
numbers: each exact count job splits the bracket of possible scores into
``WAYS`` parts and keeps the one that holds the cutoff, then the same is done
on the doc_ids tied at the cutoff.  Only the drawn rows are sorted, by ranges,
and numbered from the sizes of the ranges before.

Texts are walked in pieces of bounded size whatever their length; what comes
to the driver is one number per bucket and a few counts per job.

Edge cases: a null or empty text has no feature and weight 0; a null id hashes
like an empty one and comes last among ties; rows that repeat an id take part
one by one (equal ones in any order); without enough documents the sample is
smaller; empty tables give gains of 0 or an empty result; further columns are
carried in ``row``, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotated, ranked, small_batches, table, written
from .textops import ALNUM, BLOCK, Words, doc_ranges, text_buffer

#: Parts into which one count job splits a bracket.
WAYS = 16
#: Words of more bytes are hashed one by one.
LONG = 48


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


CRC = _crc_table()


def crc_on(crc: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 values continued over the bytes from ``starts`` to ``ends``, all
    runs at once: one step a byte, the longest runs first."""
    size = ends - starts
    out = np.empty(len(size), dtype=np.uint32)
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(buf[starts[i]:ends[i]], int(crc[i]))
    at = np.flatnonzero(size <= LONG)
    at = at[np.argsort(size[at].astype(np.uint8), kind="stable")[::-1]]
    left = np.searchsorted(-size[at], -np.arange(LONG), side="left")  # runs longer than 0, 1, 2, ...
    state, first = ~crc[at], starts[at]
    for j in range(LONG):
        n = left[j]
        if not n:
            break
        s = state[:n]
        state[:n] = CRC[(s ^ buf[first[:n] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out[at] = ~state
    return out


def _cut(buf: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Pieces of about ``limit`` bytes that end between words."""
    a, n = 0, len(buf)
    while a < n:
        b = min(a + limit, n)
        while b < n and ALNUM.is_word[buf[b - 1]]:
            step = ~ALNUM.is_word[buf[b:b + limit]]
            b += int(step.argmax()) + 1 if step.any() else len(step)
        yield a, b
        a = b


def features(column: pa.Array, max_n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, bucket, length in words) of all features of a column of texts, a bounded part at a time."""
    buf, offsets = text_buffer(column)
    for i, j in doc_ranges(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= BLOCK:
            yield from _runs(buf[lo:hi], offsets[i:j + 1] - lo, i, max_n, buckets, 0)
            continue
        back, skip = lo, 0  # one long text: a piece starts with the last words of the one before
        for a, b in _cut(buf[lo:hi], BLOCK):
            part = buf[back:lo + b]
            yield from _runs(part, np.array([0, len(part)]), i, max_n, buckets, skip)
            if max_n > 1:
                words = Words(part, np.array([0, len(part)]), ALNUM, hashes=False)
                skip = min(max_n - 1, len(words))
                back = back + int(words.starts[len(words) - skip]) if skip else lo + b
            else:
                back = lo + b


def _runs(buf, offsets, base, max_n, buckets, skip):
    words = Words(buf, offsets, ALNUM, hashes=False)
    if not len(words):
        return
    folded = ALNUM.fold[buf]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.by_doc))
    starts, ends = words.starts, words.ends
    crc = np.zeros(len(starts), dtype=np.uint32)
    for n in range(1, max_n + 1):
        if n > 1:  # a run of n words: the one of n - 1, a space, the next word
            ok = doc[n - 1:] == doc[:len(doc) - n + 1]
            crc = crc[:len(ok)]
            crc = CRC[(~crc ^ np.uint32(32)) & np.uint32(255)] ^ (~crc >> np.uint32(8))
            crc = crc_on(~crc, folded, starts[n - 1:], ends[n - 1:])
        else:
            ok = np.ones(len(doc), dtype=bool)
            crc = crc_on(crc, folded, starts, ends)
        if skip:  # runs that end within the words of the piece before were seen there
            ok = ok & (np.arange(len(ok)) + n > skip)
        yield doc[:len(ok)][ok] + base, (crc[ok] % np.uint32(buckets)).astype(np.int64), np.full(int(ok.sum()), n)
        if len(crc) < 2:
            return
        crc = crc[:-1] if n < max_n else crc


def bucket_counts(texts: DataFrame, text_col: str, max_n: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket: each task counts its own, the counts meet by bucket."""
    small_batches(texts.sparkSession)

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, at, _ in features(b.column(0), max_n, buckets):
                total += np.bincount(at, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    parts = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(buckets, dtype=np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * log of the ratio of the smoothed shares) for each bucket."""
    b, total_s, total_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(scale * math.log((t + 1.0) * (total_s + b) / ((s + 1.0) * (total_t + b))))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighted(docs: DataFrame, text_col: str, gain: np.ndarray, max_n: int, keep: list[str]) -> DataFrame:
    """(row, n_words, n_features, weight): the gain array summed over each document's features."""
    def make():
        def run(column):
            n = len(column)
            out = np.zeros((3, n), dtype=np.int64)
            for doc, at, length in features(column, max_n, len(gain)):
                lo, m = int(doc[0]) if len(doc) else 0, int(doc[-1] - doc[0]) + 1 if len(doc) else 0
                if not m:
                    continue
                edges = np.searchsorted(doc, np.arange(lo, lo + m + 1))
                run_sum = np.concatenate(([0], np.cumsum(gain[at])))
                count = np.diff(edges)
                out[0, lo:lo + m] += count if length[0] == 1 else 0
                out[1, lo:lo + m] += count
                out[2, lo:lo + m] += np.diff(run_sum[edges])
            return [pa.array(x) for x in out]
        return run

    return annotated(docs, text_col, make, "n_words bigint, n_features bigint, weight bigint", keep)


def gumbel(doc_id: Column, seed: int, scale: int = 1000) -> Column:
    """floor(-scale * ln(-ln(u))) for u drawn from the id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-float(scale) * F.log(-F.log(u)))


def kth_smallest(df: DataFrame, value: Column, k: int, lo: int, hi: int) -> tuple[int, int]:
    """The k-th smallest of the integers ``value`` (all from lo to hi) and how many are smaller than it."""
    below = 0
    while lo < hi:
        step = -(-(hi - lo + 1) // WAYS)
        cuts = [x for x in range(lo + step, hi + 1, step)]
        part = sum(((value >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
        found = {r[0]: r[1] for r in df.filter((value >= F.lit(lo)) & (value <= F.lit(hi))).groupBy(part).count().collect()}
        for i in range(len(cuts) + 1):
            if below + found.get(i, 0) >= k:
                lo, hi = lo + i * step, min(lo + (i + 1) * step - 1, hi)
                break
            below += found.get(i, 0)
    return lo, below


def draw(scored: DataFrame, percent: float, min_words: int, by: str = "score", doc_id: str = "id") -> DataFrame:
    """Adds ``rank`` = 1, 2, ... to the share ``percent`` of the documents of
    ``min_words`` words or more with the highest ``by``; null for the others."""
    able = scored.filter(F.col("n_words") >= min_words)
    n, lo, hi = able.agg(F.count(F.lit(1)), F.min(by), F.max(by)).first()
    k = math.floor(Fraction(percent) * n / 100)
    nobody = scored.withColumn("rank", F.lit(None).cast("long"))
    if not k:
        return nobody
    # the k-th highest score is the (n - k + 1)-th smallest
    cut, smaller = kth_smallest(able, F.col(by), n - k + 1, lo, hi)
    tied = able.filter(F.col(by) == F.lit(cut))
    ties, ids, first, last = tied.agg(F.count(F.lit(1)), F.count(doc_id), F.min(doc_id), F.max(doc_id)).first()
    wanted = k - (n - smaller - ties)
    chosen = F.col(by) > F.lit(cut)
    if wanted > ids:
        chosen = chosen | (F.col(by) == F.lit(cut))
    else:
        upto, _ = kth_smallest(tied.filter(F.col(doc_id).isNotNull()), F.col(doc_id), wanted, first, last)
        chosen = chosen | ((F.col(by) == F.lit(cut)) & (F.col(doc_id) <= F.lit(upto)))
    chosen = F.coalesce(chosen & (F.col("n_words") >= min_words), F.lit(False))
    order = [F.desc(by), F.asc_nulls_last(doc_id), "n_words", "weight", "place"]
    drawn = ranked(scored.filter(chosen), order, "rank").withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return drawn.unionByName(nobody.filter(~chosen))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             percent: float = 10, min_words: int = 20, max_n: int = 1, buckets: int = 10000, seed: int = 2024,
             keep: list[str] | None = None) -> DataFrame:
    """(row, n_words, n_features, weight, score, rank) for every document;
    ``row`` holds the columns ``keep`` (all by default), ``rank`` is null for
    documents that were not drawn."""
    keep = docs.columns if keep is None else list(keep)
    gain = gains(bucket_counts(docs, text_col, max_n, buckets), bucket_counts(target, target_col, max_n, buckets))
    names = keep if id_col in keep else [*keep, id_col]
    out = weighted(docs, text_col, gain, max_n, names).withColumn("id", F.col(f"row.`{id_col}`").cast("long"))
    out = written(out.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumn(
        "place", F.monotonically_increasing_id()), "scores")
    row = F.struct(*[F.col(f"row.`{c}`") for c in keep]).alias("row")
    return draw(out, percent, min_words).select(row, "n_words", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark, sf_dir):
    """A tenth of ``documents``, drawn towards ``benchmark``."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("row.doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), dw AS (
  SELECT r, unnest(w) AS word FROM d
), bw AS (
  SELECT unnest({_WORDS}) AS word FROM benchmark
), crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), word AS (
  SELECT word, xor(list_reduce(list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
                   lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc
), s AS (
  SELECT bucket, count(*) AS n FROM dw JOIN word USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM bw JOIN word USING (word) GROUP BY bucket
), total AS (
  SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t
), gain AS (
  SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (total.s + 10000) / ((s.n + 1.0::DOUBLE) * (total.t + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), total
), weight AS (
  SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN word USING (word) JOIN gain USING (bucket) GROUP BY r
), scored AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
         (('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weight USING (r)
), place AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight, r) AS rank FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM place) * 10 // 100 THEN CAST(rank AS BIGINT) END AS rank
FROM scored LEFT JOIN place USING (r)
"""
