"""Substring dedup: removes words covered by a passage that occurs elsewhere.

A window is ``depth`` consecutive words of one document; a word is removed if
a window that covers it has the same word sequence as a window that starts
anywhere else, in the same document included.

Method: suffix trees over word symbols, partitioned by prefix.  No task ever
needs the whole corpus:

1. Suffixes are grouped by a content-chosen key: of the ``depth`` - ``ANCHOR``
   + 1 word ``ANCHOR``-grams in a window, the one with the smallest hash, the
   leftmost of equals.  Equal windows choose the same gram at the same offset, so every
   repeat lies within one group.  Consecutive windows with one chosen place
   form a run of at most ``depth - ANCHOR + 1`` windows; a run is one record.
2. Groups with one run hold leaves only and go.  Equal runs collapse to one
   with a count (all their windows repeat).  What is left are groups with
   runs that differ.
3. A group of at most ``GROUP`` distinct runs fits in memory: its texts are
   fetched and the subtree's levels are built by naming prefixes of 1, 2, 4,
   ... ``depth`` words (equal name = same node).  An internal node of string
   depth ``depth``, i.e. with two leaves or more, is a deep one: the windows
   below it repeat.
4. Larger groups are split by longer prefixes.  At the full depth the prefix
   is the node itself, so counting it (pre-aggregated) tells whether it is
   internal, with no bound on the leaves below.

Neighbouring deep windows merge to maximal repeated spans.  Symbols are
64-bit word hashes; runs and full-depth prefixes are compared by 128 bits.

Edge cases: null or empty texts have no words; documents of fewer words than
``depth`` are kept whole; two rows with one text repeat each other, also when
they repeat a doc_id; a null doc_id is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, small_batches, table, written
from .textops import (PLAIN, Words, doc_ranges, gram_hashes, list_fields, mix64, ragged, signed, sliding_min,
                      text_buffer)

#: Words of the gram that names a group.
ANCHOR = 8
#: Distinct runs whose subtree is built in one piece: about 5 MB of text, 50 MB while it is named.
GROUP = 1 << 14
RUN = "start int, n int, mkey bigint, rkey bigint"


def _runs(w: Words, n_docs: int, depth: int):
    """Runs of windows with one chosen gram: (document, start, windows, key, run key)."""
    span = depth - ANCHOR + 1
    total = len(w) - depth + 1
    none = np.zeros(0, np.int64)
    if total <= 0:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams = gram_hashes(w.hashes, ANCHOR, 11)
    low = np.uint64(max(1, int(len(grams)).bit_length()))
    order = ((grams >> low) << low) | np.arange(len(grams), dtype=np.uint64)
    best = sliding_min(order, span)[:total]
    doc_of = np.repeat(np.arange(n_docs), np.diff(w.by_doc))
    ok = doc_of[:total] == doc_of[depth - 1:]
    change = np.ones(total, dtype=bool)
    change[1:] = (best[1:] != best[:-1]) | (doc_of[1:total] != doc_of[:total - 1])
    first = np.flatnonzero(change & ok)
    # a run ends where the next change or the last window of the document is
    group = np.cumsum(change & ok) - 1
    n = np.bincount(group[ok], minlength=len(first))[:len(first)] if len(first) else none
    place = (best[first] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    full = gram_hashes(w.hashes, depth, 23)
    rkey = mix64(full[first] * np.uint64(0x9E3779B97F4A7C15) + full[first + n - 1] + n.astype(np.uint64), 5)
    return doc_of[first], first - w.by_doc[doc_of[first]], n, grams[place], rkey


def runs_of(docs: DataFrame, depth: int) -> DataFrame:
    """(doc_id, tkey, start, n, mkey, rkey) for all documents of ``keyed`` form."""
    def run(batches):
        for b in batches:
            buf, offs = text_buffer(b.column(2))
            for i, j in doc_ranges(offs):
                w = Words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], PLAIN)
                d, start, n, mkey, rkey = _runs(w, j - i, depth)
                if len(d):
                    take = pa.array(d + i)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(take), b.column(1).take(take), pa.array(start, pa.int32()),
                         pa.array(n, pa.int32()), pa.array(signed(mkey)), pa.array(signed(rkey))],
                        ["doc_id", "tkey", "start", "n", "mkey", "rkey"])

    return docs.mapInArrow(run, f"doc_id bigint, tkey bigint, {RUN}")


def _cut(depth: int):
    """Texts of the runs asked for: documents with ``want`` -> (mkey, rkey, large, text)."""
    def run(batches):
        for b in batches:
            counts, want = list_fields(b.column(1))
            upto = np.cumsum(counts)
            buf, offs = text_buffer(b.column(0))
            for i, j in doc_ranges(offs):
                w = Words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], PLAIN, hashes=False)
                own = slice(int(upto[i] - counts[i]), int(upto[j - 1]))
                first = np.repeat(w.by_doc[:-1], counts[i:j]) + want["start"][own]
                last = first + want["n"][own] + depth - 2
                texts = [w.buf[a:z].tobytes() for a, z in zip(w.starts[first], w.ends[last], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(want["mkey"][own], pa.int64()), pa.array(want["rkey"][own], pa.int64()),
                     pa.array(want["large"][own], pa.bool_()), pa.array(texts, pa.binary())], ["mkey", "rkey", "large", "run"])

    return run


def _symbols(column):
    buf, offs = text_buffer(column)
    return Words(buf, offs, PLAIN)


def deep_leaves(symbols: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix with ``depth`` symbols, the name of its node at that
    depth: levels 1, 2, 4, ... are named from the level before."""
    _, name = np.unique(symbols, return_inverse=True)
    name = name.astype(np.int64)
    length = 1
    while length < depth:
        step = min(length, depth - length)
        n = len(symbols) - length - step + 1
        if n <= 0:
            return name[:0]
        pair = name[:n] * np.int64(len(symbols) + 1) + name[step:step + n]
        _, name = np.unique(pair, return_inverse=True)
        name = name.astype(np.int64)
        length += step
    return name


def _subtrees(depth: int):
    """Complete groups in order of mkey -> (mkey, rkey, off, n): repeated windows of each run."""
    def one(mkey, rkey, column):
        w = _symbols(column)
        n = np.diff(w.by_doc) - depth + 1
        at = np.repeat(w.by_doc[:-1], n) + ragged(n)
        row = np.repeat(np.arange(len(n)), n)
        node = deep_leaves(w.hashes, depth)[at]
        many = np.bincount(node, minlength=1)[node] > 1
        return _spans(mkey, rkey, row, at - w.by_doc[row], many)

    def run(batches):
        held = None
        for b in batches:
            held = b if held is None else pa.concat_batches([held, b])
            last = held.column(0)[held.num_rows - 1].as_py()
            done = int(np.searchsorted(held.column(0).to_numpy(), last, side="left"))
            if done:
                yield one(held.column(0).to_numpy()[:done], held.column(1).to_numpy()[:done], held.column(2).slice(0, done))
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield one(held.column(0).to_numpy(), held.column(1).to_numpy(), held.column(2))

    return run


def _spans(mkey, rkey, row, off, many):
    """Consecutive marked windows of a run as (mkey, rkey, off, n)."""
    row, off = row[many], off[many]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1)
    first = np.flatnonzero(fresh)
    n = np.diff(np.append(first, len(row)))
    return pa.RecordBatch.from_arrays(
        [pa.array(mkey[row[first]]), pa.array(rkey[row[first]]), pa.array(off[first], pa.int32()), pa.array(n, pa.int32())],
        ["mkey", "rkey", "off", "n"])


def _windows(depth: int):
    """Full-depth prefixes of the runs of large groups: (mkey, rkey, off, p, q)."""
    def run(batches):
        for b in batches:
            w = _symbols(b.column(2))
            n = np.diff(w.by_doc) - depth + 1
            at = np.repeat(w.by_doc[:-1], n) + ragged(n)
            row = np.repeat(np.arange(len(n)), n)
            p, q = gram_hashes(w.hashes, depth, 23)[at], gram_hashes(mix64(w.hashes, 77), depth, 41)[at]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(at - w.by_doc[row], pa.int32()),
                 pa.array(signed(p)), pa.array(signed(q))], ["mkey", "rkey", "off", "p", "q"])

    return run


def repeated_spans(docs: DataFrame, depth: int = 35) -> DataFrame:
    """(doc_id, tkey, start, n): runs of n windows from word ``start`` that
    occur elsewhere; ``docs`` in ``keyed`` form."""
    runs = runs_of(docs, depth)
    # tables of their own: joined straight after the aggregation, a frequent key could not be split over tasks
    twice = written(runs.groupBy("mkey").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("mkey"), "twice")
    live = written(runs.join(twice, "mkey", "left_semi"), "runs")
    distinct = written(live.groupBy("mkey", "rkey").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "tkey", "start", "n")).alias("at")), "distinct")
    sizes = written(distinct.groupBy("mkey").agg(F.count(F.lit(1)).alias("d")).filter("d > 1").withColumnRenamed("mkey", "m"), "sizes")
    open_ = distinct.join(sizes, F.col("mkey") == F.col("m"))
    want = open_.select("at.*", "mkey", "rkey", (F.col("d") > GROUP).alias("large"))
    by_doc = want.groupBy(F.col("doc_id").alias("id"), F.col("tkey").alias("tk")).agg(
        F.collect_list(F.struct("start", "n", "mkey", "rkey", "large")).alias("want"))
    once = docs.join(by_doc, docs.doc_id.eqNullSafe(by_doc.id) & (docs.tkey == by_doc.tk)).select("text", "want")
    texts = written(once.mapInArrow(_cut(depth), "mkey bigint, rkey bigint, large boolean, run binary")
                    .dropDuplicates(["mkey", "rkey"]), "run_texts")
    small = (texts.filter("not large").select("mkey", "rkey", F.col("run")).repartition("mkey")
             .sortWithinPartitions("mkey").mapInArrow(_subtrees(depth), "mkey bigint, rkey bigint, off int, n int"))
    full = texts.filter("large").select("mkey", "rkey", "run").mapInArrow(
        _windows(depth), "mkey bigint, rkey bigint, off int, p bigint, q bigint")
    inner = full.groupBy("p", "q").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    large = full.join(inner, ["p", "q"], "left_semi").select("mkey", "rkey", "off", F.lit(1).alias("n"))
    found = small.unionByName(large).select(F.col("mkey").alias("m"), F.col("rkey").alias("r"), "off", F.col("n").alias("k"))
    whole = distinct.filter("c > 1").select(F.col("mkey").alias("m"), F.col("rkey").alias("r"), F.lit(0).alias("off"),
                                            F.col("at.n").alias("k"))
    marked = found.unionByName(whole)
    return live.join(marked, (live.mkey == marked.m) & (live.rkey == marked.r)).select(
        "doc_id", "tkey", (F.col("start") + F.col("off")).alias("start"), F.col("k").alias("n"))


def _strip(depth: int):
    """(doc_id, text, spans) -> (doc_id, n_words, n_removed, kept)."""
    def run(batches):
        for b in batches:
            words, removed, kept = [], [], []
            counts, span = list_fields(b.column(2))
            upto = np.cumsum(counts)
            buf, offs = text_buffer(b.column(1))
            for d in range(b.num_rows):
                w = buf[offs[d]:offs[d + 1]].tobytes().split()
                words.append(len(w))
                if counts[d]:
                    start = span["start"][upto[d] - counts[d]:upto[d]]
                    stop = start + span["n"][upto[d] - counts[d]:upto[d]] + depth - 1
                    marks = np.bincount(start, minlength=len(w) + 1) - np.bincount(stop, minlength=len(w) + 1)
                    keep = np.cumsum(marks[:-1]) == 0
                    w = [y for y, k in zip(w, keep.tolist(), strict=True) if k]
                removed.append(words[-1] - len(w))
                kept.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space."""
    if depth < 2 * ANCHOR:
        raise ValueError(f"depth must be at least {2 * ANCHOR} words")
    docs = keyed(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    spans = repeated_spans(docs, depth).groupBy(F.col("doc_id").alias("id"), F.col("tkey").alias("tk")).agg(
        F.collect_set(F.struct("start", "n")).alias("spans"))
    both = docs.join(spans, docs.doc_id.eqNullSafe(spans.id) & (docs.tkey == spans.tk), "left")
    return both.select("doc_id", "text", "spans").mapInArrow(
        _strip(depth), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def op2_substring_dedup(spark, sf_dir):
    """Repeated 35-word passages of the whole table, removed."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
