"""MinHash near-duplicate detection on SetSketch registers.

A document's set is its distinct ``shingle``-word shingles (fewer words: the
whole sequence as one); two documents are linked where the Jaccard similarity
of their full sets is at least ``percent`` / 100; classes are the connected
components of the links.

Each register keeps, of one pseudo-random exponential per shingle, the
minimum, truncated to floor(1 - log_b(minimum)): exponentially spaced, so one
byte each, mergeable by maximum, and equal in two sets about as often as
their similarity.  ``ROWS`` registers make one band; at similarity 0.85 a band
agrees with probability 0.33, so ``BANDS`` bands miss a link with less than
1e-6, and similar ones on the way to it less often still.  Below 0.85 the
bands have ``SHORT_ROWS`` registers: at 0.8 one agrees with probability 0.33,
so a link is missed with less than 1e-6 too.

1. Equal sets collapse to one node (the smallest doc_id).
2. Nodes with a common band value share a bucket.  Each is paired with the
   bucket's smallest node only: as many pairs as members, whatever its size.
3. A pair is dropped if, by the joint likelihood of its registers (counts of
   larger, smaller and equal ones, given both set sizes), no similarity of
   ``percent`` or more is credible; the others are verified on the full sets.
4. In buckets whose members are still in different classes, all pairs across
   classes are compared inside tasks, in blocks of ``BLOCK_ROWS`` members, by
   their registers and then by the full sets; only links that connect classes
   come out, fewer than there are members.  So a link is lost only where every
   band differs.

Edge cases: a document without words has an empty set and is linked with
nothing; rows that repeat a doc_id are one document (their links are shared);
a null doc_id is linked with nothing and kept, its component is null; texts of
any length are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small_batches, table, written
from .textops import FOLDED, Words, doc_ranges, gram_hashes, mix64, signed, text_buffer

ROWS, BANDS = 7, 36
REGISTERS = ROWS * BANDS
#: Registers of a band where similarities below 0.85 count.
SHORT_ROWS = 5
#: Base of the registers; they hold floor(1 - log_b x) + SHIFT, truncated to a byte.
BASE, SHIFT = 1.1, 35
#: A pair goes if its best similarity is this many nats likelier than any that would link it.
DOUBT = 14.0
#: Members of a bucket compared with each other in one piece.
BLOCK_ROWS = 1024
_SEED = np.random.default_rng(20240229)
_MULT = _SEED.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_XOR = _SEED.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def document_sets(w: Words, n_docs: int, shingle: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each document."""
    grams = gram_hashes(w.hashes, shingle, 3)
    out = []
    for d in range(n_docs):
        a, b = w.by_doc[d], w.by_doc[d + 1]
        if b - a >= shingle:
            out.append(np.unique(grams[a:b - shingle + 1]))
        else:
            out.append(gram_hashes(w.hashes[a:b], int(b - a), 3) if b > a else grams[:0])
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (bytes) of non-empty sets."""
    low = np.full((len(sets), REGISTERS), 0xFFFFFFFF, dtype=np.uint32)
    sizes = [len(s) for s in sets]
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32) if sets else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(sets)), sizes)
    for i in range(0, len(x), 2048):
        part = row[i:i + 2048]
        u = (x[i:i + 2048, None] ^ _XOR) * _MULT
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        at = part[first]
        low[at] = np.minimum(low[at], np.minimum.reduceat(u, first, axis=0))
    minimum = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(minimum) / np.log(BASE)) + SHIFT, 0, 255).astype(np.uint8)


def _less(x):
    """Probability that a register of the one set is larger, by the share that only it has."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def credible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of register rows may have a similarity of ``percent`` or more."""
    most = np.minimum(na, nb) / np.maximum(na, nb)
    out = 100 * most >= percent
    if not out.any():
        return out
    at = np.flatnonzero(out)
    for i in range(0, len(at), 4096):
        k = at[i:i + 4096]
        larger, smaller = (a[k] > b[k]).sum(1)[:, None], (a[k] < b[k]).sum(1)[:, None]
        u = (na[k] / (na[k] + nb[k]))[:, None]
        v = 1 - u
        j = most[k][:, None] * np.linspace(0, 1, 81)
        p, q = np.maximum(_less(u - v * j), 1e-9), np.maximum(_less(v - u * j), 1e-9)
        like = larger * np.log(p) + smaller * np.log(q) + (REGISTERS - larger - smaller) * np.log(np.maximum(1 - p - q, 1e-9))
        # between two grid points the value sought may lie; the one below the bound counts too
        linked = np.where(100 * j >= percent - 1.25, like, -np.inf).max(1)
        out[k] = like.max(1) - linked <= DOUBT
    return out


def sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, s1, s2, sketch) of each row; sketch is null for empty sets."""
    def run(batches):
        for b in batches:
            buf, offs = text_buffer(b.column(1))
            for i, j in doc_ranges(offs):
                w = Words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], FOLDED)
                sets = document_sets(w, j - i, shingle)
                full = [s for s in sets if len(s)]
                rows = iter(registers(full))
                s1 = np.array([mix64(s, 101).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                s2 = np.array([mix64(s, 211).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(s1)),
                     pa.array(signed(s2)), pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "n", "s1", "s2", "sketch"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, s1 bigint, s2 bigint, sketch binary")


def _estimate(percent: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, REGISTERS) for i in (2, 3))
                ok = credible(a, c, b.column(4).to_numpy(), b.column(5).to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok)) for i in (0, 1)], ["a", "b"])

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence columns."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, col, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = seen[col] > 1  # the others add nothing between two sets
    row, col = row[many], np.unique(col[many], return_inverse=True)[1]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)  # counts below 2**24 are exact
    width = max(256, (4 << 20) // len(sets))
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, [a, a + width])
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[row[i:j], col[i:j] - a] = 1
        out += m @ m.T
    return out.astype(np.int64)


#: Registers that agree in a pair at similarity 0.85, less six standard deviations.
AGREE = int(REGISTERS * 0.85 - 6 * (REGISTERS * 0.85 * 0.15) ** 0.5)


def _links_within(shingle: int, percent: int):
    """Rows sorted by (key, i, j) -> links that connect classes, group by group."""
    least = AGREE if percent >= 85 else int(REGISTERS * percent / 100 - 6 * (REGISTERS / 4) ** 0.5)

    def one(nodes, sizes, label, side, sketch, texts):
        pairs = []
        for i in range(len(nodes) - 1):
            later = np.arange(i + 1, len(nodes))
            ok = (label[later] != label[i]) & (nodes[later] != nodes[i])
            if side is not None:  # two blocks: within each, another group compares
                ok &= side[later] != side[i]
            ok &= np.minimum(sizes[later], sizes[i]) * 100 >= percent * np.maximum(sizes[later], sizes[i])
            later = later[ok]
            later = later[(sketch[later] == sketch[i]).sum(1) >= least]
            pairs.append(np.stack([np.full(len(later), i), later]))
        pairs = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        if not pairs.shape[1]:
            return
        own, at = np.unique(pairs, return_inverse=True)
        at = at.reshape(pairs.shape)
        buf, offs = text_buffer(texts.take(pa.array(own)))
        sets = document_sets(Words(buf, offs, FOLDED), len(own), shingle)
        common = common_counts(sets)[at[0], at[1]]
        size = np.array([len(x) for x in sets])
        linked = 100 * common >= percent * (size[at[0]] + size[at[1]] - common)
        root: dict = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for a, b in pairs[:, linked].T.tolist():  # a spanning set of the links
            x, y = find(label[a]), find(label[b])
            if x != y:
                root[max(x, y)] = min(x, y)
                yield nodes[a], nodes[b]

    def groups(t):
        cols = [t.column(i).to_numpy() for i in range(6)]
        blk, texts = t.column(8).to_numpy(), t.column(7)
        sketch = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint8).reshape(-1, REGISTERS)
        key = np.stack(cols[:3])
        cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
        out = []
        for a, z in zip(cut, np.append(cut[1:], t.num_rows), strict=True):
            side = None if cols[1][a] == cols[2][a] else blk[a:z] == cols[1][a]
            out += one(cols[3][a:z], cols[4][a:z], cols[5][a:z], side, sketch[a:z], texts.slice(a, z - a))
        out = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["u", "v"])

    def run(batches):
        held = None
        for b in batches:
            held = b if held is None else pa.concat_batches([held, b])
            if held.num_rows:
                k = np.stack([held.column(i).to_numpy() for i in range(3)])
                other = np.flatnonzero((k != k[:, -1:]).any(0))
                if len(other):
                    yield groups(held.slice(0, int(other[-1]) + 1))
                    held = held.slice(int(other[-1]) + 1)
        if held is not None and held.num_rows:
            yield groups(held)

    return run


def _confirm(shingle: int, percent: int):
    """(a, b, text a, text b) -> linked pairs, on the full sets."""
    def sets(column, i, j):
        buf, offs = text_buffer(column.slice(i, j - i))
        return document_sets(Words(buf, offs, FOLDED), j - i, shingle)

    def run(batches):
        for b in batches:
            ok = []
            for i in range(0, b.num_rows, 64):
                j = min(i + 64, b.num_rows)
                for x, y in zip(sets(b.column(2), i, j), sets(b.column(3), i, j), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    union = len(x) + len(y) - common
                    ok.append(union > 0 and 100 * common >= percent * union)
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["u", "v"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of docs."""
    if percent < 80:
        raise ValueError("the bands are laid out for a similarity of 0.8 or more")
    width = ROWS if percent >= 85 else SHORT_ROWS
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    sets = written(sketched(docs, shingle), "sets")
    nodes = written(sets.filter("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(
        F.min(F.struct("doc_id", "sketch")).alias("m")).select("s1", "s2", "n", F.col("m.doc_id").alias("node"), F.col("m.sketch").alias("sketch")), "nodes")
    info = nodes.select(F.col("node").alias("id"), F.col("n").alias("size"), "sketch")
    bands = nodes.select("node", F.explode(F.expr(
        f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sketch, i * {width} + 1, {width})))")).alias("key"))
    # written, so that the join below can split a frequent key over tasks
    buckets = written(bands.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("lead")).filter("c > 1").select(
        F.col("key").alias("k"), "c", "lead"), "leads")
    live = written(bands.join(buckets, F.col("key") == F.col("k")).select("key", "node", "c", "lead"), "buckets")

    def with_sketch(pairs):
        x, y = (info.select(*[F.col(c).alias(f"{c}{i}") for c in info.columns]) for i in (1, 2))
        return pairs.join(x, F.col("a") == F.col("id1")).join(y, F.col("b") == F.col("id2")).select(
            "a", "b", "sketch1", "sketch2", "size1", "size2")

    stars = live.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    stars = written(with_sketch(stars).mapInArrow(_estimate(percent), "a bigint, b bigint"), "stars")
    # the texts that later steps need, moved once; a merge join whatever the sizes
    busy = live.select(F.col("node").alias("b")).distinct().hint("merge")
    texts = written(docs.join(busy, docs.doc_id == busy.b, "left_semi"), "near_texts")
    x, y = (texts.select(F.col("doc_id").alias(f"id{i}"), F.col("text").alias(f"text{i}")) for i in (1, 2))
    both = stars.join(x, F.col("a") == F.col("id1")).join(y, F.col("b") == F.col("id2")).select("a", "b", "text1", "text2")
    links = written(both.mapInArrow(_confirm(shingle, percent), "u bigint, v bigint").distinct(), "links")
    label = components(links)
    named = live.join(label.withColumnRenamed("node", "l"), F.col("node") == F.col("l"), "left").select(
        "key", "node", "c", F.coalesce("component", "node").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m"),
                                     F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).filter("lo <> hi")
    mixed = written(mixed.groupBy("m", "who").agg(F.min("key").alias("k")).select("k"), "mixed")  # buckets with the same members: one of them
    open_ = named.join(mixed, F.col("key") == F.col("k"), "left_semi")
    cut = open_.withColumn("nb", F.ceil(F.col("c") / BLOCK_ROWS).cast("long")).withColumn(
        "blk", F.pmod(F.xxhash64("node"), F.col("nb")))
    dealt = cut.join(info, F.col("node") == F.col("id")).join(x, F.col("node") == F.col("id1"))
    dealt = dealt.withColumn("o", F.explode(F.expr("sequence(cast(0 as bigint), nb - 1)"))).select(
        "key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "node", "size", "label", "sketch", "text1", "blk")
    more = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(
        _links_within(shingle, percent), "u bigint, v bigint").distinct()
    label = components(links.unionByName(more))
    where = nodes.select(F.col("s1").alias("p"), F.col("s2").alias("q"), F.col("n").alias("m"), "node")
    label = label.withColumnRenamed("node", "l")
    out = sets.select("doc_id", "n", "s1", "s2").join(
        where, (F.col("s1") == F.col("p")) & (F.col("s2") == F.col("q")) & (F.col("n") == F.col("m")) & F.col("doc_id").isNotNull(), "left")
    out = out.join(label, F.col("node") == F.col("l"), "left")
    component = F.coalesce("component", "node", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4_setsketch_neardup(spark, sf_dir):
    """Near-duplicate classes of all documents at similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"))
