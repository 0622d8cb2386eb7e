"""Benchmark decontamination by a prefix-filtered set join.

A document is contaminated where a window of ``window`` consecutive words of a
benchmark item occurs in it word for word (an item with fewer words is one
window).  Words are those of ``textops.ALNUM``: A-Z folded, runs of letters,
digits and non-ASCII characters.

A window is the set of its word shingles.  Exact containment means that every
shingle must be met, so a prefix of one shingle is necessary and enough for
the candidate join: shingles are ordered by rarity, counted over all
documents, and a window is indexed under its rarest.  A document shingle that
meets a prefix gives one candidate place; the length bound (the window must
fit between the document's ends) and the positional bound (the shingle's place
inside the window) fix where it would start; then all words are compared.

The benchmark side is cut into blocks of at most ``block_bytes`` of text; each
block's index, arrays over the words of its items, is broadcast, so what the
driver and a task hold is bounded for a benchmark of any size, and documents
are never shuffled.

Edge cases: null or empty texts have no words and no hits; an item without
words never occurs; repeated items and repeated document rows each keep their
own result; an empty benchmark gives no hits; a null item_id still marks
words but is not listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotated, table
from .textops import ALNUM, Words, doc_ranges, gram_hashes, ragged, signed, text_buffer

#: Words of a shingle; shorter windows use as many as they have.
SHINGLE = 3
#: Candidate places compared at once.
SLICE = 1 << 18
FIELDS = "n_words bigint, spans array<struct<start:int,stop:int>>, items array<bigint>"


class Windows:
    """Distinct windows of a block of items, as places in the items' words:
    window r is ``flat[start[r]:start[r] + length[r]]`` and occurs in the items
    ``item[first[r]:first[r + 1]]`` (ids that are not null, ascending)."""

    def __init__(self, texts: list, ids: list, window: int):
        buf, offs = text_buffer(pa.array(texts, pa.string()))
        w = Words(buf, offs, ALNUM)
        self.flat = w.hashes
        n = np.diff(w.by_doc)
        size = np.minimum(window, n)
        count = np.where(n > 0, n - size + 1, 0)
        start, length = np.repeat(w.by_doc[:-1], count) + ragged(count), np.repeat(size, count)
        key = np.zeros(len(start), dtype=np.uint64)
        for k in np.unique(length):
            at = length == k
            key[at] = gram_hashes(self.flat, int(k))[start[at]]
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        same = one[which]
        equal = length == length[same]
        for t in range(window):
            inside = np.flatnonzero(equal & (t < length))
            equal[inside] = self.flat[start[inside] + t] == self.flat[start[same[inside]] + t]
        same[~equal] = np.flatnonzero(~equal)  # equal hashes of different words: a window of its own
        kept, row = np.unique(same, return_inverse=True)
        self.start, self.length = start[kept], length[kept]
        known = np.array([x is not None for x in ids], dtype=bool)
        number = np.array([x if x is not None else 0 for x in ids], dtype=np.int64)
        of = np.repeat(np.arange(len(ids)), count)
        row, item = row[known[of]], number[of[known[of]]]
        order = np.lexsort((item, row))
        row, item = row[order], item[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        self.item, self.first = item[new], np.searchsorted(row[new], np.arange(len(kept) + 1))

    def shingles(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """{words: (windows whose shingles have that many, hash of the shingle at each place of ``flat``)}."""
        size = np.minimum(SHINGLE, self.length)
        return {int(s): (np.flatnonzero(size == s), gram_hashes(self.flat, int(s))) for s in np.unique(size)}

    def within(self, rows: np.ndarray, size: int) -> np.ndarray:
        """Places of ``flat`` at which a shingle of one of the windows begins."""
        edge = np.zeros(len(self.flat) + 1, dtype=np.int64)
        np.add.at(edge, self.start[rows], 1)
        np.add.at(edge, self.start[rows] + self.length[rows] - size + 1, -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


class _Lookup:
    """Membership and place of 64-bit keys, with a bit table in front."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.front = np.zeros(1 << 20, dtype=bool)
        self.front[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray):
        """Places of ``h`` that hold a key, and the key's index."""
        at = np.flatnonzero(self.front[(h >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == h[at]
        return at[ok], k[ok]


def _rarity(docs: DataFrame, text_col: str, keys_by_size: dict) -> dict:
    """Occurrences over all documents of the given shingles: {size: (hashes, numbers)}."""
    shared = docs.sparkSession.sparkContext.broadcast(keys_by_size)

    def run(batches):
        lookups = {s: _Lookup(k) for s, k in shared.value.items()}
        counts = {s: np.zeros(len(x.keys), dtype=np.int64) for s, x in lookups.items()}
        for b in batches:
            buf, offs = text_buffer(b.column(0))
            for i, j in doc_ranges(offs):
                w = Words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], ALNUM)
                for s, x in lookups.items():  # a shingle across two documents only blurs the order
                    _, k = x.find(gram_hashes(w.hashes, s))
                    counts[s] += np.bincount(k, minlength=len(x.keys))
        for s, x in lookups.items():
            hit = counts[s] > 0
            if hit.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(hit.sum()), s), pa.int32()), pa.array(signed(x.keys[hit])),
                     pa.array(counts[s][hit])], ["size", "shingle", "n"])

    rows = (docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "size int, shingle bigint, n bigint")
            .groupBy("size", "shingle").agg(F.sum("n").alias("n")).toArrow())  # one row per benchmark shingle of the block
    size, shingle, n = (rows[c].to_numpy() for c in ("size", "shingle", "n"))
    return {s: (shingle[size == s].view(np.uint64), n[size == s]) for s in keys_by_size}


def _index(docs, text_col, texts, ids, window):
    """(windows, place of the rarest shingle in each, {size: (prefixes, windows by prefix, first, number)})."""
    w = Windows(texts, ids, window)
    by_size = w.shingles()
    seen = _rarity(docs, text_col, {s: np.unique(g[w.within(rows, s)]) for s, (rows, g) in by_size.items()}) if by_size else {}
    place, parts = np.zeros(len(w.start), np.int64), {}
    for s, (rows, g) in by_size.items():
        keys, n = seen[s]
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        often = np.zeros(len(g), dtype=np.int64)
        if len(keys):
            k = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            often = np.where(keys[k] == g, n[k], 0)
        for length in np.unique(w.length[rows]):
            mine = rows[w.length[rows] == length]
            each = np.lib.stride_tricks.sliding_window_view(often, int(length) - s + 1)
            for a in range(0, len(mine), SLICE):
                place[mine[a:a + SLICE]] = each[w.start[mine[a:a + SLICE]]].argmin(axis=1)
        prefix = g[w.start[rows] + place[rows]]
        order = np.argsort(prefix, kind="stable")
        keys, first, n = np.unique(prefix[order], return_index=True, return_counts=True)
        parts[s] = (keys, rows[order], first, n)
    return w, place, parts


def _scan(index, w: Words, n_docs: int):
    """Hits of a run of documents: (document, start, length, window row)."""
    wins, place, parts = index
    lengths = wins.length
    doc_of = np.repeat(np.arange(n_docs), np.diff(w.by_doc))
    hits = []
    for s, (lookup, rows, first, count) in parts.items():
        at, key = lookup.find(gram_hashes(w.hashes, s))
        if not len(at):
            continue
        per = count[key]
        upto = np.cumsum(per)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE, side="right")))
            p = per[lo:hi]
            row = rows[np.repeat(first[key[lo:hi]], p) + ragged(p)]
            pos = np.repeat(at[lo:hi], p)
            start = pos - place[row]
            stop = start + lengths[row]
            d = doc_of[pos]
            ok = (start >= w.by_doc[d]) & (stop <= w.by_doc[d + 1])
            row, start, d = row[ok], start[ok], d[ok]
            for t in range(int(lengths.max(initial=0))):
                if not len(row):
                    break
                inside = t < lengths[row]
                same = ~inside
                same[inside] = w.hashes[start[inside] + t] == wins.flat[wins.start[row[inside]] + t]
                row, start, d = row[same], start[same], d[same]
            if len(row):
                hits.append((d, start, lengths[row], row))
            lo = hi
    if not hits:
        e = np.zeros(0, np.int64)
        return e, e, e, e
    return tuple(np.concatenate(x) for x in zip(*hits, strict=True))


def _finder(index):
    wins, place, parts = index
    index = (wins, place, {s: (_Lookup(k), r, f, n) for s, (k, r, f, n) in parts.items()})

    def texts(column):
        buf, offs = text_buffer(column)
        n_words, spans, who = [], [], []
        for i, j in doc_ranges(offs):
            w = Words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], ALNUM)
            n = j - i
            n_words.append(np.diff(w.by_doc))
            d, start, length, row = _scan(index, w, n)
            marks = np.zeros(len(w) + 1, dtype=np.int64)
            np.add.at(marks, start, 1)
            np.add.at(marks, start + length, -1)
            covered = np.cumsum(marks[:-1]) > 0
            by_doc: dict[int, set] = {}
            for x, r in set(zip(d.tolist(), row.tolist(), strict=True)):
                by_doc.setdefault(x, set()).update(wins.item[wins.first[r]:wins.first[r + 1]].tolist())
            for x in range(n):
                if x not in by_doc:
                    spans.append([])
                    who.append([])
                    continue
                a, b = w.by_doc[x], w.by_doc[x + 1]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], covered[a:b].astype(np.int8), [0]))))
                spans.append([{"start": int(p), "stop": int(q)} for p, q in zip(edge[::2], edge[1::2], strict=True)])
                who.append(sorted(by_doc[x]))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return [pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                pa.array(spans, kind), pa.array(who, pa.list_(pa.int64()))]

    return texts


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "item_id",
                  text_col: str = "text", keep=None, block_bytes: int = 16 << 20) -> DataFrame:
    """``row`` (columns ``keep`` of docs), n_words, spans (word ranges that are
    hit, merged) and items (ids of the items with an occurring window)."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    out, keep = docs, list(docs.columns if keep is None else keep)
    spark = docs.sparkSession
    found = None
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        rows = part.collect()  # at most about block_bytes of text
        index = spark.sparkContext.broadcast(_index(docs, text_col, [r["text"] for r in rows], [r["id"] for r in rows], window))
        make = lambda index=index: _finder(index.value)
        last = b == blocks - 1
        if found is None:
            found = annotated(docs, text_col, make, FIELDS, keep if last else docs.columns)
        else:  # a further block of items: its hits are merged with those so far
            prev = found.select("row.*", F.struct("spans", "items").alias("llm_before"))
            found = annotated(prev, text_col, make, FIELDS, prev.columns)
            merged = F.array_sort(F.concat("spans", "row.llm_before.spans"))
            found = found.select(
                F.struct(*[F.col(f"row.`{c}`") for c in (keep if last else docs.columns)]).alias("row"), "n_words",
                _merge_spans(merged).alias("spans"),
                F.array_sort(F.array_union("items", "row.llm_before.items")).alias("items"))
    return found


def _merge_spans(spans):
    """Union of sorted word ranges."""
    return F.aggregate(
        spans, F.expr("cast(array() as array<struct<start:int,stop:int>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= s["start"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                                  F.element_at(acc, -1)["start"].alias("start"),
                                  F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop")))))
        .otherwise(F.concat(acc, F.array(s))))


def hit_words(spans="spans"):
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])


def op8_decontaminate(spark, sf_dir):
    """Overlap of every document with every benchmark item."""
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "row.doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
