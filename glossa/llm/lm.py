"""Masked pseudo-likelihood language-model scoring.

A window network predicts every token from ``SIDE`` tokens on both sides: the
neighbours' embeddings, one hidden layer, and a softmax factored into classes
(log p(class) + log p(token | class)), normalised over the whole vocabulary.
A document's score is the sum of the conditional log-probabilities of all its
tokens.

Vocabulary: word counts over all documents.  The network predicts the most
frequent words and hashed buckets of the others; a word in a bucket gets
log p(bucket | neighbours) + log(count(word) / count(bucket)), with its count
over all documents.  So every word of the corpus has a probability of its own,
and they sum to one (but for what training leaves to an empty bucket).  The counts of up to ``LOCAL`` words are sent to the tasks;
those of rarer words are joined on the word hash in a shuffle.  Training
(numpy): words are hashed and looked up once, and written as 16-bit codes that
all rounds and the scoring read; the rounds part the positions of all documents by a hash, and in each
every task masks its share, takes Adagrad steps on them from the common
parameters, and the tasks' results are averaged by examples, merged in salted
groups on the executors; so every token of every document is masked and
predicted in exactly one round, and only one set of parameters (fixed size)
reaches the driver.

Edge cases: null or empty texts have no token, score 0 and a null mean;
neighbours beyond the ends are a padding token; repeated rows train and score
each; a word that the counted documents lack is scored as if it occurred once; an empty table gives no rows (and an untrained model).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotated, small_batches, table, written
from .textops import ALNUM, Words, doc_ranges, mix64, signed, text_buffer

SIDE = 2
CLASSES, MEMBERS = 64, 64
VOCAB = CLASSES * MEMBERS
BUCKETS = 256
DIM, HIDDEN = 16, 32
#: Words beyond the network's own whose counts are sent to the tasks.
LOCAL = 1 << 19
ROUNDS, RATE = 2, 0.1
#: Targets of a step: few in a task's first steps, more as it has seen more.
BATCH, LARGEST = 512, 16384
#: Targets of a pass within a step.
CACHED = 2048
#: Parts in which parameters are merged, and salted groups of each.
PARTS, SALTS = 16, 16
NEIGHBOURS = [o for o in range(-SIDE, SIDE + 1) if o]


class Vocabulary:
    """Word hash -> id; ids are in order of frequency, buckets come last, then padding."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, sums: np.ndarray | None = None):
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], order.astype(np.int32)
        share = np.zeros(VOCAB)
        share[:len(counts)] = counts
        share[VOCAB - BUCKETS:] += max(0, total - int(counts.sum())) / BUCKETS if sums is None else sums
        share = (share + 0.1) / (share + 0.1).sum()
        self.share = share.reshape(CLASSES, MEMBERS)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        out = (VOCAB - BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int32)).astype(np.int32)
        if len(self.keys):
            k = np.searchsorted(self.keys, h)
            k[k == len(self.keys)] = 0
            known = self.keys[k] == h
            out[known] = self.ids[k[known]]
        return out


class Tail:
    """Counts of words in the buckets: sums by bucket, and the words with ``least`` or more."""

    def __init__(self, sums: np.ndarray, hashes: np.ndarray, counts: np.ndarray, least: int):
        order = np.argsort(hashes)
        self.sums, self.least = np.log(np.maximum(sums, 1)), least
        self.keys, self.logs = hashes[order], np.log(counts[order])

    @property
    def whole(self) -> bool:
        """Whether every word that is left out occurs once, so that its log count is 0."""
        return self.least <= 2

    def share(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log(count / count of the bucket), with a count of 1 where it is not
        here, and which are here."""
        out = -self.sums[(h % np.uint64(BUCKETS)).astype(np.int64)]
        known = np.zeros(len(h), dtype=bool)
        if len(self.keys):
            k = np.searchsorted(self.keys, h)
            k[k == len(self.keys)] = 0
            known = self.keys[k] == h
            out[known] += self.logs[k[known]]
        return out, known


def initial(vocab: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    """Small random weights; the biases start at the words' frequencies."""
    r = np.random.default_rng(seed)
    f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
    return {"e": f(VOCAB + 1, DIM, scale=0.3), "w": f(len(NEIGHBOURS), DIM, HIDDEN, scale=0.2), "b": np.zeros(HIDDEN, np.float32),
            "c": f(HIDDEN, CLASSES, scale=0.1), "cb": np.log(vocab.share.sum(1)).astype(np.float32),
            "m": f(CLASSES, HIDDEN, MEMBERS, scale=0.1), "mb": np.log(vocab.share / vocab.share.sum(1, keepdims=True)).astype(np.float32)}


def _logits(h, weights, bias):
    """Logits of the units ``h`` (n, units): an entry a row and a target a
    column, so that what follows runs along the targets."""
    x = weights.T @ h.T
    x += bias[:, None]
    return x


def _sums(x):
    """Sums of the columns, in the order in which numpy sums 64 neighbours."""
    if len(x) % 8 or len(x) > 128:
        return x.sum(0)
    r = x.reshape(-1, 8, x.shape[1]).sum(0)
    return ((r[0] + r[1]) + (r[2] + r[3])) + ((r[4] + r[5]) + (r[6] + r[7]))


def _softmax(x, bounded):
    """Softmax of each column, in place; ``bounded`` says that no entry can overflow ``exp``."""
    if not bounded:
        x -= x.max(0)
    np.exp(x, out=x)
    x /= _sums(x)
    return x


def _log_softmax_at(x, row, bounded):
    """log-softmax of x at one row of each column; ``bounded`` says that no
    entry can overflow ``exp``."""
    if not bounded:
        x -= x.max(0)
    own = x[row, np.arange(x.shape[1])]
    return own - np.log(_sums(np.exp(x, out=x)))


class Model:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self.first = None

    def _bounded(self):
        """Where no logit can overflow ``exp``: hidden units lie between -1 and 1."""
        p = self.p
        return ((np.abs(p["c"]).sum(0) + np.abs(p["cb"])).max() < 60, (np.abs(p["m"]).sum(1) + np.abs(p["mb"])).max(1) < 60)

    def log_probs(self, target: np.ndarray, around: np.ndarray) -> np.ndarray:
        """log p(target | neighbours), normalised over the vocabulary."""
        p = self.p
        if self.first is None:
            self.first = [p["e"] @ p["w"][i] for i in range(len(NEIGHBOURS))]
            self.low_c, self.low_m = self._bounded()
            self.bias = np.tile(p["b"], (CACHED, 1))
        order = np.argsort((target // MEMBERS).astype(np.uint8), kind="stable")  # classes become slices
        cls, member = np.divmod(np.take(target, order), MEMBERS)
        around = np.take(around, order, axis=0)
        n = len(target)
        h = np.empty((n, HIDDEN), p["e"].dtype)
        found = np.empty(n, h.dtype)
        for a in range(0, n, CACHED):
            at = slice(a, min(a + CACHED, n))
            x = np.take(self.first[0], around[at, 0], axis=0)
            for i, f in enumerate(self.first[1:], 1):
                x += np.take(f, around[at, i], axis=0)
            x += self.bias[:len(x)]
            np.tanh(x, out=h[at])
            found[at] = _log_softmax_at(_logits(h[at], p["c"], p["cb"]), cls[at], self.low_c)
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            for a in range(cuts[k], cuts[k + 1], CACHED):
                at = slice(a, min(a + CACHED, cuts[k + 1]))
                found[at] += _log_softmax_at(_logits(h[at], p["m"][k], p["mb"][k]), member[at], self.low_m[k])
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradient(self, target, around):
        """Loss and gradients of the mean negative log-probability."""
        p, n = self.p, len(target)
        order = np.argsort((target // MEMBERS).astype(np.uint8), kind="stable")  # classes become slices
        target, around = np.take(target, order), np.take(around, order, axis=0)
        w = p["w"].reshape(-1, HIDDEN)
        cls, member = np.divmod(target, MEMBERS)
        rows = np.arange(n)
        low_c, low_m = self._bounded()
        kind = p["e"].dtype
        h = np.empty((n, HIDDEN), kind)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dh, loss = np.empty_like(h), 0.0
        for a in range(0, n, CACHED):  # what a pass touches stays in the cache
            at = slice(a, min(a + CACHED, n))
            np.matmul(np.take(p["e"], around[at], axis=0).reshape(-1, len(w)), w, out=h[at])
            h[at] += p["b"]
            np.tanh(h[at], out=h[at])
            dc = _softmax(_logits(h[at], p["c"], p["cb"]), low_c)
            own = rows[:dc.shape[1]]
            loss -= np.log(dc[cls[at], own]).sum()
            dc[cls[at], own] -= 1
            np.matmul(dc.T, p["c"].T, out=dh[at])
            g["c"] += (dc @ h[at]).T
            g["cb"] += dc.sum(1)
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            for a in range(cuts[k], cuts[k + 1], CACHED):
                at = slice(a, min(a + CACHED, cuts[k + 1]))
                dm = _softmax(_logits(h[at], p["m"][k], p["mb"][k]), low_m[k])
                own, row = rows[:dm.shape[1]], member[at]
                loss -= np.log(dm[row, own]).sum()
                dm[row, own] -= 1
                g["m"][k] += (dm @ h[at]).T
                g["mb"][k] += dm.sum(1)
                dh[at] += dm.T @ p["m"][k].T
        e = np.zeros((DIM, VOCAB + 1))
        for a in range(0, n, CACHED):
            at = slice(a, min(a + CACHED, n))
            d = dh[at]
            slope = h[at] * h[at]
            d *= np.subtract(1, slope, out=slope)
            g["b"] += d.sum(0)
            g["w"] += (np.take(p["e"], around[at], axis=0).reshape(-1, len(w)).T @ d).reshape(p["w"].shape)
            dx = np.ascontiguousarray((w @ d.T).reshape(len(NEIGHBOURS), DIM, -1).transpose(1, 0, 2), dtype=np.float64).reshape(DIM, -1)
            where = np.ascontiguousarray(around[at].T, dtype=np.intp).ravel()
            for i in range(DIM):
                e[i] += np.bincount(where, weights=dx[i], minlength=VOCAB + 1)
        g["e"] = e.T.astype(kind)
        for v in g.values():
            v /= n
        return loss / n, g

    def learn(self, target, around, seen, rate):
        loss, g = self.gradient(target, around)
        for k, d in g.items():
            seen[k] += d * d
            self.p[k] -= rate * d / np.sqrt(seen[k])
        return loss


def _examples(w: Words, vocab: Vocabulary):
    """Targets, neighbours and documents of the tokens."""
    return _windows(vocab.lookup(w.hashes), w.by_doc)


def _windows(ids: np.ndarray, by_doc: np.ndarray, which=None):
    """The same from ids, for all tokens or those at ``which``."""
    at = np.arange(len(ids)) if which is None else np.flatnonzero(which)
    doc = np.repeat(np.arange(len(by_doc) - 1), np.diff(by_doc))[at]
    lo, hi = by_doc[doc], by_doc[doc + 1]
    around = np.empty((len(at), len(NEIGHBOURS)), np.int32)
    for i, o in enumerate(NEIGHBOURS):
        j = at + o
        inside = (j >= lo) & (j < hi)
        around[:, i] = np.where(inside, ids[np.clip(j, 0, max(0, len(ids) - 1))], VOCAB)
    return ids[at], around, doc


def _chunks(batches, column=0):
    for b in batches:
        buf, offs = text_buffer(b.column(column))
        for i, j in doc_ranges(offs):
            yield Words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], ALNUM)


def build_vocabulary(texts: DataFrame, size: int = VOCAB - BUCKETS) -> tuple[Vocabulary, Tail, DataFrame]:
    """The ``size`` most frequent words of all documents (ties: smaller hash),
    the counts of the others, and the table (word, n) of those not in ``Tail``."""
    def run(batches):
        held = []

        def counted():
            h, n = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            c = np.bincount(n, weights=np.concatenate([c for _, c in held])).astype(np.int64)
            return h, c

        size_ = total = 0
        for w in _chunks(batches):
            total += len(w)
            h, c = np.unique(w.hashes, return_counts=True)
            held.append((h, c))
            size_ += len(h)
            if size_ > 2_000_000:  # pre-aggregated in bounded memory
                h, c = counted()
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(c)], ["word", "n"])
                held, size_ = [], 0
        if held:
            h, c = counted()
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(c)], ["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["word", "n"])  # of all words

    counts = written(texts.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    rows = counts.filter("word is not null").orderBy(F.desc("n"), "word").limit(size).collect()
    hashes = np.array([r["word"] for r in rows], dtype=np.int64).view(np.uint64)
    top = np.array([r["n"] for r in rows], dtype=np.int64)
    # at most 256 buckets of 63 bands; the first band that fits, down to the words that occur twice
    shares = counts.groupBy(F.col("word").bitwiseAND(BUCKETS - 1).alias("bucket"), (F.length(F.bin("n")) - 1).alias("band")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).collect()
    total = sum(r["n"] for r in shares if r["bucket"] is None)
    sums, words = np.zeros(BUCKETS, np.int64), np.zeros(64, np.int64)
    for r in shares:
        if r["bucket"] is not None:
            sums[r["bucket"]] += r["n"]
            words[r["band"]] += r["c"]
    np.subtract.at(sums, (hashes % np.uint64(BUCKETS)).astype(np.int64), top)
    above = words[::-1].cumsum()[::-1]
    least = 1 << next(i for i in range(1, 64) if i == 63 or above[i] <= size + LOCAL)
    more = counts.filter((F.col("n") >= least) & F.col("word").isNotNull()).toArrow()
    tail = Tail(sums, more["word"].to_numpy().view(np.uint64), more["n"].to_numpy(), least)
    return Vocabulary(hashes, top, total, sums), tail, counts.filter((F.col("n") > 1) & (F.col("n") < least))


def turns(w: Words, rounds: int) -> np.ndarray:
    """The round in which each token is a target: by word and place in the document."""
    place = (np.arange(len(w)) - np.repeat(w.by_doc[:-1], np.diff(w.by_doc))).astype(np.uint64)
    return mix64(w.hashes + place * np.uint64(0x9E3779B97F4A7C15), 1) % np.uint64(max(1, rounds))


def masked(w: Words, turn: int, rounds: int) -> np.ndarray:
    """Which tokens are targets in this round; each is in one of the rounds."""
    return turns(w, rounds) == turn


def encoded(docs: DataFrame, text_col: str, vocab: Vocabulary, tail: Tail, rounds: int, keep=None) -> DataFrame:
    """``row`` (columns ``keep``), n_tokens, codes, share, rare: the words hashed
    and looked up once for all rounds and the scoring.  A code is id + (VOCAB + 1)
    * round, 16 bits a token; ``share`` sums the bucket shares of a document's
    words, ``rare`` lists the words whose count is not in ``tail``."""
    if rounds * (VOCAB + 1) > 1 << 16:
        raise ValueError("rounds must be 15 at most")
    shared = docs.sparkSession.sparkContext.broadcast((vocab, tail))  # bounded size

    def make():
        vocab, tail = shared.value

        def texts(column):
            buf, offs = text_buffer(column)
            counts, codes, shares, rare, rare_by = [], [], [], [], []
            for i, j in doc_ranges(offs):
                w = Words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], ALNUM)
                ids = vocab.lookup(w.hashes)
                codes.append((ids + (VOCAB + 1) * turns(w, rounds).astype(np.int32)).astype("<u2").tobytes())
                counts.append(np.diff(w.by_doc))
                at = np.flatnonzero(ids >= VOCAB - BUCKETS)
                doc = np.repeat(np.arange(j - i), counts[-1])[at]
                share, known = tail.share(w.hashes[at])
                shares.append(np.bincount(doc, weights=share, minlength=j - i))
                if not tail.whole:
                    rare.append(w.hashes[at[~known]])
                    rare_by.append(np.bincount(doc[~known], minlength=j - i))
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            ends = np.concatenate([[0], *rare_by]).cumsum().astype(np.int32) if rare_by else np.zeros(len(n) + 1, np.int32)
            words = signed(np.concatenate(rare)) if rare else np.zeros(0, np.int64)
            bounds = np.concatenate([[0], 2 * n.cumsum()]).astype(np.int32)
            return [pa.array(n, pa.int64()), pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(b"".join(codes))]),
                    pa.array(np.concatenate(shares) if shares else [], pa.float64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(words, pa.int64()))]

        return texts

    out = annotated(docs, text_col, make, "n_tokens bigint, codes binary, share double, rare array<bigint>", keep)
    return written(out if keep is None or keep else out.drop("row"), "encoded")


def _coded_chunks(column: pa.Array):
    """(first document, documents after the last, ids, rounds, offsets by document), a bounded part at a time."""
    buf, offs = text_buffer(column)
    for i, j in doc_ranges(offs):
        codes = buf[offs[i]:offs[j]].view("<u2").astype(np.int32)
        yield i, j, codes % (VOCAB + 1), codes // (VOCAB + 1), (offs[i:j + 1] - offs[i]) // 2


def _train_round(coded: DataFrame, vocab, params, turn: int, rounds: int, rate: float) -> dict:
    """Parameters after one round on encoded documents, averaged over the tasks by examples."""
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast(params)
    names = list(params)
    shapes = [params[k].shape for k in names]

    def run(batches):
        start = shared.value
        model = Model({k: v.copy() for k, v in start.items()})
        seen = {k: np.full_like(v, 1e-6) for k, v in start.items()}
        n, held = 0, []

        def learn(last):
            target = np.concatenate([t for t, _ in held])
            around = np.concatenate([a for _, a in held])
            held.clear()
            size = min(LARGEST, max(BATCH, n // 16))
            stop = len(target) if last else len(target) // size * size
            mixed = np.random.default_rng(turn).permutation(stop)
            for i in range(0, stop, size):
                model.learn(target[mixed[i:i + size]], around[mixed[i:i + size]], seen, rate)
            if stop < len(target):
                held.append((target[stop:], around[stop:]))
            return stop

        waiting = 0
        for b in batches:
            for _, _, ids, when, by_doc in _coded_chunks(b.column(0)):
                target, around, _ = _windows(ids, by_doc, when == turn)
                held.append((target, around))
                waiting += len(target)
                if waiting >= 64 * BATCH:
                    done = learn(False)
                    n, waiting = n + done, waiting - done
        if waiting:
            n += learn(True)
        if n:
            flat = np.concatenate([model.p[k].ravel() for k in names]).astype(np.float64) * n
            for i, part in enumerate(np.array_split(flat, PARTS)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([n % SALTS], pa.int32()), pa.array([n], pa.int64()),
                     pa.array([part.tobytes()], pa.binary())], ["part", "salt", "n", "total"])

    def merge(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for i, n, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x = np.frombuffer(raw, np.float64)
                if i in sums:
                    sums[i][0] += n
                    sums[i][1] += x
                else:
                    sums[i] = [n, x.copy()]
        for i, (n, x) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([0], pa.int32()), pa.array([n], pa.int64()),
                                              pa.array([x.tobytes()], pa.binary())], ["part", "salt", "n", "total"])

    schema = "part int, salt int, n bigint, total binary"
    tasks = coded.select("codes").mapInArrow(run, schema)
    merged = tasks.repartition(PARTS * SALTS, "part", "salt").mapInArrow(merge, schema)
    rows = merged.repartition(PARTS, "part").mapInArrow(merge, schema).collect()  # one set of parameters
    if not rows:
        return params
    flat = np.concatenate([np.frombuffer(r["total"], np.float64) / r["n"] for r in sorted(rows, key=lambda r: r["part"])]).astype(np.float32)
    out, at = {}, 0
    for k, s in zip(names, shapes, strict=True):
        size = int(np.prod(s))
        out[k] = flat[at:at + size].reshape(s).copy()
        at += size
    return out


def _fit(docs: DataFrame, text_col: str, rounds: int, keep):
    small_batches(docs.sparkSession)
    vocab, tail, rest = build_vocabulary(docs.select(F.col(f"`{text_col}`").cast("string").alias("text")))
    params = initial(vocab)
    coded = encoded(docs, text_col, vocab, tail, rounds, keep)
    for turn in range(rounds):
        params = _train_round(coded, vocab, params, turn, rounds, RATE / (1 + turn))
    return (vocab, params, tail, rest), coded


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS):
    """(vocabulary, parameters, counts of the words in buckets, table of further counts) from all documents."""
    return _fit(docs, text_col, rounds, [])[0]


def score(docs: DataFrame, fitted, text_col: str = "text", keep=None) -> DataFrame:
    """``row`` (columns ``keep``), n_tokens and log_prob of each document."""
    small_batches(docs.sparkSession)
    return scored(encoded(docs, text_col, fitted[0], fitted[2], 1, keep), fitted)


def scored(coded: DataFrame, fitted) -> DataFrame:
    """``row``, n_tokens and log_prob of encoded documents."""
    _, params, tail, rest = fitted
    shared = coded.sparkSession.sparkContext.broadcast(params)  # fixed size
    src = coded.withColumn("at", F.monotonically_increasing_id())

    def run(batches):
        model = Model(shared.value)
        for b in batches:
            total = b.column(2).to_numpy().copy()
            for i, j, ids, _, by_doc in _coded_chunks(b.column(1)):
                target, around, doc = _windows(ids, by_doc)
                for a in range(0, len(target), LARGEST):
                    lp = model.log_probs(target[a:a + LARGEST], around[a:a + LARGEST])
                    total[i:j] += np.bincount(doc[a:a + LARGEST], weights=lp, minlength=j - i)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total)], ["place", "log_prob"])

    sums = src.select(F.struct("row", "n_tokens", "at", "rare").alias("place"), "codes", "share")
    out = sums.mapInArrow(run, f"place {sums.schema['place'].dataType.simpleString()}, log_prob double").select("place.*", "log_prob")
    if tail.whole:
        return out.select("row", "n_tokens", "log_prob")
    # the words whose counts the tasks lack, joined on the word; written, so that a row keeps its number
    part = written(out, "scored")
    asked = part.select("at", F.explode("rare").alias("asked"))
    more = asked.join(rest.hint("shuffle_hash"), F.col("asked") == F.col("word")).groupBy("at").agg(F.sum(F.ln("n")).alias("more"))
    more = more.withColumnRenamed("at", "to")
    return part.join(more, F.col("at") == F.col("to"), "left").select(
        "row", "n_tokens", (F.col("log_prob") + F.coalesce("more", F.lit(0.0))).alias("log_prob"))


def op6_lm_score(spark, sf_dir):
    """Pseudo-log-likelihood of every document under a model of all documents."""
    fitted, coded = _fit(table(spark, sf_dir, "documents"), "text", ROUNDS, ["doc_id"])
    out = scored(coded, fitted)
    return out.select("row.doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))
