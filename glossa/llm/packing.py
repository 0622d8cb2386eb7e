"""Best-fit packing of token pieces into sequences by minimum bin slack.

Documents become token ids (a tokenizer file, then one end token); only those
longer than ``capacity`` are cut.  For each sequence, a bitset subset-sum over
the lengths that are still available finds the fullest combination that fits
beside the longest piece left; it is removed, as often as the counts allow.

The plan needs only the histogram of lengths, which has at most ``capacity``
rows whatever the input, so it is made on the driver; a plan of (pattern,
repeats) is then turned into places for all pieces on the executors.  Pieces
of one length are numbered in salted groups with offsets, so that no length,
however frequent, is gathered in one task.

Edge cases: null or empty text is the end token alone; repeated rows are
packed each; a null doc_id is packed like any other; an empty table gives no
rows.  Tokenizer files that split at blanks and drop them have their words
encoded once per task and reused, in a memo of bounded bytes; all others get
whole texts.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, table, written
from .textops import text_buffer

#: Bytes of encoded words, and of word parts, that a task keeps (about); a memo is emptied beyond this, which changes speed only.
MEMO_BYTES = 160 << 20
#: What an entry costs beside its bytes, and the bytes of a word that is not kept.
ENTRY, LONG_WORD = 180, 512
#: Bytes of text handled together.
CHUNK = 1 << 20
#: Words of these characters only have a plain normal form; all others go through the whole tokenizer.
_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """Byte -> letter of byte-level vocabularies: printable Latin-1 stays, the rest follows from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """Blank-delimited word (bytes) -> its token ids as little-endian uint32.

    Word by word is exact for files whose steps are known to split at ASCII
    blanks and to drop them (``_pattern``); every other file gets whole texts.
    For words of ASCII and Latin letters the steps are lower case and the
    file's own split pattern, so they need the model for new parts only; a test
    holds this against the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters, self.parts = self.tokenizer.model, _byte_letters(), {}
        self.held = self.held_parts = 0
        self.split = self._pattern(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def _pattern(spec: dict):
        """The split pattern for simple words, or None if the file is built otherwise."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        norm = (spec.get("normalizer") or {}).get("normalizers") or []
        if ([x["type"] for x in steps] != ["Split", "ByteLevel"] or [x["type"] for x in norm] != ["NFC", "Replace", "Lowercase"]
                or steps[1]["add_prefix_space"] or steps[1]["use_regex"] or spec.get("post_processor")
                or (steps[0]["behavior"], steps[0]["invert"]) != ("Removed", True) or "Regex" not in steps[0]["pattern"]
                or (norm[1]["pattern"], norm[1]["content"]) != ({"Regex": "\\s+"}, " ") or "\\s" not in steps[0]["pattern"]["Regex"]):
            return None
        pattern = steps[0]["pattern"]["Regex"].replace("[\\p{L}]", "[a-zß-öø-ÿ]").replace("[\\p{N}]", "[0-9]")
        pattern = pattern.replace("\\p{L}", "a-zß-öø-ÿ").replace("\\p{N}", "0-9")
        return None if "\\p" in pattern else re.compile(pattern)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if word.isalpha():  # ASCII letters alone are one part
            ids = self.parts.get(text := text.lower()) or self._part(text)
        elif "<|" in text or not _SIMPLE.fullmatch(text):
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        else:
            ids = b"".join([self.parts.get(x) or self._part(x) for x in self.split.findall(text.lower())])
        if len(word) <= LONG_WORD:
            cost = ENTRY + len(word) + len(ids)
            if self.held + cost > MEMO_BYTES:
                self.clear()
                self.held = 0
            self.held += cost
            self[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        text = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = [x.id for x in self.model.tokenize(text)]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= LONG_WORD:
            cost = ENTRY + len(part) + len(packed)
            if self.held_parts + cost > MEMO_BYTES:
                self.parts.clear()
                self.held_parts = 0
            self.held_parts += cost
            self.parts[part] = packed
        return packed

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if self.split is None:  # parts may cross blanks
            found = self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)
            return [np.array(x.ids, dtype="<u4").tobytes() for x in found]
        get = self.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids (little-endian uint32)."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    small_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = WordEncoder(tokenizer_path)
        for b in batches:
            buf, offs = text_buffer(b.column(1))
            raw = buf.tobytes()
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK, side="right")) - 1)
                rows, piece, start, length, ids = [], [], [], [], []
                for d, x in enumerate(encoder.encode([raw[offs[r]:offs[r + 1]] for r in range(i, j)]), i):
                    x += end
                    for p, a in enumerate(range(0, len(x), 4 * capacity)):
                        part = x[a:a + 4 * capacity]
                        rows.append(d)
                        piece.append(p)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        ids.append(part)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])
                i = j

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def fullest(available: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, copies) with the largest sum of at most ``room``."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(available, reverse=True):
        left, m = min(available[length], room // length), 1
        while left > 0:
            m = min(m, left)
            steps.append((length, m, reach))
            reach |= (reach << (length * m)) & mask
            left -= m
            m *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, m, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + m
            at -= length * m
    return sorted(used.items(), reverse=True)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """(pattern, repeats): minimum bin slack around the longest piece left."""
    left = {x: n for x, n in histogram.items() if n > 0}
    if any(not 0 < x <= capacity for x in left):
        raise ValueError("lengths must be between 1 and the capacity")
    plan = []
    while left:
        seed = max(left)
        left[seed] -= 1
        used = dict(fullest({x: n for x, n in left.items() if n and x <= capacity - seed}, capacity - seed))
        left[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(left[x] // k for x, k in used.items())
        for x, k in used.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
        plan.append((sorted(used.items(), reverse=True), times))
    return plan


def _segments(plan):
    """Per pattern and length, the ranks that it takes, ordered by (length, first rank)."""
    taken, first_bin, rows = {}, 0, []
    for pattern, times in plan:
        offset = 0
        for length, k in pattern:
            a = taken.get(length, 0)
            rows.append((length, a, k, first_bin, offset))
            taken[length] = a + k * times
            offset += length * k
        first_bin += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 4096, salts: int = 0) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length and any other columns) with
    sequence_id and offset; the table is written once and read three times."""
    spark = pieces.sparkSession
    salts = salts or max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    others = [c for c in pieces.columns if c not in ("doc_id", "piece", "start", "length") and
              not dict(pieces.dtypes)[c].startswith("map")]
    pieces = written(pieces, "pieces")
    salted = pieces.withColumn("llm_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", *others), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "llm_salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    segments = spark.sparkContext.broadcast(_segments(plan_bins(histogram, capacity)))
    before = counts.select("length", "llm_salt", (F.sum("n").over(
        Window.partitionBy("length").orderBy("llm_salt")) - F.col("n")).alias("llm_before"))
    within = Window.partitionBy("length", "llm_salt").orderBy("doc_id", "piece", "start", *others)
    ranked = salted.withColumn("llm_rank", F.row_number().over(within)).join(before, ["length", "llm_salt"]).select(
        *pieces.columns, (F.col("llm_rank") + F.col("llm_before") - 1).alias("llm_rank"))
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def place(batches):
        s = segments.value
        key = s[:, 0] * (1 << 44) + s[:, 1]
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.num_columns - 1).to_numpy()
            at = s[np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1]
            j = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(at[:, 3] + j // at[:, 2]), pa.array(at[:, 4] + (j % at[:, 2]) * length)], schema.names)

    return ranked.mapInArrow(place, schema)


def op5_best_fit_packing(spark, sf_dir):
    """Sequences of at most 4096 tokens from all documents."""
    import public_tokenizers
    pieces = tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
