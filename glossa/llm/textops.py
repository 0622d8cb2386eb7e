"""Vectorised word handling on Arrow string columns (numpy, inside tasks).

A text is a run of UTF-8 bytes; every word class used here is defined on ASCII
bytes only, so bytes >= 0x80 always belong to words and no decoding is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes hashed at once; words never straddle two blocks.
BLOCK = 1 << 19

_U = np.uint64


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ _U(salt & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int):
        if n > self.n:
            self.n = max(n, 2 * BLOCK)
            for name, base in (("pw", _MULT), ("inv", _INV)):
                a = np.full(self.n, base, dtype=_U)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=_U))
        return self.pw, self.inv


_POWERS = _Powers()


class WordClass:
    """Which bytes make words, and whether A-Z are folded to a-z first."""

    def __init__(self, separators: bytes, lower: bool):
        self.is_word = np.ones(256, dtype=bool)
        self.is_word[list(separators)] = False
        fold = np.arange(256, dtype=np.uint8)
        if lower:
            fold[65:91] += 32
            self.is_word[65:91] = self.is_word[97:123]
        self.fold = fold
        self.table = mix64(fold.astype(_U) + _U(1), 0x5851F42D4C957F2D)


#: Words are runs of non-blank bytes, as they are.
PLAIN = WordClass(SPACE_BYTES, lower=False)
#: The same after folding A-Z.
FOLDED = WordClass(SPACE_BYTES, lower=True)
#: Letters, digits and non-ASCII after folding A-Z.
ALNUM = WordClass(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), lower=True)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def doc_ranges(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ``limit`` bytes together (one at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Words of a run of documents: byte spans, 64-bit hashes, offsets by document."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, kind: WordClass, hashes: bool = True):
        self.buf, self.offsets, self.kind = buf, offsets, kind
        inside = kind.is_word[buf]
        n = len(buf)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
            before &= ~edge[:-1]
            after[-1] = False
            after[:-1] = inside[1:]
            after &= ~edge[1:]
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.by_doc = np.searchsorted(self.starts, offsets)
        if hashes:
            self.hashes = self._hash()

    def __len__(self):
        return len(self.starts)

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=_U)
        i, n = 0, len(self.starts)
        while i < n:
            base = int(self.starts[i])
            j = int(np.searchsorted(self.ends, base + BLOCK, side="right"))
            j = min(max(j, i + 1), n)
            s, e = self.starts[i:j] - base, self.ends[i:j] - base
            pw, inv = _POWERS.upto(int(e[-1]))
            v = self.kind.table[self.buf[base:base + int(e[-1])]]
            v *= pw[:len(v)]
            c = np.cumsum(v, dtype=_U)
            out[i:j] = mix64((c[e - 1] - c[s] + v[s]) * inv[s])
            i = j
        return out


def gram_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the k consecutive symbols from each place (n - k + 1 of them),
    built by doubling, so that no power table grows with the text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    cur, length, acc, done = mix64(words, salt), 1, None, 0
    while True:
        if k & length:
            part = cur[done:done + n]
            acc = part.copy() if acc is None else acc * _U(pow(_MULT, length, 1 << 64)) + part
            done += length
        length *= 2
        if length > k:
            return mix64(acc, salt + k)
        cur = cur[:-(length // 2)] * _U(pow(_MULT, length // 2, 1 << 64)) + cur[length // 2:]


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries (len - w + 1 of them)."""
    n = len(a) - w + 1
    if n <= 0:
        return a[:0]
    cur, length = a, 1
    while 2 * length <= w:
        cur = np.minimum(cur[:-length], cur[length:])
        length *= 2
    return np.minimum(cur[:n], cur[w - length:w - length + n])


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first, counts)


def list_fields(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Entries per row (null: none) and the fields of all entries, for a list of flat structs."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    return counts, {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)
