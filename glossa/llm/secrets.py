"""Secret scan with a recursive decoding worklist.

Three kinds are matched, leftmost and without overlap per kind: ``assign``
(a key word, an assignment sign and a value of 6 or more characters),
``access`` (AKIA..., 20 or more) and ``hex`` (24 or more hex digits).

The text is the first layer of a worklist.  Each layer is unwrapped in every
way that applies (percent escapes, Unicode escapes, base64 runs, compressed
bytes); what comes out is a new layer, rescanned and unwrapped in turn, until
no new layer appears.  A digest of each layer with its place in the text stops
cycles and repeats.  Layers are made one at a time, the deepest first.  Escapes
keep a map by runs from characters to spans in the original text; what comes out of a base64 run or a compressed stream maps to
the whole run.  Finds of inner layers are added as spans of the original text;
finds of the text itself always stay.

Base64 runs go on over line breaks (with indents) and escaped ones, and are
decoded at all four alignments, so that a path or key glued to the front does
no harm; each character then maps to the run within its own line.  Bytes that
are not all text are read leniently, if any stretch of them may hold a find.
Compressed bytes are tried at the run's start and after each '/', '+', '-',
'_' and line break, and in runs of percent or hexadecimal escapes.

Edge cases: null is an empty text, without finds; rows are judged one by one,
so repeated rows give repeated results; broken encodings are not layers; of a
compressed stream all members are read.  One that expands beyond
``LAYER_LIMIT`` is not held in memory: it is scanned in pieces of ``PIECE``
that overlap by ``OVERLAP``, each unwrapped in turn, and counted in
``oversized``, since an encoded layer that crosses pieces is not joined.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotated, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Bytes of one unwrapped layer.
LAYER_LIMIT = 64 << 20
#: Bytes scanned at once of a longer one, and how many the next piece repeats.
PIECE, OVERLAP = 8 << 20, 1 << 16
#: Base64 characters by which a stream without a long mark is tried.
HEAD = 1 << 12
#: The shortest finding has 12 characters, which are 16 in base64.  Runs are possessive: a matcher that may go back
#: keeps a state for each step of a long one.
BREAK = r"(?:[ \t]*\r?\n[ \t]*|\\r\\n|\\n)"
RUN = re.compile(rf"[A-Za-z0-9+/_-](?:{BREAK}?[A-Za-z0-9+/_-]){{15,}}+={{0,2}}")
WRAP = re.compile(BREAK)
#: Where a base64 text may begin within a run.
SEAM = re.compile(r"[/+_-]")
#: Bytes that may hold a find or another layer.
LEGIBLE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
ESCAPED = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/+-]){12,}+|(?:\\(?:x|u00)[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/+()-]){12,}+")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})++")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})++|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
MAGIC = ((b"\x1f\x8b", "gzip"), (b"BZh", "bz2"), (b"\xfd7zXZ\x00", "xz"), (b"\x28\xb5\x2f\xfd", "zstd"))
FIELDS = "spans array<struct<kind:string,start:int,stop:int,path:string>>, oversized int"


def find(text: str) -> list[tuple[str, int, int]]:
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


class Oversized(Exception):
    pass


def _readable(raw: bytes) -> str | None:
    """The bytes as text, if that is what they are."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return None if re.search("[\x00-\x08\x0e-\x1f\x7f]", text) else text


def _lenient(raw: bytes) -> str | None:
    """The bytes as text with one character for each, if a stretch of them is legible."""
    return raw.decode("latin-1") if LEGIBLE.search(raw) else None


def _inflate_kind(raw: bytes) -> str | None:
    kind = next((k for m, k in MAGIC if raw.startswith(m)), None)
    if kind is None and len(raw) > 2 and raw[0] & 0x0F == 8 and (raw[0] * 256 + raw[1]) % 31 == 0:
        kind = "zlib"
    return kind


def _inflate(raw: bytes) -> tuple[str, bytes] | None:
    kind = _inflate_kind(raw)
    if kind is None:
        return None
    out = bytearray()
    try:
        for block in _blocks(kind, raw):
            out += block
            if len(out) > LAYER_LIMIT:
                raise Oversized
    except (Oversized, MemoryError):
        raise
    except Exception:  # each codec raises its own kind for bytes that only look like it
        if not out:
            return None
    return kind, bytes(out)


def _blocks(kind: str, raw: bytes):
    """What all members of a compressed stream expand to, in blocks of at most ``PIECE`` bytes."""
    if kind == "zstd":
        import zstandard
        source = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
        while block := source.read(PIECE):
            yield block
        return
    make = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[kind]
    while _inflate_kind(raw) == kind:
        d = make()
        while not d.eof:
            block = d.decompress(raw, PIECE)
            raw = d.unconsumed_tail if kind in ("gzip", "zlib") else b""
            if block:
                yield block
            elif not raw:
                return  # cut off
        raw = d.unused_data.lstrip(b"\0")


def _pieces(kind: str, raw: bytes):
    """The text of an oversized stream in overlapping pieces, up to the first broken member."""
    held = b""
    try:
        for block in _blocks(kind, raw):
            held += block
            if len(held) >= PIECE:
                yield held.decode("latin-1")
                held = held[-OVERLAP:]
    except MemoryError:
        raise
    except Exception:  # as in _inflate
        pass
    yield held.decode("latin-1")


def _base64(body: str) -> bytes:
    """Bytes of base64 characters, as far as they go."""
    body = body.replace("-", "+").replace("_", "/")
    body = body[:-1] if len(body) % 4 == 1 else body
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _escaped(run: str) -> bytes:
    """The bytes that a run of percent or hexadecimal escapes spells."""
    return re.sub(rb"(?:%|\\x|\\u00)([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), run.encode())


class Spans:
    """Where the characters of a layer stand in the original text, by runs: a
    run either follows the text character by character or lies whole in one
    span of it.  Its size follows the number of escapes or lines."""

    __slots__ = ("at", "start", "stop")

    def __init__(self):
        self.at, self.start, self.stop = array("q"), array("q"), array("q")

    def add(self, at: int, start: int, stop: int) -> None:
        """A run from character ``at``; ``stop`` is -1 where it follows the text from ``start``."""
        self.at.append(at)
        self.start.append(start)
        self.stop.append(stop)

    def place(self, a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        return (self.start[i] + (a - self.at[i] if self.stop[i] < 0 else 0),
                self.stop[j] if self.stop[j] >= 0 else self.start[j] + b - self.at[j])

    def copy(self, a: int, b: int, to: "Spans", at: int) -> None:
        """The runs of characters a..b, as those from ``at`` on."""
        i = bisect_right(self.at, a) - 1
        while a < b:
            end = min(b, self.at[i + 1]) if i + 1 < len(self.at) else b
            follows = self.stop[i] < 0
            to.add(at, self.start[i] + (a - self.at[i] if follows else 0), self.stop[i])
            at, a, i = at + end - a, end, i + 1


class _Layer:
    """A text with the place of its characters in the original text: None (it is
    the original), one span for all, or ``Spans``."""

    __slots__ = ("text", "spans", "path")

    def __init__(self, text, spans, path):
        self.text, self.spans, self.path = text, spans, path

    def place(self, a: int, b: int) -> tuple[int, int]:
        """Span in the original text of characters a..b."""
        if self.spans is None:
            return a, b
        return self.spans if isinstance(self.spans, tuple) else self.spans.place(a, b)

    def escapes(self, pattern: re.Pattern, decode, name: str):
        """The layer with all matches that ``decode`` can turn into text, or None."""
        parts, at, n = [], 0, 0
        spans = self.spans if isinstance(self.spans, tuple) else Spans()

        def keep(a, b):
            nonlocal n
            if a == b:
                return
            parts.append(self.text[a:b])
            if self.spans is None:
                spans.add(n, a, -1)
            elif isinstance(self.spans, Spans):
                self.spans.copy(a, b, spans, n)
            n += b - a

        for m in pattern.finditer(self.text):
            units = decode(m)  # (text, first, last) within the match
            if not units:
                continue
            keep(at, m.start())
            for t, a, b in units:
                parts.append(t)
                if not isinstance(spans, tuple):
                    spans.add(n, *self.place(m.start() + a, m.start() + b))
                n += len(t)
            at = m.end()
        if not at:
            return None
        keep(at, len(self.text))
        return _Layer("".join(parts), spans, (*self.path, name))


def _wrapped(spans: list[tuple[int, int]], first: list[int], shift: int, sizes) -> Spans:
    """Runs of a text whose characters (``sizes`` bytes each) stand in base64
    lines: ``first`` has the number of the first base64 character of each line."""
    out, edges, byte, at, last = Spans(), np.array(first), 0, 0, (-1, -1)
    for a in range(0, len(sizes), PIECE // 8):
        n = sizes[a:a + PIECE // 8].astype(np.int64)
        stop = byte + np.cumsum(n)
        i = np.searchsorted(edges, shift + (stop - n) * 4 // 3, side="right") - 1
        j = np.maximum(i, np.searchsorted(edges, shift + (stop * 8 - 1) // 6, side="right") - 1)
        new = np.flatnonzero((np.diff(i, prepend=last[0]) != 0) | (np.diff(j, prepend=last[1]) != 0))
        for k in new.tolist():
            out.add(at + k, spans[i[k]][0], spans[j[k]][1])
        last, byte, at = (i[-1], j[-1]), int(stop[-1]), at + len(n)
    return out


def _percent(m: re.Match):
    raw = bytes.fromhex(m[0].replace("%", ""))
    units, i = [], 0
    while i < len(raw):
        n = 1 if raw[i] < 0x80 else 2 if raw[i] >> 5 == 6 else 3 if raw[i] >> 4 == 14 else 4
        try:
            units.append((raw[i:i + n].decode(), 3 * i, 3 * min(i + n, len(raw))))
        except UnicodeDecodeError:
            n = 1
            units.append((m[0][3 * i:3 * i + 3], 3 * i, 3 * i + 3))
        i += n
    return units if any(b - a != len(t) for t, a, b in units) else None


def _unicode(m: re.Match):
    code = next((int(g, base) for g, base in zip(m.groups(), (16, 16, 16, 10), strict=True) if g), None)
    if code is not None:
        return [(chr(code), 0, len(m[0]))] if code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    units, i, raw = [], 0, m[0]
    while i < len(raw):
        n, code = 6, int(raw[i + 2:i + 6], 16)
        if 0xD800 <= code < 0xDC00 and i + 12 <= len(raw) and 0xDC00 <= (low := int(raw[i + 8:i + 12], 16)) < 0xE000:
            n, code = 12, 0x10000 + (code - 0xD800) * 0x400 + low - 0xDC00
        units.append((raw[i:i + n] if 0xD800 <= code < 0xE000 else chr(code), i, i + n))
        i += n
    return units


def _sizes(text: str) -> np.ndarray:
    """UTF-8 bytes of each character."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return (1 + (code > 0x7F).astype(np.int8) + (code > 0x7FF) + (code > 0xFFFF)).astype(np.int8)


def _begins(body: str, at: int) -> bool:
    """Whether a compressed stream seems to begin at this base64 character:
    its first block must open, so that chance headers do not cost the rest of the run."""
    if len(body) < at + 8 or (kind := _inflate_kind(_base64(body[at:at + 8]))) is None:
        return False
    if kind != "zlib":  # the others have longer marks
        return True
    try:
        zlib.decompressobj().decompress(_base64(body[at:at + HEAD]), HEAD)
    except zlib.error:
        return False
    return True


def _inflated(layer: _Layer, raw: bytes, a: int, b: int, path: tuple):
    """The layer of compressed bytes, which stand at a..b of the text, however
    often they are compressed; or (kind, bytes, place, path) of a stream too large for one."""
    seen = set()
    while True:
        digest = hashlib.blake2b(raw, digest_size=16).digest()
        if digest in seen:
            return
        seen.add(digest)
        try:
            step = _inflate(raw)
        except Oversized:
            kind = _inflate_kind(raw)
            yield kind, raw, layer.place(a, b), (*path, kind)
            return
        if step is None:
            return
        raw, path = step[1], (*path, step[0])
        text = _readable(raw)
        if text is None and _inflate_kind(raw) is None:
            text = _lenient(raw)
        if text is not None:
            yield _Layer(text, layer.place(a, b), path)
            return


def _unwrap(layer: _Layer):
    """Layers directly inside ``layer``, one at a time, and the streams that are
    too large for one."""
    if "%" in layer.text and (x := layer.escapes(PERCENT, _percent, "url")) is not None:
        yield x
    if ("\\" in layer.text or "&#" in layer.text) and (x := layer.escapes(UNICODE, _unicode, "unicode")) is not None:
        yield x
    for m in RUN.finditer(layer.text):
        yield from _unwrap_run(layer, m[0], m.start(), m.end())
    if "%" in layer.text or "\\x" in layer.text or "\\u00" in layer.text:
        for m in ESCAPED.finditer(layer.text):
            if ("%" in m[0] or "\\" in m[0]) and _inflate_kind(_escaped(m[0][:64])) is not None:
                yield from _inflated(layer, _escaped(m[0]), *m.span(), (*layer.path, "url" if "%" in m[0] else "unicode"))


def _unwrap_run(layer: _Layer, run: str, at: int, stop: int):
    """Layers of a base64 run, which may go over several lines."""
    cuts = [(x.start(), x.end()) for x in WRAP.finditer(run)]
    lines = list(zip([0, *[b for _, b in cuts]], [*[a for a, _ in cuts], len(run)], strict=True))
    pieces = [run[a:b].rstrip("=") for a, b in lines]
    body, first = "".join(pieces), [0]
    for x in pieces:
        first.append(first[-1] + len(x))
    path = (*layer.path, "base64")
    readable = False
    for shift in range(4):
        if shift == 0 and len(body) % 4 != 1:
            text = _readable(_base64(body))
            readable = text is not None
        else:
            text = None
        if text is None:
            text = _lenient(_base64(body[shift:]))
        if text is None:
            continue
        if len(lines) == 1:
            yield _Layer(text, layer.place(at + shift, stop), path)
        else:
            sizes = _sizes(text) if shift == 0 and readable else np.ones(len(text), np.int8)
            yield _Layer(text, _wrapped([layer.place(at + a, at + b) for a, b in lines], first[:-1], shift, sizes), path)
    if readable:
        return
    for k, (a, _) in enumerate(lines):
        for seam in (0, *[x.end() for x in SEAM.finditer(pieces[k])]):
            if first[k] + seam + 8 <= len(body) and _begins(body, first[k] + seam):
                yield from _inflated(layer, _base64(body[first[k] + seam:]), at + a + seam, stop, path)
    for shift in range(1, 4):
        if len(body) > shift + 8 and _begins(body, shift):
            yield from _inflated(layer, _base64(body[shift:]), at + shift, stop, path)


def scan(text: str):
    """All findings of a text as (kind, start, stop, path), and oversized layers.
    A find has the path with the fewest layers among those that lead to it."""
    found = {(a, KINDS.index(k), b): () for k, a, b in find(text)}
    seen, large = set(), 0

    def note(x):
        where = x.place(0, len(x.text)) if x.text else (0, 0)
        key = hashlib.blake2b(x.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), where
        if key in seen:
            return False
        seen.add(key)
        for k, a, b in find(x.text):
            s, e = x.place(a, b)
            old = found.get((s, KINDS.index(k), e))
            if old is None or (len(x.path), x.path) < (len(old), old):
                found[s, KINDS.index(k), e] = x.path
        return True

    def layers(parent):
        """New layers inside ``parent``; pieces of an oversized stream are layers too."""
        nonlocal large
        for x in _unwrap(parent):
            if isinstance(x, _Layer):
                if x.text != parent.text and note(x):
                    yield x
                continue
            large += 1
            kind, raw, where, path = x
            for piece in _pieces(kind, raw):
                x = _Layer(piece, where, path)
                if note(x):
                    yield x

    # the deepest open layer is unwrapped first: what is held follows the depth, not the number of layers
    open_ = [layers(_Layer(text, None, ()))]
    while open_:
        x = next(open_[-1], None)
        if x is None:
            open_.pop()
        else:
            open_.append(layers(x))
    return [(KINDS[k], a, b, ">".join(path)) for (a, k, b), path in sorted(found.items())], large


def _texts(column):
    spans, large = [], []
    for t in column:
        found, n = scan(t.as_py() or "")
        spans.append([{"kind": k, "start": a, "stop": b, "path": p} for k, a, b, p in found])
        large.append(n)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("path", pa.string())]))
    return [pa.array(spans, kind), pa.array(large, pa.int32())]


def _redacted(column):
    texts, counts, large = [], [], []
    for t in column:
        t = t.as_py()
        out, at = [], 0
        found, n = scan(t or "")
        large.append(n)
        for kind, a, b, _ in found:
            if b > at:
                out += [t[at:max(a, at)], f"[{kind}]" if a >= at else ""]
                at = b
        texts.append(t if not found else "".join(out) + t[at:])
        counts.append(len(found))
    return [pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(large, pa.int32())]


def scan_secrets(docs: DataFrame, text_col: str = "text", keep=None) -> DataFrame:
    """``row`` (columns ``keep``), spans (sorted; ``path`` names the layers and
    is empty for the text's own) and the number of oversized layers."""
    return annotated(docs, text_col, lambda: _texts, FIELDS, keep)


def redact_secrets(docs: DataFrame, text_col: str = "text", keep=None) -> DataFrame:
    """``row``, redacted (the text with each finding replaced by its kind in
    brackets; null stays null), the number of findings and that of oversized
    layers, in which some may be left."""
    return annotated(docs, text_col, lambda: _redacted, "redacted string, n_secrets int, oversized int", keep)


def op3_secret_scan(spark, sf_dir):
    """Findings in every document, base ones and those of inner layers."""
    found = scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["path"] == "")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select("row.doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        F.expr("array_join(array_distinct(transform(filter(spans, s -> s.path <> ''), s -> s.path)), ',')").alias("layers"),
                        "oversized")
