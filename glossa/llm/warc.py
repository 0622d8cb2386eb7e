"""WARC archives with revisit records and an externally merged capture index.

``folder`` is a URI that ``pyarrow.fs`` opens on every executor (a shared file
system, HDFS or an object store).

Writing: every task writes its captures as gzip members to archive files of
its own in a shared folder and, with each file, a run: its index entries
sorted by URL key and timestamp.  Runs are bounded (``RUN_RECORDS``).  A file
name is new for each attempt and only the entries of the attempt that Spark
commits are kept, so a lost executor leaves at most an unreferenced file.

Merging: the entries are range-partitioned by (URL key, timestamp, page id),
so any share of one host or URL is dealt over many tasks; in each range the
slices of the runs meet in a k-way merge by a loser tree.  Ranges in order
are the globally ordered capture histories, the index of the archives.

Reading: each record is read back from its file, offset and length; a revisit
takes its payload from the response it refers to.

Of captures with one payload of ``min_bytes`` or more, the one with the
smallest page id is a response, the others refer to it.

Edge cases: a null html is an empty payload; a null url is the empty URL; a
null page id is written and read as such and never referred to; rows that
repeat a page id are records of their own (as responses if theirs is the
smallest); an empty table gives no archive and no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import urllib.parse
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, small_batches, table, written

#: Records of one archive file and its run.
RUN_RECORDS = 50_000
INDEX = "urlkey string, captured bigint, page_id bigint, run string, pos int, record_type string, offset bigint, length bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then path and query; scheme,
    user, ``www.`` and default ports are left out."""
    try:
        u = urllib.parse.urlsplit(url.strip())
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    tail = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + tail.lower()


def record(page_id, url: str, captured: int, digest: str, refers_to, payload: bytes) -> bytes:
    """One uncompressed WARC record."""
    when = (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=captured)).strftime("%Y-%m-%dT%H:%M:%SZ")
    name = lambda x: f"<urn:page:{'none' if x is None else x}>"
    block = HTTP + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}",
            f"WARC-Target-URI: {urllib.parse.quote(url, safe=URL_SAFE)}", f"WARC-Date: {when}", f"WARC-Payload-Digest: sha256:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: All printable ASCII but the percent sign's own escape; the rest is percent-encoded.
URL_SAFE = "".join(map(chr, range(0x21, 0x7F))).replace("%", "")


def parse(raw: bytes) -> dict:
    """Fields of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    number = lambda k: None if (v := fields.get(k, "<urn:page:none>")[10:-1]) == "none" else int(v)
    return {"page_id": number("WARC-Record-ID"), "url": urllib.parse.unquote(fields["WARC-Target-URI"]), "record_type": fields["WARC-Type"],
            "refers_to": number("WARC-Refers-To"), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
            "payload": block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None}


def with_types(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``pages`` (page_id, url, html, captured) with digest, refers_to."""
    pages = pages.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256)).withColumn("bytes", F.octet_length("html"))
    firsts = written(pages.filter((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest", "bytes").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.col("digest").alias("d"), F.col("bytes").alias("b"), "first"), "payloads")
    both = pages.join(firsts, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    return both.withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).select(
        "page_id", "url", "html", "captured", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Index entries of the archives written below ``folder``, run by run."""
    def run(batches):
        fs, path = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        out, entries, name, at = None, [], None, 0

        def close():
            entries.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0))
            cols = list(zip(*[(k, c, p, name, i, t, o, n) for i, (k, c, p, t, o, n) in enumerate(entries)], strict=True))
            out.close()
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                              ["urlkey", "captured", "page_id", "run", "pos", "record_type", "offset", "length"])

        for b in batches:
            for i in range(b.num_rows):
                page, url, html, captured, digest, refers = (b.column(c)[i].as_py() for c in range(6))
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = z.compress(record(page, url, captured, digest, refers, html.encode())) + z.flush()
                out.write(raw)
                entries.append((url_key(url), captured, page, "response" if refers is None else "revisit", at, len(raw)))
                at += len(raw)
                if len(entries) >= RUN_RECORDS:
                    yield close()
                    out, entries = None, []
        if entries:
            yield close()

    return pages.mapInArrow(run, INDEX)


class LoserTree:
    """k-way merge of sorted runs: inner places hold losers, each step replays one path."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.tree = [-1] * max(1, self.k)
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._less(a, b) else (b, a)
        self.tree[0] = winners[1] if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or x == y and a < b

    def __iter__(self):
        while self.k:
            w = self.tree[0]
            if self.at[w] >= len(self.runs[w]):
                return
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            node = (w + self.k) // 2
            while node > 0:
                if self._less(self.tree[node], w):
                    self.tree[node], w = w, self.tree[node]
                node //= 2
            self.tree[0] = w


def merge_runs(entries: DataFrame) -> DataFrame:
    """The entries in global order of (urlkey, captured, page_id), range by range."""
    schema = entries.schema
    ranged = entries.repartitionByRange("urlkey", "captured", F.asc_nulls_first("page_id"), "run", "pos").sortWithinPartitions("run", "pos")

    def run(batches):
        held = list(batches)  # one range of the index
        if not sum(b.num_rows for b in held):
            return
        t = pa.Table.from_batches(held).combine_chunks()
        names, cut = np.unique(t.column("run").to_numpy(zero_copy_only=False), return_index=True)
        keys = list(zip(t.column("urlkey").to_pylist(), t.column("captured").to_pylist(),
                        [(p is not None, p or 0) for p in t.column("page_id").to_pylist()], range(t.num_rows), strict=True))
        ends = [*sorted(cut.tolist())[1:], t.num_rows]
        merged = LoserTree([keys[a:b] for a, b in zip(sorted(cut.tolist()), ends, strict=True)])
        order = np.fromiter((k[3] for k in merged), dtype=np.int64, count=t.num_rows)
        yield from t.take(pa.array(order)).combine_chunks().to_batches()

    return ranged.mapInArrow(run, schema)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Records of the archives, in file order within a task; ``payload`` is null for revisits."""
    def run(batches):
        fs, path = pa.fs.FileSystem.from_uri(folder)
        name, f = None, None
        for b in batches:
            rows = []
            for r, o, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if r != name:
                    if f is not None:
                        f.close()
                    name, f = r, fs.open_input_file(f"{path}/{r}")
                f.seek(o)
                x = parse(zlib.decompress(f.read(n), 31))
                if x["payload"] is not None and hashlib.sha256(x["payload"]).hexdigest() != x["payload_digest"]:
                    raise ValueError(f"payload of page {x['page_id']} is damaged")
                rows.append(x)
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, KIND)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, KIND)
        if f is not None:
            f.close()

    by_place = index.select("run", "offset", "length").repartitionByRange("run", "offset").sortWithinPartitions("run", "offset")
    return by_place.mapInArrow(run, RECORD)


KIND = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                  ("payload_digest", pa.string()), ("payload", pa.binary())])


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            captured=None, min_bytes: int = 100) -> DataFrame:
    """Writes the archives and returns the merged index (a written table).
    ``captured`` is a column of epoch seconds; by default the page id says when."""
    small_batches(pages.sparkSession)
    page = F.col(id_col).cast("long")
    when = F.coalesce(F.lit(946684800) + F.pmod(page, F.lit(10**9)) if captured is None else captured, F.lit(0)).cast("long")
    rows = pages.select(page.alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"), when.alias("captured"))
    runs = written(write_archives(with_types(rows, min_bytes), folder), "runs")
    return written(merge_runs(runs), "captures")


def op9_warc_archive(spark, sf_dir):
    """All pages written as WARC records and read back through the merged index."""
    folder = shared_path(spark, "warc")
    records = read_archives(archive(table(spark, sf_dir, "pages"), folder), folder)
    records = written(records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type",
                                     "refers_to"), "records")
    sources = records.filter("record_type = 'response' and page_id is not null").select(
        F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("full")).dropDuplicates(["p", "d"])
    revisits = records.filter("record_type = 'revisit'").join(sources, (F.col("refers_to") == F.col("p")) & (F.col("payload_digest") == F.col("d"))).select(
        "page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return records.filter("record_type = 'response'").unionByName(revisits)


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT n, d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY n, d
)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.n = f.n AND p.d = f.d
"""
