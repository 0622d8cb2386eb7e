"""Counts that grow by batches and are merged in tiers.

A batch becomes one part of tier 0.  ``fan`` parts of a tier are merged into
one of the next, so of N batches at most ``fan - 1`` parts a tier are live:
reading touches O(log N) folders, and a row is rewritten once per tier.

The list of live parts is a manifest, one file a batch, written under another
name and renamed when everything it names is complete.  Whatever happens
before the rename leaves the store as it was: parts that no manifest names are
never read, and a batch that is retried is written anew.  A batch that a
manifest already holds is skipped, so a replay counts nothing twice.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 4
COUNTS = "counts"


class TieredCounts:
    """A count table (keys..., count) below ``path``, and other tables that grow
    with it by rows that never repeat; a manifest holds them all."""

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        jvm = spark.sparkContext._jvm
        self._file = jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ manifest

    def _manifests(self) -> list[str]:
        folder = self._file(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def manifest(self) -> dict:
        """{epoch, parts: [{table, name, tier, first, last}], notes} of the newest complete state."""
        names = self._manifests()
        if not names:
            return {"epoch": -1, "parts": [], "notes": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{names[-1]}", wholetext=True).first()[0])

    def _publish(self, state: dict) -> None:
        name = f"{self.path}/manifest/{state['epoch']:020d}"
        hidden = self._file(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = self._fs.create(hidden)
        out.write(json.dumps(state).encode())
        out.close()
        if not self._fs.rename(hidden, self._file(f"{name}.json")):
            raise RuntimeError(f"another writer has published batch {state['epoch']}")

    # ------------------------------------------------------------ writing

    def _write(self, df: DataFrame, table: str, tier: int, first: int, last: int) -> dict:
        name = f"{table}-{tier}/{first}-{last}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/parts/{name}")
        return {"table": table, "name": name, "tier": tier, "first": first, "last": last}

    def _read(self, parts: list[dict]) -> DataFrame:
        out = None
        for p in parts:
            df = self.spark.read.parquet(f"{self.path}/parts/{p['name']}")
            out = df if out is None else out.unionByName(df)
        return _summed(out) if parts[0]["table"] == COUNTS else out

    def add(self, counts: DataFrame, epoch: int, notes: dict | None = None, **others: DataFrame) -> bool:
        """Adds the counts of a batch (and rows of other tables; ``notes`` are kept
        in the manifest); False if the batch is already in."""
        state = self.manifest()
        if epoch <= state["epoch"]:
            return False
        parts = state["parts"]
        for table, rows in {COUNTS: counts, **others}.items():
            parts = [*parts, self._write(rows, table, 0, epoch, epoch)]
            tier = 0
            while len(same := [p for p in parts if p["table"] == table and p["tier"] == tier]) >= self.fan:
                merged = self._write(self._read(same), table, tier + 1, same[0]["first"], same[-1]["last"])
                parts = [p for p in parts if p not in same] + [merged]
                tier += 1
        self._publish({"epoch": epoch, "parts": parts, "notes": notes or state["notes"]})
        return True

    # ------------------------------------------------------------ reading

    def table(self, name: str) -> DataFrame | None:
        """All rows of a table; None before the first batch."""
        parts = [p for p in self.manifest()["parts"] if p["table"] == name]
        return self._read(parts) if parts else None

    def counts(self) -> DataFrame | None:
        """The sums over all batches."""
        return self.table(COUNTS)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes parts that none of the last ``keep`` manifests names, and older manifests; returns the number of parts."""
        names, live = self._manifests(), set()
        for name in names[-keep:]:
            live |= {p["name"] for p in json.loads(self.spark.read.text(f"{self.path}/manifest/{name}", wholetext=True).first()[0])["parts"]}
        gone = 0
        folder = self._file(f"{self.path}/parts")
        for tier in (self._fs.listStatus(folder) if self._fs.exists(folder) else []):
            for part in self._fs.listStatus(tier.getPath()):
                if f"{tier.getPath().getName()}/{part.getPath().getName()}" not in live:
                    self._fs.delete(part.getPath(), True)
                    gone += 1
        for name in names[:-keep]:
            self._fs.delete(self._file(f"{self.path}/manifest/{name}"), False)
        return gone


def _summed(parts: DataFrame) -> DataFrame:
    keys = [c for c in parts.columns if c != "count"]
    return parts.groupBy(*keys).agg(F.sum("count").cast("bigint").alias("count"))
