"""Keyed persistence on a shared folder: append-only segments, resets by scope, merge on read, compaction.

A put writes a Parquet segment and then a small commit file whose name is the next version. The commit is renamed into place and
never replaces one, so of two writers one takes the version and the other the next, and a segment without a commit (a writer that
died) is never read. A reset of a scope is a line of a commit: it hides what earlier versions put there, and rows of the same commit
stand. Reading takes the newest row of each key; of a key's rows in one commit the one of the greatest value. Compaction writes
what is live as one segment that counts as old as the version it has read, so later commits still win.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, scope string, value string, deleted boolean"


class Keyed:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("log").getFileSystem(self._conf)
        self._fs.mkdirs(self._path("log"))

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The last committed version; 0 before any."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("log"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _commit(self, entry: dict) -> int:
        jvm = self.spark.sparkContext._jvm
        held = self._path(f"log/_{uuid.uuid4().hex}")
        out = self._fs.create(held, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        files = self._hadoop.fs.FileContext.getFileContext(held.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        while True:
            v = self.version() + 1
            try:
                files.rename(held, self._path(f"log/{v:020d}.json"), none)
                return v
            except Exception as taken:
                # Another writer has taken this version; the next one is tried.
                if "FileAlreadyExists" not in str(taken):
                    raise

    def _log(self, version: int | None) -> list[tuple[int, dict]]:
        last = self.version() if version is None else version
        lines = self.spark.read.text(f"{self.path}/log/*.json", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("long").alias("v"), "value") if last else None
        return sorted((r.v, json.loads(r.value)) for r in lines.where(F.col("v") <= last).collect()) if last else []

    def _state(self, version: int | None = None) -> tuple[dict[str, int], dict[str, int]]:
        """(segments and resets in force, each with the version that it counts from)."""
        segments, resets = {}, {}
        for v, entry in self._log(version):
            for s in entry.get("remove", []):
                segments.pop(s, None)
            segments |= {s: entry.get("at", v) for s in entry.get("add", [])}
            resets |= dict.fromkeys(entry.get("reset", []), v)
            # What a compaction has read no longer holds rows that earlier resets hide.
            resets = {s: r for s, r in resets.items() if r > entry.get("at", 0)}
        return segments, resets

    def _segment(self, rows: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        has = rows.columns
        rows.select("key", "scope", "value", (F.col("deleted") if "deleted" in has else F.lit(False)).alias("deleted")).write.parquet(f"{self.path}/{name}")
        return name

    def put(self, rows: DataFrame, reset: list[str] | None = None) -> int:
        """Put rows (key, scope, value; deleted, if there, takes keys away), after a reset of scopes in the same commit."""
        return self._commit({"add": [self._segment(rows)], "reset": reset or []})

    def reset(self, scopes: list[str]) -> int:
        return self._commit({"reset": scopes})

    def read(self, version: int | None = None) -> DataFrame:
        """key, scope, value of what is live, now or after an earlier version that has not been vacuumed."""
        segments, resets = self._state(version)
        if not segments:
            return self.spark.createDataFrame([], "key string, scope string, value string")
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{s}" for s in segments])
        # As many rows as there are segments since the last compaction, and scopes reset since.
        of = F.broadcast(self.spark.createDataFrame(list(segments.items()), "_segment string, _v long"))
        rows = rows.withColumn("_segment", F.regexp_extract(F.col("_metadata.file_path"), r"(segment-[0-9a-f]+)/", 1)).join(of, "_segment")
        newest = rows.groupBy("key").agg(F.max_by(F.struct("scope", "value", "deleted", "_v"), F.struct("_v", "value")).alias("x")).select("key", "x.*")
        hidden = F.broadcast(self.spark.createDataFrame(list(resets.items()), "scope string, _reset long"))
        live = newest.join(hidden, "scope", "left").where("not deleted and (_reset is null or _v >= _reset)")
        return live.select("key", "scope", "value")

    def get(self, keys: DataFrame) -> DataFrame:
        return self.read().join(keys.select("key").distinct(), "key", "left_semi")

    def compact(self) -> int:
        """One segment in place of all; readers of this version go on with the old ones until vacuum."""
        v = self.version()
        segments, _ = self._state(v)
        return self._commit({"add": [self._segment(self.read(v))], "remove": list(segments), "at": v})

    def vacuum(self) -> int:
        """Delete segments that no live version needs, left by compactions or writers that died; no writer may be at work."""
        kept, gone = self._state()[0], 0
        for s in self._fs.listStatus(self._hadoop.fs.Path(self.path)):
            name = s.getPath().getName()
            if name.startswith("segment-") and name not in kept:
                gone += bool(self._fs.delete(s.getPath(), True))
        return gone
