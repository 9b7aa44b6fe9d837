"""An append-only log laid out by the hash of its key, so that a batch reads only what it touches.

Rows lie in commits, and within a commit in buckets of the key's 128-bit hash. A
manifest names the commits; each version of it is written whole, after the
commit's files, so that a writer that is killed leaves nothing that is read.
Commits of one level are merged into one of the next when there are ``FAN`` of
them, which keeps the latest row of each key: a bucket is read from at most
``FAN`` files a level, of which there are logarithmically many.

One writer at a time; readers see the version they began with until the second
merge after it, when merged commits are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tandem.session import children, read_text, remove, write_text

#: Buckets of a new log, and commits of a level that are merged.
BUCKETS, FAN = 16, 8

class Entry(NamedTuple):
    """A commit of the manifest; without a name it only marks the last batch."""

    commit: str | None
    level: int
    buckets: list[int]
    batch: int | None
    retired: bool = False


def key_hash(*keys: Column | str) -> Column:
    """The 128-bit hash of one or more key columns; nulls differ from all texts."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    if len(parts) == 1:
        return F.unhex(F.md5(parts[0].cast("string")))
    listed = (F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts)
    return F.unhex(F.md5(F.concat(*listed)))


class KeyedLog:
    """Rows (key, fields, revision) under ``path``; ``fields`` is a DDL list of columns."""

    def __init__(
        self, spark: SparkSession, path: str, key: str, key_type: str, fields: str, buckets: int = BUCKETS, fan: int = FAN
    ):
        self.spark, self.path, self.key, self.fan = spark, path.rstrip("/"), key, fan
        self.fields = f"`{key}` {key_type}, {fields}, revision bigint"
        self._stored = f"_hash binary, _at bigint, {self.fields}"
        names = [n for n in children(spark, f"{self.path}/manifest") if n.startswith("v") and n.endswith(".json")]
        self._version = max((int(n[1:-5]) for n in names), default=0)
        now = json.loads(read_text(spark, self._manifest(self._version))) if names else {"buckets": buckets, "entries": []}
        self._entries = [Entry(**entry) for entry in now["entries"]]
        self.n = now["buckets"]  # a log keeps the buckets it began with

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/v{version}.json"

    def bucket(self, hashed: Column) -> Column:
        return F.pmod(F.xxhash64(hashed), F.lit(self.n)).cast("int")

    @property
    def commits(self) -> list[Entry]:
        """The commits that hold the log's rows."""
        return [e for e in self._entries if not e.retired and e.commit]

    def holds_batch(self, batch: int) -> bool:
        """Whether a numbered batch, or a later one, has been appended."""
        return any(e.batch is not None and e.batch >= batch for e in self._entries)

    def paths(self, buckets: Iterable[int] | None = None) -> list[str]:
        """The folders that hold the given buckets."""
        wanted = None if buckets is None else set(buckets)
        return [
            f"{self.path}/{e.commit}/bucket={b}" for e in self.commits for b in e.buckets if wanted is None or b in wanted
        ]

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(*paths)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that keys (with ``_hash``) fall in: at most as many numbers as there are buckets."""
        return [r.b for r in keys.select(self.bucket(F.col("_hash")).alias("b")).distinct().collect()]

    def hashed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_hash", key_hash(self.key))

    def missing(self, keys: DataFrame, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of ``keys`` (with ``_hash``) that the log does not hold, from the buckets they touch."""
        held = self._read(self.paths(self.touched(keys) if buckets is None else buckets)).select("_hash").distinct()
        return keys.join(held, "_hash", "left_anti")

    def latest(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The last row of each key by revision, with ``_hash``."""
        return _newest(self._read(self.paths(buckets)))

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        commit = f"commit-{uuid.uuid4().hex}"
        # one file for each bucket of a commit
        dealt = rows.withColumn("bucket", self.bucket(F.col("_hash"))).repartition(self.n, "bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/{commit}")
        names = children(self.spark, f"{self.path}/{commit}")
        return commit, sorted(int(name.removeprefix("bucket=")) for name in names if name.startswith("bucket="))

    def _publish(self, entries: list[Entry]) -> None:
        self._version += 1
        now = {"buckets": self.n, "entries": [e._asdict() for e in entries]}
        write_text(self.spark, self._manifest(self._version), json.dumps(now))
        self._entries = entries
        remove(self.spark, self._manifest(self._version - 2))

    def append(self, rows: DataFrame, batch: int | None = None) -> None:
        """Add rows (key, fields and, unless it is now, revision) as one commit; rows without a key are left out.

        ``batch`` numbers the appends of a stream.
        """
        if "revision" not in rows.columns:
            rows = rows.withColumn("revision", F.unix_micros(F.current_timestamp()))
        stored = self.hashed(rows.where(F.col(self.key).isNotNull())).withColumn("_at", F.monotonically_increasing_id())
        commit, buckets = self._write(stored.select("_hash", "_at", *self._columns()))
        self._publish([*self._entries, Entry(commit if buckets else None, 0, buckets, batch)])
        self._merge()

    def _columns(self) -> list[str]:
        return StructType.fromDDL(self.fields).names

    def _merge(self) -> None:
        level = 0
        while True:
            same = [e for e in self.commits if e.level == level]
            if len(same) < self.fan:
                if level >= max((e.level for e in self.commits), default=0):
                    return
                level += 1
                continue
            merged = _newest(self._read([f"{self.path}/{e.commit}/bucket={b}" for e in same for b in e.buckets]))
            commit, buckets = self._write(merged)
            names = {e.commit for e in same}
            batch = max((e.batch for e in same if e.batch is not None), default=None)
            gone = [e for e in self._entries if e.retired]
            kept = [e for e in self._entries if e.commit and not e.retired and e.commit not in names]
            marks = [e for e in self._entries if not e.commit][-1:]
            retired = [e._replace(retired=True) for e in same]
            self._publish([*kept, *marks, Entry(commit, level + 1, buckets, batch), *retired])
            for e in gone:
                remove(self.spark, f"{self.path}/{e.commit}")


def _newest(rows: DataFrame) -> DataFrame:
    """The last row of each hash; only (hash, revision, number) is grouped."""
    last = rows.groupBy("_hash").agg(F.max(F.struct("revision", "_at")).alias("_last"))
    return rows.join(last.select("_hash", "_last.*"), ["_hash", "revision", "_at"]).dropDuplicates(["_hash", "revision", "_at"])
