"""The log as a folder of Parquet segments: appending, polling from an absolute offset, its bounds, identity and retention."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.operators import markers as marks
from tidelog.operators.chunks import numbered
from tidelog.sources.codec import MAX_ENVELOPE
from tidelog.sources.state import StateStore

SEGMENT = "offset bigint, partition int, key string, value string"


class LogError(RuntimeError):
    """The log isn't the one that was pinned, or doesn't hold what is asked of it."""


class Log:
    """One ordered log: records (offset, partition 0, key, value) under `root`, and its identity in `root`/identity.

    Order is the offset, never that of files. One writer appends; a segment that a crash left without its place in the
    list of segments doesn't count, and a retry writes its offsets again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def create(self, topic: str, system: str) -> Log:
        """Pin what this log is and which system it comes from."""
        if not self._fs.exists(self._path(f"{self.root}/identity")):
            stream = self._fs.create(self._path(f"{self.root}/identity"), False)
            stream.write(json.dumps({"topic": topic, "system": system}).encode())
            stream.close()
        return self

    def identity(self) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/identity"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def require_identity(self, topic: str, system: str) -> None:
        found = self.identity()
        if found != {"topic": topic, "system": system}:
            raise LogError(f"the log is {found}, not topic {topic} of system {system}")

    def _segments(self) -> list[str]:
        folder = self._path(f"{self.root}/segments")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return [f"{self.root}/segments/{n}" for n in sorted(names) if self._fs.exists(self._path(f"{self.root}/segments/{n}/_SUCCESS"))]

    def records(self) -> DataFrame:
        paths = self._segments()
        return self.spark.read.schema(SEGMENT).parquet(*paths) if paths else self.spark.createDataFrame([], SEGMENT)

    def lead(self, owner: str) -> tuple[StateStore, int]:
        """Become the one writer; who led before is fenced from then on."""
        leader = StateStore(self.spark, f"{self.root}/leader", owner)
        return leader, leader.acquire()

    def append(self, records: DataFrame, order: list[str], leader: tuple[StateStore, int] | None = None) -> int:
        """Add records (key, value) in the order of columns; the next offset. A record over the limit, or another leader, raises."""
        if leader is not None:
            leader[0].assert_owner(leader[1])
        start = self.bounds()["end_offset"] or 0
        kept = numbered(records, order, "__number")[0]  # in the shared folder, so records are computed once
        if kept.where(F.octet_length("value") > MAX_ENVELOPE).limit(1).count():
            raise LogError(f"a record has more than {MAX_ENVELOPE} bytes")
        placed = kept.select((F.col("__number") + start).cast("bigint").alias("offset"), F.lit(0).alias("partition"), "key", "value")
        placed.write.mode("overwrite").parquet(f"{self.root}/segments/{start:020d}")
        return self.bounds()["end_offset"] or 0

    def bounds(self) -> dict:
        """earliest, end_offset and partitions; nulls for an empty log."""
        return bounds(self.records()).first().asDict()

    def poll(self, start: int, max_records: int = 100) -> DataFrame:
        """At most `max_records` records from an absolute offset on. An offset that is no longer, or not yet, there raises."""
        found = self.bounds()
        if found["partitions"] and found["partitions"] != 1:
            raise LogError(f"the log has {found['partitions']} partitions")
        self.require_retained(start)
        if start > (found["end_offset"] or 0):
            raise LogError(f"offset {start} is behind the end of the log, {found['end_offset']}")
        return self.records().where((F.col("offset") >= start) & (F.col("offset") < start + max_records))

    def require_retained(self, frontier: int) -> None:
        """The checkpoint's next offset must still be in the log."""
        earliest = self.bounds()["earliest"]
        if earliest is not None and frontier < earliest:
            raise LogError(f"offset {frontier} is gone; the log starts at {earliest}")

    def barrier(self, changes: DataFrame, marker: str, start: int) -> int:
        """The offset after a barrier that must be in the log by now."""
        found = marks.after_barrier(changes, marker, start).first()["next_offset"]
        if found is None:
            raise LogError(f"barrier {marker} is not in the log at or after {start}")
        return found


def bounds(records: DataFrame) -> DataFrame:
    """(earliest, end_offset, partitions) of records."""
    return records.agg(F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("end_offset"), F.countDistinct("partition").alias("partitions"))


def bounded(records: DataFrame, limit: int) -> DataFrame:
    """Records, if they have at most `limit` distinct offsets; else an error."""
    if records.select("offset").distinct().limit(limit + 1).count() > limit:
        raise LogError(f"a batch has more than {limit} offsets")
    return records


def start_faults(slot: dict | None, published: set[str], table: str, marker_table: str, identity_full: bool, frontier: str | None = None) -> list[str]:
    """What keeps a capture from starting: slot, publication, row identity, and a position that the source no longer keeps."""
    faults = []
    if slot is None:
        faults.append("the slot doesn't exist")
    elif slot.get("lost") or slot.get("plugin") != "pgoutput":
        faults.append("the slot can't be used")
    faults += [f"{name} is not published" for name in (table, marker_table) if name not in published]
    if not identity_full:
        faults.append(f"{table} doesn't log whole old rows")
    if slot and frontier and slot.get("restart_lsn") and _position(frontier) < _position(slot["restart_lsn"]):
        faults.append(f"{frontier} is behind what the slot keeps, {slot['restart_lsn']}")
    return faults


def _position(lsn: str) -> int:
    high, low = lsn.split("/")
    return int(high, 16) << 32 | int(low, 16)
