"""Versioned state tables with one exclusive commit for all of them.

A table is kept in one of three ways: whole (written anew by a commit), appended to (each commit adds a part), or in buckets
of a key (a commit writes only the buckets that it changes). So what a commit writes depends on what it changes, not on
the size of the state.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: An appended table of more parts than this is written as one by the next commit that adds to it.
PARTS = 64
BUCKET = "__bucket"


class StaleOwner(RuntimeError):
    """Another owner has taken over, or has committed this version."""


@dataclass(frozen=True)
class Buckets:
    """New content of the buckets `touched` (None: of all) of a table kept in `count` buckets of `key`."""

    rows: DataFrame
    key: tuple[str, ...]
    count: int
    touched: tuple[int, ...] | None = None


@dataclass
class Change:
    """What a commit does: tables written anew, rows added, buckets replaced, tables dropped, and facts."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    added: dict[str, DataFrame] = field(default_factory=dict)
    buckets: dict[str, Buckets] = field(default_factory=dict)
    dropped: tuple[str, ...] = ()
    facts: dict = field(default_factory=dict)


def bucket_number(key: tuple[str, ...] | list[str], count: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(count)).cast("int")


class StateStore:
    """Tables under `root`: written as v=N/table, visible once commits/N exists.

    commits/N is created exclusively, through the file system that Spark uses for `root`: of two writers of one
    version one fails. A version that was written but not committed is an orphan that a retry overwrites.
    """

    def __init__(self, spark: SparkSession, root: str, owner: str = "owner"):
        self.spark, self.root, self.owner = spark, root.rstrip("/"), owner
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/commits"))

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def version(self) -> int:
        """The highest commit; 0 before the first."""
        return max((int(n) for n in self._names(f"{self.root}/commits") if n.isdigit()), default=0)

    def commit_record(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "epoch": 0, "owner": None, "tables": {}, "facts": {}}
        stream = self._fs.open(self._path(f"{self.root}/commits/{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def facts(self, version: int | None = None) -> dict:
        return self.commit_record(version)["facts"]

    def _read(self, name: str, entry: dict, touched=None) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        if entry["kind"] == "buckets":
            paths = [f"{self.root}/v={v}/{name}/{BUCKET}={b}" for b, v in entry["at"].items() if touched is None or int(b) in touched]
        else:
            paths = [f"{self.root}/v={v}/{name}" for v in entry["at"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """The table as of a version; None if it doesn't exist."""
        entry = self.commit_record(version)["tables"].get(table)
        return None if entry is None else self._read(table, entry)

    def bucket_count(self, table: str, default: int) -> int:
        """In how many buckets a table is kept; the default for one that isn't."""
        return self.commit_record()["tables"].get(table, {}).get("count", default)

    def read_buckets(self, table: str, touched, version: int | None = None) -> DataFrame | None:
        entry = self.commit_record(version)["tables"].get(table)
        return None if entry is None else self._read(table, entry, set(touched))

    def acquire(self) -> int:
        """Take ownership: a commit that only raises the epoch. Writers of older epochs are fenced from then on."""
        record = self.commit_record()
        self._create(record["version"] + 1, record | {"version": record["version"] + 1, "epoch": record["epoch"] + 1, "owner": self.owner})
        return record["epoch"] + 1

    def assert_owner(self, epoch: int) -> None:
        """Raises if another owner has taken over since `epoch` was acquired."""
        record = self.commit_record()
        if record["epoch"] != epoch or record["owner"] != self.owner:
            raise StaleOwner(f"{record['owner']} owns this state in epoch {record['epoch']}, not {self.owner} in epoch {epoch}")

    def release(self, epoch: int) -> None:
        """Give ownership up; the epoch stays, so that it never repeats."""
        self.assert_owner(epoch)
        record = self.commit_record()
        self._create(record["version"] + 1, record | {"version": record["version"] + 1, "owner": None})

    def commit(self, tables: dict[str, DataFrame] | Change, facts: dict | None = None, epoch: int = 0, expected: int = 0, before_commit: Callable[[], None] | None = None) -> int:
        """Write a change and make it the next version, if `expected` is still the last and `epoch` is ours."""
        change = tables if isinstance(tables, Change) else Change(tables=tables)
        record = self.commit_record()
        if record["version"] != expected or record["epoch"] != epoch or record["owner"] != self.owner:
            raise StaleOwner(f"version {record['version']} of {record['owner']} in epoch {record['epoch']}; {expected} in epoch {epoch} was expected")
        version, entries = expected + 1, dict(record["tables"])
        for name, df in change.tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v={version}/{name}")
            entries[name] = {"kind": "whole", "at": [version], "schema": df.schema.jsonValue()}
        for name, df in change.added.items():
            old = entries.get(name, {"at": []})
            whole = df if len(old["at"]) < PARTS else self._read(name, old).unionByName(df)
            whole.write.mode("overwrite").parquet(f"{self.root}/v={version}/{name}")
            entries[name] = {"kind": "parts", "at": [*(old["at"] if whole is df else []), version], "schema": df.schema.jsonValue()}
        for name, new in change.buckets.items():
            folder = f"{self.root}/v={version}/{name}"
            placed = new.rows.withColumn(BUCKET, bucket_number(new.key, new.count))
            placed.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
            written = {n.removeprefix(f"{BUCKET}=") for n in self._names(folder) if n.startswith(BUCKET)}
            kept = {} if new.touched is None else {b: v for b, v in entries.get(name, {"at": {}})["at"].items() if int(b) not in new.touched}
            entries[name] = {"kind": "buckets", "count": new.count, "at": kept | dict.fromkeys(written, version), "schema": new.rows.schema.jsonValue()}
        for name in change.dropped:
            entries.pop(name, None)
        if before_commit:
            before_commit()
        self._create(version, record | {"version": version, "tables": entries, "facts": record["facts"] | change.facts | (facts or {})})
        return version

    def _create(self, version: int, record: dict) -> None:
        target = f"{self.root}/commits/{version}"
        if self._fs.getUri().getScheme() == "file":  # the local file system's create() isn't exclusive between processes
            local = self._path(target).toUri().getPath()
            try:
                handle = os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError as e:
                raise StaleOwner(f"version {version} is committed already") from e
            with os.fdopen(handle, "w") as f:
                json.dump(record, f)
            return
        try:
            stream = self._fs.create(self._path(target), False)
        except Exception as e:
            raise StaleOwner(f"version {version} is committed already") from e
        stream.write(json.dumps(record).encode())
        stream.close()
