"""A snapshot read under live changes, reconciled with the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.operators.chunks import with_chunks
from tidelog.operators.fold import DELETE, last_values

#: More than twice any offset, so that an offset and a step make one number. As text: it is beyond a bigint.
STEP = "1000000000000000000000"


def kept_row() -> Column:
    """Whether a change leaves a row; a null operation, like a delete, doesn't."""
    return F.coalesce(F.col("op") != DELETE, F.lit(False))


def surviving_candidates(snapshot: DataFrame, clocks: DataFrame, key: list[str]) -> DataFrame:
    """Snapshot rows (with their chunk's `low`) that no clock after LOW evicts. A key without a clock is untouched."""
    later = clocks.select(*key, F.col("lsn").alias("__lsn"))
    return snapshot.join(later, key, "left").where("__lsn IS NULL OR __lsn <= low").drop("__lsn")


def evicted_keys(snapshot: DataFrame, changes: DataFrame, key: str, offset: str = "offset") -> DataFrame:
    """Keys of snapshot rows that a change inside (low, high] of their chunk evicts. Equal keys meet first, then the interval decides."""
    return snapshot.join(changes.select(key, offset), key).where((F.col(offset) > F.col("low")) & (F.col(offset) <= F.col("high"))).select(key, "chunk_min").distinct()


def reconcile(snapshot: DataFrame, changes: DataFrame, windows: DataFrame, key: str, values: list[str], offset: str = "offset") -> DataFrame:
    """The replica: (key, values, origin) after backfill under `windows` (chunk_min, chunk_max, low, high) and all changes.

    The last change of a key counts, unless its chunk's LOW comes at or after it and the snapshot has the key: then
    the scan saw the change and the snapshot row counts. A deleted key never comes back.
    """
    last = last_values(changes.select(key, kept_row().alias("__kept"), offset, *values), [key], offset, ["__kept", offset, *values])
    log = last.select(F.col(key).alias("__k"), "__kept", F.col(offset).alias("__offset"), *[F.col(v).alias(f"__{v}") for v in values])
    base = with_chunks(snapshot.select(key, *values), key, windows.select("chunk_min", "chunk_max", "low"))
    joined = base.join(log, F.col(key) == F.col("__k"), "full_outer")
    has_row, seen = F.col(key).isNotNull() & F.col("low").isNotNull(), F.col("__offset") <= F.col("low")
    from_snapshot = has_row & (F.col("__offset").isNull() | seen)
    kept = joined.where(from_snapshot | (F.col("__k").isNotNull() & F.col("__kept")))
    return kept.select(
        F.coalesce(key, "__k").alias(key), *[F.when(from_snapshot, F.col(v)).otherwise(F.col(f"__{v}")).alias(v) for v in values],
        F.when(from_snapshot, "snapshot").otherwise("log").alias("origin"),
    )


def reconcile_in_steps(snapshot: DataFrame, changes: DataFrame, windows: DataFrame, key: str, values: list[str], offset: str = "offset", evict: bool = True) -> DataFrame:
    """The same by evicting candidates inside (low, high]: fold up to LOW, put survivors over it, fold what comes after.

    evict=False is the negative control: stale snapshot rows win over what happened during the scan.
    """
    rows = with_chunks(snapshot.select(key, *values), key, windows.select("chunk_min", "chunk_max", "low", "high")).where("low IS NOT NULL")
    if evict:
        rows = rows.join(evicted_keys(rows, changes, key, offset), [key, "chunk_min"], "left_anti")
    placed = with_chunks(changes.select(key, "op", offset, *values), key, windows.select("chunk_min", "chunk_max", "low", "high"))
    edge = F.col("low") if evict else F.col("high")
    before, after = F.col(offset) <= edge, F.col("low").isNull() | (F.col(offset) > edge)
    # One number holds the step (the log, the snapshot, the log again) and, within it, the offset.
    scanned = F.lit(STEP).cast("decimal(24,0)")
    place = F.col(offset).cast("decimal(24,0)") + F.when(after, scanned + scanned).otherwise(F.lit(0).cast("decimal(24,0)"))
    steps = placed.where(before | after).select(key, kept_row().alias("__kept"), place.cast("decimal(24,0)").alias("__at"), *values).unionByName(
        rows.select(key, F.lit(True).alias("__kept"), scanned.alias("__at"), *values)
    )
    from_snapshot = F.col("__at") == scanned
    return last_values(steps, [key], "__at", ["__kept", "__at", *values]).where("__kept").select(key, *values, F.when(from_snapshot, "snapshot").otherwise("log").alias("origin"))
