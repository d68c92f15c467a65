"""Folding a change log: last writer wins, per-key clocks, and applying the result to a replica."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

DELETE = "delete"
OPERATIONS = ("insert", "update", DELETE)


def last_changes(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last change of every key. max_by combines on the map side, so a hot key adds one row for each task."""
    rest = [c for c in changes.columns if c not in key]
    at = F.struct(*order)
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias("last")).select(*key, *[F.col("last")[c].alias(c) for c in rest])


def last_values(changes: DataFrame, key: list[str], at: str, values: list[str]) -> DataFrame:
    """The values at the greatest number `at` of every key, each by a max_by of its own: all see the same rows in the same order, so ties agree.

    Values of fixed width are then combined in a hash map, with memory for a task's distinct keys; a struct, or a text, has the task sort all
    its rows first.
    """
    return changes.groupBy(*key).agg(*[F.max_by(v, at).alias(v) for v in values])


def last_changes_ranked(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The same by row_number, as a cross-check."""
    by = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return changes.withColumn("__rank", F.row_number().over(by)).where("__rank = 1").drop("__rank")


def checked_operations(changes: DataFrame, column: str = "op") -> DataFrame:
    """Unknown operations raise as soon as they are read."""
    known = F.col(column).isin(*OPERATIONS)
    return changes.withColumn(column, F.when(known, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce(column, F.lit("null")))).cast("string")))


def apply_changes(target: DataFrame, last: DataFrame, key: list[str]) -> DataFrame:
    """The target after one last change per key: inserts and updates are upserts, a delete of an absent key is none."""
    upserts = last.where(F.col("op") != DELETE).select(*target.columns)
    return target.join(last.select(*key), key, "left_anti").unionByName(upserts)


def newer_changes(last: DataFrame, clocks: DataFrame, key: list[str]) -> DataFrame:
    """Changes that their key's clock doesn't lead: no clock, or (lsn, seq) at least that of the clock."""
    known = clocks.select(*key, F.struct("lsn", "seq").alias("__clock"))
    free = F.col("__clock").isNull() | (F.struct("lsn", "seq") >= F.col("__clock"))
    return last.join(known, key, "left").where(free).drop("__clock")


def merge_clocks(clocks: DataFrame, last: DataFrame, key: list[str]) -> DataFrame:
    """The later of each key's clock and change; of equal ones the change, which comes second."""
    both = clocks.select(*key, "lsn", "seq", "deleted", F.lit(0).alias("__turn")).unionByName(
        last.select(*key, "lsn", "seq", (F.col("op") == DELETE).alias("deleted"), F.lit(1).alias("__turn"))
    )
    return last_changes(both, key, ["lsn", "seq", "__turn"]).drop("__turn")


def fan_out(changes: DataFrame, routes: DataFrame) -> DataFrame:
    """Every change for every active route of its stream: an equi-join, so streams stay apart."""
    return changes.join(routes.where("active").drop("active"), "stream_id")


def stage_candidates(staged: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Staged candidates refreshed: the new payload counts, an eviction once made stays, also one that came first."""
    joined = staged.select(*key, F.col("payload").alias("__old"), F.col("evicted").alias("__was")).join(fresh, key, "full_outer")
    return joined.select(*key, F.coalesce("payload", "__old").alias("payload"), (F.coalesce("evicted", F.lit(False)) | F.coalesce("__was", F.lit(False))).alias("evicted"))


def numbered_changes(transactions: DataFrame, changes: str = "changes") -> DataFrame:
    """One row a change with its sequence number in the transaction. Markers take a number too."""
    rest = [c for c in transactions.columns if c != changes]
    return transactions.select(*rest, F.posexplode(changes).alias("seq", "change"))


def lag(applied, end):
    """Records that are still to be applied; never negative."""
    return F.greatest(end - applied, F.lit(0))
