"""Fragments of one ordered log put together to transactions; transactions seen before dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def islands(fragments: DataFrame, stream: str = "stream", offset: str = "offset") -> DataFrame:
    """Fragments with the number of their island: fragment 0 opens one and drops an open prefix before it."""
    order = Window.partitionBy(stream).orderBy(offset)
    return fragments.withColumn("island", F.sum((F.col("index") == 0).cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def transactions(fragments: DataFrame, stream: str = "stream", offset: str = "offset") -> DataFrame:
    """One row an island: offsets, fragments, events, and its state.

    complete: starts at 0, has no gap, one source, and ends with its final fragment. abandoned: a later fragment 0 came
    first. open: its end is still to come. broken: a gap, or fragments of more than one source. Islands that fragments have already stay.
    """
    placed = fragments if "island" in fragments.columns else islands(fragments, stream, offset)
    grouped = placed.groupBy(stream, "island").agg(
        F.min(offset).alias("first_offset"), F.max(offset).alias("final_offset"), F.count("*").alias("fragments"), F.min("index").alias("least"), F.max("index").alias("most"),
        F.sum("events").cast("bigint").alias("events"), F.count_if("final").alias("finals"), F.max_by("final", F.struct(offset, "index")).alias("ended"),
        F.min("source").alias("source"), F.max("source").alias("other"),
    ).withColumn("last_island", F.max("island").over(Window.partitionBy(stream)))  # a row for each island
    dense = (F.col("least") == 0) & (F.col("most") == F.col("fragments") - 1) & (F.col("final_offset") - F.col("first_offset") == F.col("fragments") - 1) & F.col("source").eqNullSafe(F.col("other"))
    state = (
        F.when(~dense | (F.col("finals") > 1), "broken").when((F.col("finals") == 1) & F.col("ended"), "complete").when(F.col("finals") == 1, "broken")
        .when(F.col("island") < F.col("last_island"), "abandoned").otherwise("open")
    )
    return grouped.select(stream, "island", "source", "first_offset", "final_offset", "fragments", "events", state.alias("state"))


def first_deliveries(found: DataFrame, identity: list[str], offset: str) -> DataFrame:
    """Of transactions with one identity that of the least offset. Replays keep their identity, not their offset."""
    rest = [c for c in found.columns if c not in identity]
    return found.groupBy(*identity).agg(F.min_by(F.struct(*rest), offset).alias("one")).select(*identity, *[F.col("one")[c].alias(c) for c in rest])


def not_applied(found: DataFrame, ledger: DataFrame, identity: list[str]) -> DataFrame:
    return found.join(ledger.select(*identity), identity, "left_anti")
