"""Markers in the log: what they are called, where they are, and the windows that they open and close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LOW, HIGH, BARRIER = "low", "high", "barrier"
KINDS = (LOW, HIGH, BARRIER)
RANGE = ["job_id", "attempt", "chunk_min", "chunk_max"]


def marker_id(job: Column, attempt: Column, kind: Column, chunk_min: Column, chunk_max: Column, nanos: Column) -> Column:
    """job:attempt:kind:min:max:nanoseconds. A kind outside the set raises."""
    known = F.when(kind.isin(*KINDS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown marker kind: "), kind)).cast("string"))
    return F.concat_ws(":", job, attempt, known, *(c.cast("string") for c in (chunk_min, chunk_max, nanos)))


def written(requests: DataFrame) -> DataFrame:
    """Marker rows for requests (job_id, attempt, kind, chunk_min, chunk_max, nanos); a barrier's range is 0 to 0."""
    low, high = (F.when(F.col("kind") == BARRIER, 0).otherwise(F.col(c)).cast("bigint") for c in ("chunk_min", "chunk_max"))
    placed = requests.withColumn("chunk_min", low).withColumn("chunk_max", high)
    return placed.select(marker_id(*(F.col(c) for c in ("job_id", "attempt", "kind", "chunk_min", "chunk_max", "nanos"))).alias("id"), "kind", *RANGE)


def once(markers: DataFrame) -> DataFrame:
    """Each marker where it is first delivered; replays keep the id, not the offset."""
    rest = [c for c in markers.columns if c != "id"]
    return markers.groupBy("id").agg(F.min_by(F.struct(*rest), "offset").alias("one")).select("id", "one.*")


def position(markers: DataFrame, marker: str) -> DataFrame:
    """(offset, lsn) of a marker that has been applied; no row if it hasn't."""
    return markers.where(F.col("id") == marker).select("offset", "lsn").orderBy("offset").limit(1)


def committed(markers: DataFrame, marker: str) -> bool:
    return not position(markers, marker).isEmpty()


def after_barrier(markers: DataFrame, marker: str, start: int) -> DataFrame:
    """The offset after the first delivery of a barrier at or after `start`; null if there is none."""
    found = markers.where((F.col("id") == marker) & (F.col("kind") == BARRIER) & (F.col("offset") >= start))
    return found.agg((F.min("offset") + 1).alias("next_offset"))


def windows(chunks: DataFrame, markers: DataFrame) -> DataFrame:
    """Each chunk (job_id, attempt, chunk_min, chunk_max) with its window: low, high, low_lsn, state and fault.

    outside: no LOW yet; inside: LOW seen; completing: HIGH seen after it. A second LOW, a HIGH without a LOW before it and
    a second HIGH are faults. Markers whose job, attempt or range is another's, and barriers, don't count.
    """
    is_low, is_high = F.col("kind") == LOW, F.col("kind") == HIGH
    seen = once(markers.where(is_low | is_high)).groupBy(*RANGE).agg(
        F.min(F.when(is_low, F.col("offset"))).alias("low"), F.min(F.when(is_high, F.col("offset"))).alias("high"),
        F.min_by(F.when(is_low, F.col("lsn")), F.when(is_low, F.col("offset"))).alias("low_lsn"), F.count_if(is_low).alias("__lows"), F.count_if(is_high).alias("__highs"),
    )
    # The first offset at which the sequence LOW, HIGH is broken decides what the fault is.
    fault = (
        F.when((F.col("__highs") > 0) & (F.col("low").isNull() | (F.col("high") < F.col("low"))), "HIGH without LOW")
        .when(F.col("__lows") > 1, "LOW inside a window").when(F.col("__highs") > 1, "HIGH after the window")
    )
    state = F.when(F.col("low").isNull(), "outside").when(F.col("high").isNull(), "inside").otherwise("completing")
    return chunks.join(seen, RANGE, "left").select(*chunks.columns, "low", "high", "low_lsn", state.alias("state"), fault.alias("fault"))


def checked(found: DataFrame) -> DataFrame:
    """Windows without faults; the first fault raises when it is read."""
    bad = F.raise_error(F.format_string("%s: job %s, chunk %d to %d", "fault", "job_id", "chunk_min", "chunk_max"))
    return found.withColumn("state", F.when(F.col("fault").isNull(), F.col("state")).otherwise(bad.cast("string"))).drop("fault")


def only_marker(transactions: DataFrame) -> DataFrame:
    """Transactions (events, markers) that are one marker and nothing else: they leave the target as it is."""
    return transactions.where((F.col("events") == 1) & (F.col("markers") == 1))
