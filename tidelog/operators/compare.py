"""Exact comparison of two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidelog.operators.chunks import with_chunks


def differences(source: DataFrame, replica: DataFrame, key: str) -> DataFrame:
    """(key, kind): keys missing on a side, and keys whose cells differ; nulls equal each other."""
    values = [c for c in source.columns if c != key]
    left = source.select(F.col(key).alias("__a"), F.struct(*values).alias("__x"))
    right = replica.select(F.col(key).alias("__b"), F.struct(*values).alias("__y"))
    joined = left.join(right, F.col("__a") == F.col("__b"), "full_outer")
    kind = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(~F.col("__x").eqNullSafe(F.col("__y")), "different")
    return joined.select(F.coalesce("__a", "__b").alias(key), kind.alias("kind")).where("kind IS NOT NULL")


def first_difference(source: DataFrame, replica: DataFrame, key: str) -> DataFrame:
    """In the order of the typed key."""
    return differences(source, replica, key).orderBy(key).limit(1)


def changed_keys(changes: DataFrame, key: str, start: int, stop: int, cap: int, offset: str = "offset") -> DataFrame:
    """Distinct keys of changes in [start, stop). More than `cap` raises; none is dropped."""
    keys = changes.where((F.col(offset) >= start) & (F.col(offset) < stop)).select(key).distinct()
    if keys.limit(cap + 1).count() > cap:
        raise ValueError(f"more than {cap} keys changed between {start} and {stop}")
    return keys


def compare_keys(keys: DataFrame, source: DataFrame, replica: DataFrame, key: str) -> DataFrame:
    """(key, equal) for given keys; absent on both sides is equal."""
    values = [c for c in source.columns if c != key]
    left = source.select(key, F.struct(*values).alias("__x"))
    right = replica.select(key, F.struct(*values).alias("__y"))
    return keys.join(left, key, "left").join(right, key, "left").select(key, F.col("__x").eqNullSafe(F.col("__y")).alias("equal"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of `a`, then of `b`, that the other lacks, counting repeats, with `side` 'source' or 'replica'. Nulls equal each other."""
    only = {"source": a.exceptAll(b), "replica": b.exceptAll(a)}
    return only["source"].withColumn("side", F.lit("source")).unionByName(only["replica"].withColumn("side", F.lit("replica")))


def multiset_equal(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def range_differences(source: DataFrame, replica: DataFrame, key: str, chunks: DataFrame) -> DataFrame:
    """(chunk_min, chunk_max, differences) of every chunk of a manifest; keys outside all chunks come with nulls, if they differ."""
    placed = with_chunks(differences(source, replica, key), key, chunks.select("chunk_min", "chunk_max"))
    counts = placed.groupBy("chunk_min", "chunk_max").agg(F.count("*").alias("__n"))
    known = chunks.select("chunk_min", "chunk_max").join(counts, ["chunk_min", "chunk_max"], "left").select("chunk_min", "chunk_max", F.coalesce("__n", F.lit(0)).alias("differences"))
    outside = counts.where("chunk_min IS NULL").select("chunk_min", "chunk_max", F.col("__n").alias("differences"))
    return known.unionByName(outside)
