"""Key ranges of a backfill: bounds, keyset pages, manifests, their proof, and the completed prefix."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window, functions as F

from tidelog.sources.shared import ensure_checkpoints

LEAST = -(1 << 63)
GREATEST = (1 << 63) - 1
#: Starts of chunks that a plan compares one by one, and those that it may hold as a constant (8 bytes each).
TREE = 32
LISTED = 100_000


def upper_bound(rows: DataFrame, key: str) -> DataFrame:
    """The greatest key; 0 for an empty table."""
    return rows.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("upper_bound"))


def next_page(rows: DataFrame, key: str, after: int | None, upper: int, size: int) -> DataFrame:
    """Least and greatest of the first `size` keys after a cursor (None: from the start) up to a bound. No row count is skipped."""
    page = rows.where(F.col(key) <= upper)
    if after is not None:
        page = page.where(F.col(key) > after)
    return page.select(key).orderBy(key).limit(size).agg(F.min(key).alias("chunk_min"), F.max(key).alias("chunk_max"))


def arithmetic_page(done: int, size: int, upper: int) -> tuple[int, int] | None:
    """The next range without a query, clamped to the bound."""
    if done >= upper:
        return None
    return done + 1, min(upper, done + size if done <= GREATEST - size else GREATEST)


def numbered(rows: DataFrame, order: list[str], name: str = "rank") -> tuple[DataFrame, int]:
    """Rows with their number, from 0, in the order of columns, and how many there are. No task sorts or counts all of them.

    Rows are spread by range over partitions, sorted there and kept with their place in the shared folder, so that counts and
    numbers are of the same spread; the counts, one a partition, give each partition its first number.
    """
    ensure_checkpoints(rows.sparkSession)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the row's number in its partition
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", place).checkpoint()
    counts = sorted((r["__part"], r["n"]) for r in spread.groupBy("__part").agg(F.count("*").alias("n")).collect())
    firsts, total = [], 0
    for part, n in counts:
        firsts.append((part, total))
        total += n
    starts = rows.sparkSession.createDataFrame(firsts, "__part int, __first bigint")  # a row for each partition
    return spread.join(F.broadcast(starts), "__part").withColumn(name, F.col("__first") + F.col("__at")).drop("__part", "__at", "__first"), total


def ranked_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, rank from 0) in the order of keys."""
    return numbered(rows.select(key), [key])[0]


def manifest(rows: DataFrame, key: str, size: int, upper: int) -> DataFrame:
    """Gap-free chunks of `size` keys from the least bigint to the bound: (chunk_id, chunk_min, chunk_max, keys)."""
    ranked, n = numbered(rows.where(F.col(key) <= upper).select(F.col(key).alias("__key")), ["__key"])
    if not n:
        return rows.sparkSession.createDataFrame([(0, LEAST, upper, 0)], "chunk_id bigint, chunk_min bigint, chunk_max bigint, keys bigint")
    pages = ranked.groupBy(F.floor(F.col("rank") / size).cast("bigint").alias("chunk_id")).agg(F.max("__key").alias("__last"), F.count("*").alias("keys"))
    before = pages.select((F.col("chunk_id") + 1).alias("chunk_id"), F.col("__last").alias("__before"))
    last = F.when(F.col("chunk_id") == (n - 1) // size, F.lit(upper)).otherwise(F.col("__last"))
    return pages.join(before, "chunk_id", "left").select("chunk_id", F.coalesce(F.col("__before") + 1, F.lit(LEAST)).alias("chunk_min"), last.alias("chunk_max"), "keys")


def manifest_faults(chunks: DataFrame, upper: int) -> DataFrame:
    """Rows that break the proof: start at the least bigint, no gap, no overlap, end at the bound. None: proven."""
    ranked, n = numbered(chunks.select("chunk_min", "chunk_max"), ["chunk_min", "chunk_max"])
    before = ranked.select((F.col("rank") + 1).alias("rank"), F.col("chunk_max").alias("__before"))
    fault = (
        F.when(F.col("chunk_min") > F.col("chunk_max"), "empty range")
        .when(F.col("rank") == 0, F.when(F.col("chunk_min") != LEAST, "does not start at the least key"))
        .when(F.col("__before") >= F.col("chunk_min"), "overlap")
        .when(F.try_add("__before", F.lit(1)) < F.col("chunk_min"), "gap")
    )
    ends = F.when((F.col("rank") == n - 1) & (F.col("chunk_max") != upper), "does not end at the bound")
    return ranked.join(before, "rank", "left").select("chunk_min", "chunk_max", F.coalesce(fault, ends).alias("fault")).where("fault IS NOT NULL")


def contiguous_frontier(chunks: DataFrame) -> DataFrame:
    """The greatest key of the completed prefix: the end of the last chunk before the first that isn't completed."""
    broken = F.min(F.when(~F.col("completed"), F.col("chunk_min")))
    first = chunks.agg(broken.alias("__stop"))
    done = chunks.crossJoin(F.broadcast(first)).where(F.col("__stop").isNull() | (F.col("chunk_min") < F.col("__stop")))  # one row
    return done.agg(F.coalesce(F.max("chunk_max"), F.lit(LEAST)).alias("completed_through"), F.count("*").alias("chunks"))


def progress(chunks: DataFrame) -> DataFrame:
    """Chunks by state and the job's next state."""
    done, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    state = F.when(failed > 0, "failed").when(done == F.count("*"), "ready_to_verify").otherwise("running")
    return chunks.groupBy("job_id").agg(F.count("*").alias("chunks"), done.alias("completed"), failed.alias("failed"), state.alias("state"))


def place_in(key, starts: list[int]):
    """How many of some ascending numbers are not above a key: a tree of comparisons, or for many a binary search."""
    if len(starts) <= TREE:
        def tree(low: int, high: int):  # the answer is in [low, high]
            if low == high:
                return F.lit(low)
            middle = (low + high + 1) // 2
            return F.when(key >= starts[middle - 1], tree(middle, high)).otherwise(tree(low, middle - 1))

        return F.when(key.isNull(), 0).otherwise(tree(0, len(starts)))
    listed = F.from_json(F.lit(json.dumps(starts)), "array<bigint>")  # folded to one constant
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(starts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) <= key, at + step).otherwise(at))


def with_chunks(rows: DataFrame, key: str, chunks: DataFrame, limit: int = LISTED) -> DataFrame:
    """Each row with the columns of the chunk that holds its key; nulls outside all. Chunks don't overlap.

    The starts of at most `limit` chunks go into the plan, where each row finds its chunk's start by itself; the chunk's other
    columns come by an equi-join on that start. Of more chunks every so many-th start cuts the keys into blocks in this way, and inside a
    block, which has as many keys as its chunks, the last start before each key is carried forward.
    """
    n = chunks.count()
    every = max(1, -(-n // limit))
    cuts = chunks.select("chunk_min") if every == 1 else numbered(chunks.select("chunk_min"), ["chunk_min"])[0].where(F.col("rank") % every == 0)
    starts = sorted(r["chunk_min"] for r in cuts.select("chunk_min").collect())  # at most `limit`
    columns = [c for c in chunks.columns if c != "chunk_min"]
    facts = chunks.select(F.col("chunk_min").alias("__start"), F.struct("chunk_min", *columns).alias("__chunk"))
    if every == 1:
        place = place_in(F.col(key), starts)
        listed = F.from_json(F.lit(json.dumps(starts)), "array<bigint>")
        found = rows.withColumn("__start", F.get(listed, place - 1)).join(facts, "__start", "left").drop("__start")
    else:
        marks = facts.select(F.col("__start").alias("__key"), place_in(F.col("__start"), starts).alias("__block"), F.lit(0).alias("__turn"), "__chunk")
        each = rows.select(F.col(key).alias("__key"), place_in(F.col(key), starts).alias("__block"), F.lit(1).alias("__turn"), F.struct(*rows.columns).alias("__row"))
        both = each.unionByName(marks, allowMissingColumns=True)
        so_far = Window.partitionBy("__block").orderBy("__key", "__turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = both.withColumn("__chunk", F.last("__chunk", ignorenulls=True).over(so_far)).where("__turn = 1").select("__row.*", "__chunk")
    inside = F.col(key) <= F.col("__chunk.chunk_max")
    return found.select(*rows.columns, *[F.when(inside, F.col("__chunk")[c]).alias(c) for c in ("chunk_min", *columns)])


def arithmetic_pages(spark, done: int, size: int, upper: int) -> DataFrame:
    """All ranges of `size` keys after `done` up to the bound, without a query: (chunk_id, chunk_min, chunk_max)."""
    n = max(0, -(-(upper - done) // size))
    first = F.lit(done).cast("decimal(38,0)") + F.col("id") * size + 1  # wide, so that the last page can't overflow
    last = F.least(first + (size - 1), F.lit(upper).cast("decimal(38,0)"))
    return spark.range(n).select(F.col("id").alias("chunk_id"), first.cast("bigint").alias("chunk_min"), last.cast("bigint").alias("chunk_max"))


def counters(chunks: DataFrame) -> DataFrame:
    """Chunks completed, candidates seen and rows that survived, by job."""
    done = F.col("status") == "completed"
    return chunks.groupBy("job_id").agg(F.count_if(done).alias("completed"), F.coalesce(F.sum("rows_scanned"), F.lit(0)).alias("candidates"), F.coalesce(F.sum(F.when(done, F.col("rows_applied"))), F.lit(0)).alias("survivors"))
