"""One batch of the log applied to a replica: effects, clocks, ledger, markers and frontier in one commit.

Every active route (a live table, the shadow tables of backfills) gets the same changes and keeps clocks of its own. A batch is fragments of transactions in the order of their offsets. They are assembled first; every transaction is then
judged by the strict replay rules against the ledger and the frontier that it would meet if transactions were
applied one by one. What is still open at the end of a batch, or held by a gate, waits in the state for the next one.

A batch costs what it changes: only the buckets of the target and the clocks that hold changed keys are read and written, the
ledger and the markers are added to, and of the ledger only files that can hold the batch's log positions are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from tidelog.functions.payload import fingerprint
from tidelog.operators import assemble, fold, replay
from tidelog.sources.state import Buckets, Change, StateStore, bucket_number

IDENTITY = ["generation", "lsn"]
LEDGER = "generation string, lsn decimal(20,0), events bigint, fingerprint string, first_offset bigint, final_offset bigint"
MARKER = "struct<id:string,kind:string,job_id:string,attempt:string,chunk_min:bigint,chunk_max:bigint>"
#: Most events of one transaction, counted over all its fragments.
MAX_EVENTS = 1_000_000
BUCKETS = 16


class ReplayError(RuntimeError):
    """The log contradicts the ledger or the frontier."""


def with_fragments(changes: DataFrame) -> DataFrame:
    """Changes without fragment columns are whole transactions, one an offset; without markers all are rows."""
    for name, value in (("fragment", F.lit(0)), ("final", F.lit(True)), ("marker", F.lit(None).cast(MARKER))):
        if name not in changes.columns:
            changes = changes.withColumn(name, value)
    return changes


def assembled(changes: DataFrame, values: list[str], keep: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> tuple[DataFrame, DataFrame]:
    """(offset, island, before) of the fragments, and one row an island with identity, offsets, state, events and fingerprint.

    Changes are read once: a fragment is one row with its changes' fingerprints in order, and all that follows is about fragments.
    `before` counts the events of the island's earlier fragments. `keep` is asked to hold what is read more than once.
    """
    mark = fingerprint([F.col(v) for v in values])
    fragments = changes.withColumn("__mark", mark).groupBy("offset").agg(
        F.min("fragment").alias("index"), F.max("fragment").alias("__most"), F.max("final").alias("final"), F.min(F.struct(*IDENTITY)).alias("source"),
        F.max(F.struct(*IDENTITY)).alias("__other"), F.count("*").alias("events"), F.count("marker").alias("markers"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "__mark"))), lambda x: x["__mark"]), "").alias("marks"),
    )
    clean = (F.col("index") == F.col("__most")) & F.col("source").eqNullSafe(F.col("__other"))
    fragments = keep(fragments.withColumn("index", F.when(clean, F.col("index")).otherwise(F.raise_error(F.lit("mixed fragments at one offset")).cast("int"))).withColumn("stream", F.lit(0)).drop("__most", "__other"))
    fragments = with_islands(fragments)
    islands = assemble.transactions(fragments, "stream", "offset").drop("stream").select("*", "source.*").drop("source")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("index", "marks"))), lambda x: x["marks"])
    rows = fragments.groupBy("island").agg(F.sha2(F.array_join(listed, ""), 256).alias("fingerprint"), F.sum("markers").alias("markers"))
    earlier = Window.partitionBy("island").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    placed = fragments.select("offset", "island", F.coalesce(F.sum("events").over(earlier), F.lit(0)).alias("before"))
    return placed, islands.join(rows, "island")


def with_islands(fragments: DataFrame) -> DataFrame:
    """Fragments with the island that each belongs to.

    In a whole transaction, or the start of one, offset - index is where fragment 0 is; if each group by that is
    without a gap, the groups are the islands. Only a log that has a gap is put in order as a whole, to say what is wrong.
    """
    claimed = fragments.withColumn("island", F.col("offset") - F.col("index"))
    gaps = claimed.groupBy("island").agg(F.min("index").alias("__least"), F.max("index").alias("__most"), F.count("*").alias("__n")).where("__least <> 0 OR __most <> __n - 1")
    return claimed if gaps.limit(1).isEmpty() else assemble.islands(fragments, "stream", "offset")


def judged(islands: DataFrame, ledger: DataFrame, frontier: int) -> DataFrame:
    """Islands with `action`: what the replay rules say when transactions are applied in the order of their offsets."""
    order = Window.orderBy("first_offset")  # a row for each transaction of one batch of one ordered log
    meets = F.greatest(F.lit(frontier), F.coalesce(F.lag("final_offset").over(order) + 1, F.lit(frontier)))
    placed = islands.withColumn("meets", meets)
    complete = placed.where("state = 'complete'")
    firsts = complete.groupBy(*IDENTITY).agg(F.min("first_offset").alias("__at"), F.min_by(F.struct("events", "fingerprint"), "first_offset").alias("__first"))
    span = complete.agg(F.min("lsn"), F.max("lsn")).first()
    near = ledger.where(F.col("lsn").between(span[0], span[1])) if span[0] is not None else ledger.limit(0)
    known = near.select(*IDENTITY, F.struct("events", "fingerprint").alias("__ledger"))
    joined = placed.join(firsts, IDENTITY, "left").join(known, IDENTITY, "left")
    before = F.coalesce("__ledger", F.when(F.col("first_offset") > F.col("__at"), F.col("__first")))
    action = replay.replay_action("meets", "first_offset", "final_offset", "events", "fingerprint", before["events"], before["fingerprint"])
    gap = F.when(F.col("first_offset") > F.col("meets"), "error: gap").otherwise(F.col("state"))
    too_many = F.when(F.col("events") > MAX_EVENTS, f"error: more than {MAX_EVENTS} events")
    return joined.withColumn("action", F.when(F.col("events") > MAX_EVENTS, too_many).when(F.col("state") == "complete", action).when(F.col("state") == "broken", "error: broken transaction").otherwise(gap)).drop("__at", "__first", "__ledger", "meets")


def judge(changes: DataFrame, ledger: DataFrame, frontier: int, values: list[str]) -> DataFrame:
    """What would become of each transaction of a batch: generation, lsn, offsets, events, fingerprint and action."""
    return judged(assembled(with_fragments(changes), values)[1], ledger, frontier)


def targets(facts: dict) -> dict[str, str]:
    """Table and clocks of every active route; without routes there is one of each."""
    if "routes" not in facts:
        return {"target": "clocks"}
    return {r["target"]: f"clocks_{name}" for name, r in facts["routes"].items() if r["active"]}


def apply_batch(
    store: StateStore, epoch: int, changes: DataFrame, key: str, columns: list[str], failpoint: Callable[[str], None] = lambda name: None, gate: int | None = None, buckets: int = BUCKETS
) -> int:
    """Apply changes (generation, lsn, offset, seq, op, key, columns; and fragment, final, marker); the version that holds them.

    A transaction whose identity and content are in the ledger is skipped; one that differs, a gap, a regress or a broken
    one raises. With a gate, no transaction that ends at or after it, and none behind it, is applied. Re-running
    after any crash is safe. A target that isn't in buckets yet is put in `buckets` of them. Markers keep their place in the transaction and go to the table of markers.
    """
    spark, record = store.spark, store.commit_record()
    facts = record["facts"]
    frontier = facts.get("next_offset", 0)
    changes = with_fragments(changes).select("generation", "lsn", "offset", "fragment", "final", "seq", "op", key, *columns, "marker")
    if facts.get("waiting"):
        held = store.read("waiting")
        changes = held.unionByName(changes.join(held.select("offset").distinct(), "offset", "left_anti"))
    kept = []

    def keep(frame: DataFrame) -> DataFrame:
        kept.append(frame.persist())
        return kept[-1]

    try:
        at = F.row_number().over(Window.partitionBy("offset").orderBy("seq")).cast("bigint") - 1
        changes = keep(changes.withColumn("__at", at))  # the place in the fragment
        placed, islands = assembled(changes, ["op", key, *columns, "marker"], keep)
        ledger = store.read("ledger")
        found = keep(judged(keep(islands), spark.createDataFrame([], LEDGER) if ledger is None else ledger, frontier))
        waits = F.col("state") == "open"
        held = waits if gate is None else waits | (F.col("final_offset") >= gate)
        error = F.col("action").startswith("error")
        seen = found.agg(F.min(F.when(error, F.struct("first_offset", "lsn", "action"))).alias("wrong"), F.min(F.when(held, F.col("first_offset"))).alias("stop")).first()
        if seen["wrong"]:
            raise ReplayError(f"{seen['wrong']['lsn']} at {seen['wrong']['first_offset']}: {seen['wrong']['action'].removeprefix('error: ')}")
        stop = seen["stop"]
        taken = found if stop is None else found.where(F.col("first_offset") < stop)
        new = F.col("action") == replay.APPLY
        reach = taken.agg((F.max("final_offset") + 1).alias("next"), F.count_if(new).alias("fresh"), F.sum(F.when(new, F.col("events") - F.col("markers"))).alias("rows"), F.sum(F.when(new, F.col("markers"))).alias("markers")).first()
        failpoint("classified")
        fresh = taken.where(F.col("action") == replay.APPLY)
        wanted = changes.join(placed.join(fresh.select("island"), "island"), "offset")
        change = Change(facts={"next_offset": max(frontier, reach["next"] or 0), "waiting": stop is not None})
        if stop is not None:
            change.tables["waiting"] = changes.where(F.col("offset") >= stop).drop("__at")
        if reach["rows"]:  # a batch of markers alone leaves the targets as they are
            rows = wanted.withColumn("seq", F.col("before") + F.col("__at")).where("marker IS NULL")
            last = keep(fold.last_changes(fold.checked_operations(rows).select(key, "op", "lsn", "seq", *columns), [key], ["lsn", "seq"]))
            for table, clock_table in targets(facts).items():
                count = store.bucket_count(clock_table, store.bucket_count(table, buckets))
                touched = tuple(r[0] for r in last.select(bucket_number([key], count)).distinct().collect())  # at most `count`
                target, clocks = store.read_buckets(table, touched), store.read_buckets(clock_table, touched)
                if clocks is None:
                    clocks = spark.createDataFrame([], f"{key} bigint, lsn decimal(20,0), seq bigint, deleted boolean")
                newer = fold.newer_changes(last, clocks, [key])
                whole = record["tables"][table]["kind"] != "buckets"
                change.buckets[table] = Buckets(fold.apply_changes(target, newer, [key]), (key,), count, None if whole else touched)
                change.buckets[clock_table] = Buckets(fold.merge_clocks(clocks, newer, [key]), (key,), count, touched)
            failpoint("folded")
        if reach["fresh"]:
            change.added["ledger"] = fresh.select(*IDENTITY, "events", "fingerprint", "first_offset", "final_offset")
        if reach["markers"]:
            change.added["markers"] = wanted.where("marker IS NOT NULL").select("marker.*", "generation", "lsn", "offset")
        if not (change.added or change.buckets or change.tables or change.facts["next_offset"] > frontier):
            return record["version"]
        version = store.commit(change, epoch=epoch, expected=record["version"], before_commit=lambda: failpoint("written"))
        failpoint("committed")
        return version
    finally:
        for frame in kept:
            frame.unpersist()
