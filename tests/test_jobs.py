"""Batches over fragments, windows, leases, backfills, validation and promotion: each rule, and every crash point."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelog import catalog_jobs
from tidelog.operators import chunks, markers
from tidelog.plans import backfill, run
from tidelog.plans.apply import ReplayError, apply_batch
from tidelog.plans.backfill import Backfills, JobError, Lease
from tidelog.sources import staging
from tidelog.sources.contract import Column, TableContract
from tidelog.sources.state import Buckets, Change, StaleOwner, StateStore

SF = "/root/testdata/sf0.001"
ACCOUNTS = TableContract("accounts", (Column("id", "int8", False), Column("v", "int8")), "id")
LOG = "generation string, lsn decimal(20,0), offset bigint, fragment int, final boolean, seq bigint, op string, id bigint, v bigint, marker struct<id:string,kind:string,job_id:string,attempt:string,chunk_min:bigint,chunk_max:bigint>"


def batch(spark, *fragments):
    """(lsn, offset, fragment, final, [(op, id, v) or a marker])."""
    rows = []
    for lsn, offset, fragment, final, events in fragments:
        for seq, e in enumerate(events):
            row = (None, None, None, e) if len(e) == 6 else (*e, None)
            op = "marker" if len(e) == 6 else row[0]
            rows.append(("g", Decimal(lsn), offset, fragment, final, seq, op, row[1] if op != "marker" else None, row[2] if op != "marker" else None, row[3]))
    return spark.createDataFrame(rows, LOG)


@pytest.fixture
def store(spark, tmp_path):
    found = StateStore(spark, str(tmp_path / "state"))
    epoch = found.acquire()
    found.commit({"target": spark.createDataFrame([], ACCOUNTS.schema())}, {"next_offset": 0}, epoch, found.version())
    return found, epoch


def content(store, table="target"):
    return {r["id"]: r["v"] for r in store.read(table).collect()}


def apply(store, *fragments, **options):
    return apply_batch(store[0], store[1], batch(store[0].spark, *fragments), "id", ["v"], buckets=4, **options)


def test_equal_fragments_are_one_transaction(store):
    apply(store, (5, 0, 0, False, [("insert", 1, 1)]), (5, 1, 1, True, [("insert", 1, 1)]))
    ledger = store[0].read("ledger").collect()
    assert [(r["events"], r["first_offset"], r["final_offset"]) for r in ledger] == [(2, 0, 1)]
    apply(store, (6, 2, 0, False, [("insert", 2, 1)]), (6, 3, 1, False, [("update", 2, 2)]), (6, 4, 2, True, [("update", 2, 3)]))
    assert content(store[0]) == {1: 1, 2: 3} and store[0].facts()["next_offset"] == 5


def test_open_transaction_waits_for_its_end(store):
    apply(store, (5, 0, 0, True, [("insert", 1, 1)]), (6, 1, 0, False, [("insert", 2, 2)]))
    assert content(store[0]) == {1: 1} and store[0].facts()["next_offset"] == 1
    second = ((6, 1, 0, False, [("insert", 2, 2)]), (6, 2, 1, True, [("insert", 3, 3)]))
    apply(store, *second)  # the first fragment comes again
    assert content(store[0]) == {1: 1, 2: 2, 3: 3} and store[0].facts()["next_offset"] == 3 and not store[0].facts()["waiting"]
    apply(store, *second)
    assert content(store[0]) == {1: 1, 2: 2, 3: 3}


def test_abandoned_prefix_is_consumed(store):
    apply(store, (5, 0, 0, False, [("insert", 1, 9)]), (5, 1, 0, False, [("insert", 1, 1)]), (5, 2, 1, True, [("insert", 2, 2)]))
    assert content(store[0]) == {1: 1, 2: 2} and store[0].facts()["next_offset"] == 3


@pytest.mark.parametrize("first,second,what", [
    ([(5, 0, 0, True, [("insert", 1, 1)])], [(5, 1, 0, True, [("insert", 1, 2)])], "content"), ([(5, 0, 0, True, [("insert", 1, 1)])], [(6, 3, 0, True, [("insert", 1, 2)])], "gap"),
    ([(5, 0, 0, True, [("insert", 1, 1)])], [(4, 0, 0, True, [("insert", 1, 1)])], "behind"), ([(5, 0, 0, True, [("insert", 1, 1)])], [(6, 0, 0, False, [("insert", 1, 1)]), (6, 1, 1, True, [("insert", 1, 2)])], "inside an unapplied"),
    ([(5, 0, 0, True, [("insert", 1, 1)])], [(6, 1, 0, False, [("insert", 1, 1)]), (6, 2, 2, True, [("insert", 1, 2)])], "broken"), ([(5, 0, 0, False, [("insert", 1, 1)]), (5, 1, 1, True, [("insert", 2, 1)])], [(5, 1, 0, False, [("insert", 1, 1)]), (5, 2, 1, True, [("insert", 2, 1)])], "inside a replay"),
])
def test_contradictions(store, first, second, what):
    apply(store, *first)
    before = content(store[0])
    with pytest.raises(ReplayError, match=what):
        apply(store, *second)
    assert content(store[0]) == before


def test_replay_in_the_same_batch_and_sequences_count_markers(store):
    low = ("m", "low", "j", "a", 0, 9)
    apply(store, (5, 0, 0, True, [("insert", 1, 1), low, ("update", 1, 2)]), (6, 1, 0, True, [("update", 1, 3)]), (5, 2, 0, True, [("insert", 1, 1), low, ("update", 1, 2)]))
    assert content(store[0]) == {1: 3} and store[0].facts()["next_offset"] == 3
    assert [r["seq"] for r in store[0].read("clocks").collect()] == [0] and store[0].read("markers").count() == 1


def test_markers_alone_leave_the_target(store):
    apply(store, (5, 0, 0, True, [("insert", 1, 1)]))
    at = store[0].commit_record()["tables"]["target"]
    apply(store, (6, 1, 0, True, [("m", "barrier", "j", "a", 0, 0)]))
    assert store[0].commit_record()["tables"]["target"] == at and markers.committed(store[0].read("markers"), "m")


def test_gate_holds_whole_transactions(store):
    rows = [(5, 0, 0, True, [("insert", 1, 1)]), (6, 1, 0, False, [("insert", 2, 2)]), (6, 2, 1, True, [("insert", 3, 3)])]
    apply(store, *rows, gate=2)
    assert content(store[0]) == {1: 1} and store[0].facts()["next_offset"] == 1
    apply(store, (7, 3, 0, True, [("insert", 4, 4)]))
    assert content(store[0]) == {1: 1, 2: 2, 3: 3, 4: 4}


def written(path) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    sizes = []
    for n in (1_000, 40_000):
        store = StateStore(spark, str(tmp_path / f"s{n}"))
        epoch = store.acquire()
        rows = spark.range(n).select("id", F.col("id").alias("v"))
        store.commit(Change(buckets={"target": Buckets(rows, ("id",), 64)}, facts={"next_offset": 0}), epoch=epoch, expected=store.version())
        apply_batch(store, epoch, batch(spark, (5, 0, 0, True, [("update", 1, 0)])), "id", ["v"])
        sizes.append(written(f"{store.root}/v={store.version()}"))
        assert store.read("target").count() == n and store.read("target").where("id = 1").first()["v"] == 0
    # Forty times the rows: one bucket of 64 is written, not the table.
    assert sizes[1] < written(f"{store.root}/v=2") / 8
    before = written(f"{store.root}/v={store.version()}")
    for i in range(3):
        apply_batch(store, epoch, batch(spark, (6 + i, 1 + i, 0, True, [("update", 1, i)])), "id", ["v"])
    assert written(f"{store.root}/v={store.version()}") < 1.5 * before


def test_state_store_tables(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    epoch = store.acquire()
    frame = lambda *ids: spark.createDataFrame([(i, i) for i in ids], "id long, v long")
    store.commit(Change(buckets={"b": Buckets(frame(*range(20)), ("id",), 4)}, added={"a": frame(1)}), epoch=epoch, expected=store.version())
    touched = tuple({r[0] for r in frame(3).select(F.pmod(F.xxhash64("id"), F.lit(4))).collect()})
    gone = store.read_buckets("b", touched)
    store.commit(Change(buckets={"b": Buckets(gone.limit(0), ("id",), 4, touched)}, added={"a": frame(2)}), epoch=epoch, expected=store.version())
    assert store.read("b").count() == 20 - gone.count() and store.read("a").count() == 2 and store.read("a", store.version() - 1).count() == 1
    with pytest.raises(StaleOwner):
        store.commit(Change(), epoch=epoch, expected=store.version() - 1)
    store.release(epoch)
    with pytest.raises(StaleOwner):
        store.assert_owner(epoch)
    assert StateStore(spark, str(tmp_path), "other").acquire() == epoch + 1


# Windows


def mark_rows(spark, *rows):
    return spark.createDataFrame([(f"id{i}", k, "j", a, 0, 9, o, Decimal(o)) for i, (k, a, o) in enumerate(rows)], "id string, kind string, job_id string, attempt string, chunk_min long, chunk_max long, offset long, lsn decimal(20,0)")


@pytest.mark.parametrize("rows,state,fault", [
    ([], "outside", None), ([("low", "a", 3)], "inside", None), ([("low", "a", 3), ("high", "a", 7)], "completing", None), ([("high", "a", 7)], "outside", "HIGH without LOW"),
    ([("high", "a", 2), ("low", "a", 3)], "completing", "HIGH without LOW"), ([("low", "a", 3), ("low", "a", 4)], "inside", "LOW inside a window"), ([("low", "a", 3), ("high", "a", 7), ("high", "a", 8)], "completing", "HIGH after the window"),
    ([("low", "b", 1), ("low", "a", 3), ("high", "b", 4), ("barrier", "a", 5)], "inside", None),
])
def test_windows(spark, rows, state, fault):
    chunk = spark.createDataFrame([("j", "a", 0, 9)], "job_id string, attempt string, chunk_min long, chunk_max long")
    found = markers.windows(chunk, mark_rows(spark, *rows))
    assert [(r["state"], r["fault"]) for r in found.collect()] == [(state, fault)]
    if fault:
        with pytest.raises(Exception, match=fault):
            markers.checked(found).collect()


def test_replayed_markers_count_once(spark):
    one = mark_rows(spark, ("low", "a", 3), ("high", "a", 7))
    again = one.withColumn("offset", F.col("offset") + 100)
    chunk = spark.createDataFrame([("j", "a", 0, 9)], "job_id string, attempt string, chunk_min long, chunk_max long")
    assert [(r["low"], r["high"], r["fault"]) for r in markers.windows(chunk, one.unionByName(again)).collect()] == [(3, 7, None)]


# Many chunks


def test_many_chunks_in_one_scan(spark, tmp_path):
    spark.range(200_000).select((F.col("id") * 3).alias("k"), F.col("id").alias("v")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    manifest = spark.range(10_000).select((F.col("id") * 60).alias("chunk_min"), (F.col("id") * 60 + 49).alias("chunk_max"), F.col("id").alias("n"))
    for limit in (chunks.LISTED, 100):
        found = chunks.with_chunks(rows, "k", manifest, limit)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan
        want = {(k, k // 60 if k % 60 <= 49 else None) for k in range(0, 600_000, 3)}
        assert {(r["k"], r["n"]) for r in found.select("k", "n").collect()} == want


def test_few_chunks_and_edges(spark):
    rows = spark.createDataFrame([(k,) for k in (None, chunks.LEAST, -1, 0, 5, 6, 99, chunks.GREATEST)], "k long")
    manifest = spark.createDataFrame([(chunks.LEAST, -1), (0, 5), (50, 99)], "chunk_min long, chunk_max long")
    for limit in (10, 1):
        found = {r["k"]: r["chunk_min"] for r in chunks.with_chunks(rows, "k", manifest, limit).collect()}
        assert found == {None: None, chunks.LEAST: chunks.LEAST, -1: chunks.LEAST, 0: 0, 5: 0, 6: None, 99: 50, chunks.GREATEST: None}
    assert [r["chunk_min"] for r in chunks.with_chunks(rows, "k", manifest.limit(0)).collect()] == [None] * 8


def test_arithmetic_pages(spark):
    assert [tuple(r)[1:] for r in chunks.arithmetic_pages(spark, 0, 4, 10).collect()] == [(1, 4), (5, 8), (9, 10)]
    assert [tuple(r)[1:] for r in chunks.arithmetic_pages(spark, chunks.GREATEST - 3, 5, chunks.GREATEST).collect()] == [(chunks.GREATEST - 2, chunks.GREATEST)]
    assert chunks.arithmetic_pages(spark, 10, 4, 10).count() == 0


# Backfills


class Clock:
    def __init__(self):
        self.now = 100.0

    def __call__(self):
        return self.now


class Crash(Exception):
    pass


@pytest.fixture
def jobs(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    found = Backfills(store, store.acquire(), ACCOUNTS, Clock(), buckets=2, failpoint=run.Failpoints())
    found.folder = str(tmp_path / "stage")
    found.start_live("accounts_live")
    return found


def manifest(spark, *ranges):
    return spark.createDataFrame(ranges, "chunk_min long, chunk_max long")


def begin(jobs, *ranges, name="job", shadow="shadow_a"):
    jobs.create(name, shadow, {"topic": "t"})
    return jobs.seal(name, manifest(jobs.store.spark, *(ranges or [(chunks.LEAST, 5), (6, 9)])), (ranges or [(0, 9)])[-1][1])


def follow(jobs, *fragments):
    apply_batch(jobs.store, jobs.epoch, batch(jobs.store.spark, *fragments), "id", ["v"], buckets=2)


def mark_of(lease, kind, number):
    return (f"{kind}{number}", kind, lease.job, lease.attempt, lease.chunk_min, lease.chunk_max)


def test_job_rules(jobs, spark):
    with pytest.raises(JobError):
        jobs.create("job", "accounts_live", {})
    jobs.create("job", "shadow_a", {"topic": "t"})
    assert jobs.create("job", "shadow_a", {"topic": "t"})["state"] == "discovering"  # once more is harmless
    for name, shadow, pins in (("job", "shadow_b", {"topic": "t"}), ("other", "SHADOW_A", {})):
        with pytest.raises(JobError):
            jobs.create(name, shadow, pins)
    assert jobs.routes()["shadow_job"] == {"target": "shadow_a", "active": True}
    with pytest.raises(JobError, match="manifest"):
        jobs.seal("job", manifest(spark, (chunks.LEAST, 5), (7, 9)), 9)
    assert jobs.seal("job", manifest(spark, (chunks.LEAST, 5), (6, 9)), 9) == jobs.seal("job", manifest(spark, (chunks.LEAST, 5), (6, 9)), 9) == 2
    assert jobs.recover("job", {"topic": "t"}, 0)["state"] == "running"
    for pins, earliest in (({"topic": "x"}, 0), ({"topic": "t"}, 5)):
        with pytest.raises(JobError):
            jobs.recover("job", pins, earliest)


def test_leases_are_fenced(jobs):
    begin(jobs)
    one, two = jobs.lease("job", "w1", 10), jobs.lease("job", "w2", 10)
    assert (one.chunk_min, two.chunk_min, jobs.lease("job", "w3", 10)) == (chunks.LEAST, 6, None)
    jobs.renew(one, 30)
    jobs.clock.now += 20
    taken = jobs.lease("job", "w3", 10)
    assert (taken.chunk_min, taken.token) == (6, 2)
    with pytest.raises(JobError):
        jobs.begin_scan(two, "low")
    jobs.begin_scan(taken, "low")
    jobs.clock.now += 100
    assert jobs.release_expired("job", jobs.clock.now) == 2 and jobs.lease("job", "w4", 10).token == 2
    assert jobs.new_attempt("job") == "gen:1:attempt:2"
    assert {r["attempt"] for r in jobs.chunks("job").collect()} == {"gen:1:attempt:2"}


def test_chunk_needs_its_markers_and_keeps_newer_changes(jobs, spark):
    begin(jobs, (chunks.LEAST, 9))
    lease = jobs.lease("job", "w", 1000)
    follow(jobs, (1, 0, 0, True, [("insert", 1, 50)]))
    jobs.begin_scan(lease, "low1")
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "id long, v long")
    assert jobs.stage(lease, rows, jobs.folder) == jobs.stage(lease, rows, jobs.folder) == 4
    jobs.seal_scan(lease, "high1")
    with pytest.raises(JobError, match="low1"):
        jobs.finalise(lease)
    follow(jobs, (2, 1, 0, True, [mark_of(lease, "low", 1)]), (3, 2, 0, True, [("update", 2, 99), ("delete", 3, None)]), (4, 3, 0, True, [mark_of(lease, "high", 1)]))
    jobs.failpoint.fail("before_commit", Crash())
    with pytest.raises(Crash):
        jobs.finalise(lease)
    assert jobs.finalise(lease) == 2
    # Key 1 changed before LOW, so the scan saw it; 2 and 3 after it.
    assert content(jobs.store, "shadow_a") == {1: 10, 2: 99, 4: 40}
    assert jobs.progress("job") == {"state": "ready_to_verify", "attempt": "gen:1:attempt:1", "chunks": {"completed": 1}, "completed_through": 9, "next_offset": 4}
    with pytest.raises(JobError):
        jobs.finalise(lease)


def backfilled(jobs, spark, rows=((1, 10), (2, 20))):
    begin(jobs, (chunks.LEAST, 9))
    at = [0]

    def mark(kind, lease):
        follow(jobs, (at[0], at[0], 0, True, [mark_of(lease, kind, at[0])]))
        at[0] += 1
        return f"{kind}{at[0] - 1}"

    phases = run.Phases()
    lease = jobs.lease("job", "w", 1000)
    run.run_chunk(jobs, lease, lambda a, b: spark.createDataFrame(list(rows), "id long, v long"), mark, lambda: None, jobs.folder, phases)
    assert set(phases.seconds) == {"low", "stage", "high", "follow", "complete"}
    return mark("barrier", Lease("job", "x", 0, 0, "", 0)), mark


def test_validation_and_promotion(jobs, spark):
    marker, mark = backfilled(jobs, spark)
    source = spark.createDataFrame([(1, 10), (2, 20)], "id long, v long")
    with pytest.raises(JobError, match="not applied"):
        jobs.prepare_validation("job", "nothing")
    jobs.prepare_validation("job", marker)
    assert jobs.prepare_validation("job", marker)["validation"]["marker"] == marker
    follow(jobs, (9, 3, 0, True, [("update", 2, 21)]))  # after the marker: the pinned table doesn't change
    jobs.validate("job", source)
    follow(jobs, (10, 4, 0, True, [("p", "barrier", "job", "x", 0, 0)]))
    changed, now = spark.createDataFrame([(2,)], "id long"), spark.createDataFrame([(1, 10), (2, 21)], "id long, v long")
    with pytest.raises(JobError, match="differs"):
        jobs.promote("job", "p", changed, source)
    jobs.failpoint.fail("promotion_intent", Crash())
    with pytest.raises(Crash):
        jobs.promote("job", "p", changed, now)
    assert jobs.job("job")["state"] == "promoting" and jobs.store.facts()["view"] == "accounts_live"
    with pytest.raises(JobError, match="another marker"):
        jobs.promote("job", marker, changed, now)
    assert jobs.promote("job", "p", changed, now) == jobs.promote("job", "p", changed, now) == "accounts_live"
    assert {r["id"]: r["v"] for r in jobs.live().collect()} == {1: 10, 2: 21}
    follow(jobs, (11, 5, 0, True, [("insert", 5, 5)]))
    assert {r["id"]: r["v"] for r in jobs.live().collect()} == {1: 10, 2: 21, 5: 5}
    other = Backfills(StateStore(spark, jobs.store.root, "later"), 0, ACCOUNTS, buckets=2)
    assert other.job("job")["state"] == "completed" and other.live().count() == 3  # another session sees it


def test_failed_validation_switches_the_route_off(jobs, spark):
    marker, _ = backfilled(jobs, spark)
    jobs.prepare_validation("job", marker)
    with pytest.raises(ValueError, match="different at key 2"):
        jobs.validate("job", spark.createDataFrame([(1, 10), (2, 22)], "id long, v long"))
    assert jobs.job("job")["state"] == "failed" and not jobs.routes()["shadow_job"]["active"] and "key 2" in jobs.job("job")["error"]
    before = content(jobs.store, "shadow_a")
    follow(jobs, (9, 3, 0, True, [("insert", 7, 7)]))
    assert content(jobs.store, "shadow_a") == before and content(jobs.store, "accounts_live")[7] == 7
    with pytest.raises(JobError):
        jobs.promote("job", marker, spark.createDataFrame([], "id long"), spark.createDataFrame([], "id long, v long"))


def test_common_offset():
    assert backfill.common_offset([3, 7]) == 7 and backfill.common_offset([3, 7], 9) == 9
    with pytest.raises(JobError):
        backfill.common_offset([3, 7], 5)


def test_staging_names_files_by_content(spark, tmp_path):
    rows = spark.createDataFrame([(i, i) for i in range(50)], "id long, v long")
    where = str(tmp_path), "s", "job", "a", 0
    one, two = staging.stage(rows, ACCOUNTS, *where), staging.stage(rows.repartition(3).orderBy(F.desc("id")), ACCOUNTS, *where)
    assert one == two and staging.stage(rows.limit(49), ACCOUNTS, *where) != one and staging.stage(rows.limit(0), ACCOUNTS, *where)[1] == 0
    lines = staging.load_lines(spark, one[0])
    assert sorted(map(tuple, staging.staged_rows(lines, ACCOUNTS, 50).collect())) == [(i, i) for i in range(50)]
    for wrong in (lines.limit(49), lines.limit(49).unionByName(lines.limit(1))):
        with pytest.raises(staging.StageError):
            staging.staged_rows(wrong, ACCOUNTS, 50)
    with pytest.raises(ValueError):
        staging.file_identity("a\0b")


def test_registered_state_queries_on_the_smallest_tables(spark):
    assert {"apply_fragmented", "chunk_completion", "marker_windows", "promoted_view"} <= set(catalog_jobs.Q) == set(catalog_jobs.SQL)


def test_retry_permits_and_failpoints():
    waits, left = [], [3]

    def step():
        left[0] -= 1
        if left[0]:
            raise run.Transient
        return "done"

    assert run.retry(step, sleep=waits.append) == "done" and waits == [0.1, 0.2]
    with pytest.raises(run.Transient):
        run.retry(lambda: (_ for _ in ()).throw(run.Transient()), attempts=3, sleep=waits.append)
    with pytest.raises(KeyError):
        run.retry(lambda: {}["x"], sleep=waits.append)
    with pytest.raises(TimeoutError), run.Permits(1, max_lag=5, lag=lambda: 9, poll=0.001).scan(give_up=0.01):
        pass
    with run.Permits(2, max_lag=5, lag=lambda: 5).scan():
        pass
    points = run.Failpoints()
    points.fail("written", Crash())
    with pytest.raises(Crash):
        points("written")
    points("written")  # once only
    with pytest.raises(ValueError):
        points.fail("nowhere", Crash())
