"""The state store and batch application against a dict model, over crash points, replays and hard keys."""

import random

import pytest
from pyspark.sql import Row, functions as F

from tidelog.operators import chunks, reconcile, replay
from tidelog.plans import backfill
from tidelog.plans.apply import ReplayError, apply_batch
from tidelog.sources.contract import Column, TableContract
from tidelog.sources.state import StaleOwner, StateStore
from tidelog.streaming.follow import follow

LOG = "generation string, lsn decimal(20,0), offset bigint, seq bigint, op string, id bigint, v bigint"
POINTS = ("classified", "folded", "written", "committed", None)


def transactions(seed: int, n: int = 6):
    """(lsn, [(op, id, v)]) with deletes, re-inserts and several changes of a key."""
    r = random.Random(seed)
    return [(100 + 10 * t, [(r.choice(["insert", "update", "delete"]), r.randint(1, 9), r.randint(0, 999)) for _ in range(r.randint(1, 3))]) for t in range(n)]


def rows(numbered):
    from decimal import Decimal

    return [("g", Decimal(lsn), offset, seq, op, id_, v) for offset, lsn, changes in numbered for seq, (op, id_, v) in enumerate(changes)]


def model(start: dict, found) -> dict:
    state = dict(start)
    for _, changes in found:
        for op, id_, v in changes:
            if op == "delete":
                state.pop(id_, None)
            else:
                state[id_] = v
    return state


class Crash(Exception):
    pass


def new_store(spark, path) -> tuple[StateStore, int]:
    store = StateStore(spark, str(path))
    epoch = store.acquire()
    store.commit({"target": spark.createDataFrame([(i, -i) for i in range(1, 7)], "id bigint, v bigint")}, {"next_offset": 0}, epoch, store.version())
    return store, epoch


def content(store) -> dict:
    return {r["id"]: r["v"] for r in store.read("target").collect()}


@pytest.mark.parametrize("seed,point", [(s, POINTS[s % 5]) for s in range(5)])
def test_model_over_crash_points(spark, tmp_path, seed, point):
    store, epoch = new_store(spark, tmp_path)
    found = transactions(seed)
    # The first transaction is delivered again after the second.
    numbered = [(0, *found[0]), (1, *found[1]), (2, *found[0]), *[(3 + i, *t) for i, t in enumerate(found[2:])]]
    batches = [spark.createDataFrame(rows(numbered[:3]), LOG), spark.createDataFrame(rows(numbered[3:]), LOG)]
    for batch in batches:
        def fail(name):
            if name == point:
                raise Crash

        if point:
            with pytest.raises(Crash):
                apply_batch(store, epoch, batch, "id", ["v"], fail)
        apply_batch(store, epoch, batch, "id", ["v"])
        apply_batch(store, epoch, batch, "id", ["v"])  # once more changes nothing
    assert content(store) == model({i: -i for i in range(1, 7)}, found)
    assert store.commit_record()["facts"]["next_offset"] == 3 + len(found) - 2
    assert store.read("ledger").count() == len(found)


def test_gap_changed_content_and_stale_owner(spark, tmp_path):
    store, epoch = new_store(spark, tmp_path)
    one = [(0, 100, [("insert", 1, 5)])]
    with pytest.raises(ReplayError, match="gap"):
        apply_batch(store, epoch, spark.createDataFrame(rows([(3, 100, [("insert", 1, 5)])]), LOG), "id", ["v"])
    apply_batch(store, epoch, spark.createDataFrame(rows(one), LOG), "id", ["v"])
    with pytest.raises(ReplayError, match="content"):
        apply_batch(store, epoch, spark.createDataFrame(rows([(0, 100, [("insert", 1, 6)])]), LOG), "id", ["v"])
    other = StateStore(spark, str(tmp_path), "other")
    other.acquire()
    with pytest.raises(StaleOwner):
        store.commit({}, {}, epoch, store.version())


def test_gate_holds_at_an_offset(spark, tmp_path):
    store, epoch = new_store(spark, tmp_path)
    both = [(0, 100, [("update", 1, 5)]), (1, 110, [("update", 2, 6)])]
    apply_batch(store, epoch, spark.createDataFrame(rows(both), LOG), "id", ["v"], gate=1)
    assert content(store)[1] == 5 and content(store)[2] == -2


def test_stream_restarts(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    epoch = store.acquire()
    store.commit({"target": spark.createDataFrame([], "id bigint, v bigint")}, {"next_offset": 0}, epoch, store.version())
    found = transactions(11, 4)
    for i, t in enumerate(found):
        spark.createDataFrame(rows([(i, *t)]), LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        follow(spark, str(tmp_path / "log"), LOG, store, "id", ["v"], str(tmp_path / "cp")).awaitTermination()
    assert content(store) == model({}, found)


def test_hard_keys_and_negative_control(spark):
    keys = [-10, -5, *range(11), chunks.GREATEST - 1]
    snapshot = spark.createDataFrame([(k, 1) for k in keys], "k bigint, v bigint")
    upper = chunks.upper_bound(snapshot, "k").first()[0]
    manifest = chunks.manifest(snapshot, "k", 5, upper)
    assert chunks.manifest_faults(manifest, upper).isEmpty()
    windows = manifest.withColumn("low", F.lit(10).cast("bigint")).withColumn("high", F.lit(20).cast("bigint"))
    log = [(5, 0, "update", 9), (11, 1, "update", 2), (12, 2, "delete", 0), (13, 3, "delete", 0), (14, 3, "insert", 7), (15, 5, "update", 8), (16, 5, "update", 9), (17, 100, "insert", 4), (25, -10, "delete", 0)]
    changes = spark.createDataFrame(log, "offset bigint, k bigint, op string, v bigint")
    want = {k: 1 for k in keys} | {1: 2, 3: 7, 5: 9, 100: 4}
    del want[2], want[-10]
    for build in (reconcile.reconcile, reconcile.reconcile_in_steps):
        assert {r["k"]: r["v"] for r in build(snapshot, changes, windows, "k", ["v"]).collect()} == want
    naive = {r["k"]: r["v"] for r in reconcile.reconcile_in_steps(snapshot, changes, windows, "k", ["v"], evict=False).collect()}
    assert naive != want and naive[2] == 1  # the deleted row came back


def test_empty_table_manifest(spark):
    rows_ = spark.createDataFrame([], "k bigint")
    assert chunks.upper_bound(rows_, "k").first()[0] == 0
    assert [tuple(r)[1:3] for r in chunks.manifest(rows_, "k", 5, 0).collect()] == [(chunks.LEAST, 0)]


@pytest.mark.parametrize("ranges,ok", [
    ([(chunks.LEAST, 10), (11, 50), (51, 100)], True), ([(1, 10), (11, 100)], False), ([(chunks.LEAST, 10), (12, 100)], False),
    ([(chunks.LEAST, 10), (10, 100)], False), ([(chunks.LEAST, 10), (11, 99)], False),
])
def test_manifest_proof(spark, ranges, ok):
    assert chunks.manifest_faults(spark.createDataFrame(ranges, "chunk_min bigint, chunk_max bigint"), 100).isEmpty() == ok


@pytest.mark.parametrize("frontier,count,mark,want", [
    (10, 0, "m", "error: resnapshot"), (10, 3, "", "error: resnapshot"), (10, 2, "m", "error: content differs"), (13, 3, "m", "past"), (10, 3, "m", "advance"),
    (9, 3, "m", "error: gap"), (11, 3, "m", "error: frontier inside a replay"), (10, None, None, "apply"), (9, None, None, "error: gap"),
    (13, None, None, "error: behind the frontier, not in the ledger"), (11, None, None, "error: frontier inside an unapplied transaction"),
])
def test_replay_decisions(spark, frontier, count, mark, want):
    row = spark.createDataFrame([Row(first=10, final=12, events=3, fp="m")])
    action = replay.replay_action(F.lit(frontier), "first", "final", "events", "fp", F.lit(count), F.lit(mark))
    assert row.select(action).first()[0] == want


def test_contract():
    contract = TableContract("accounts", (Column("id", "int8", False), Column("price", "numeric", modifier="12,2")), "id")
    other = TableContract("accounts", (Column("id", "int8", False), Column("price", "numeric", modifier="10,4")), "id")
    assert contract.fingerprint() != other.fingerprint()
    with pytest.raises(ValueError):
        contract.for_warehouse()
    with pytest.raises(ValueError):
        TableContract("bad name", (Column("id", "int8", False),), "id")


def test_job_states():
    assert backfill.advance("running", "ready_to_verify") == "ready_to_verify"
    with pytest.raises(ValueError):
        backfill.advance("completed", "running")
    assert backfill.next_attempt("gen:2:attempt:9") == "gen:2:attempt:10"
