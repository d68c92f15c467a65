"""What a batch and a reconciliation cost: fragments read once and not ordered as a whole, folds in a hash map."""

from pyspark.sql import functions as F

from tidelog.functions.payload import transaction_fingerprints
from tidelog.operators import reconcile
from tidelog.plans import apply


def changes(spark, broken: bool = False):
    """Transactions of two fragments of three changes, in descending order of seq; with `broken`, one fragment is lost."""
    rows = spark.range(60).selectExpr(
        "'g' AS generation", "CAST(id DIV 6 AS DECIMAL(20,0)) AS lsn", "id DIV 3 AS offset", "CAST(id DIV 3 % 2 AS INT) AS fragment", "id DIV 3 % 2 = 1 AS final", "2 - id % 3 AS seq", "'insert' AS op", "id AS k", "CAST(id AS DOUBLE) AS v",
    )
    return apply.with_fragments(rows.where("offset <> 4") if broken else rows)


def test_whole_transactions_are_not_ordered_in_one_task(spark):
    fragments = changes(spark).groupBy("offset").agg(F.min("fragment").alias("index")).withColumn("stream", F.lit(0))
    found = apply.with_islands(fragments)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.where("island <> offset - offset % 2").count() == 0


def test_fragments_give_the_fingerprint_of_all_changes(spark):
    placed, islands = apply.assembled(changes(spark), ["op", "k", "v"])
    want = transaction_fingerprints(changes(spark), ["lsn"], ["op", "k", "v"], ["fragment", "seq"]).select("lsn", "fingerprint")
    assert islands.join(want, ["lsn", "fingerprint"]).count() == 10
    assert {(r["offset"] % 2, r["before"]) for r in placed.collect()} == {(0, 0), (1, 3)}
    assert "Join" not in placed._jdf.queryExecution().optimizedPlan().toString()


def test_a_gap_is_still_found(spark):
    islands = apply.assembled(changes(spark, broken=True), ["op", "k", "v"])[1]
    assert {r["state"] for r in islands.where("lsn IN (1, 2)").collect()} == {"broken"} and islands.where("state = 'complete'").count() == 8


def test_reconciling_folds_in_a_hash_map(spark):
    snapshot = spark.createDataFrame([(k, 100.0 + k) for k in range(6)], "k bigint, v double")
    log = spark.createDataFrame([(0, 1, "update", 1.0), (1, 2, "delete", 2.0), (6, 2, "update", 3.0), (7, 3, "delete", None), (8, 3, "delete", 4.0), (9, 4, "update", None)], "offset bigint, k bigint, op string, v double")
    windows = spark.createDataFrame([(-(1 << 63), 5, 2, 7)], "chunk_min bigint, chunk_max bigint, low bigint, high bigint")
    for evict, k2 in ((True, (2, 3.0, "log")), (False, (2, 102.0, "snapshot"))):
        found = reconcile.reconcile_in_steps(snapshot, log, windows, "k", ["v"], evict=evict)
        assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
        want = {(0, 100.0, "snapshot"), (1, 101.0, "snapshot"), k2, (4, None, "log"), (5, 105.0, "snapshot")}
        assert {tuple(r) for r in found.collect()} == want
    whole = reconcile.reconcile(snapshot, log, windows, "k", ["v"])
    assert "SortAggregate" not in whole._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in whole.collect()} == {(0, 100.0, "snapshot"), (1, 101.0, "snapshot"), (2, 3.0, "log"), (4, None, "log"), (5, 105.0, "snapshot")}
