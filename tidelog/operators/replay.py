"""What to do with a transaction that may have been applied before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

APPLY, ADVANCE, PAST = "apply", "advance", "past"


def replay_action(frontier, first, final, count, mark, known_count, known_mark) -> Column:
    """The decision as one expression; errors are texts that start with `error:`. No known count means not in the ledger."""
    frontier, first, final, count, mark, known_count, known_mark = (F.col(c) if isinstance(c, str) else c for c in (frontier, first, final, count, mark, known_count, known_mark))
    in_ledger = known_count.isNotNull() | known_mark.isNotNull()
    return (
        F.when(in_ledger & ((F.coalesce(known_count, F.lit(0)) <= 0) | (F.coalesce(known_mark, F.lit("")) == "")), "error: resnapshot")
        .when(in_ledger & ((known_count != count) | (known_mark != mark)), "error: content differs")
        .when(final < frontier, F.when(in_ledger, PAST).otherwise("error: behind the frontier, not in the ledger"))
        .when(first > frontier, "error: gap")
        .when(first < frontier, F.when(in_ledger, "error: frontier inside a replay").otherwise("error: frontier inside an unapplied transaction"))
        .otherwise(F.when(in_ledger, ADVANCE).otherwise(APPLY))
    )


def classify(found: DataFrame, ledger: DataFrame, frontier: Column, identity: list[str]) -> DataFrame:
    """Transactions (first_offset, final_offset, events, fingerprint) with their `action`."""
    known = ledger.select(*identity, F.col("events").alias("__n"), F.col("fingerprint").alias("__mark"))
    joined = found.join(known, identity, "left").withColumn("__frontier", frontier)
    action = replay_action("__frontier", "first_offset", "final_offset", "events", "fingerprint", "__n", "__mark")
    return joined.withColumn("action", action).drop("__n", "__mark", "__frontier")
