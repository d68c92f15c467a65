"""Change-log reconciliation on Spark: ordered logs, replicas, backfills and exact comparison."""
