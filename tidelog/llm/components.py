"""Connected components of a graph in a DataFrame, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidelog.llm.common import ensure_checkpoints, look_up_salted

#: So many links (16 bytes each) one task takes in its stride. Where there are more, hubs are dealt to many tasks.
HUB_ROWS = 1_000_000

#: Checkpoints have files of so many links, but never fewer than `FEW` of them: many small files cost more than they hold.
FILE_ROWS = 100_000
FEW = 16


def settled(rows: DataFrame, n: int) -> DataFrame:
    """Rows, about n of them or fewer, in a checkpoint of few files."""
    return rows.coalesce(min(1 << 20, max(FEW, -(-n // FILE_ROWS)))).checkpoint()  # coalesce never adds any


def components(edges: DataFrame, hub_rows: int = HUB_ROWS, rows: int = 1 << 62) -> DataFrame:
    """(u, v) links -> (node, root): the smallest node that each linked node can reach. Nodes without links are absent.

    Each round every node hands its larger neighbours to its smallest one, then its smaller neighbours
    to the smallest of them, until nothing changes. Lineage is cut by checkpoint() in the shared folder.
    Self links and repeated links change nothing; an empty input gives an empty result.
    Either join gives the same rows; `hub_rows` only says from how many links on hubs are salted, and `rows`, about how many
    links there may be, only how many files their first checkpoint has.
    """
    ensure_checkpoints(edges.sparkSession)
    now = settled(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), rows)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")).withColumn("m", F.least("u", "m"))
        n = both.count()
        if n > hub_rows:
            joined = look_up_salted(both, least.checkpoint(), ["u"], "v")
        else:
            joined = both.join(least.drop("rows"), "u")
        large = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(small, "u")
        now = settled(
            handed.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(handed.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct(), n,
        )
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = mark
