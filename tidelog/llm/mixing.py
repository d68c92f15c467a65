"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame operations only.

Sources in order of code point, null last, weigh 5, 2, 1, 5, 2, 1 and so on, and share 150 % of all words.
A target stops at `epochs` = 2 times its source's words; what is above goes to the others by weight. That
is a water level: with sources in order of cap / weight, the first whose share of what is left lies within
its cap sets it.

A document's key is exponential with its quality weight as rate: -ln(u) / quality with u from a hash of its
id, so reruns agree. Full epochs take every document of a source; the rest of the target takes documents
in order of their keys until the words run out, the last of them in part.

The prefix sums don't need a source in one task: keys fall into at least `BUCKETS` ranges of even probability, range
sums are aggregated on the map side, and only rows of one range of one source are sorted together.

Defined cases: a null or empty text has size 0 and nothing is taken of it; a null source is a source of its own;
without an id the text's hash stands for it; rows that repeat an id are each a document (of equal keys the smaller id
and size come first, and equal rows in any order); a source without words has target 0; a text longer than what is left
of its source's target is taken in part; an empty table gives an empty table; other columns pass through in `rest`
under their own names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidelog.llm.common import partitions, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
BUCKETS = 1024


def quality_weight(size):
    """Default quality weight of a document of `size` words, from 0.5 to 1: very short texts count less."""
    return F.lit(0.5) + F.lit(0.5) * (size / (size + F.lit(50.0)))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(src, no_src, source_size), one row a source -> the same with its target."""
    every = Window.partitionBy(F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(every.orderBy("no_src", "src")) - 1) % len(weights) + 1).cast("int"))
    known = sizes.withColumn("weight", weight).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    by_cap = every.orderBy(F.col("cap") / F.col("weight"), "no_src", "src")
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum(
        "weight"
    ).over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = known.withColumn("level", level).withColumn("place", F.row_number().over(by_cap))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(every)
    return ranked.select("src", "no_src", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * first["level"]).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality=None, buckets: int | None = None, carry: list[str] | None = None, **plan) -> DataFrame:
    """Every row of `docs`, its columns `carry` (by default all) as struct `rest`, with size, source_size, target and taken (words, repeats counted).

    quality: a column of positive document quality weights; by default quality_weight of the size.
    """
    buckets = buckets or max(BUCKETS, 4 * partitions(docs.sparkSession))  # the ranges shrink as the cluster's partitions do; the mix is the same
    size = word_count(F.col(text_col))
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col)), F.lit(""))
    draw = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("rest"), F.col(id_col).alias("id"), size.alias("size"), draw.alias("draw"),
        F.coalesce(F.col(source_col), F.lit("")).alias("src"), F.col(source_col).isNull().alias("no_src"),
        *([] if quality is None else [quality.alias("quality")]),
    )
    if quality is None:
        rows = rows.withColumn("quality", quality_weight(F.col("size")))
    keyed = rows.withColumn("key", -F.log("draw") / F.col("quality")).drop("draw", "quality")
    dealt = keyed.withColumn("bucket", F.floor(F.lit(buckets) * (F.lit(1.0) - F.exp(-F.col("key")))).cast("int"))
    sums = dealt.groupBy("src", "no_src", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(sums.groupBy("src", "no_src").agg(F.sum("words").alias("source_size")), **plan)
    before = Window.partitionBy("src", "no_src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(targets, ["src", "no_src"])
    inside = Window.partitionBy("src", "no_src", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.join(offsets, ["src", "no_src", "bucket"]).withColumn("prefix", F.col("offset") + F.sum("size").over(inside) - F.col("size"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    part = F.round(F.col("target") - full * F.col("source_size")).cast("long")
    taken = full * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), part - F.col("prefix")))
    return summed.select("rest", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs, carry=["doc_id"])
    return mixed.select("rest.doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their size, target and taken words. A column of that name becomes document_<name>."""
    made = ("size", "source_size", "target", "taken")
    own = [F.col("rest").getField(c).alias(f"document_{c}" if c.lower() in made else c) for c in docs.columns]
    return mix(docs).where("taken > 0").select(*own, *made)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), k AS (
  SELECT *, -ln(u) / (0.5 + 0.5 * (size / (size + 50.0::DOUBLE))) AS key FROM d
), s AS (
  SELECT source, sum(size) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source
), o AS (
  SELECT *, 2 * source_size AS cap, row_number() OVER c AS place,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW c AS (ORDER BY 2 * source_size / w, source NULLS LAST)
), l AS (SELECT arg_min(level, place) AS level FROM o WHERE level * w <= cap
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, w * l.level) AS target FROM o, l
), p AS (
  SELECT k.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS prefix
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
       CAST(epochs * size + greatest(0, least(size, CAST(round(target - epochs * source_size) AS BIGINT) - prefix)) AS BIGINT) AS taken
FROM p
"""
