"""What the wire form and the log cost: numbers without a call for each transaction, one parse and one exchange, records computed once."""

from pyspark.sql import functions as F

from tidelog.operators import chunks
from tidelog.sources import codec
from tidelog.sources.log import Log


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fragments_are_packed_in_one_pass_over_batches(spark):
    sizes = [40, 40, 30, 90, 10, 100, 1]
    rows = [(t, i, n) for t in ("a", "b", None) for i, n in enumerate(sizes)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a batch ends inside a transaction
    try:
        found = codec.fragment_numbers(spark.createDataFrame(rows, "tx string, seq int, bytes int").coalesce(1), ["tx"], "seq", "bytes", 100)
        assert "InPandas" not in plan(found)
        have = sorted((str(r["tx"]), r["seq"], r["fragment"]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert have == [(str(t), i, n) for t in ("None", "a", "b") for i, n in enumerate([0, 0, 1, 2, 2, 3, 4])]


def test_an_envelope_is_parsed_once(spark):
    log = spark.range(3).select(F.col("id").alias("offset"), F.concat(F.lit("{"), F.col("id")).alias("value"))
    found = codec.changes(codec.checked(codec.decode(log))).select("offset", "change.Source.XID", "change.Op")
    assert plan(found).count("from_json") == 1


def test_fragments_and_totals_come_without_a_join(spark):
    source = F.struct(F.lit("g").alias("Generation"), F.lit("s").alias("SystemID"), F.col("tx").alias("XID"), F.lit("0/1").alias("LSN"))
    rows = spark.range(60).selectExpr("id DIV 30 AS tx", "id % 30 AS seq", "id % 30 DIV 10 AS fragment")
    found = codec.encode(rows.withColumn("change", F.struct("seq")).withColumn("source", source).withColumn("schema_id", F.lit("e")), ["tx"])
    assert "Join" not in plan(found)
    have = found.select("tx", "fragment", *[F.get_json_object("value", f"$.{c}").alias(c) for c in ("FragmentIndex", "Final", "Count", "TotalCount")]).orderBy("tx", "fragment").collect()
    assert [tuple(r) for r in have] == [(t, f, str(f), str(f == 2).lower(), "10", "30") for t in (0, 1) for f in (0, 1, 2)]


def test_numbers_need_no_second_sort(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    found, n = chunks.numbered(rows, ["k"])
    assert n == 1000 and "Window" not in plan(found)
    assert found.where("k <> rank").count() == 0


def test_append_computes_records_once_and_sampled(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(500).select("id", F.col("id").cast("string").alias("key"), F.lit("x").alias("value"))
    assert Log(spark, f"file://{tmp_path}/log").append(rows.mapInArrow(count, rows.schema), ["id"]) == 500
    assert seen.value <= 1000  # once for the bounds of the ranges, once for the records
