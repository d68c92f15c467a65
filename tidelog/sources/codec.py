"""The wire form of the log: JSON envelopes with fragments of transactions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_ENVELOPE = 1 << 20
FRAGMENT_BYTES = 900 << 10
SOURCE = "struct<Generation:string,SystemID:string,XID:bigint,LSN:string>"
CHANGE = (
    "struct<Op:string,SchemaID:string,Row:struct<Values:array<struct<Kind:int,Int:bigint,Text:string>>>,"
    f"Marker:struct<ID:string,Kind:string,JobID:string,Attempt:string,ChunkMin:bigint,ChunkMax:bigint>,Source:{SOURCE}>"
)
ENVELOPE = f"struct<Version:int,SchemaID:string,FragmentIndex:int,Final:boolean,Count:int,TotalCount:int,Source:{SOURCE},Changes:array<{CHANGE}>>"


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with columns that are computed once a row, however often later expressions read them: a generator's output isn't copied into its readers."""
    made = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return rows.select("*", made)


def decode(log: DataFrame, payload: str = "value") -> DataFrame:
    """(offset, envelope, fault): envelopes with what is wrong with each, or null."""
    e = F.col("envelope")
    changes = e["Changes"]
    has_row, has_marker = (lambda c: c["Row"].isNotNull()), (lambda c: c["Marker"].isNotNull())
    one_payload = F.forall(changes, lambda c: has_row(c) != has_marker(c))
    same_source = F.forall(changes, lambda c: c["Source"].eqNullSafe(e["Source"]))
    one_epoch = F.forall(changes, lambda c: c["SchemaID"].eqNullSafe(e["SchemaID"]))
    fault = (
        F.when(F.octet_length(payload) > MAX_ENVELOPE, "too large").when(e.isNull() | changes.isNull(), "malformed").when(~F.coalesce(e["Version"].isin(1, 2), F.lit(False)), "unknown version")
        .when(e["Source"]["LSN"].isNull() | (e["Source"]["LSN"] == "") | e["SchemaID"].isNull() | (e["SchemaID"] == ""), "missing identity")
        .when(e["Count"] != F.size(changes), "count differs").when(e["TotalCount"] < e["Count"], "total below count").when(~one_payload, "not exactly one payload")
        .when(~same_source, "mixed sources").when(~one_epoch, "mixed schemas")
    )
    parsed = once(log.select("offset", payload), envelope=F.from_json(payload, ENVELOPE, {"mode": "PERMISSIVE"}))
    return once(parsed, fault=fault).select("offset", "envelope", "fault")


def checked(decoded: DataFrame) -> DataFrame:
    """Envelopes; the first fault raises."""
    return decoded.withColumn("envelope", F.when(F.col("fault").isNull(), F.col("envelope")).otherwise(F.raise_error(F.concat(F.lit("bad envelope: "), "fault")))).drop("fault")


def changes(decoded: DataFrame) -> DataFrame:
    """One row a change, with its offset and its place in the fragment."""
    return decoded.select("offset", F.col("envelope")["FragmentIndex"].alias("fragment"), F.posexplode(F.col("envelope")["Changes"]).alias("seq", "change"))


def cell(value: Column, kind: str) -> Column:
    """A wire value as a typed cell: kind 0 is null, 1 a number, 2 text."""
    text = F.when(value["Kind"] == 1, value["Int"].cast("string")).when(value["Kind"] == 2, value["Text"]).when(value["Kind"] != 0, F.raise_error(F.lit("unknown value kind")).cast("string"))
    return text.cast(kind)


def filled_update(new: Column, old: Column, unchanged: Column) -> Column:
    """A cell that an update didn't send keeps its old value; a null that it sent is a null."""
    return F.when(unchanged, old).otherwise(new)


def same_key(old: Column, new: Column) -> Column:
    return F.when(old.eqNullSafe(new), new).otherwise(F.raise_error(F.lit("the key changed")))


def fragment_numbers(changes: DataFrame, by: list[str], order: str, size: str, limit: int = FRAGMENT_BYTES) -> DataFrame:
    """Changes with the fragment that each goes to: as many as fit under `limit` bytes, in order. One change above it raises.

    Greedy packing is a recurrence: one pass over partitions sorted by transaction and order carries it from row to row,
    so that no transaction is a call, or a frame, of its own.
    """
    changes = changes.drop("fragment")
    schema = changes.withColumn("fragment", F.lit(0).cast("bigint")).schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, held = None, 0, 0
        for batch in batches:
            numbers = []
            for one, n in zip(zip(*(batch.column(c).to_pylist() for c in by)), batch.column(size).to_pylist()):
                if n > limit:
                    raise ValueError(f"a change of {n} bytes is larger than a fragment")
                if one != now:
                    now, number, held = one, 0, 0
                if held + n > limit:
                    number, held = number + 1, 0
                held += n
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "fragment"])

    return changes.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(pack, schema)


def encode(changes: DataFrame, by: list[str]) -> DataFrame:
    """One record (by, fragment, key, value) a fragment, of changes (by, fragment, seq, change, source, schema_id): JSON that `decode` reads back.

    One exchange by transaction serves the fragments and, over them, the transaction's last fragment and total.
    """
    whole = Window.partitionBy(*by)
    packed = changes.repartition(*by).groupBy(*by, "fragment").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "change"))), lambda x: x["change"]).alias("Changes"), F.count("*").alias("__n"), F.first("source").alias("Source"), F.first("schema_id").alias("SchemaID")
    ).withColumn("__last", F.max("fragment").over(whole)).withColumn("__total", F.sum("__n").over(whole))
    envelope = F.struct(
        F.lit(2).alias("Version"), "SchemaID", F.col("fragment").cast("int").alias("FragmentIndex"), (F.col("fragment") == F.col("__last")).alias("Final"), F.col("__n").cast("int").alias("Count"),
        F.col("__total").cast("int").alias("TotalCount"), "Source", "Changes",
    )
    return packed.select(*by, "fragment", F.concat_ws(":", "Source.SystemID", "Source.Generation", "Source.LSN").alias("key"), F.to_json(envelope, {"ignoreNullFields": "false"}).alias("value"))


def envelope_bytes(source: Column, schema_id: Column, index: Column, final: Column, count: Column, total: Column, changes_bytes: Column) -> Column:
    """Bytes of an envelope whose changes, encoded, take `changes_bytes` without the commas between them."""
    head = F.to_json(F.struct(F.lit(2).alias("Version"), schema_id.alias("SchemaID"), index.alias("FragmentIndex"), final.alias("Final"), count.alias("Count"), total.alias("TotalCount"), source.alias("Source"), F.array().cast(f"array<{CHANGE}>").alias("Changes")), {"ignoreNullFields": "false"})
    return F.octet_length(head) + changes_bytes + F.greatest(count - 1, F.lit(0))


def tuple_cell(kind: Column, text: Column, old: Column) -> Column:
    """A cell of a row message: n is null, t its text, u the old row's; b (binary) and others raise."""
    return F.when(kind == "n", F.lit(None).cast("string")).when(kind == "t", text).when(kind == "u", old).otherwise(F.raise_error(F.concat(F.lit("cell kind "), F.coalesce(kind, F.lit("null")))).cast("string"))
