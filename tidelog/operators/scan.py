"""Scans of tables by key: in canonical form, within limits, and as a warehouse's values are read for validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.functions import payload
from tidelog.sources.contract import TableContract

#: Bytes that a row counts besides its texts.
ROW_BYTES = 96


class ScanLimit(RuntimeError):
    """A chunk holds more than a scan may."""


def canonical(column: Column, kind: str) -> Column:
    """A value of a source type as the text by which it is compared. Types without an exact text raise."""
    if kind in ("int2", "int4", "int8"):
        return column.cast("string")
    if kind == "bool":
        return F.when(column, "t").when(~column, "f")
    if kind in ("text", "varchar", "bpchar", "char", "uuid"):
        return column.cast("string")
    if kind == "date":
        return F.date_format(column, "yyyy-MM-dd")
    if kind == "timestamp":
        return payload.canonical_timestamp(column)
    if kind == "timestamptz":
        return payload.canonical_timestamptz(column)
    if kind == "jsonb":
        return payload.canonical_json(column)
    raise ValueError(f"no exact text for type {kind}")


def canonical_rows(rows: DataFrame, contract: TableContract) -> DataFrame:
    """The columns of the contract, in its order, as canonical texts; the key stays a number."""
    return rows.select(*[F.col(c.name) if c.name == contract.key else canonical(F.col(c.name), c.kind).alias(c.name) for c in contract.columns])


def typed_rows(rows: DataFrame, contract: TableContract) -> DataFrame:
    """Texts back to the contract's types, in its order."""
    return rows.select(*[typed(F.col(c.name), contract.spark_type(c).simpleString(), c.kind).alias(c.name) for c in contract.columns])


def typed(text: Column, spark_type: str, kind: str) -> Column:
    if kind == "bool":
        return F.when(text.isin("t", "true"), True).when(text.isin("f", "false"), False).otherwise(F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), text))).cast("boolean"))
    if kind == "bytea":
        return F.unhex(F.regexp_replace(text.cast("string"), r"^\\x", ""))
    return text.cast(spark_type)


def range_rows(rows: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Rows with keys from `low` to `high`, both included."""
    return rows.where(F.col(key).between(low, high))


def key_rows(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is in `keys`; keys that are missing give none. Repeated keys count once."""
    return rows.join(keys.select(key).where(F.col(key).isNotNull()), key, "left_semi")


def row_bytes(columns: list[str]) -> Column:
    return sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(ROW_BYTES)).cast("bigint")


def chunk_sizes(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Rows and bytes of each chunk."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(row_bytes(columns)).alias("bytes"))


def read_chunk(rows: DataFrame, key: str, low: int, high: int, max_rows: int, max_bytes: int) -> DataFrame:
    """The rows of a chunk. More rows or bytes than allowed raise; none is dropped."""
    chunk = range_rows(rows, key, low, high)
    size = chunk_sizes(chunk, [c for c in rows.columns if c != key], []).first()
    if size["rows"] > max_rows or (size["bytes"] or 0) > max_bytes:
        raise ScanLimit(f"chunk {low} to {high} has {size['rows']} rows and {size['bytes']} bytes; {max_rows} and {max_bytes} are allowed")
    return chunk


def next_size(current: Column, median: Column, target: float, least: int, most: int, step: float = 2.0) -> Column:
    """A chunk's size, pushed toward the target duration by at most `step` at once, and clamped."""
    ratio = F.least(F.greatest(F.lit(float(target)) / median, F.lit(1 / step)), F.lit(step))
    moved = F.least(F.floor(current * ratio), F.lit((1 << 31) - 1)).cast("bigint")
    return F.when(median > 0, F.greatest(F.least(moved, F.lit(most)), F.lit(least))).otherwise(current).cast("bigint")


def running_median(durations: DataFrame, value: str, by: list[str], order: str, rows: int = 32) -> Column:
    """The median of the last `rows` values, as a column for `durations`."""
    from pyspark.sql import Window

    return F.percentile(value, 0.5).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - rows, 0))


class Sizer:
    """The size of the next chunk from the durations of the last ones: a fold, so it runs where the chunks are started."""

    def __init__(self, start: int, target: float, least: int, most: int, warmup: int = 3, rows: int = 32, step: float = 2.0):
        self.size, self.target, self.least, self.most, self.warmup, self.rows, self.step = start, target, least, most, warmup, rows, step
        self.durations: list[float] = []

    def observe(self, seconds: float) -> int:
        if seconds > 0:
            self.durations = [*self.durations, seconds][-self.rows :]
        if len(self.durations) >= self.warmup:
            ordered, half = sorted(self.durations), len(self.durations) // 2
            median = ordered[half] if len(ordered) % 2 else (ordered[half - 1] + ordered[half]) / 2
            ratio = min(max(self.target / median, 1 / self.step), self.step)
            self.size = max(self.least, min(self.most, int(self.size * ratio)))
        return self.size
