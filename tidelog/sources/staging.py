"""Snapshot chunks on their way to the target: JSON lines in files named by their content, with exact row counts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidelog.functions.payload import row_payload
from tidelog.sources.contract import TableContract

LINE = "stream_id string, job_id string, attempt string, chunk_min string, sequence bigint, pk string, payload string"


class StageError(RuntimeError):
    """A staged file doesn't hold what was written to it."""


def content_digest(lines: DataFrame) -> tuple[int, str]:
    """(rows, digest) of lines, whatever their order: sums of their hashes, which tasks add up by themselves."""
    halves = [F.conv(F.substring(F.sha2(F.to_json(F.struct(*[c for c in lines.columns if c != "sequence"])), 256), at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16, 31)]
    row = lines.agg(F.count("*").alias("rows"), *[F.sum(h).alias(f"h{i}") for i, h in enumerate(halves)]).first()
    return row["rows"], hashlib.sha256("\0".join(str(row[f"h{i}"] or 0) for i in range(3)).encode()).hexdigest()


def file_identity(*parts: str) -> str:
    """SHA-256 over names joined by NUL; no name may hold one."""
    if any("\0" in p for p in parts):
        raise ValueError("a name holds a NUL")
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def snapshot_lines(rows: DataFrame, contract: TableContract, stream: str, job: str, attempt: str, chunk_min: int) -> DataFrame:
    """One line a row: its names, its key as text, and its cells as a JSON object of texts."""
    body = row_payload([c.name for c in contract.columns])
    return rows.select(
        F.lit(stream).alias("stream_id"), F.lit(job).alias("job_id"), F.lit(attempt).alias("attempt"), F.lit(str(chunk_min)).alias("chunk_min"),
        F.lit(0).cast("bigint").alias("sequence"), F.col(contract.key).cast("string").alias("pk"), body.alias("payload"),
    )


def stage(rows: DataFrame, contract: TableContract, folder: str, stream: str, job: str, attempt: str, chunk_min: int, files: int = 1) -> tuple[str, int]:
    """Write a chunk and read it back: (path, rows). The same rows give the same path, so a retry finds its own file."""
    spark = rows.sparkSession
    lines = snapshot_lines(rows, contract, stream, job, attempt, chunk_min)
    n, digest = content_digest(lines)
    path = f"{folder.rstrip('/')}/{file_identity(stream, job, attempt, str(chunk_min), digest)}"
    lines.coalesce(files).write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false").json(path)
    staged, found = content_digest(load_lines(spark, path))
    if (staged, found) != (n, digest):
        raise StageError(f"{path} holds {staged} rows of {n}, or others")
    return path, n


def clear(spark: SparkSession, path: str) -> None:
    """Remove a staged file; one that is gone already is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINE).option("mode", "FAILFAST").json(path)


def staged_rows(lines: DataFrame, contract: TableContract, expected: int | None = None) -> DataFrame:
    """Typed rows of staged lines. Another number of rows than expected, or a repeated key, raises."""
    rows = lines.select(*[json_cell(F.col("payload"), c.name, c.kind, contract.spark_type(c)).alias(c.name) for c in contract.columns])
    if expected is not None:
        n = rows.agg(F.count("*").alias("n"), F.countDistinct(contract.key).alias("keys")).first()
        if n["n"] != expected or n["keys"] != expected:
            raise StageError(f"{n['n']} rows with {n['keys']} keys are staged, {expected} were expected")
    return rows


def json_cell(payload: Column, name: str, kind: str, spark_type: T.DataType) -> Column:
    """A cell of a JSON object of texts as a typed value, for every type that a warehouse takes and the others that a cast can read."""
    text = F.get_json_object(payload, f"$['{name}']")
    if kind == "bool":
        return F.when(text.isin("t", "true"), True).when(text.isin("f", "false"), False)
    if kind == "bytea":
        return F.unhex(F.regexp_replace(text, r"^\\x", ""))
    return text.cast(spark_type)


def surviving_rows(candidates: DataFrame, contract: TableContract) -> DataFrame:
    """Candidates (payload: a JSON array of one object; evicted) that weren't evicted, as typed rows."""
    kept = candidates.where(~F.col("evicted")).select(F.get_json_object("payload", "$[0]").alias("payload"))
    return kept.select(*[json_cell(F.col("payload"), c.name, c.kind, contract.spark_type(c)).alias(c.name) for c in contract.columns])


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows from the driver as a table."""
    return spark.createDataFrame(rows, schema)
