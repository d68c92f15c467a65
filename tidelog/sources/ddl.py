"""Statements that make typed tables and views, and the control tables with what later versions added."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tidelog.sources.contract import TableContract, identifier, quoted

#: The warehouse's type for each source type that it can hold without loss.
WAREHOUSE_DDL = {
    "int2": "NUMBER(38,0)", "int4": "NUMBER(38,0)", "int8": "NUMBER(38,0)", "bool": "BOOLEAN", "text": "VARCHAR", "varchar": "VARCHAR", "bpchar": "VARCHAR", "char": "VARCHAR",
    "uuid": "VARCHAR", "date": "DATE", "timestamp": "TIMESTAMP_NTZ(6)", "timestamptz": "TIMESTAMP_TZ(6)", "jsonb": "VARIANT",
}
#: Control tables and their columns; those with a default came later.
CONTROL = {
    "jobs": ("job_id string, attempt string, state string, live string, shadow string, upper_bound bigint, start_offset bigint", {"error": (None, "string")}),
    "chunks": ("job_id string, attempt string, chunk_min bigint, chunk_max bigint, status string, owner string, token bigint, expires double", {"rows_scanned": (0, "bigint"), "rows_applied": (0, "bigint")}),
    "candidates": ("job_id string, attempt string, chunk_min bigint, k bigint, payload string", {"evicted": (False, "boolean")}),
    "ledger": ("generation string, lsn decimal(20,0), events bigint, fingerprint string", {"first_offset": (None, "bigint"), "final_offset": (None, "bigint")}),
}


def object_path(*names: str) -> str:
    """Names upper-cased and quoted, joined by dots."""
    return ".".join(map(quoted, names))


def column_list(contract: TableContract) -> str:
    return ", ".join(identifier(c.name) for c in contract.columns)


def scan_list(contract: TableContract) -> str:
    """Expressions that read all columns as text but the key."""
    return ", ".join(c.name if c.name == contract.key else f"CAST({c.name} AS STRING) AS {c.name}" for c in contract.columns)


def cast_list(contract: TableContract) -> str:
    """Expressions that make texts the contract's types again."""
    return ", ".join(f"CAST({c.name} AS {contract.spark_type(c).simpleString()}) AS {c.name}" for c in contract.columns)


def create_table(contract: TableContract, table: str | None = None) -> str:
    """A Spark table with the contract's columns."""
    body = ", ".join(f"{identifier(c.name)} {contract.spark_type(c).simpleString()}{'' if c.nullable else ' NOT NULL'}" for c in contract.columns)
    return f"CREATE TABLE IF NOT EXISTS {identifier(table or contract.table)} ({body}) USING parquet"


def create_warehouse_table(contract: TableContract, *path: str) -> str:
    contract.for_warehouse()
    body = ", ".join(f"{quoted(c.name)} {WAREHOUSE_DDL[c.kind]}{'' if c.nullable else ' NOT NULL'}" for c in contract.columns)
    return f"CREATE TABLE IF NOT EXISTS {object_path(*path)} ({body}, PRIMARY KEY ({quoted(contract.key)}))"


def create_view(contract: TableContract, view: str, table: str) -> str:
    """The stable name that readers use; replacing it is how a promotion takes effect."""
    return f"CREATE OR REPLACE VIEW {identifier(view)} AS SELECT {column_list(contract)} FROM {identifier(table)}"


def control_schema(name: str) -> T.StructType:
    """All columns of a control table, those added later included."""
    first, later = CONTROL[name]
    return T.StructType.fromDDL(", ".join([first, *(f"{c} {kind}" for c, (_, kind) in later.items())]))


def migrated(name: str, table: DataFrame) -> DataFrame:
    """A control table of any version with all columns; added ones have their default. Nothing is dropped or changed."""
    first, later = CONTROL[name]
    missing = [f.name for f in T.StructType.fromDDL(first) if f.name not in table.columns]
    if missing:
        raise ValueError(f"{name} lacks {missing}")
    for column, (value, kind) in later.items():
        if column not in table.columns:
            table = table.withColumn(column, F.lit(value).cast(kind))
    return table


def require_empty(table: DataFrame, name: str) -> None:
    """A new job may not write over rows that are there."""
    if not table.isEmpty():
        raise ValueError(f"{name} is not empty")


def swap_fault(live: TableContract, shadow: TableContract) -> str | None:
    """What keeps a shadow table from taking the place of a live one, or None."""
    if live.key != shadow.key:
        return f"the keys differ: {live.key} and {shadow.key}"
    if live.columns != shadow.columns:
        return "the columns differ: " + ", ".join(str(c.name) for c in sorted(set(live.columns) ^ set(shadow.columns), key=lambda c: c.name))
    return None
