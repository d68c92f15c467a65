"""The table contract: columns, key and types, pinned by a fingerprint. Whatever is ambiguous is an error."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Source type names, and the types that stand for them here.
SOURCE_TYPES = {
    "int2": T.ShortType(), "int4": T.IntegerType(), "int8": T.LongType(), "bool": T.BooleanType(), "text": T.StringType(), "varchar": T.StringType(),
    "bpchar": T.StringType(), "char": T.StringType(), "uuid": T.StringType(), "bytea": T.BinaryType(), "numeric": T.StringType(), "float4": T.FloatType(),
    "float8": T.DoubleType(), "date": T.DateType(), "time": T.StringType(), "timetz": T.StringType(), "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(), "interval": T.StringType(), "json": T.StringType(), "jsonb": T.StringType(),
}
#: Of these, the ones that a warehouse target accepts.
WAREHOUSE_TYPES = {"int2", "int4", "int8", "bool", "text", "varchar", "bpchar", "char", "uuid", "date", "timestamp", "timestamptz", "jsonb"}


def identifier(name: str) -> str:
    """The name itself, if it can stand in SQL text unquoted; else an error."""
    if not IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def quoted(name: str) -> str:
    """Upper-cased and quoted, for warehouse targets, which also allow $."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_$]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return f'"{name.upper()}"'


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    nullable: bool = True
    modifier: str = ""  # precision and scale, or length; part of the fingerprint


@dataclass(frozen=True)
class TableContract:
    """Columns in order; `key` is one int8 column that is not null."""

    table: str
    columns: tuple[Column, ...]
    key: str

    def __post_init__(self):
        for name in (self.table, *(c.name for c in self.columns)):
            identifier(name)
        if unknown := [c.kind for c in self.columns if c.kind not in SOURCE_TYPES]:
            raise ValueError(f"unsupported types: {unknown}")
        mine = [c for c in self.columns if c.name == self.key]
        if len(mine) != 1 or mine[0].kind != "int8" or mine[0].nullable:
            raise ValueError(f"the key {self.key!r} must be one int8 column that is not null")

    def fingerprint(self) -> str:
        body = json.dumps([self.table, self.key, [[c.name, c.kind, c.nullable, c.modifier] for c in self.columns]], separators=(",", ":"))
        return hashlib.sha256(body.encode()).hexdigest()[:16]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, self.spark_type(c), c.nullable) for c in self.columns])

    @staticmethod
    def spark_type(column: Column) -> T.DataType:
        if column.kind == "numeric" and re.fullmatch(r"\d+,\d+", column.modifier):
            precision, scale = map(int, column.modifier.split(","))
            return T.DecimalType(precision, scale)
        return SOURCE_TYPES[column.kind]

    def for_warehouse(self) -> None:
        if refused := [c.name for c in self.columns if c.kind not in WAREHOUSE_TYPES]:
            raise ValueError(f"a warehouse target has no type for: {refused}")

    def check(self, df: DataFrame) -> DataFrame:
        """The table itself, if names, order and types are those of the contract."""
        have, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in self.schema()]
        if have != want:
            raise ValueError(f"the table differs from its contract: {have} is not {want}")
        return df


def contract_of(df: DataFrame, table: str, key: str) -> TableContract:
    """The contract of a DataFrame's schema: its columns in their order, by the first source type that stands for each."""
    kinds = {}
    for name, spark_type in SOURCE_TYPES.items():
        kinds.setdefault(spark_type.simpleString(), name)
    kinds |= {"string": "text", "timestamp_ntz": "timestamp", "timestamp": "timestamptz"}
    columns = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        if isinstance(f.dataType, T.DecimalType):
            columns.append(Column(f.name, "numeric", f.nullable, f"{f.dataType.precision},{f.dataType.scale}"))
        elif kind in kinds:
            columns.append(Column(f.name, kinds[kind], f.nullable and f.name != key))
        else:
            raise ValueError(f"column {f.name} has the type {kind}, which no source type stands for")
    return TableContract(table, tuple(columns), key)
