"""Rows as JSON payloads, and values in canonical form for comparison."""

from __future__ import annotations

import json
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf


def row_payload(columns: list[str]) -> Column:
    """A JSON object of texts, column by column; null stays null."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"})


def payload_cell(payload: Column, column: str, kind: str) -> Column:
    """A cell of a payload as a typed value."""
    return F.get_json_object(payload, f"$.{column}").cast(kind)


#: Digits that a number may need when it is written out; beyond that it is refused, not rounded.
MAX_DIGITS = 10_000


def exact_number(text: str) -> Fraction:
    exponent = re.search(r"[eE]([+-]?\d+)$", text)
    if exponent and abs(int(exponent[1])) > MAX_DIGITS or len(text) > MAX_DIGITS:
        raise ValueError(f"a number of more than {MAX_DIGITS} digits")
    return Fraction(text)


def refuse(text: str):
    raise ValueError(f"not JSON: {text}")


def canonical_text(text: str) -> str:
    """JSON with sorted keys, no white space, and numbers as fractions in lowest terms: equal documents have equal texts."""

    def write(value) -> str:
        if isinstance(value, Fraction):
            return str(value)
        if isinstance(value, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{write(value[k])}" for k in sorted(value)) + "}"
        if isinstance(value, list):
            return "[" + ",".join(map(write, value)) + "]"
        return json.dumps(value, ensure_ascii=False)

    return write(json.loads(text, parse_float=exact_number, parse_int=exact_number, parse_constant=refuse))


@pandas_udf(T.StringType())
def _canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_text, na_action="ignore")


def canonical_json(text: Column) -> Column:
    """JSON in a form in which equal documents have equal texts: exact numbers, however long. Malformed text raises; null stays null."""
    return _canonical_json(text)


def canonical_timestamp(stamp: Column) -> Column:
    """ISO text without zone, with no trailing zeros in the fraction."""
    return F.regexp_replace(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", "")


def canonical_timestamptz(stamp: Column) -> Column:
    """The same in UTC, with Z, whatever the session's zone."""
    return F.concat(canonical_timestamp(F.to_utc_timestamp(stamp, F.current_timezone())), F.lit("Z"))


def parsed_timestamp(text: Column) -> Column:
    """A timestamp without zone from its text, with a space or T between date and time. Anything else raises."""
    return F.when(text.rlike(r"^\d{4,}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(\.\d{1,9})?$"), text.cast("timestamp_ntz")).otherwise(
        F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a timestamp: "), text))).cast("timestamp_ntz")
    )


def parsed_timestamptz(text: Column) -> Column:
    """A timestamp from its text with Z or an offset of hours, or hours and minutes. Anything else raises."""
    whole = F.regexp_replace(F.regexp_replace(text, " ", "T"), r"([+-]\d\d)$", "$1:00")
    return F.when(text.rlike(r"^\d{4,}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d(:\d\d)?)$"), whole.cast("timestamp")).otherwise(
        F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a timestamp with zone: "), text))).cast("timestamp")
    )


def fingerprint(columns: list[Column]) -> Column:
    """SHA-256 over values that are preceded by their lengths, so that no two lists of values look alike."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def transaction_fingerprints(changes: DataFrame, by: list[str], values: list[str], order: str | list[str]) -> DataFrame:
    """One fingerprint for each transaction, over its changes in order, whatever their offsets."""
    each = changes.withColumn("__mark", fingerprint([F.col(v) for v in values]))
    places = [order] if isinstance(order, str) else order
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*places, "__mark"))), lambda x: x["__mark"]), "")
    return each.groupBy(*by).agg(F.sha2(listed, 256).alias("fingerprint"), F.count("*").alias("events"))
