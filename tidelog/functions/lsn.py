"""Log positions, source keys and attempt names."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

LSN = "decimal(20,0)"
ATTEMPT = re.compile(r"gen:(\d+):attempt:(\d+)")


def parse_lsn(text: Column) -> Column:
    """`X/Y` in hexadecimal -> a number of 64 bits as decimal(20,0). Anything else raises."""
    high, low = (F.conv(F.split_part(text, F.lit("/"), F.lit(i)), 16, 10).cast(LSN) for i in (1, 2))
    number = (high * F.lit(4294967296).cast("decimal(10,0)") + low).cast(LSN)
    return F.when(text.isNull(), F.lit(None).cast(LSN)).when(text.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), number).otherwise(
        F.raise_error(F.concat(F.lit("malformed log position: "), text)).cast(LSN)
    )


def position(lsn, seq) -> Column:
    """What orders changes: the log position, then the place in the transaction."""
    return F.struct(F.col(lsn).alias("lsn"), F.col(seq).alias("seq"))


def source_key(system: Column, generation: Column, lsn: Column) -> Column:
    return F.concat_ws(":", system, generation, lsn)


def attempt_parts(attempt: Column) -> tuple[Column, Column]:
    pattern = r"^gen:(\d+):attempt:(\d+)$"
    return tuple(F.regexp_extract(attempt, pattern, i).try_cast("bigint") for i in (1, 2))


def bump_attempt(attempt: Column) -> Column:
    generation, number = attempt_parts(attempt)
    return F.when(generation.isNotNull(), F.format_string("gen:%d:attempt:%d", generation, number + 1)).otherwise(
        F.raise_error(F.concat(F.lit("malformed attempt: "), attempt)).cast("string")
    )


def bump_generation(attempt: Column) -> Column:
    generation, _ = attempt_parts(attempt)
    return F.when(generation.isNotNull(), F.format_string("gen:%d:attempt:1", generation + 1)).otherwise(
        F.raise_error(F.concat(F.lit("malformed attempt: "), attempt)).cast("string")
    )
