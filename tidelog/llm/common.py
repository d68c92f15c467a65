"""Pieces that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

#: bytes.split() without arguments splits at exactly \x20 and \x09-\x0D.
#: Words of [0-9a-z] and non-ASCII bytes: A-Z fold to a-z, every other ASCII byte becomes a space.
FOLD_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

#: Odd multiplier and finalizer constants of the 64-bit mixing below.
MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)

#: Most bytes of an Arrow batch on its way to Python (one row may be more). A batch stands in memory of both sides.
ARROW_BYTES = 8 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer, elementwise."""
    x = (x ^ (x >> np.uint64(33))) * MIX_A
    x = (x ^ (x >> np.uint64(33))) * MIX_B
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """Word bytes -> XXH3-64, remembered for at most `bound` words."""

    def __init__(self, bound: int = 100_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.bound:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def texts_as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text of an Arrow string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


SPACE = re.compile(rb"[\x20\x09-\x0D]")


def parts(text: bytes, size: int = 256 << 10) -> Iterator[bytes]:
    """The text in parts of about `size` bytes, cut at white space: its words, without a list of all of them."""
    at = 0
    while at < len(text):
        space = SPACE.search(text, at + size)
        end = space.end() if space else len(text)
        yield text[at:end]
        at = end


def slices(batches: Iterable[pa.RecordBatch], column: str, rows: int = 4096, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that none holds more than `rows` rows or (unless it is one row) `size` bytes of `column`."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        lengths = pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, base + size, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def tidied(run):
    """`run`, a function of Arrow batches, that at its end gives freed memory back to the system.

    Python workers wait for their next task with what they hold, beside the workers that have one.
    """

    def each(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return each


def bound_arrow_batches(spark: SparkSession) -> None:
    """Lower the session's limit of Arrow batches to `ARROW_BYTES`; a lower one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower()
    if not now.removesuffix("b").isdigit() or not 0 < int(now.removesuffix("b")) <= ARROW_BYTES:
        spark.conf.set(name, ARROW_BYTES)


def shared_base(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or what the session has been given.

    Where neither is set, a session whose only executor is this process gets a temporary folder; on a cluster, where
    such a folder would be another one on every machine, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share. What is written there stays until the folder is cleaned."""
    return os.path.join(shared_base(spark), f"{name}-{uuid.uuid4().hex}")


def ensure_checkpoints(spark: SparkSession) -> None:
    """checkpoint() works after this, in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_base(spark))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Words [^\\x20\\x09-\\x0D]+ of a text column as a long; 0 for null. JVM only."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def look_up_salted(rows: DataFrame, facts: DataFrame, keys: list[str], by: str, rows_col: str = "rows") -> DataFrame:
    """`rows` left-joined with `facts` on `keys`; facts have one row a key and in `rows_col` how many rows have it.

    A key with more than a fair share (a quarter of a partition) of all rows is hot. There are at most four hot keys for
    each partition, which proves the bound of their broadcast. Rows of a hot key are dealt by column `by` to salts of a
    fair share each, and the key's fact is copied to every salt: fewer than eight copies for each partition in all.
    """
    total = facts.agg(F.coalesce(F.sum(rows_col), F.lit(0)).alias("n")).first()["n"]
    fair = max(1, int(total) // (4 * partitions(rows.sparkSession)))
    salts = F.ceil(F.col(rows_col) / F.lit(fair)).cast("int")
    hot = facts.where(F.col(rows_col) > fair).select(*keys, salts.alias("__salts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("__salts")).cast("int"), F.lit(0))
    )
    copies = F.when(F.col(rows_col) > fair, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    return dealt.join(facts.withColumn("__salt", F.explode(copies)), [*keys, "__salt"], "left").drop("__salt", "__salts", rows_col)


def per_text(docs: DataFrame, text_col: str, carry: list[str] | None, work, out: str, with_text: bool = False) -> DataFrame:
    """Every row's columns `carry` (by default all) as struct `rest`, beside what `work` makes of its text.

    With `with_text` the text, as it came, is column `text` beside them, so that `rest` needn't hold it once more.
    work() is called once a task; what it returns maps a list of UTF-8 texts to a list of Arrow arrays, in the
    order of the DDL `out`, whose columns are separated by semicolons.
    """
    bound_arrow_batches(docs.sparkSession)
    rest = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("rest")
    pair = docs.select(F.col(text_col).cast("string").alias("text"), rest)
    names = ["rest", *["text"] * with_text, *(x.split()[0] for x in out.split(";"))]

    def run(batches):
        each = work()
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(1), *[batch.column(0)] * with_text, *each(texts_as_bytes(batch.column(0)))], names=names)

    return pair.mapInArrow(tidied(run), f"rest {pair.schema['rest'].dataType.simpleString()}, {'text string, ' * with_text}{out.replace(';', ',')}")


def unpacked(found: DataFrame, columns: list[str], *more) -> DataFrame:
    """The columns of struct `rest` under their own names, then `more`."""
    return found.select(*[F.col("rest").getField(c).alias(c) for c in columns], *more)
