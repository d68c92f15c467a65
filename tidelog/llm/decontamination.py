"""Benchmark decontamination by winnowing.

Of every window of `WINDOW` = 13 consecutive words the least hash of its 5-grams is kept as a fingerprint. Documents and
benchmark texts choose alike, so a shared span of 13 words always shares a fingerprint. The fingerprints of the documents
are held against those of the benchmark; each that matches is extended to the windows whose least hash it is, and
these are joined in Spark with the benchmark's windows, word by word. Items of fewer words are windows of their own
size, with a hash of all their words as fingerprint.

What goes to every executor is the benchmark's distinct fingerprints, 8 bytes each, up to `INDEX_BYTES` of them; of more a bitmap
of `BITMAP_BITS` bits, which lets some more windows through to the join and loses none. So the documents are
read once, however large the benchmark is, and neither texts nor windows of it go through the driver.

Defined cases: null or empty texts have no words, no hits and are clean; items without words are never
found; an item without an id is listed as the empty string; rows that repeat a document are each judged, by their text;
rows that repeat an item count as one; of windows that overlap each word counts once; whole texts are read, however
long, a part at a time; an empty table gives an empty table, an empty benchmark no hits; other columns pass through
in `rest` under their own names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.llm.common import FOLD_WORDS, WordHashes, bound_arrow_batches, ensure_checkpoints, parts, slices, table, texts_as_bytes, tidied
from tidelog.llm.components import settled
from tidelog.llm.substring_dedup import Powers, window_hashes

WINDOW = 13
GRAM = 5
INDEX_BYTES = 32 << 20
BITMAP_BITS = 1 << 29
PIECE_WORDS = 128 << 10


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD_WORDS).split() if text else []


def kept_hashes(words: np.ndarray, window: int, gram: int, powers: Powers) -> np.ndarray:
    """For every window start the least hash of the grams inside."""
    least = window_hashes(words, gram, powers)
    need, have = window - gram + 1, 1
    while have < need:
        step = min(have, need - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def benchmark_windows(window: int):
    """(item, text) -> (n, words, item): the windows of every item, repeats left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for item, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), strict=True):
                words = words_of(text)
                if words:
                    n = min(window, len(words))
                    out += [(n, found, item) for found in {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}]
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.binary(), pa.string()), strict=True)], names=["n", "words", "item"])

    return run


def fingerprint_windows(window: int, gram: int):
    """(n, words) of windows -> (n, hash): the fingerprint of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()
        for batch in batches:
            sizes, out = batch.column(0).to_pylist(), []
            for n, words in zip(sizes, batch.column(1).to_pylist(), strict=True):
                numbers = hashes.of(words.split(b" "))
                out.append(kept_hashes(numbers, window, gram, powers)[0] if n == window else window_hashes(numbers, n, powers)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["n", "hash"])

    return run


class Fingerprints:
    """The benchmark's fingerprints: those of each window size in order, or for any number of them a bitmap."""

    def __init__(self, sizes: list[int], exact: dict[int, np.ndarray] | None, bitmap: np.ndarray | None):
        self.sizes, self.exact, self.bitmap = sizes, exact, bitmap

    def has(self, n: int, hashes: np.ndarray) -> np.ndarray:
        if self.exact is not None:
            known = self.exact[n]
            return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
        at = hashes & np.uint64(64 * len(self.bitmap) - 1)
        return (self.bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def fingerprints(windows: DataFrame, rows: int, window: int, gram: int, index_bytes: int = INDEX_BYTES, bitmap_bits: int = BITMAP_BITS) -> Fingerprints:
    found = windows.select("n", "words").distinct().mapInArrow(tidied(fingerprint_windows(window, gram)), "n int, hash long").distinct()
    found = settled(found, rows)
    sizes = {r["n"]: r["count"] for r in found.groupBy("n").count().collect()}  # a row for each size up to `window`
    if 8 * sum(sizes.values()) <= index_bytes:
        rows = found.toArrow()
        number, value = rows["n"].to_numpy(), rows["hash"].to_numpy().view(np.uint64)
        return Fingerprints(sorted(sizes), {n: np.sort(value[number == n]) for n in sizes}, None)
    at = found.select(F.col("hash").bitwiseAND(F.lit(bitmap_bits - 1)).alias("at"))
    filled = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits")).toArrow()  # bitmap_bits / 64 rows at most
    bitmap = np.zeros(bitmap_bits // 64, np.uint64)
    bitmap[filled["word"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return Fingerprints(sorted(sizes), None, bitmap)


def stretches(texts: list[bytes | None], counts: list[int], window: int, limit: int = PIECE_WORDS) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Lists of (row, first word, words), about `limit` words a list, that have every window of the texts. `counts` gets the words of each."""
    held, total = [], 0
    for row, text in enumerate(texts):
        tail, n = [], 0
        for part in parts(text.translate(FOLD_WORDS) if text else b""):
            words = part.split()
            if not words:
                continue
            held.append((row, n - len(tail), tail + words))
            total += len(words)
            n += len(words)
            tail = (tail + words)[1 - window :]
            if total >= limit:
                yield held
                held, total = [], 0
        counts[row] = n
    if held:
        yield held


def candidates(held: list[tuple[int, int, list[bytes]]], known: Fingerprints, hashes: WordHashes, window: int, gram: int, powers: Powers) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, n, first word, words) of the windows of some stretches that share a fingerprint with the benchmark."""
    pieces = []
    for i, (_, _, words) in enumerate(held):
        pieces += [hashes.of(words), np.full(1, i, np.uint64)]
    numbers = np.concatenate(pieces)
    size = np.array([len(x[2]) for x in held])
    begin = np.cumsum(size + 1) - (size + 1)
    for n in known.sizes:
        if len(numbers) < n:
            continue
        if n == window:
            least = kept_hashes(numbers, window, gram, powers)
            new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            stretch = known.has(n, least[new])
            ends = np.concatenate([new[1:], [len(least)]])
            starts = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in zip(new[stretch], ends[stretch], strict=True))])
        else:
            starts = np.flatnonzero(known.has(n, window_hashes(numbers, n, powers)))
        owner = np.searchsorted(begin, starts, side="right") - 1
        inside = starts + n <= (begin + size)[owner]
        for j, at in zip(owner[inside].tolist(), (starts - begin[owner])[inside].tolist(), strict=True):
            row, first, words = held[j]
            yield row, n, first + at, b" ".join(words[at : at + n])


FOUND = pa.list_(pa.struct([("n", pa.int32()), ("at", pa.int64()), ("words", pa.binary())]))


def look_up(index, window: int, gram: int):
    """(text, mark, id, rest) -> (rest, id, mark, n_words, found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes, powers = index.value, WordHashes(), Powers()
        for batch in slices(batches, "text"):
            texts = texts_as_bytes(batch.column(0))
            counts, found = [0] * len(texts), [[] for _ in texts]
            for held in stretches(texts, counts, window):
                for row, n, at, words in candidates(held, known, hashes, window, gram, powers):
                    found[row].append({"n": n, "at": at, "words": words})
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), batch.column(2), batch.column(1), pa.array(counts, pa.int64()), pa.array([x or None for x in found], FOUND)], names=["rest", "id", "mark", "n_words", "found"]
            )

    return run


def covered(spans):
    """Words inside any of the spans (at, n). JVM only."""
    sweep = F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reach")),
        lambda a, s: F.struct((a["total"] + F.greatest(F.lit(0), s["at"] + s["n"] - F.greatest(s["at"], a["reach"]))).alias("total"), F.greatest(a["reach"], s["at"] + s["n"]).alias("reach")),
    )
    return sweep["total"]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES, carry: list[str] | None = None, id_col: str = "doc_id",
    bitmap_bits: int = BITMAP_BITS, window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """Every row of `docs`, its columns `carry` (by default all) as struct `rest`, with n_words, n_hit, n_items, items_sha256 and contaminated."""
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    ensure_checkpoints(spark)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text"))
    windows = items.mapInArrow(tidied(benchmark_windows(window)), "n int, words binary, item string").distinct()
    about = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 6 + 1  # windows, give or take
    windows = settled(windows, about)
    index = spark.sparkContext.broadcast(fingerprints(windows, about, window, gram, index_bytes, bitmap_bits))
    rest = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns])
    text = F.col(text_col).cast("string")
    whole = docs.select(text.alias("text"), F.xxhash64(text).alias("mark"), F.col(id_col).cast("long").alias("id"), rest.alias("rest"))
    ddl = f"rest {whole.schema['rest'].dataType.simpleString()}, id long, mark long, n_words long, found array<struct<n:int,at:long,words:binary>>"
    passed = settled(whole.mapInArrow(tidied(look_up(index, window, gram)), ddl), docs.count())
    # Rows of one id with one text have the same windows and get the same result.
    asked = passed.where("found IS NOT NULL").select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.explode("found").alias("f")).select("__id", "__mark", "f.*")
    hits = asked.join(windows, ["n", "words"]).groupBy("__id", "__mark").agg(F.collect_set("item").alias("__items"), F.collect_set(F.struct(F.col("at"), F.col("n").cast("long").alias("n"))).alias("__spans"))
    known = passed.drop("found").join(hits, F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    listed = F.coalesce("__items", F.array().cast("array<string>"))
    n_hit = F.coalesce(covered(F.col("__spans")), F.lit(0)).cast("long")
    return known.select(
        "rest", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(listed), ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("rest.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated. Only the ids of the others, and hashes of their texts, meet the documents again."""
    marked = docs.select(F.col("doc_id").alias("__doc_id"), F.xxhash64("text").alias("__mark"), "text")
    found = find_contamination(marked, table(spark, sf_dir, "benchmark"), carry=["__doc_id", "__mark"], id_col="__doc_id")
    bad = found.where("contaminated").select("rest.__doc_id", "rest.__mark").distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.xxhash64("text") == F.col("__mark")), "left_anti")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(words[i:i + least(13, len(words)) - 1], ' ') AS k
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n)
), f AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM f) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM f) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
