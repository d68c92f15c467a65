"""Near copies by the Jaccard similarity of five-word shingles, for the pipeline's near-dedup.

Texts with the same set of shingles are one class. Two ways propose which classes to compare:

* SimHash fingerprints of the sets, linked by op2's anchor-point covering (`simhash_dedup.links`): all classes whose
  fingerprints chains of at most 4 differing bits join are one group.
* `BANDS` bands of `ROWS` MinHash values each: of similarity 0.8, 1 - (1 - 0.8**5)**20 = 99.96 % of pairs share a band,
  above it more. This is for what the fingerprints can't reach: at 0.8 about 15 % of their bits differ, 10 or so of 64, and a
  covering code that reaches as far compares all with all.

Groups that join the same classes are compared once. Inside a group the sets themselves are compared, exactly, and a
breadth-first search leaves at most one link for each class. A group with more than `BLOCK` shingles is cut into
blocks, every two of which are compared.

Defined cases: null and empty texts are one class; a text of under five words is one shingle; a null id takes part in
no component and has none, and its row stays; rows that repeat an id are one document with several texts, which its id
links; of a component the row with the smallest id stays, of rows that repeat it the one with the least text hash; whole
texts are read, however long, a part at a time; an empty table gives an empty table; other columns pass through
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.llm.common import bound_arrow_batches, ensure_checkpoints, look_up_salted, partitions, slices, texts_as_bytes, tidied
from tidelog.llm import simhash_dedup
from tidelog.llm.components import components, settled
from tidelog.llm.simhash_dedup import all_bit_counts, majority, one_of_each, shingle_hashes

SHINGLE = 5
BANDS = 20
ROWS = 5
SEED = 43
#: Shingles (8 bytes each) of a block.
BLOCK = 1 << 20

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
FLIPS, FACTORS = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    found = [np.unique(x) for x in shingle_hashes(text, size, SEED)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def class_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def bands(hashes: np.ndarray, rows: int = 2048) -> np.ndarray:
    """A key for each band of the MinHash values of a set; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), rows):
        np.minimum(least, ((hashes[at : at + rows] ^ FLIPS) * FACTORS).min(axis=1), out=least)
    data, width = least.tobytes(), 8 * ROWS
    return np.array([xxhash.xxh3_64_intdigest(data[i * width : (i + 1) * width], i) for i in range(BANDS)], np.uint64).view(np.int64)


def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = [shingle_set(x) for x in texts_as_bytes(batch.column(1))]
        classes = pa.array([class_of(x) for x in sets], pa.int64())
        keys = pa.array([bands(x).tobytes() for x in sets], pa.binary())
        prints = np.array([majority(all_bit_counts(x), len(x)) for x in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), classes, pa.array([len(x) for x in sets], pa.int64()), keys, pa.array(prints)], names=["id", "cls", "size", "bands", "fp"])


def explode_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "bands"):
        keys = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        at = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.concatenate(keys))], names=["cls", "size", "band"])


def zip_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(least, text) -> (least, zipped): for an exchange this takes a third less than what Spark makes of it."""
    packer = zstandard.ZstdCompressor(level=6)
    for batch in slices(batches, "text"):
        zipped = [packer.compress(x or b"") for x in texts_as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(zipped, pa.binary())], names=["least", "zipped"])


def fetch_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(zipped text, cls): the shingles of the text if they are those of the class; a document's other texts give none."""
    unzip = zstandard.ZstdDecompressor()
    for batch in slices(batches, "zipped", size=1 << 20):
        sets = [shingle_set(unzip.decompress(x)) for x in batch.column(0).to_pylist()]
        own = [(c, x.tobytes()) for c, x in zip(batch.column(1).to_pylist(), sets, strict=True) if class_of(x) == c]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary())], names=["cls", "shingles"])


def spanning_links(classes: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all which chains of sets of similarity 0.8 or more join; at most one for each set."""
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holds, free = np.zeros(numbers.max() + 1, bool), np.arange(len(sets))
    us, vs = [], []
    while len(free):
        queue, free = [free[0]], free[1:]
        while queue and len(free):
            x = queue.pop()
            # Sets of too different a size can't be that similar.
            fits = (5 * sizes[free] >= 4 * sizes[x]) & (4 * sizes[free] <= 5 * sizes[x])
            near = free[fits]
            if not len(near):
                continue
            own = numbers[starts[x] : starts[x + 1]]
            holds[own] = True
            begins = np.concatenate([[0], np.cumsum(sizes[near])[:-1]])
            places = np.arange(sizes[near].sum()) + np.repeat(starts[near] - begins, sizes[near])
            common = np.add.reduceat(holds[numbers[places]], begins, dtype=np.int64)
            holds[own] = False
            got = near[9 * common >= 4 * (sizes[x] + sizes[near])]  # common / (a + b - common) >= 4 / 5
            us += [x] * len(got)
            vs += got.tolist()
            queue += got.tolist()
            free = np.setdiff1d(free, got, assume_unique=True)
    return classes[np.array(us, int)], classes[np.array(vs, int)]


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, cls, shingles) in order of group: links within each group."""
    group, classes, sets = None, [], []

    def done():
        u, v = spanning_links(np.array(classes, np.int64), sets)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        for g, c, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if g != group:
                if len(sets) > 1:
                    yield done()
                group, classes, sets = g, [], []
            classes.append(c)
            sets.append(np.frombuffer(x, np.uint64))
    if len(sets) > 1:
        yield done()


def covered(classes: DataFrame, rows: int) -> DataFrame:
    """(cls, size, band): the group of each class (cls, size, fp) whose fingerprints op2's covering links."""
    near = components(simhash_dedup.links(classes.select("fp").distinct()), rows=rows).select(F.col("node").alias("fp"), "root")
    return classes.select("cls", "size", "fp").join(near, "fp", "left").select("cls", "size", F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp")).alias("band"))


def links(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, more: DataFrame | None = None, rows: int = 1 << 62) -> DataFrame:
    """(u, v): links between classes; `classes` has cls, least (the id of a row that has its text), size and bands, `more` further groups (cls, size, band)."""
    n = partitions(docs.sparkSession)
    banded = classes.select("cls", "size", "bands").mapInArrow(tidied(explode_bands), "cls long, size long, band long")
    banded = banded if more is None else banded.unionByName(more)
    joined = banded.groupBy("band").agg(
        F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("cls").alias("first"), F.max("cls").alias("last"),
        F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("mark"),
    ).where("n > 1")
    # Of the bands that join the same classes one stands for all.
    once = joined.groupBy("n", "shingles", "first", "last", "mark").agg(F.min("band").alias("band"))
    cut = once.select("band", F.when(F.col("shingles") > block, F.ceil(2 * F.col("shingles") / block)).otherwise(F.lit(1)).alias("blocks"))
    own = banded.join(cut, "band").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    dealt = own.select("cls", "band", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")).select(
        "cls", F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("grp")
    )
    dealt = settled(dealt, rows)
    wanted = classes.join(dealt.select("cls").distinct(), "cls", "left_semi").select("cls", "least")
    texts = docs.select(F.col(id_col).cast("long").alias("least"), F.col(text_col).cast("string").alias("text"))
    zipped = texts.where("least IS NOT NULL").mapInArrow(tidied(zip_texts), "least long, zipped binary")
    sets = zipped.join(wanted, "least").select("zipped", "cls").mapInArrow(tidied(fetch_sets), "cls long, shingles binary")
    ordered = dealt.join(sets, "cls").select("grp", "cls", "shingles").repartition(n, "grp").sortWithinPartitions("grp")
    return ordered.mapInArrow(tidied(compare), "u long, v long").where("u <> v").distinct()


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, cls and component_id, the smallest id that links reach from it."""
    ensure_checkpoints(docs.sparkSession)
    bound_arrow_batches(docs.sparkSession)
    n = docs.count()
    pair = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = settled(pair.mapInArrow(tidied(mark), "id long, cls long, size long, bands binary, fp long"), n)
    known = marked.where("id IS NOT NULL")
    # Rows of a class have the same size, bands and fingerprint.
    first = [F.first(c).alias(c) for c in ("size", "bands", "fp")]
    classes = settled(known.groupBy("cls").agg(F.min("id").alias("least"), F.count("*").alias("rows"), *first), n)
    repeated = known.groupBy("id").agg(F.min("cls").alias("u"), F.max("cls").alias("v")).where("u <> v")
    several = known.join(repeated.select("id", "u"), "id").select("u", F.col("cls").alias("v")).where("u <> v")
    found = links(docs, classes, id_col, text_col, more=covered(classes, n), rows=n)
    roots = settled(components(found.unionByName(several), rows=n), n)
    reach = classes.join(roots.withColumnRenamed("node", "cls"), "cls").groupBy("root").agg(F.min("least").alias("component"))
    linked = roots.join(reach, "root").select(F.col("node").alias("cls"), "component")
    named = settled(classes.join(linked, "cls", "left").select("cls", F.coalesce("component", "least").alias("component_id"), "rows"), n)
    return look_up_salted(marked.select("id", "cls"), named, ["cls"], "id").select(
        "id", "cls", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the smallest id, of rows that repeat it the one with the least text hash."""
    return one_of_each(docs, similar(docs))
