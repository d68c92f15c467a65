"""SimHash near-dedup by anchor-point covering.

Two fingerprints with at most `THRESHOLD` = 4 differing bits differ in at most 2 bits of one 32-bit half.
The anchors of a half are the words of a covering code: the 31-bit Hamming code, of covering radius 1,
with one free bit. Two halves that differ in at most 2 bits have a word between them, 1 bit from either,
and that word has an anchor within the radius: so each half is copied to every anchor within
radius + 1 = 2, the share of the threshold that falls to each of the two. Anchors are listed from the
syndrome, without a table: 17 or so for a half, of 2**27.

Only distinct fingerprints are copied, so exact copies and a hot fingerprint cost one row. Those of an
anchor are compared in blocks of at most `BLOCK`, every block with itself and every later one, and a
breadth-first search leaves at most one link for each fingerprint of a block pair.

Defined cases: null and empty texts have fingerprint zero and link with each other; a null id takes part
in no component and is its own (null) component; rows that repeat an id are one document with several
fingerprints, which its id links; of a component the smallest id names it, so there are no ties; whole texts are
read, however long, a part at a time; an empty table gives an empty table; other columns aren't read by the
query, and the stage returns them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidelog.llm.common import bound_arrow_batches, ensure_checkpoints, look_up_salted, partitions, parts, slices, table, texts_as_bytes, tidied
from tidelog.llm.components import components, settled

SHINGLE = 4
SEED = 42
THRESHOLD = 4
BLOCK = 8192

#: Bits as they come out of np.unpackbits on little-endian bytes.
PLACES = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(text: bytes | None, size: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every word shingle of a text in lower case, repeats included, a part of the text at a time."""
    digest, tail, any_yet = xxhash.xxh64_intdigest, [], False
    for part in parts(text or b""):
        words = tail + part.lower().split()
        tail = words[max(0, len(words) - size + 1) :]
        if len(words) < size:
            tail = words
            continue
        any_yet = True
        yield joined_hashes(words, size, digest, seed)
    if tail and not any_yet:
        yield joined_hashes(tail, len(tail), digest, seed)


def joined_hashes(words: list[bytes], size: int, digest, seed: int) -> np.ndarray:
    joined, n = b" ".join(words), len(words) - size + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text: the bits that over half of the shingle hashes have."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, size, SEED):
        n += len(hashes)
        ones += all_bit_counts(hashes)
    return majority(ones, n)


def majority(ones: np.ndarray, n: int) -> int:
    return int(PLACES[2 * ones > n].sum(dtype=np.uint64))


def all_bit_counts(hashes: np.ndarray, rows: int = 1 << 16) -> np.ndarray:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), rows):
        ones += bit_counts(hashes[at : at + rows])
    return ones


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, by blocks of at most 255 so that bytes don't overflow."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", size=8 << 20):
        values = np.array([fingerprint(x) for x in texts_as_bytes(batch.column(1))], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64 bits as a signed long."""
    bound_arrow_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidied(fingerprint_batches), "id long, fp long")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Of 31-bit words: the exclusive or of the numbers 1 to 31 of the bits that are set; zero for code words."""
    out = np.zeros(len(words), dtype=np.int64)
    for bit in range(31):
        out ^= ((words >> bit) & 1) * (bit + 1)
    return out


def anchors_within_two(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within 2 bits of each 32-bit half; bit 31 is the code's free bit."""
    code, row = halves & 0x7FFFFFFF, np.arange(len(halves))
    s = syndromes(code)
    rows, found = [row[s == 0]], [halves[s == 0]]  # at distance 0
    at = np.flatnonzero(s)
    rows.append(at)
    found.append(halves[at] ^ (1 << (s[at] - 1)))  # at distance 1
    for i in range(1, 32):  # at distance 2: the flipped bits i and j have i ^ j = s
        j = i ^ s
        at = np.flatnonzero(j > i)
        rows.append(at)
        found.append(halves[at] ^ (1 << (i - 1)) ^ (1 << (j[at] - 1)))
    near = s > 0  # the free bit flipped, and at most one bit of the code
    rows += [row[~near], row[near]]
    found += [halves[~near] ^ (1 << 31), halves[near] ^ (1 << 31) ^ (1 << (s[near] - 1))]
    return np.concatenate(rows), np.concatenate(found)


def copy_to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 50_000):
            fp = batch.column(0).slice(start, 50_000).to_numpy(zero_copy_only=False)
            for which in (0, 1):
                row, anchor = anchors_within_two((fp >> (32 * which)) & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(anchor | (which << 32)), pa.array(fp[row])], names=["anchor", "fp"])


def spanning_links(left: np.ndarray, right: np.ndarray | None, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of a block, or of two blocks, that a chain of close pairs joins. Between two blocks only pairs across count."""
    us, vs = [], []
    if right is None:
        free = left
        while len(free) > 1:
            queue, free = [free[0]], free[1:]
            while queue and len(free):
                x = queue.pop()
                close = np.bitwise_count(free ^ x) <= threshold
                if close.any():
                    got = free[close]
                    us.append(np.full(len(got), x))
                    vs.append(got)
                    queue += list(got)
                    free = free[~close]
    else:
        sides = [left, right]
        while len(sides[0]) and len(sides[1]):
            queue, sides[0] = [(sides[0][0], 0)], sides[0][1:]
            while queue:
                x, side = queue.pop()
                others = sides[1 - side]
                close = np.bitwise_count(others ^ x) <= threshold
                if close.any():
                    got = others[close]
                    us.append(np.full(len(got), x))
                    vs.append(got)
                    queue += [(y, 1 - side) for y in got]
                    sides[1 - side] = others[~close]
    if not us:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(us), np.concatenate(vs)


def compare_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, side, fp) in order of (group, side): links within each group. A group holds two blocks at most."""
    held_groups, held_sides, held_fps = [], [], []

    def done(groups, sides, fps):
        edges = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        us, vs = [], []
        for a, b in zip(edges, [*edges[1:], len(groups)], strict=True):
            if b - a < 2:
                continue
            middle = a + int(np.searchsorted(sides[a:b], 1))
            u, v = spanning_links(fps[a:middle], None if middle == b else fps[middle:b])
            us.append(u)
            vs.append(v)
        if us:
            both = (pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs))
            yield pa.RecordBatch.from_arrays(list(both), names=["u", "v"])

    for batch in batches:
        groups, sides, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fps = fps.view(np.uint64)  # bitwise_count takes absolute values of signed numbers
        if not len(groups):
            continue
        last = int(np.searchsorted(groups, groups[-1]))  # the last group may go on in the next batch
        held_groups.append(groups[:last])
        held_sides.append(sides[:last])
        held_fps.append(fps[:last])
        if last:
            yield from done(np.concatenate(held_groups), np.concatenate(held_sides), np.concatenate(held_fps))
            held_groups, held_sides, held_fps = [], [], []
        held_groups.append(groups[last:])
        held_sides.append(sides[last:])
        held_fps.append(fps[last:])
    if held_groups:
        yield from done(np.concatenate(held_groups), np.concatenate(held_sides), np.concatenate(held_fps))


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v): links between distinct fingerprints that join all which chains of close pairs join."""
    n = partitions(distinct.sparkSession)
    copied = distinct.select("fp").mapInArrow(tidied(copy_to_anchors), "anchor long, fp long")
    # Of the anchors with at least two, those with more than a block are cut into blocks by a hash of the fingerprint.
    sizes = copied.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > block)
    cut = copied.join(sizes, "anchor", "left").withColumn("blocks", F.coalesce(F.ceil(2 * F.col("n") / block), F.lit(1)))
    own = cut.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    dealt = own.select(
        "fp", "anchor", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    ).select(
        F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other")).alias("grp"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fp",
    )
    ordered = dealt.repartition(n, "grp").sortWithinPartitions("grp", "side")
    return ordered.mapInArrow(tidied(compare_in_blocks), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, fp and component_id, the smallest id that links reach from it."""
    ensure_checkpoints(docs.sparkSession)
    n = docs.count()
    marked = settled(fingerprints(docs, id_col, text_col), n)
    known = marked.where("id IS NOT NULL")
    classes = settled(known.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")), n)
    # Rows that repeat an id join their fingerprints.
    repeated = known.groupBy("id").agg(F.min("fp").alias("u"), F.max("fp").alias("v")).where("u <> v")
    several = known.join(repeated.select("id", "u"), "id").select("u", F.col("fp").alias("v")).where("u <> v")
    roots = settled(components(links(classes).unionByName(several), rows=n), n)
    reach = classes.join(roots.withColumnRenamed("node", "fp"), "fp").groupBy("root").agg(F.min("least").alias("component"))
    linked = roots.join(reach, "root").select(F.col("node").alias("fp"), "component")
    named = settled(classes.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"), "rows"), n)
    return look_up_salted(marked, named, ["fp"], "id").select(
        "id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each of op2's components. The pipeline takes the stage of similar_texts."""
    return one_of_each(docs, near_duplicates(docs))


def one_of_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    """One document of each component: that with the smallest id, of rows that repeat it the one with the least text hash.

    Documents without an id all stay. `named` has id and component_id.
    """
    found = named.where("id = component_id").select(F.col("id").alias("doc_id")).distinct()
    kept = docs.join(found, "doc_id", "left_semi")
    twice = kept.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    one = kept.join(twice, "doc_id", "left_semi").withColumn("__row", F.row_number().over(first)).where("__row = 1").drop("__row")
    return kept.join(twice, "doc_id", "left_anti").unionByName(one).unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)
