"""Nearest neighbours by a block matrix join.

Queries go to the executors in blocks of about `QUERY_BLOCK` rows, one after the other: each block is a broadcast of
bounded size and one pass over all candidates, whose heaps are written to the shared folder before the next block comes.
Neither driver nor plan grows with the queries, and the candidates are never shuffled. In a task, tiles of candidates and the query block are
coded in int8 with a scale for each vector. Their products give squared distances whose error the norms of the
rounding residues bound (Cauchy-Schwarz). A pair survives if its least possible distance doesn't exceed the k-th
smallest greatest possible one of its query; survivors are computed anew in double precision from the original
vectors, term by term, and go to the query's heap. The heaps of all tasks are merged by query. The result is exact.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part; only
vectors of equal length are compared; a null id takes no part; a query doesn't find rows of its own id, and of rows
that repeat another id the nearest counts; ties go to the smaller id; an empty table or no query gives no rows; vectors
of any length are compared whole; other columns aren't read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidelog.llm.common import partitions, shared_folder, table

K = 10
QUERY_BLOCK = 8192
TILE = 2048


def usable(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vector length -> (ids, matrix in double precision) of the rows that take part."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    offsets, values = vectors.offsets.to_numpy(), vectors.values
    missing = values.is_null().to_numpy(zero_copy_only=False)
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(missing | ~np.isfinite(flat))])
    sizes = np.diff(offsets)
    good = vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    good &= (sizes > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == size))
        matrix = flat[offsets[rows][:, None] + np.arange(size)]
        rows, matrix = rows[matrix.any(axis=1)], matrix[matrix.any(axis=1)]
        if len(rows):
            out[size] = (numbers[rows], matrix)
    return out


class Coded:
    """Vectors as int8 codes times a scale, with norms of the codes, the residues and the vectors."""

    def __init__(self, matrix: np.ndarray):
        self.scale = np.abs(matrix).max(axis=1) / 127.0
        self.scale[self.scale == 0] = 1.0
        self.codes = np.rint(matrix / self.scale[:, None]).astype(np.int8)
        close = self.codes * self.scale[:, None]
        self.close_norm, self.norm = np.linalg.norm(close, axis=1), np.linalg.norm(matrix, axis=1)
        self.residue_norm = np.linalg.norm(matrix - close, axis=1)

    def products(self, other: Coded) -> np.ndarray:
        """Whole-number products of the codes; float64 holds them exactly, and float32 up to 2**24."""
        exact = np.float32 if self.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
        return (self.codes.astype(exact) @ other.codes.astype(exact).T).astype(np.float64)


def bounds(queries: Coded, tile: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible squared distances of all pairs."""
    product = queries.products(tile) * queries.scale[:, None] * tile.scale[None, :]
    error = queries.close_norm[:, None] * tile.residue_norm[None, :] + queries.residue_norm[:, None] * tile.norm[None, :]
    about = (queries.norm**2)[:, None] + (tile.norm**2)[None, :] - 2.0 * product
    error = 2.0 * error + 1e-9 * ((queries.norm**2)[:, None] + (tile.norm**2)[None, :])  # and rounding
    return about - error, about + error


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, the squares summed in the order of the components."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        difference = a[:, i] - b[:, i]
        total += difference * difference
    return np.sqrt(total)


def search(block, k: int, tile_rows: int):
    """Candidates (id, vector) -> (query, id, score): the k nearest of each query among this task's candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = {size: (ids, matrix, Coded(matrix)) for size, (ids, matrix) in block.value.items()}
        heaps: dict[tuple[int, int], list] = {}
        # limit: the k-th smallest greatest distance of each query so far
        limit = {size: np.full(len(x[0]), np.inf) for size, x in prepared.items()}
        for batch in batches:
            for size, (ids, matrix) in usable(batch.column(0), batch.column(1)).items():
                if size not in prepared:
                    continue
                q_ids, q_matrix, q_coded = prepared[size]
                for at in range(0, len(ids), tile_rows):
                    t_ids, t_matrix = ids[at : at + tile_rows], matrix[at : at + tile_rows]
                    coded = Coded(t_matrix)
                    for start in range(0, len(q_ids), 1024):
                        stop = min(start + 1024, len(q_ids))
                        part = Coded.__new__(Coded)
                        for name, value in vars(q_coded).items():
                            setattr(part, name, value[start:stop])
                        low, high = bounds(part, coded)
                        own = q_ids[start:stop, None] == t_ids[None, :]
                        if own.any():
                            low[own] = high[own] = np.inf
                        now = limit[size][start:stop]
                        if low.shape[1] >= k and len(np.unique(t_ids)) == len(t_ids):
                            now = np.minimum(now, np.partition(high, k - 1, axis=1)[:, k - 1])
                        q, t = np.nonzero((low <= now[:, None]) & np.isfinite(low))
                        for a in range(0, len(q), 1 << 16):
                            qa, ta = q[a : a + (1 << 16)], t[a : a + (1 << 16)]
                            scores = exact_distances(q_matrix[start + qa], t_matrix[ta])
                            for i, j, score in zip((start + qa).tolist(), t_ids[ta].tolist(), scores.tolist(), strict=True):
                                push(heaps.setdefault((size, i), []), -score, -j, k)
                        for i in np.unique(q).tolist():
                            heap = heaps.get((size, start + i))
                            if heap and len(heap) == k:
                                kth = heap[0][0] * heap[0][0]
                                limit[size][start + i] = min(limit[size][start + i], kth * (1 + 1e-9) + 1e-300)
        out = [(int(prepared[size][0][i]), -j, -score) for (size, i), heap in heaps.items() for score, j in heap]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def push(heap: list, score: float, number: int, k: int) -> None:
    """Keep the k greatest (-score, -id) in a heap, of rows that repeat an id the nearest."""
    if len(heap) == k and (score, number) <= heap[0]:
        return
    for i, (s, j) in enumerate(heap):
        if j == number:
            if score > s:
                heap[i] = (score, number)
                heapq.heapify(heap)
            return
    if len(heap) < k:
        heapq.heappush(heap, (score, number))
    else:
        heapq.heappushpop(heap, (score, number))


def merge_heaps(k: int):
    """Rows in order of query_id -> its k nearest, ranked. Holds one query's k at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap, out = None, [], []

        def done():
            for rank, (score, j) in enumerate(sorted(heap, reverse=True), 1):
                out.append((now, rank, -j, -score))

        def flush():
            q, r, v, s = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int32()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for q, v, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if q != now:
                    done()
                    now, heap = q, []
                push(heap, -s, -v, k)
            if len(out) > 20_000:
                yield flush()
        done()
        if out:
            yield flush()

    return run


def nearest(candidates: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest candidates by Euclidean distance."""
    spark = candidates.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    rows = candidates.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    blocks = max(1, -(-asked.count() * 5 // (4 * query_block)))
    folder = shared_folder(spark, "neighbours")
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow().combine_chunks().to_batches()
        ready = usable(block[0].column(0), block[0].column(1)) if block else {}
        # Of rows that repeat a query's id the one with the least components asks.
        for size, (ids, matrix) in ready.items():
            order = np.lexsort((*matrix.T[::-1], ids))
            first = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
            ready[size] = (ids[first], matrix[first])
        shared = spark.sparkContext.broadcast(ready)
        found = rows.mapInArrow(search(shared, k, TILE), "query_id long, vec_id long, score double")
        if blocks > 1:  # each block is done with before the next comes to the driver
            found.write.mode("append").parquet(folder)
            shared.destroy()
    if blocks > 1:
        found = spark.read.parquet(folder)
    dealt = found.repartition(partitions(spark), "query_id").sortWithinPartitions("query_id")
    return dealt.mapInArrow(merge_heaps(k), "query_id long, rank int, vec_id long, score double")


def op5_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
