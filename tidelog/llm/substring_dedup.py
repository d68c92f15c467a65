"""Substring dedup by recompression.

Every document's words are renamed in rounds, each a run step (a maximal run of one symbol gets one
name) and a pair step (a symbol of the left class followed by one of the right class gets one name).
A name is a hash of what it stands for and a class is a bit of the name, so all executors name alike
without a shared dictionary, and equal word sequences get equal interior symbols.

With each symbol goes its context: the words that suffice to produce it wherever they occur. A window
of `window` words therefore owns a set of symbols that depends on its words alone; its key is the
highest of them, leftmost first. Equal windows have equal keys, and one key serves several
neighbouring windows. Occurrences meet by key in Spark; a 48-bit hash of all words of each window,
compared only under an equal 64-bit key, verifies it.

Among the windows that a task holds at once only the smallest document of each goes to the exchange, since
they decide the others themselves: a passage that a third of all documents share adds one row each time. A bucket of
keys with more than `BUCKET_WINDOWS` windows is not compared at once: its windows are dealt anew over all
buckets, by their own hash, so that a common phrase with ever other surroundings stays bounded.

Memory doesn't grow with the texts: a text is split `PART` bytes at a time, and stretches that overlap by
a window less a word have the windows of the whole.

Defined cases: a null or empty text has no words and stays; documents with null ids are passed on and
count as no one's copy; rows that repeat an id are one document for "smaller id" and each is judged by its own text
(they are told apart by the rank of their texts' hashes); texts of fewer words than the window lose nothing; texts of
any length are judged whole; an empty table gives an empty table; other columns pass through under their own names,
whatever these are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidelog.llm.common import WordHashes, bound_arrow_batches, mix64, partitions, parts, slices, table, texts_as_bytes, tidied

WINDOW = 13
ROUNDS = 6
RUN_SALT = np.uint64(0x9E3779B97F4A7C15)
PAIR_SALT = np.uint64(0xD6E8FEB86659FD93)
POLY = 0x9FB21C651E98DF25
OCCURRENCE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("variant", "<u4"), ("count", "u1")])
STRETCH = np.dtype([("doc", "<i8"), ("start", "<u4"), ("variant", "<u4"), ("count", "<u4")])
TAG_BYTES = 6
#: Bytes of a text that are split at once, words that are named at once, and windows that a task holds before it deals them out.
PART = 256 << 10
PIECE_WORDS = 128 << 10
HELD_WINDOWS = 640 << 10
#: Windows of a bucket that are compared at once.
BUCKET_WINDOWS = 3 << 19
#: Buckets for each partition.
BUCKETS = 4


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, for hashes of windows by prefix sums."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base = np.full(n + (n >> 2), POLY, dtype=np.uint64)
            base[0] = 1
            back = np.full(len(base), pow(POLY, -1, 1 << 64), dtype=np.uint64)
            back[0] = 1
            self.up, self.down = np.multiply.accumulate(base), np.multiply.accumulate(back)
        return self.up[:n], self.down[:n]


def window_hashes(words: np.ndarray, window: int, powers: Powers) -> np.ndarray:
    """A hash of words[i:i+window] for every i; equal words give equal hashes at any place."""
    up, down = powers.to(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * down)])
    return mix64((sums[window:] - sums[:-window]) * up[: len(words) - window + 1])


def recompress(words: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels from low to high: (name, first context word, end of context) of the symbols whose context fits a window."""
    name, lo, hi = words, np.arange(len(words), dtype=np.int32), np.arange(1, len(words) + 1, dtype=np.int32)
    yield name, lo, hi
    for level in range(1, rounds + 1):
        # Runs: every symbol's context takes in both neighbours, which tell where its run ends.
        head = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        tail = np.concatenate([head[1:], [len(name)]]) - 1
        length = (tail - head + 1).astype(np.uint64)
        lo, hi = lo[np.maximum(head - 1, 0)], hi[np.minimum(tail + 1, len(name) - 1)]
        name = np.where(length > 1, mix64(name[head] ^ (length * RUN_SALT)), name[head])
        if len(name) < 3:
            return
        # Pairs: a left symbol before a right one merges; the others look at one neighbour to know that they don't.
        right = (mix64(name + np.uint64(level * int(PAIR_SALT) % (1 << 64))) & np.uint64(1)).astype(bool)
        first = np.concatenate([~right[:-1] & right[1:], [False]])
        second = np.concatenate([[False], first[:-1]])
        at = np.flatnonzero(~second)
        pair, alone_right, last = first[at], right[at], len(name) - 1
        following = np.minimum(at + 1, last)
        low = np.where(alone_right & ~pair, lo[np.maximum(at - 1, 0)], lo[at])
        high = np.where(alone_right & ~pair, hi[at], hi[following])
        name = np.where(pair, mix64((name[at] * PAIR_SALT) ^ mix64(name[following] + RUN_SALT)), name[at])
        lo, hi = low, high
        fit = hi - lo <= window
        if not fit.any():
            return
        yield name[fit], lo[fit], hi[fit]


def window_keys(words: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """For every window start the name of its highest symbol, of several the leftmost."""
    starts = np.arange(len(words) - window + 1, dtype=np.int32)
    keys = np.zeros(len(starts), dtype=np.uint64)
    for name, lo, hi in recompress(words, window, rounds):
        at = np.searchsorted(lo, starts)
        inside = np.minimum(at, len(lo) - 1)
        fits = (at < len(lo)) & (hi[inside] <= starts + window)
        keys[fits] = name[inside[fits]]
    return keys


def joined_runs(*same: np.ndarray, start: np.ndarray, count: np.ndarray | int = 1, limit: int = 255) -> tuple[np.ndarray, np.ndarray]:
    """Heads and lengths (in rows) of stretches of rows that follow on each other, with equal values, cut at `limit` rows."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.concatenate([[True], start[1:] != (start + count)[:-1]])
    for x in same:
        cut[1:] |= x[1:] != x[:-1]
    head = np.flatnonzero(cut)
    where = np.arange(len(start)) - head[np.cumsum(cut) - 1]
    head = np.flatnonzero(cut | (where % limit == 0))
    return head, np.diff(np.concatenate([head, [len(start)]]))


def stretches(ids, variants, texts: list[bytes | None], window: int, hashes: WordHashes, size: int = PART, limit: int = PIECE_WORDS):
    """Lists of (id, variant, first word, word hashes), about `limit` words a list, that have every window of the texts once."""
    held, words = [], 0
    for number, variant, text in zip(ids, variants, texts, strict=True):
        tail, at = np.zeros(0, np.uint64), 0
        for part in parts(text or b"", size):
            tail = np.concatenate([tail, hashes.of(part.split())])
            if len(tail) < window:
                continue
            held.append((number, variant, at, tail))
            words += len(tail)
            at += len(tail) - window + 1
            tail = tail[len(tail) - window + 1 :]
            if words >= limit:
                yield held
                held, words = [], 0
    if held:
        yield held


def windows_of(held: list, window: int, rounds: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(key, tag, document id, variant, start) of every window of some stretches."""
    pieces, edge = [np.zeros(1, np.uint64)], np.zeros(1, np.uint64)
    for _, _, _, words in held:
        edge = edge + np.uint64(1)  # parts the stretches: no window goes across one
        pieces += [words, edge]
    size = np.array([len(x[3]) for x in held])
    count = size - window + 1
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(1 + np.cumsum(size + 1) - (size + 1), count) + within
    words = np.concatenate(pieces)
    keys, tags = window_keys(words, window, rounds)[at], window_hashes(words, window, powers)[at] >> np.uint64(64 - 8 * TAG_BYTES)
    docs, variants, first = (np.repeat(np.array([x[i] for x in held], kind), count) for i, kind in ((0, np.int64), (1, np.uint32), (2, np.int64)))
    return keys, tags, docs, variants, (first + within).astype(np.uint32)


def smallest_of_group(keys: np.ndarray, tags: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """True where the document is the smallest with its (key, tag)."""
    order = np.argsort(mix64(keys + tags * PAIR_SALT))
    k, t, d = keys[order], tags[order], docs[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])])
    least = np.empty(len(d), dtype=bool)
    least[order] = d == np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1]
    return least


EXCHANGE = "bucket int, kind int, n long, blob binary"
EXCHANGE_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())])
#: Kinds of rows in an exchange: windows to compare, windows found (by the bucket of their document), documents.
COMPARE, FOUND, DOCUMENT = range(3)


def exchange_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(EXCHANGE_ARROW)], schema=EXCHANGE_ARROW)


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def layers_of(table: np.ndarray) -> np.ndarray:
    """The bytes of a table's columns, a row for those of the same weight; some columns of this are the same of some rows."""
    return np.concatenate([np.ascontiguousarray(table[f]).view(np.uint8).reshape(-1, table.dtype[f].itemsize).T for f in table.dtype.names])


def planes(table: np.ndarray) -> bytes:
    """The bytes of a table's columns, those of the same weight together, which compress better."""
    return layers_of(table).tobytes()


def from_planes(body: bytes, kind: np.dtype, n: int, at: int) -> tuple[np.ndarray, int]:
    table = np.empty(n, kind)
    for f in kind.names:
        width = kind[f].itemsize
        table[f] = np.ascontiguousarray(np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T).view(kind[f]).ravel()
        at += n * width
    return table, at


def packed(got: tuple[np.ndarray, ...], bucket: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, windows, blob) of each bucket: its occurrences in order of their keys, then the tag of each window.

    All buckets are sorted and laid out at once, so that a bucket of a few windows costs little more than its bytes.
    """
    keys, tags, docs, variants, start = got
    if not len(keys):
        return
    head, length = joined_runs(bucket, keys, docs, variants, start=start)
    order = np.lexsort((keys[head], bucket[head]))
    head, length = head[order], length[order]
    table = np.empty(len(head), dtype=OCCURRENCE)
    for field, values in (("key", keys), ("doc", docs), ("start", start), ("variant", variants)):
        table[field] = values[head]
    table["count"] = length
    layers = layers_of(table)
    ends = np.cumsum(length)
    rows = np.repeat(head - ends + length, length) + np.arange(length.sum())
    marks = tags[rows].view(np.uint8).reshape(-1, 8)[:, :TAG_BYTES].tobytes()
    numbers = bucket[head]
    edges = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    packer, at = zstandard.ZstdCompressor(level=1), 0
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(head)], strict=True):
        to = int(ends[b - 1])
        body = b"".join([(b - a).to_bytes(4, "little"), layers[:, a:b].tobytes(), marks[at * TAG_BYTES : to * TAG_BYTES]])
        yield int(numbers[a]), to - at, packer.compress(body)
        at = to


def pack(keys, tags, docs, variants, start) -> bytes:
    """The blob of windows that are all of one bucket."""
    return next(packed((keys, tags, docs, variants, start), np.zeros(len(keys), np.int64)))[2]


def unpack(*blobs: bytes) -> tuple[np.ndarray, ...]:
    """(key, tag, document id, variant, start) of the windows of all blobs."""
    unzip = zstandard.ZstdDecompressor()
    layers, marks = [], []
    for blob in blobs:
        body = unzip.decompress(blob)
        size = OCCURRENCE.itemsize * int.from_bytes(body[:4], "little")
        layers.append(np.frombuffer(body, np.uint8, size, 4).reshape(OCCURRENCE.itemsize, -1))
        marks.append(np.frombuffer(body, np.uint8, offset=4 + size))
    layers, marks, out, at = np.concatenate(layers, axis=1), np.concatenate(marks).reshape(-1, TAG_BYTES), {}, 0
    for f in OCCURRENCE.names:
        width = OCCURRENCE[f].itemsize
        out[f] = np.ascontiguousarray(layers[at : at + width].T).view(OCCURRENCE[f]).ravel()
        at += width
    count = out["count"].astype(np.int64)
    tags = np.zeros((len(marks), 8), np.uint8)
    tags[:, :TAG_BYTES] = marks
    inner = np.arange(len(marks)) - np.repeat(np.cumsum(count) - count, count)
    repeated = {f: np.repeat(out[f], count) for f in ("key", "doc", "variant", "start")}
    return repeated["key"], tags.view(np.uint64).ravel(), repeated["doc"], repeated["variant"], (repeated["start"] + inner).astype(np.uint32)


def stretch_table(docs, variants, start, count=1) -> np.ndarray:
    """Windows, or stretches of them, as joined stretches in order of (document, variant, start)."""
    order = np.lexsort((start, variants, docs))
    table = np.empty(len(order), STRETCH)
    for field, values in (("doc", docs), ("variant", variants), ("start", start)):
        table[field] = values[order]
    table["count"] = count if np.isscalar(count) else count[order]
    head, _ = joined_runs(table["doc"], table["variant"], start=table["start"], count=table["count"], limit=1 << 30)
    joined = table[head]
    if len(head):
        joined["count"] = np.add.reduceat(table["count"], head)
    return joined


class Found:
    """Windows found so far, given out by the bucket of their document, or if that isn't wanted yet all together, in any bucket."""

    def __init__(self, buckets: int, by_document: bool = True, limit: int = HELD_WINDOWS):
        self.buckets, self.by_document, self.limit, self.held, self.n = buckets, by_document, limit, [], 0

    def add(self, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(table)
        self.n += len(table)
        if self.n >= self.limit:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        table = np.concatenate(self.held)
        self.held, self.n = [], 0
        table = stretch_table(table["doc"], table["variant"], table["start"], table["count"])
        mark = mix64(table["doc"].view(np.uint64))
        if not self.by_document:
            mark = np.full(len(table), np.bitwise_xor.reduce(mix64(mark + table["start"])))
        bucket = bucket_of(mark, self.buckets)
        order = np.argsort(bucket, kind="stable")
        layers, number = layers_of(table[order]), bucket[order]
        edges = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        packer, rows = zstandard.ZstdCompressor(level=1), []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
            rows.append((int(number[a]), FOUND, b - a, packer.compress(layers[:, a:b].tobytes())))
        yield exchange_rows(rows)


def dealt_windows(got: tuple[np.ndarray, ...], bucket: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """Rows for the exchange: the windows of each bucket packed together."""
    return [(number, COMPARE, n, blob) for number, n, blob in packed(got, bucket)]


def name_windows(buckets: int, window: int, rounds: int, held_windows: int = HELD_WINDOWS):
    """Arrow batches of (id, variant, text) -> windows by bucket of their key, and windows already found, in any bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers, turn = WordHashes(), Powers(), 0

        def deal(held):
            got = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            least = smallest_of_group(*got[:3])
            if not least.all():
                table = stretch_table(*(x[~least] for x in got[2:]))
                yield exchange_rows([((turn * 7919 + int(got[2][0])) % buckets, FOUND, len(table), zstandard.compress(planes(table), 1))])
            got = tuple(x[least] for x in got)
            yield exchange_rows(dealt_windows(got, bucket_of(got[0], buckets)))

        held, n = [], 0
        for batch in slices(batches, "text"):
            ids, variants = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = np.argsort(ids, kind="stable")
            texts = batch.column(2)
            each = (texts_as_bytes(texts.slice(int(j), 1))[0] for j in order)
            for some in stretches(ids[order].tolist(), variants[order].tolist(), each, window, hashes):
                held.append(windows_of(some, window, rounds, powers))
                n += len(held[-1][0])
                if n >= held_windows:
                    yield from deal(held)
                    held, n, turn = [], 0, turn + 1
        if held:
            yield from deal(held)

    return run


def compare_windows(buckets: int, limit: int | None, held_windows: int = HELD_WINDOWS):
    """Rows in the order of their buckets -> windows that also start in a smaller document.

    They come out by bucket of the document if there is no `limit`. With one they come together, in any bucket, and
    windows of buckets with more than `limit` come out again, by bucket of their own hash; some `held_windows` are dealt at
    once, since a row of the exchange costs as much as many windows. Holds one bucket's windows at most, or `limit` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(buckets, by_document=limit is None)

        def judged(blobs):
            keys, tags, docs, variants, start = unpack(*blobs)
            least = smallest_of_group(keys, tags, docs)
            return stretch_table(docs[~least], variants[~least], start[~least])

        def dealt(blobs, sizes):
            turn = (np.cumsum(sizes) - 1) // held_windows
            for a, b in zip(*(np.searchsorted(turn, np.unique(turn), side) for side in ("left", "right")), strict=True):
                some = unpack(*blobs[a:b])
                yield exchange_rows(dealt_windows(some, bucket_of(mix64(some[0] + some[1] * PAIR_SALT), buckets)))

        def ended(blobs, sizes, over):
            if over:
                yield from dealt(blobs, sizes)
            elif blobs:
                yield from found.add(judged(blobs))

        now, blobs, sizes, held, over = None, [], [], 0, False
        for batch in batches:
            for bucket, kind, n, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if kind == FOUND:
                    yield from found.add(from_planes(zstandard.decompress(blob), STRETCH, n, 0)[0])
                    continue
                if bucket != now:
                    yield from ended(blobs, sizes, over)
                    now, blobs, sizes, held, over = bucket, [], [], 0, False
                blobs.append(blob)
                sizes.append(n)
                held += n
                over = over or (limit is not None and held > limit)
                if over and held >= held_windows:
                    yield from dealt(blobs, sizes)
                    blobs, sizes, held = [], [], 0
        yield from ended(blobs, sizes, over)
        yield from found.rest()

    return run


def found_windows(pairs: DataFrame, window: int, rounds: int, limit: int = BUCKET_WINDOWS, held_windows: int = HELD_WINDOWS) -> DataFrame:
    """(id, variant, text) -> rows of kind FOUND: stretches of windows that also start in a document of smaller id, by bucket of the id."""
    n = partitions(pairs.sparkSession)
    buckets = BUCKETS * n

    def compared(rows, most):
        return rows.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket").mapInArrow(tidied(compare_windows(buckets, most)), EXCHANGE)

    named = pairs.mapInArrow(tidied(name_windows(buckets, window, rounds, held_windows)), EXCHANGE)
    # What overfull buckets send on is dealt by the windows' own hash: equal windows meet, of each a task has sent one, and
    # so these buckets are as even as hashes are. Windows found already, a small part of all, come along.
    return compared(compared(named, limit), None)


def compress_texts(buckets: int):
    """(id, variant, text, rest) of documents -> the same with the text zipped, by bucket of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = zstandard.ZstdCompressor(level=6), 0
        for batch in slices(batches, "text"):
            ids = batch.column(0)
            bucket = bucket_of(mix64(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)), buckets)
            # A null id has no windows; such rows are dealt in turn.
            bucket = np.where(ids.is_null().to_numpy(zero_copy_only=False), (seen + np.arange(len(bucket))) % buckets, bucket)
            seen += len(bucket)
            texts = batch.column(2)
            zipped = [None if x is None else packer.compress(x) for x in texts_as_bytes(texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), ids, batch.column(1), pa.array(zipped, pa.binary()), batch.column(3)], names=["bucket", "id", "variant", "zipped", "rest"]
            )

    return run


def cut_text(text: bytes, found: np.ndarray, window: int, with_text: bool) -> tuple[int, int, str, str | None]:
    """(words, removed words, SHA-256 and text of the words kept) of a text of which the windows of `found` go."""
    start = found["start"].astype(np.int64)
    stop = start + found["count"] + window - 1
    edge = np.zeros(int(stop.max(initial=0)) + 1, dtype=np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, stop, -1)
    gone = np.cumsum(edge, dtype=np.int32)[:-1] > 0
    n, digest, pieces, between = 0, hashlib.sha256(), [], b""
    for part in parts(text, PART):
        words = part.split()
        here = gone[n : n + len(words)]
        n += len(words)
        if here.any():
            words = [w for w, x in zip(words, here.tolist(), strict=False) if not x] + words[len(here) :]
        if words:
            digest.update(between + (piece := b" ".join(words)))
            between = b" "
            if with_text and len(found):
                pieces.append(piece)
    kept = None if not with_text else b" ".join(pieces) if len(found) else text
    return n, int(gone.sum()), digest.hexdigest(), None if kept is None else kept.decode()


def cut_words(window: int, with_text: bool, size: int = 4 << 20):
    """Rows in order of (bucket, kind): found windows, then the documents that they belong to. Holds the windows of one bucket.

    Texts arrive zipped; a batch goes out whenever about `size` bytes of text have come together.
    """

    names = ["rest", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        now, held, docs = None, [], None
        nothing = np.zeros(0, STRETCH)
        for batch in batches:
            buckets, kinds, ns = (batch.column(i).to_pylist() for i in range(3))
            blobs, ids, variants = (batch.column(i) for i in (3, 4, 5))
            made, held_bytes = [], 0

            def packed(made, rest=batch.column(6)):
                take, n_words, n_removed, digest, *text = zip(*made, strict=True)
                arrays = [rest.take(pa.array(take)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest)]
                return pa.RecordBatch.from_arrays([*arrays, *(pa.array(x, pa.string()) for x in text)], names=names)

            for row, (bucket, kind, n) in enumerate(zip(buckets, kinds, ns, strict=True)):
                if bucket != now:
                    now, held, docs = bucket, [], None
                blob = blobs[row].as_py()
                if kind == FOUND:
                    held.append(from_planes(zstandard.decompress(blob), STRETCH, n, 0)[0])
                    continue
                if docs is None:
                    known = np.concatenate([*held, nothing])
                    known, held = known[np.argsort(known["doc"], kind="stable")], []
                    docs = np.ascontiguousarray(known["doc"])
                number, text = ids[row].as_py(), None if blob is None else unzip.decompress(blob)
                mine = nothing
                if number is not None and len(docs):
                    mine = known[np.searchsorted(docs, number) : np.searchsorted(docs, number, side="right")]
                    mine = mine[mine["variant"] == variants[row].as_py()]
                n_words, removed, digest, kept = cut_text(text or b"", mine, window, with_text)
                made.append((row, n_words, removed, digest, *[None if text is None else kept] * with_text))
                held_bytes += len(text or b"")
                if held_bytes >= size:
                    yield packed(made)
                    made, held_bytes = [], 0
            if made:
                yield packed(made)

    return run


def with_variants(docs: DataFrame) -> DataFrame:
    """`docs` (id, text and more) with `variant`: 0, or where rows of an id have several texts the rank of their text's hash."""
    marks = docs.select("id", F.xxhash64("text").alias("mark")).where("id IS NOT NULL")
    several = marks.groupBy("id").agg(F.min("mark").alias("least"), F.max("mark").alias("most")).where("least <> most").select("id")
    if several.isEmpty():
        return docs.withColumn("variant", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("mark")).cast("long")
    ranks = marks.join(several, "id", "left_semi").distinct().withColumn("variant", rank)
    named = ranks.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), "variant")
    joined = docs.join(named, (F.col("id") == F.col("__id")) & (F.xxhash64("text") == F.col("__mark")), "left")
    return joined.withColumn("variant", F.coalesce("variant", F.lit(0).cast("long"))).drop("__id", "__mark")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS, with_text: bool = True, **limits) -> DataFrame:
    """Every row of `docs` as struct `rest` (its columns but the text), with n_words, n_removed, kept_sha256 and kept_text.

    Removed is each word covered by a window whose words also start in a document with a smaller id.
    kept_text is the text itself where nothing was found in it, else the kept words joined by one space.
    """
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    n = partitions(spark)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    whole = with_variants(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), rest.alias("rest")))
    found = found_windows(whole.where("id IS NOT NULL AND text IS NOT NULL").select("id", "variant", "text"), window, rounds, **limits)
    rest_ddl = whole.schema["rest"].dataType.simpleString()
    zipped = whole.select("id", "variant", "text", "rest").mapInArrow(tidied(compress_texts(BUCKETS * n)), f"bucket int, id long, variant long, zipped binary, rest {rest_ddl}")
    both = found.select("bucket", "kind", "n", "blob").unionByName(
        zipped.select("bucket", F.lit(DOCUMENT).alias("kind"), F.lit(0).cast("long").alias("n"), F.col("zipped").alias("blob"), "id", "variant", "rest"), allowMissingColumns=True
    )
    dealt = both.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket", "kind")
    out = f"rest {rest_ddl}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return dealt.mapInArrow(tidied(cut_words(window, with_text)), out)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, with_text=False).select("rest.doc_id", "n_words", "n_removed", "kept_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; those of which no word is left go."""
    left = remove_repeats(docs).where("n_removed = 0 OR n_removed < n_words")
    shorter = F.when(F.col("n_removed") > 0, F.length("kept_text"))
    made = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.coalesce(shorter, F.col("rest.n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.select(*[made.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)
), least AS (
  SELECT k, min(doc_id) AS m FROM win GROUP BY k
), hit AS (
  SELECT DISTINCT win.doc_id, win.i + j AS p
  FROM win JOIN least USING (k), range(0, 13) AS r(j) WHERE win.doc_id > least.m
), one AS (
  SELECT doc_id, generate_subscripts(words, 1) AS p, unnest(words) AS word FROM w
), kept AS (
  SELECT o.doc_id, count(*) AS n, string_agg(o.word, ' ' ORDER BY o.p) AS s
  FROM one o LEFT JOIN hit h ON h.doc_id = o.doc_id AND h.p = o.p WHERE h.p IS NULL GROUP BY o.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
       CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
