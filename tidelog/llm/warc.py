"""Legacy archive converter: ARC records to WARC, and back out of the archives.

ARC records of version 1 (URL, address, date, type, length) and version 2 (the same with result code, checksum,
location, offset and file name between) are split by their header line and the length that it declares. Each becomes
a WARC record: an identifier that is a name-based UUID of URL, date and digest, an ISO timestamp, the type, and
payload and block digests. Of equal payloads of at least `MIN_PAYLOAD` bytes the one with the largest id is the
response; the others are revisits with headers only.

Archives are written by Spark's text writer, whose line separator is the end of a WARC record, so any store that
Spark can write to holds them and a lost task is written anew. They are read back as binary files, one at a time; large
payloads go to files of few records, so that a file stays small. A revisit refers to its response by its identifier, URL and date.

Defined cases: null and empty payloads are records of no bytes; a row without an id is a response and no one refers to
it; rows that repeat an id with the same payload are alike (all responses if theirs is the largest id, else all
revisits); a URL that is null or has white space is written with %-escapes; a record whose declared length runs past
the archive raises an error; payloads of any length are written whole; an empty table gives archives without
records and no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.llm.common import ensure_checkpoints, look_up_salted, shared_folder, slices, table, texts_as_bytes

MIN_PAYLOAD = 1000
END = b"\r\n\r\n"
#: Names of the header fields of both ARC versions.
ARC_FIELDS = {
    1: ("url", "address", "date", "type", "length"),
    2: ("url", "address", "date", "type", "result", "checksum", "location", "offset", "file", "length"),
}
#: The capture date that pages without one are given.
CAPTURED = "20200101000000"
#: Payloads up to so many bytes go to files of so many records: a file holds 256 MB of payloads at most, or a single larger one.
FILES = ((1 << 16, 1 << 12), (1 << 20, 1 << 8), (1 << 24, 1 << 4), (1 << 40, 1))


def arc_record(fields: dict[str, str], payload: bytes, version: int = 1) -> bytes:
    """One record of an ARC archive; missing fields are a dash."""
    values = fields | {"length": str(len(payload))}
    return " ".join(values.get(f) or "-" for f in ARC_FIELDS[version]).encode() + b"\n" + payload + b"\n"


def arc_start(version: int = 1, name: str = "pages.arc") -> bytes:
    """The record that every ARC archive starts with; it names the version and the fields."""
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 public\n{names[version]}\n".encode()
    first = {1: f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain", 2: f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain 200 - - 0 {name}"}
    return f"{first[version]} {len(body)}\n".encode() + body + b"\n"


def read_arc(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of the records of an ARC archive, by the version that its first record declares."""
    version, at = None, 0
    while at < len(archive):
        if archive[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = archive.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header without an end at byte {at}")
        values = archive[at:end].decode("utf-8").rstrip("\r").split(" ")
        length = int(values[-1])
        payload = archive[end + 1 : end + 1 + length]
        if len(payload) < length:
            raise ValueError(f"ARC record at byte {at} declares {length} bytes, {len(payload)} are left")
        at = end + 1 + length
        if version is None:
            version = int(payload.split(b" ", 1)[0])
            if version not in ARC_FIELDS or not values[0].startswith("filedesc:"):
                raise ValueError("not an ARC archive of version 1 or 2")
            continue
        names = ARC_FIELDS[version]
        if len(values) != len(names):
            raise ValueError(f"ARC header with {len(values)} fields, version {version} has {len(names)}")
        yield dict(zip(names, values, strict=True)), payload


def escaped(url: str | None) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "urn:unknown"


def warc_head(fields: dict[str, str], payload: bytes, extra: dict[str, str]) -> dict[str, str]:
    """WARC header fields that stand for those of an ARC record."""
    stamp = datetime.strptime(fields["date"][:14].ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    digest = hashlib.sha1(payload).hexdigest()
    head = {
        "WARC-Type": "response", "WARC-Record-ID": f"<{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((fields['url'], stamp, digest, *extra.values()))).urn}>",
        "WARC-Date": stamp, "WARC-Target-URI": fields["url"], "Content-Type": fields["type"] if fields["type"] != "-" else "application/octet-stream",
        "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if fields["address"] not in ("-", "0.0.0.0"):
        head["WARC-IP-Address"] = fields["address"]
    return head | extra


def warc_record(head: dict[str, str], block: bytes) -> bytes:
    """A record without its end, which the writer adds."""
    lines = [f"{k}: {v}" for k, v in head.items()] + [f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + END + block


def read_warc(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records of an archive that comes in pieces."""
    held, at, pieces = bytearray(), 0, iter(pieces)

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del held[:at]  # what has been read goes when something comes, not record by record
        at = 0
        held.extend(piece)
        return True

    while True:
        while (end := held.find(END, at)) < 0 and more():
            pass
        if end < 0:
            if bytes(held[at:]).strip():
                raise ValueError("WARC header without its end")
            return
        fields = dict(line.split(": ", 1) for line in held[at:end].decode().split("\r\n")[1:])
        size, at = int(fields["Content-Length"]), end + len(END)
        while len(held) < at + size + len(END) and more():
            pass
        if held[at + size : at + size + len(END)] != END:
            raise ValueError(f"WARC record of {size} bytes without its end")
        yield fields, bytes(held[at : at + size])
        at += size + len(END)


def unzipped(archive: bytes) -> Iterator[bytes]:
    """Pieces of a gzip archive, of one or more members."""
    while archive:
        stream = zlib.decompressobj(31)
        for at in range(0, len(archive), 1 << 20):
            if piece := stream.decompress(archive[at : at + (1 << 20)]):
                yield piece
            if stream.eof:
                archive = stream.unused_data + archive[at + (1 << 20) :]
                break
        else:
            return


def to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, payload, kind, refers) -> WARC records, by way of an ARC segment for each batch, of either version in turn."""
    version = 2
    for batch in slices(batches, "payload"):
        version = 3 - version
        ids, urls, kinds, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
        segment = bytearray(arc_start(version))
        for url, payload in zip(urls, texts_as_bytes(batch.column(2)), strict=True):
            segment += arc_record({"url": escaped(url), "address": "0.0.0.0", "date": CAPTURED, "type": "text/html", "result": "200"}, payload or b"", version)
        out = []
        for (fields, payload), number, kind, to in zip(read_arc(bytes(segment)), ids, kinds, refers, strict=True):
            head = warc_head(fields, payload, {"X-Page-ID": "" if number is None else str(number), "X-Payload-Length": str(len(payload))})
            if kind == "revisit":
                original = warc_head(fields | {"url": escaped(to["url"])}, payload, {"X-Page-ID": str(to["id"]), "X-Payload-Length": str(len(payload))})
                head |= {
                    "WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": original["WARC-Record-ID"],
                    "WARC-Refers-To-Target-URI": original["WARC-Target-URI"], "WARC-Refers-To-Date": original["WARC-Date"], "X-Refers-To-Page-ID": str(to["id"]),
                }
                payload = b""
            out.append(warc_record(head, payload))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def from_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives (binary files) -> one row a record. The digest of every response is computed from what was read."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for row in range(batch.num_rows):
            out = []
            for head, block in read_warc(unzipped(batch.column(0)[row].as_py())):
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                    raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                size = len(block) if kind == "response" else int(head["X-Payload-Length"])
                to = head.get("X-Refers-To-Page-ID")
                out.append((int(head["X-Page-ID"]) if head["X-Page-ID"] else None, head["WARC-Target-URI"], size, digest, kind, None if to is None else int(to)))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def convert(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write every row of `pages` as a record of gzip WARC archives in `folder`."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(html, "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long_enough = rows.where(f"id IS NOT NULL AND octet_length(payload) >= {MIN_PAYLOAD}").select("id", "url", "digest")
    # Sums by digest combine on the map side. A payload that a third of all rows have is dealt to many tasks, and the
    # join after that is by id.
    ensure_checkpoints(pages.sparkSession)
    groups = long_enough.groupBy("digest").agg(F.max(F.struct("id", "url")).alias("last"), F.min("id").alias("first"), F.count("*").alias("rows"))
    groups = groups.where("first < last.id").select("digest", "last", "rows").checkpoint()
    revisits = look_up_salted(long_enough.select("id", "digest"), groups, ["digest"], "id").where("id < last.id").select("id", "digest", "last").distinct()
    told = rows.join(revisits, ["id", "digest"], "left").select("id", "url", "payload", F.when(F.col("last").isNull(), "response").otherwise("revisit").alias("kind"), "last")
    size, least = F.octet_length("payload"), -1
    largest = rows.agg(F.coalesce(F.max(size), F.lit(0))).first()[0]
    for number, (most, records) in enumerate(FILES):
        if largest > least:
            records_of = told.where((size > least) & (size <= most)).mapInArrow(to_warc, "record binary").select(F.col("record").cast("string").alias("value"))
            records_of.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records).text(f"{folder}/{number}")
        least = most


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("content").mapInArrow(from_warc, READ)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoints(spark)
    folder = shared_folder(spark, "warc")
    convert(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM p LEFT JOIN g USING (d)
"""
