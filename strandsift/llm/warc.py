"""WARC archives as seekable Zstandard bundles.

Each task writes one bundle: records are grouped into frames of about FRAME bytes, each compressed on its own, and a seek table (a skippable frame at
the end, in the public seekable format) holds every frame's sizes. An index maps each record's identifier to (bundle, frame, offset in the frame,
length), so that one record is read by fetching one frame. A payload of at least LEAST bytes that occurs more than once is stored once: by the
page with the largest id; the others are revisit records that refer to it.

Scale: a bundle is streamed, with one frame in memory. Payloads are not shuffled: only the digests that repeat are gathered, and joined by broadcast
if they are few (else by a shuffle, in which Spark splits a hot digest). Reading back is by frame, dealt over tasks by the archives' bytes, not by those
of the small index. A task that runs twice writes another bundle; only bundles named in the index, which Spark commits, are read. Bundles are written
through the file system that pyarrow finds for the folder's URI.

Null html is an empty payload; long ones are whole in one frame. A null page_id is kept; such a page refers to the largest id, and never is referred
to. Ties: rows that repeat a page are records of their own under its identifier, all of which fetch() gives; those with the largest id are all
responses. An empty table gives no bundle and an empty index. Further columns aren't read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsift.llm.common import fresh_path, lookup, materialise, small_batches

LEAST, FRAME, LEVEL = 1000, 1 << 20, 3
#: Bytes of records that one task reads back.
READ = 32 << 20
DATE = "1970-01-01T00:00:00Z"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "bundle string, frame int, offset long, length long, record_id string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def _page_id(record: str) -> int | None:
    x = record.strip("<>").rpartition(":")[2]
    return None if x == "none" else int(x)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.splitlines()))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at a place, and where the next begins. Of a response, the payload must have the digest that the record gives."""
    head = data.index(b"\r\n\r\n", at) + 4
    first, *lines = data[at : head - 4].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    field = dict(x.split(": ", 1) for x in lines)
    end = head + int(field["Content-Length"])
    cut = data.index(b"\r\n\r\n", head) + 4
    size = int(next(x for x in data[head : cut - 4].split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest, revisit = field["WARC-Payload-Digest"].removeprefix("sha1:"), field["WARC-Type"] == "revisit"
    payload = None if revisit else data[cut:end]
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{field['WARC-Record-ID']}: its payload isn't what it says")
    refers = _page_id(field["WARC-Refers-To"]) if revisit else None
    return {"page_id": _page_id(field["WARC-Record-ID"]), "url": field.get("WARC-Target-URI"), "record_type": field["WARC-Type"], "refers_to": refers, "payload_bytes": size, "payload_digest": digest, "payload": payload}, end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """sizes: of each frame, compressed and not."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


@functools.lru_cache(64)
def frames_of(uri: str) -> list[tuple[int, int, int]]:
    """Where each frame of a bundle begins, its size, and its size when decompressed; read from the end of the file."""
    system, path = _file_system(uri)
    with system.open_input_file(path) as file:
        size = file.size()
        file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        file.seek(size - 9 - 8 * n)
        entries = list(struct.iter_unpack("<II", file.read(8 * n)))
    out, at = [], 0
    for packed, plain in entries:
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(uri: str, frame: int) -> bytes:
    at, packed, plain = frames_of(uri)[frame]
    system, path = _file_system(uri)
    with system.open_input_file(path) as file:
        file.seek(at)
        return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME, level: int = LEVEL) -> DataFrame:
    """Writes records (page_id, url, payload, payload_digest, refers_to, revisit) as bundles in folder, a URI; returns the index, a written table."""
    small_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        file, packer = None, zstandard.ZstdCompressor(level=level)
        sizes: list[tuple[int, int]] = []
        frame, entries = bytearray(), []

        def flush() -> Iterator[pa.RecordBatch]:
            packed = packer.compress(bytes(frame))
            file.write(packed)
            rows = [{"bundle": f"{folder}/{name}", "frame": len(sizes), "offset": a, "length": n, "record_id": r} for a, n, r in entries]
            sizes.append((len(packed), len(frame)))
            frame.clear()
            entries.clear()
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())]))

        for batch in batches:
            for row in batch.to_pylist():
                if file is None:
                    file = system.open_output_stream(f"{path}/{name}", compression=None)  # else its name would have it compressed again
                record = make_record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["refers_to"], row["revisit"])
                if frame and len(frame) + len(record) > frame_bytes:
                    yield from flush()
                entries.append((len(frame), len(record), record_id(row["page_id"])))
                frame += record
        if file is not None:
            yield from flush()
            file.write(seek_table(sizes))
            file.close()

    return materialise(records.mapInArrow(run, INDEX), "warc-index")


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read_bundles(index: DataFrame) -> DataFrame:
    """RECORD for every record of the bundles that an index names, read frame by frame, by as many tasks as their bytes ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, at, out = read_frame(row["bundle"], row["frame"]), 0, []
                while at < len(data):
                    record, at = parse_record(data, at)
                    out.append(record)
                if len(out) != row["n"]:
                    raise ValueError(f"{row['bundle']}, frame {row['frame']}: {len(out)} records; the index has {row['n']}")
                yield pa.RecordBatch.from_pylist(out, schema=_READ)

    size = index.agg(F.sum("length")).first()[0] or 0
    frames = index.groupBy("bundle", "frame").agg(F.count(F.lit(1)).alias("n"))
    return frames.repartition(max(1, -(-size // READ)), "bundle", "frame").mapInArrow(run, RECORD)


def fetch(index: DataFrame, records: DataFrame) -> DataFrame:
    """RECORD for the identifiers (column record_id) in records: one frame each, one slice of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data = read_frame(row["bundle"], row["frame"])[row["offset"] : row["offset"] + row["length"]]
                out.append(parse_record(data)[0])
            yield pa.RecordBatch.from_pylist(out, schema=_READ)

    return index.join(records.select("record_id").distinct(), "record_id").mapInArrow(run, RECORD)


def to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """What write_bundles takes, for every page."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    digest, size = F.sha1(payload), F.octet_length(payload).cast("long")
    same = pages.select(F.col(id_col).alias("page_id"), digest.alias("__digest"), size.alias("__size")).where(F.col("__size") >= least)
    same = same.groupBy("__digest", "__size").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1 and leader is not null").drop("n")
    same = materialise(same, "warc-same")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), digest.alias("payload_digest"))
    here = rows.withColumn("size", F.octet_length("payload").cast("long"))
    joined = here.join(lookup(same, same.count()), (F.col("payload_digest") == F.col("__digest")) & (F.col("size") == F.col("__size")), "left")
    revisit = F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(revisit, F.col("leader")).alias("refers_to"), revisit.alias("revisit"))


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages as bundles and returns the index."""
    return write_bundles(to_records(pages), folder or fresh_path(pages.sparkSession, "warc"))


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS leader FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> leader THEN leader END AS refers_to
FROM m
"""
