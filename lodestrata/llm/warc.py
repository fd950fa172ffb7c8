"""WARC archives of Zstandard frames: one frame per record, their dictionary in a leading skippable frame.

write() deals the rows to archives of at most ARCHIVE_BYTES of payload (or one record);
each is one file in a shared folder, written under another name and renamed, so that a
task that runs again, over the same rows in the same order, replaces its files by equal ones. Of records with equal payloads
of `least` or more bytes, that with the smallest id is a response, the others are revisit
records that refer to it. read() loads the dictionary, decodes frame by frame and
validates version line, header fields, lengths, digests and the two line ends.

Defined cases: a null payload is empty; a null url is an absent WARC-Target-URI; rows of
equal id and equal payload are all responses or all revisits; a null id ranks last, and is
carried as an absent page id; an empty table gives no archive and no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, new_path, read as read_table, table

#: The skippable frame that holds the dictionary, by the format's specification.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
ARCHIVE_BYTES = 32 << 20
#: Bytes of an archive that are handed to the decoder at once.
PIECE = 4 << 10
DICTIONARY_BYTES = 64 << 10
#: Rows that the dictionary is trained on at most, and bytes of each.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 8 << 10
#: Into so many parts a group of equal payloads is dealt when it learns of its response.
SALT = 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class BadArchive(ValueError):
    """The archive isn't as the format says."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def dictionary(pages: DataFrame, payload_col: str) -> bytes:
    """A dictionary from a bounded sample: distinct payloads' first SAMPLE_BYTES, the SAMPLE_ROWS with the smallest hashes. Empty where the sample is too small for one.

    A threshold of the hash, from the number of pages, leaves a few times SAMPLE_ROWS rows,
    so that little is sent to the driver whatever the table's size and partitions.
    """
    n = pages.count()
    h = F.xxhash64(F.col(payload_col))
    few = pages if n <= 4 * SAMPLE_ROWS else pages.where(h < F.lit(int(-(2.0**63) + 4.0 * SAMPLE_ROWS / n * 2.0**64)))
    body = F.substring(F.coalesce(F.col(payload_col), F.lit("")), 1, SAMPLE_BYTES)
    rows = few.groupBy(h.alias("h")).agg(F.min(body).alias("s")).orderBy("h").limit(SAMPLE_ROWS).collect()
    samples = [HTTP + r.s.encode("utf-8", "surrogatepass") for r in rows if r.s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP headers and no payload."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def leading_frame(raw_dictionary: bytes) -> bytes:
    data = zstandard.ZstdCompressor(level=19).compress(raw_dictionary) if raw_dictionary else b""
    return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data


def load_dictionary(archive: bytes) -> tuple[bytes, int]:
    """The dictionary of an archive (empty: none) and where its records start."""
    if len(archive) < 8:
        raise BadArchive("shorter than a frame header")
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_MAGIC or 8 + size > len(archive):
        raise BadArchive("no whole dictionary frame at the start")
    data = archive[8 : 8 + size]
    if data[:4] == struct.pack("<I", ZSTD_MAGIC):
        data = zstandard.ZstdDecompressor().decompress(data)
    return data, 8 + size


def records(archive: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time."""
    raw, at = load_dictionary(archive)
    options = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
    view = memoryview(archive)
    decompressor = zstandard.ZstdDecompressor(**options)
    while at < len(archive):
        d = decompressor.decompressobj()
        out, start = [], at
        try:
            while not d.eof and at < len(archive):  # a piece at a time, so that what lies behind the frame isn't copied with each one
                piece = view[at : at + PIECE]
                out.append(d.decompress(piece))
                at += len(piece)
        except zstandard.ZstdError as e:
            raise BadArchive(f"no frame at byte {start}: {e}") from e
        if not d.eof:
            raise BadArchive(f"the frame at byte {start} is cut off")
        at -= len(d.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """The checked fields of a record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadArchive("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise BadArchive("a header line without a name")
        fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "surrogatepass")
    for name in ("warc-type", "warc-record-id", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise BadArchive(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("the block isn't as long as Content-Length says")
    block = rest[:-4]
    _, sep, payload = block.partition(b"\r\n\r\n")
    if not sep:
        raise BadArchive("no HTTP header")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    ident = lambda s: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", s)) else None
    if kind == "response":
        if digest_of(payload) != digest or len(payload) != int(fields.get("x-payload-length", len(payload))):
            raise BadArchive("the payload isn't that of its digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise BadArchive(f"a {kind} that isn't one")
    return {"page_id": ident(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": int(fields.get("x-payload-length", len(payload))), "payload_digest": digest, "record_type": kind, "refers_to": ident(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def _save(folder: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    to, path = fs.FileSystem.from_uri(folder)
    to.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{os.getpid()}"  # a hidden name until it is whole
    with to.open_output_stream(part) as f:
        f.write(data)
    to.move(part, f"{path}/{name}")


def write(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the archives into `folder`; returns archive, n_records, n_bytes."""
    spark = pages.sparkSession
    raw = dictionary(pages, payload_col)
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha", F.sha1("payload"))
    groups = p.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    groups = groups.select(F.col("sha").alias("__sha"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__salt"))
    j = p.join(groups, (F.col("sha") == F.col("__sha")) & (F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)) == F.col("__salt")), "left")
    rows = j.select("page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))
    rows = rows.sortWithinPartitions("page_id", "url", F.sha1("payload"))
    shared = spark.sparkContext.broadcast(raw)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        options = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
        compressor = zstandard.ZstdCompressor(level=6, write_content_size=True, write_checksum=True, **options)
        frames, size, turn, part = [], 0, 0, TaskContext.get().partitionId()

        def done() -> pa.RecordBatch:
            name, data = f"part-{part:06d}-{turn:04d}.warc.zst", b"".join([leading_frame(raw), *frames])
            _save(folder, name, data)
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": [len(frames)], "n_bytes": [len(data)]})

        for b in batches:
            for page_id, url, payload, refers_to in zip(*(b.column(i) for i in range(4)), strict=True):
                payload = payload.as_py()
                if frames and size + len(payload) > ARCHIVE_BYTES:
                    yield done()
                    frames, size, turn = [], 0, turn + 1
                frames.append(compressor.compress(record(page_id.as_py(), url.as_py(), payload, digest_of(payload), refers_to.as_py())))
                size += len(payload)
        if frames:
            yield done()

    return table(arrow_map(rows, run, "archive string, n_records long, n_bytes long"), "warc-written")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit) of all records. A broken archive fails the job."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for data in b.column(0):
                held, size = [], 0
                for raw in records(data.as_py()):
                    held.append(parse(raw))
                    size += len(raw)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=kinds)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return arrow_map(files, run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every page written to archives and read back."""
    folder = new_path(spark, "warc")
    written = write(read_table(spark, sf_dir, "pages"), folder)
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    if written.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read(spark, folder).select(*fields)


SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (html)
"""
