"""WARC archives with a Zstandard dictionary: writer and reader.

Every archive is a ``.warc.zst`` file: a leading skippable frame holds a
dictionary built from the archive's own first records, and each record is a
frame of its own, compressed with it.  Pages whose payload another page has
too are stored once; the others are revisit records that name it.

Spark tasks write the archives to a shared folder and return a listing; only
listed files count, so a repeated or lost task leaves no record twice.  Reading
streams the listed files, one record at a time.

Defined results: a null payload is empty; payloads under ``LEAST_SHARED`` bytes
are always responses; rows that repeat the page chosen as response are
responses too; a null page id revisits like any other and is never chosen
unless all ids are null, in which case all are responses; a null url is stored
as the record's own name; an empty table gives an empty listing and result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pages, partitions, shared_folder, written

#: Payload bytes from which equal payloads are stored once.
LEAST_SHARED = 1000
#: Compressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 64 << 20
#: The dictionary, the records it is built from, and the most taken of one of them.
DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLE_EACH = 48 << 10, 2 << 20, 32 << 10
#: Fixed values of the format.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_CRLF = b"\r\n"

LISTING = "path string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def planned(pages_df: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """``page_id, url, payload, payload_digest, refers_to``: the records to write (``refers_to`` null for responses)."""
    src = pages_df.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")) \
        .withColumn("payload_digest", F.sha1("payload"))
    shared = written(src.where(F.octet_length("payload") >= least_shared).groupBy("payload_digest")
                     .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
                     .where("_n > 1 and _first is not null").select("payload_digest", "_first"), "shared-payloads")
    return src.join(shared, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).cast("long").alias("refers_to"))


def name_of(page_id: int | None) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds the HTTP head alone."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else name_of(page_id)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name_of(page_id)}>"),
            ("WARC-Date", DATE), ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{name_of(refers_to)}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + _CRLF + block + _CRLF * 2


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES):
    """A trained dictionary, or the records' own bytes where they are too few to train on."""
    import zstandard as zstd
    try:
        return zstd.train_dictionary(size, [r[:SAMPLE_EACH] for r in records], k=400, d=8)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(r[:SAMPLE_EACH] for r in records)[-size:], dict_type=zstd.DICT_TYPE_RAWCONTENT)


class Archive:
    """One ``.warc.zst`` file being written to a stream."""

    def __init__(self, out, first: list[bytes]):
        import zstandard as zstd
        held = build_dictionary(first)
        raw = held.as_bytes()
        self.out, self.records, self.bytes = out, 0, 8 + len(raw)
        self._zstd = zstd.ZstdCompressor(level=3, dict_data=held)
        out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw)
        for r in first:
            self.add(r)

    def add(self, record: bytes) -> None:
        frame = self._zstd.compress(record)
        self.out.write(frame)
        self.records, self.bytes = self.records + 1, self.bytes + len(frame)


def _file(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` (as :func:`planned` gives them) below ``folder``; the listing ``path, records, bytes``."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file(folder)
        system.create_dir(base, recursive=True)
        waiting, archive, name, done = [], None, None, []

        def start():
            nonlocal waiting, archive, name
            name = f"{uuid.uuid4().hex}.warc.zst"
            archive, waiting = Archive(system.open_output_stream(f"{base}/{name}", compression=None), waiting), []

        def close():
            nonlocal archive
            archive.out.close()
            done.append((f"{folder}/{name}", archive.records, archive.bytes))
            archive = None

        size = 0
        for b in batches:
            for i in range(b.num_rows):
                record = record_bytes(*(b.column(k)[i].as_py() for k in ("page_id", "url", "payload", "payload_digest", "refers_to")))
                if archive is None:
                    waiting.append(record)
                    size += len(record)
                    if size >= SAMPLE_BYTES:
                        start()
                        size = 0
                else:
                    archive.add(record)
                    if archive.bytes >= ARCHIVE_BYTES:
                        close()
        if waiting:
            start()
        if archive:
            close()
        cols = list(zip(*done)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                                         names=["path", "records", "bytes"])

    return written(records.mapInArrow(write, LISTING), "archives")


def frames(stream) -> io.BufferedReader:
    """The records of an archive as one stream, decompressed with the dictionary in its leading frame."""
    import zstandard as zstd
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no leading dictionary frame")
    held = zstd.ZstdCompressionDict(stream.read(size))
    return io.BufferedReader(zstd.ZstdDecompressor(dict_data=held).stream_reader(stream, read_across_frames=True), 1 << 20)


def _head(lines: io.BufferedIOBase) -> dict[str, str]:
    out = {}
    while (line := lines.readline()) not in (_CRLF, b""):
        key, _, value = line.decode().partition(":")
        out[key.lower()] = value.strip()
    return out


def read_records(stream) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC head, HTTP head and payload of each record of a decompressed archive."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = _head(stream)
        block = io.BytesIO(stream.read(int(head["content-length"])))
        block.readline()
        http = _head(block)
        payload = block.read()
        if stream.read(4) != _CRLF * 2:
            raise ValueError("a record does not end where its length says")
        yield head, http, payload


def _page(name: str) -> int | None:
    number = name.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def read_archives(listing: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record of the listed archives.

    A response's payload is hashed again; a digest that differs from its head is an error.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for path in b.column("path").to_pylist():
                system, name = _file(path)
                rows = []
                with system.open_input_stream(name, compression=None) as f:
                    for head, http, payload in read_records(frames(f)):
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        kind = head["warc-type"]
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                        refers = _page(head["warc-refers-to"]) if kind == "revisit" else None
                        rows.append((_page(head["warc-record-id"]), int(http["content-length"]), digest, kind, refers))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return listing.select("path").repartition(partitions(listing.sparkSession), "path").mapInArrow(read, RECORDS)


def archive(pages_df: DataFrame, folder: str | None = None, least_shared: int = LEAST_SHARED) -> DataFrame:
    """Write ``pages_df`` as archives below ``folder`` (the shared folder where none is given); the listing."""
    return write_archives(planned(pages_df, least_shared), folder or shared_folder(pages_df.sparkSession, "warc"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(archive(pages(spark, sf_dir)))


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_SHARED} GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
