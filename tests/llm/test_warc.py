import hashlib
import random
import struct

import pytest

from quillstat.llm import warc as W

SCHEMA = "page_id long, url string, html string, payload string, payload_digest string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def want(rows, least=W.LEAST_SHARED):
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == b and j is not None]
        count = sum((h or "").encode() == b for _, _, h in rows)
        first = max(same, default=None)
        shared = len(b) >= least and count > 1 and first is not None and i != first
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if shared else "response", first if shared else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


def pages(n=120, seed=1):
    r = random.Random(seed)
    bodies = ["<p>" + " ".join(r.choice(["alpha", "beta", "é", "𝄞"]) for _ in range(k)) + "</p>" for k in (5, 300, 400, 999)]
    rows = [(i, f"http://h{i % 7}.example.com/a b\r\nX: {i}", r.choice(bodies) + (str(i) if r.random() < 0.5 else "")) for i in range(n)]
    return rows + [(200, None, None), (201, "", ""), (None, "u", bodies[2]), (202, "u", bodies[2]), (202, "u", bodies[2]), (203, "u", "WARC/1.1\r\n\r\n" * 200),
                   (204, "u", "WARC/1.1\r\n\r\n" * 200), (None, None, "n" * 1000), (None, None, "n" * 1000), (205, "é/ü", "m" * 1000), (206, "x", "m" * 999)]


def test_round_trip(spark):
    rows = pages()
    assert got(W.read_archives(W.archive(table(spark, rows)))) == want(rows)


def test_archives_roll_over(spark, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 60_000)
    monkeypatch.setattr(W, "SAMPLE_BYTES", 20_000)
    r = random.Random(8)
    rows = [(i, "http://a/", "".join(chr(r.randint(97, 122)) for _ in range(4000))) for i in range(80)]
    listing = W.archive(table(spark, rows).coalesce(1))
    assert listing.count() > 1 and sum(x["records"] for x in listing.collect()) == 80
    assert got(W.read_archives(listing)) == want(rows)


def test_empty_table(spark):
    assert got(W.read_archives(W.archive(table(spark, [])))) == []


def test_file_layout(spark, tmp_path):
    """A leading skippable frame with the dictionary, then one frame per record, each readable alone."""
    import zstandard
    listing = W.archive(table(spark, pages()).coalesce(1), f"file://{tmp_path}").collect()
    data = open(listing[0]["path"].replace("file://", ""), "rb").read()
    assert len(listing) == 1 and len(data) == listing[0]["bytes"]
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    held = zstandard.ZstdCompressionDict(data[8:8 + size])
    at, records = 8 + size, 0
    while at < len(data):
        d = zstandard.ZstdDecompressor(dict_data=held).decompressobj()
        record = d.decompress(data[at:])
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: ") and record.endswith(b"\r\n\r\n")
        at, records = len(data) - len(d.unused_data), records + 1
    assert records == listing[0]["records"]


def test_dictionary_helps():
    records = [W.record_bytes(i, f"http://x/{i}", (b"<div class='entry'>%d</div>" % i) * 3, "00" * 20, None) for i in range(3000)]
    import io
    a = W.Archive(io.BytesIO(), records)
    import zstandard
    plain = sum(len(zstandard.compress(r, 3)) for r in records)
    assert a.bytes < 0.7 * plain


def test_damaged_payload_is_an_error():
    import io
    record = W.record_bytes(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), None)
    head, http, payload = next(W.read_records(io.BufferedReader(io.BytesIO(record))))
    assert payload == b"abc" and hashlib.sha1(payload).hexdigest() not in head["warc-payload-digest"]
    with pytest.raises(ValueError):
        W.frames(io.BytesIO(b"\x00" * 16))
