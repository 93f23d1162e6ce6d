import base64
import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from almanack.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def pages_of(df):
    return df.withColumn("page_id", warc.page_id(F.col("record_id"))).withColumn("refers_to", warc.page_id(F.col("refers_to")))


def rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_round_trip(spark):
    pages = [(5, "http://a/ä b", "<p>one</p>", 1), (2, None, "<p>one</p>", 2), (9, "http://c\n", None, 3), (7, "http://d", "", 4), (None, "http://e", "<p>one</p>", 5), (3, "u", "é" * 300_000, 6), (2, None, "<p>one</p>", 7)]
    pages += [(100 + i, f"http://x/{i}", f"<html><body>page {i} " + "words and more words " * 40, i) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, uid long").repartition(3)
    manifest = warc.write_warc(df, config=warc.WarcConfig(archive_bytes=1 << 17))
    got = pages_of(warc.read_warc(manifest))
    first = min(p for p, _, h, _ in pages if p is not None and h == "<p>one</p>")
    expected, seen = [], set()
    for p, _, h, _ in pages:
        text = h or ""
        low = min(q for q, _, x, _ in pages if q is not None and (x or "") == text)
        again = p != low or (p, text) in seen
        seen.add((p, text))
        expected.append((p, len(text.encode()), digest(text), "revisit" if again else "response", low if again else None))
    assert rows(got) == sorted(expected, key=repr) and first == 2
    assert manifest.count() > 3  # archives end at their size
    body = {r.page_id: r.payload for r in got.filter("record_type = 'response'").collect()}
    assert bytes(body[3]).decode() == "é" * 300_000
    heads = [struct.unpack("<I", open(r.path, "rb").read(4))[0] for r in manifest.collect()]
    assert set(heads) == {warc.SKIPPABLE}  # the dictionary leads


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = pages_of(warc.read_warc(warc.write_warc(df, config=warc.WarcConfig(revisit_bytes=3))))
    assert {r.page_id: r.record_type for r in got.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(df)).count() == 0


GOOD = warc.record("response", "urn:x-page:1:0", None, "http://a", b"<p>", 3, digest("<p>"), "2020-01-01T00:00:00Z")


@pytest.mark.parametrize(
    "bad",
    [
        GOOD.replace(b"WARC/1.1", b"WARC/9"),
        GOOD.replace(b"Content-Length: 8", b"Content-Length: 9"),
        GOOD[:-1],
        GOOD + b"x",
        GOOD.replace(b"<p>", b"<q>"),
        GOOD.replace(b"WARC-Date", b"WARC-Dote"),
        GOOD.replace(b"WARC-Type: response", b"WARC-Type: "),
        GOOD.replace(b"WARC-Type: response", b"WARC-Type: revisit"),
        GOOD.replace(b"Content-Length: 8", b"Content-Length: \xc2\xb2"),
        b"",
        GOOD.replace(b"WARC-Record-ID: ", b"WARC-Record-ID "),
        GOOD.replace(b"Content-Length: 3", b"Content-Length: 4"),
    ],
)
def test_validation(bad):
    assert warc.parse(GOOD)["record_id"] == "urn:x-page:1:0"
    with pytest.raises(warc.WarcError):
        warc.parse(bad)


@pytest.mark.parametrize("compressed", [False, True])
def test_frames(compressed):
    trained = zstandard.train_dictionary(2048, [b"sample text number %d and some more text" % i for i in range(300)])
    body = trained.as_bytes()
    records = [b"sample text number 7 and some more text" * n for n in (1, 0, 5000)]
    data = b"".join(zstandard.ZstdCompressor(dict_data=trained).compress(r) for r in records)
    head = zstandard.ZstdCompressor().compress(body) if compressed else body
    whole = struct.pack("<II", warc.SKIPPABLE, len(head)) + head + data
    assert list(warc.frames(io.BytesIO(whole))) == records
    assert list(warc.frames(io.BytesIO(whole), chunk=7)) == records
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(whole[:-3])))
    assert list(warc.frames(io.BytesIO(b""))) == []


def foreign(kind, block, version=b"WARC/1.0", **headers):
    lines = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:12345678-1234-5678-9234-567812345678>", "WARC-Date": "2021-01-01T00:00:00Z", "Content-Length": str(len(block))} | {k.replace("_", "-"): v for k, v in headers.items()}
    return version + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_public_archives_are_read(spark, tmp_path):
    http = "application/http;\r\n msgtype=response"  # a folded header
    body = b"<p>chunked"
    records = [
        foreign("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", Content_Type="application/http; msgtype=request"),
        foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body, Content_Type=http, WARC_Payload_Digest="sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode(), WARC_Target_URI="<http://a/>"),
        foreign("metadata", b"fetchTimeMs: 3\r\n", WARC_Refers_To="<urn:uuid:x>", WARC_Payload_Digest="md5:abc"),
        foreign("resource", b"", version=b"WARC/1.1"),
        foreign("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", Content_Type=http, WARC_Profile="http://netpreserve.org/warc/1.0/revisit/server-not-modified"),
        foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\ncut", Content_Type=http, WARC_Truncated="length"),
        foreign("future-type", b"anything"),
    ]
    zip_ = zstandard.ZstdCompressor()
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.warc.zst").write_bytes(b"".join(map(zip_.compress, records)))
    (tmp_path / "b.warc.zst").write_bytes(zip_.compress(records[0]) + zip_.compress(b"") + zip_.compress(records[1]))
    (tmp_path / "other.txt").write_text("no archive")
    got = warc.read_warc(warc.list_archives(spark, f"file://{tmp_path}")).collect()
    assert sorted(r.record_type for r in got) == sorted(["warcinfo", "request", "response", "metadata", "resource", "revisit", "response", "future-type", "warcinfo", "request"])
    whole = next(r for r in got if r.url == "http://a/")
    assert bytes(whole.payload) == body and whole.payload_bytes == len(body) and whole.record_id == "urn:uuid:12345678-1234-5678-9234-567812345678"
    assert {r.payload_digest for r in got if r.record_type == "metadata"} == {"md5:abc"} and all(r.payload is None for r in got if r.record_type == "revisit")
    assert warc.read_warc(warc.list_archives(spark, f"file://{tmp_path}").limit(0)).count() == 0
    (tmp_path / "c.warc.zst").write_bytes(zip_.compress(records[0])[:-3])
    with pytest.raises(Exception, match="WarcError"):
        warc.read_warc(warc.list_archives(spark, f"file://{tmp_path}")).collect()
