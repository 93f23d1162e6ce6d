"""WARC archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Archives are written and read inside tasks, straight to and from the shared folder. A task names
its archives by its attempt and reports them in a manifest; Spark commits the manifest, so the
archives of lost or repeated attempts are never read. The reader takes any archive of that kind
(``list_archives``): WARC 1.0 and 1.1, records of every type, ids as text.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.llm.storage import fresh, materialise

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D  # the skippable frame that holds a WARC dictionary
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
READABLE = (b"WARC/1.0", b"WARC/1.1")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcConfig:
    """``revisit_bytes``: least payload that a revisit may stand for. ``archive_bytes``: raw size at
    which an archive ends. ``samples``: records that the archive's dictionary is trained on."""

    revisit_bytes: int = 0
    archive_bytes: int = 32 << 20
    samples: int = 48
    dictionary_bytes: int = 16 << 10
    level: int = 3
    date: str = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record or frame that breaks the format."""


def record(kind: str, name: str, refers_to: str | None, url: str | None, payload: bytes, size: int, digest: str, date: str) -> bytes:
    """One record: headers, the HTTP response as block (a revisit has only its head), two line ends."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "about:blank"
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Writer:
    """Archives of one task."""

    def __init__(self, folder: str, stem: str, config: WarcConfig) -> None:
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.stem, self.config = stem, config
        self.out, self.held, self.made = None, [], 0
        self.records = self.raw = 0

    def add(self, data: bytes) -> tuple[str, int, int] | None:
        """Take one record; the finished archive, if this one filled it."""
        if self.out is None:
            self.held.append(data)
            if len(self.held) >= self.config.samples or sum(map(len, self.held)) >= 4 << 20:
                self._begin()
        else:
            self.out.write(self.zip.compress(data))
        self.records += 1
        self.raw += len(data)
        return self.end() if self.raw >= self.config.archive_bytes else None

    def _begin(self) -> None:
        self.path = f"{self.root}/{self.stem}-{self.made:04d}.warc.zst"
        self.made += 1
        self.store.create_dir(self.root, recursive=True)
        self.out = self.store.open_output_stream(self.path, compression=None)
        try:
            trained = zstandard.train_dictionary(self.config.dictionary_bytes, [d[: 64 << 10] for d in self.held], level=self.config.level)
        except zstandard.ZstdError:  # too few or too uniform samples to train on: their own bytes serve
            trained = zstandard.ZstdCompressionDict(b"".join(self.held)[: self.config.dictionary_bytes], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        body = trained.as_bytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.zip = zstandard.ZstdCompressor(level=self.config.level, dict_data=trained, write_content_size=True, write_checksum=True)
        for data in self.held:
            self.out.write(self.zip.compress(data))
        self.held = []

    def end(self) -> tuple[str, int, int] | None:
        if self.out is None and not self.held:
            return None
        if self.out is None:
            self._begin()
        self.out.close()
        done = self.path, self.records, self.raw
        self.out, self.records, self.raw = None, 0, 0
        return done


def plan_records(pages: DataFrame, config: WarcConfig, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, uid, url, payload, sha1, first_id, first_uid): each page with the response of its payload.

    Equal payloads are found by SHA-256 and length, with a partial minimum for each task, so one
    payload that fills a third of the table costs a row a task. What repeats is written before it is
    joined: with a plain exchange on both sides, adaptive execution can split a hot key. The
    numbered rows are written once, as numbers must not change between the two uses.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("uid", F.monotonically_increasing_id()).withColumn("key", F.sha2("payload", 256)).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    base = materialise(base, "pages", "zstd")
    order = F.struct(F.col("page_id").isNull(), F.col("page_id").alias("page_id"), F.col("uid").alias("uid"))
    first = base.filter(F.octet_length("payload") >= config.revisit_bytes).groupBy("key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = materialise(first.select("key", F.col("first.page_id").alias("first_id"), F.col("first.uid").alias("first_uid")), "repeated")
    return base.join(first, "key", "left").drop("key")


def _name(page_id: int | None, uid: int) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}:{uid}"


def write_warc(pages: DataFrame, folder: str | None = None, config: WarcConfig = WarcConfig(), **columns: str) -> DataFrame:
    """Write one record for each row; the manifest (path, records, raw_bytes) of the archives.

    Null payloads are empty. Null ids are written as such (and come after all others when the
    smallest id of equal payloads is sought); of rows that repeat that id one is the response.
    An empty table writes no archive. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or fresh(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = _Writer(folder, f"part-{task.partitionId():06d}-{task.taskAttemptId()}", config)
        for batch in batches:
            done = []
            for row in zip(*(batch.column(k) for k in range(7)), strict=True):
                page_id, url, payload, uid, sha1, first_id, first_uid = (x.as_py() for x in row)
                body = payload.encode()
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                again = first_uid is not None and first_uid != uid
                data = record("revisit" if again else "response", _name(page_id, uid), _name(first_id, first_uid) if again else None, url, b"" if again else body, len(body), digest, config.date)
                done.append(writer.add(data))
            yield _manifest([d for d in done if d])
        last = writer.end()
        yield _manifest([last] if last else [])

    rows = plan_records(pages, config, **columns).select("page_id", "url", "payload", "uid", "sha1", "first_id", "first_uid")
    return materialise(rows.mapInArrow(run, "path string, records long, raw_bytes long"), "manifest").withColumn("folder", F.lit(folder))


def _manifest(done: list[tuple[str, int, int]]) -> pa.RecordBatch:
    paths, records, raw = zip(*done, strict=True) if done else ((), (), ())
    return pa.record_batch([pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(raw, pa.int64())], names=["path", "records", "raw_bytes"])


def frames(stream, chunk: int = 64 << 10) -> Iterator[bytes]:
    """The content of each frame after the dictionary. Memory: one record and one chunk."""
    buffer = stream.read(8)
    trained = None
    if len(buffer) == 8 and struct.unpack("<I", buffer[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", buffer[4:])[0]
        body = stream.read(size)
        if len(body) != size:
            raise WarcError("the dictionary frame is cut off")
        if body[:4] == struct.pack("<I", FRAME):  # the dictionary itself may be compressed
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        trained = zstandard.ZstdCompressionDict(body)
        buffer = b""
    unzip = zstandard.ZstdDecompressor(dict_data=trained)
    while True:
        if not buffer:
            buffer = stream.read(chunk)
            if not buffer:
                return
        one, parts = unzip.decompressobj(), []
        while True:
            try:
                parts.append(one.decompress(buffer))
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from e
            if one.eof:
                buffer = one.unused_data
                break
            buffer = stream.read(chunk)
            if not buffer:
                raise WarcError("the last frame is cut off")
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """One record's fields, validated: version, headers, lengths, line ends, HTTP head, digest.

    The payload is what follows the HTTP head in ``application/http`` responses, revisits and
    requests, and the whole block otherwise. Its length and SHA-1 are checked where the record states
    them and holds all of it; digests of other kinds are handed on.
    """
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")  # a header may go on in the next line
    if not sep or lines[0] not in READABLE:
        raise WarcError("no version line of WARC 1.0 or 1.1")
    headers = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(name):
            raise WarcError(f"{name} is missing")
    if not re.fullmatch("[0-9]{1,18}", headers["content-length"]):
        raise WarcError("content-length is no number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("the block's length differs from content-length")
    kind, block = headers["warc-type"], rest[:size]
    digest, payload, length = headers.get("warc-payload-digest"), block, size
    if headers.get("content-type", "").lower().replace(" ", "").startswith("application/http") and kind in ("response", "revisit", "request"):
        top, sep, payload = block.partition(b"\r\n\r\n")
        if not sep and kind == "response":
            raise WarcError("the HTTP head does not end")
        http = _headers(top.split(b"\r\n")[1:])
        length = http.get("content-length", "")
        if length and not re.fullmatch("[0-9]{1,18}", length):
            raise WarcError("the HTTP head's length is no number")
        length = int(length) if length else None if kind == "revisit" else len(payload)
        if kind == "response" and "transfer-encoding" not in http and "warc-truncated" not in headers and length != len(payload):
            raise WarcError("the payload's length differs from the HTTP head's")
        length = length if kind == "revisit" else len(payload)
    if kind == "revisit":
        if "warc-profile" not in headers:
            raise WarcError("a revisit without a profile")
        if payload and headers["warc-profile"] == PROFILE:
            raise WarcError("a revisit of an identical payload holds one itself")
        payload = None
    elif digest and digest.lower().startswith("sha1:") and "warc-truncated" not in headers:
        if digest[5:].upper() != base64.b32encode(hashlib.sha1(payload).digest()).decode():
            raise WarcError("the payload's digest differs")
    elif not digest:
        digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    bare = lambda name: headers[name].removeprefix("<").removesuffix(">") if name in headers else None
    return {"record_id": bare("warc-record-id"), "record_type": kind, "date": headers["warc-date"], "url": bare("warc-target-uri"), "content_type": headers.get("content-type"), "payload_bytes": length, "payload_digest": digest and (digest[5:].upper() if digest.lower().startswith("sha1:") else digest), "refers_to": bare("warc-refers-to"), "payload": payload}


def _headers(lines: list[bytes]) -> dict[str, str]:
    """Header lines by lower-case name; of repeated names the first counts."""
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError("a header line without a colon")
        out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return out


_READ = [(n, pa.string(), "string") for n in ("record_id", "record_type", "date", "url", "content_type")] + [("payload_bytes", pa.int64(), "long"), ("payload_digest", pa.string(), "string"), ("refers_to", pa.string(), "string"), ("payload", pa.binary(), "binary")]


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest of all ``*.warc.zst`` files below a folder that every executor sees; their records are not counted."""
    store, root = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    rows = [(f.path, folder) for f in found if f.is_file and f.path.endswith(".warc.zst")]
    return spark.createDataFrame(sorted(rows), "path string, folder string").withColumn("records", F.lit(None).cast("long"))


def read_warc(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of a manifest's archives, of every type; a broken archive or record fails the read (``WarcError``).

    (record_id, record_type, date, url, content_type, payload_bytes, payload_digest, refers_to, payload):
    SHA-1 digests stand bare, others with their name; a revisit has no payload. Archives are dealt out
    to tasks and streamed. Without ``payloads`` the column is left out; everything is validated all
    the same. An empty manifest gives no records.
    """
    fields = _READ if payloads else _READ[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, folder, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                store, _ = fs.FileSystem.from_uri(folder)
                rows, size, count = [], 0, 0
                with store.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream):
                        if not data:  # a frame without content is no record
                            continue
                        rows.append(parse(data))
                        size, count = size + len(data), count + 1
                        if size >= 4 << 20:
                            yield _rows(rows, fields)
                            rows, size = [], 0
                if expected is not None and count != expected:
                    raise WarcError(f"{path} has {count} records, not {expected}")
                yield _rows(rows, fields)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "folder", "records").repartition(parts).mapInArrow(run, ", ".join(f"{n} {t}" for n, _, t in fields))


def page_id(name: Column) -> Column:
    """The page's id in a record's name as ``write_warc`` gives it; null in any other."""
    return F.regexp_extract(name, "^urn:x-page:(-?[0-9]+):[0-9]+$", 1).try_cast("long")


def _rows(rows: list[dict], fields: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[n] for r in rows], t) for n, t, _ in fields], names=[n for n, _, _ in fields])
