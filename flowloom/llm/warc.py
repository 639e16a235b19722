"""WARC archives with a Zstandard dictionary.

Each task writes its rows as archives of bounded size into the shared folder. An archive starts with
a skippable frame that holds a dictionary trained on the archive's first records; every record
is a frame of its own, so a reader can seek to any of them. Of records with equal payloads the one
with the largest page id is a response, the others are revisits that name it.

An archive's name is new for every attempt of a task, and only the archives that finished attempts
list are read; what a lost executor left is never read. Archives are written through
pyarrow.fs, which takes file:, s3:, gs: and hdfs: folders.

Defined cases: a null payload is empty, a null url gives no target URI, a null page id stands as
"null" and reads back as null (it is response and no other record refers to it). Rows that repeat a
page id and a payload are all written; with the largest id they are all responses. An empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folder_of, new_folder, python_batches, stored, table

#: The magic number of the leading skippable frame, and the profile of revisit records.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload in an archive, of records that a dictionary is trained on, and of the dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 64 << 20, 2 << 20, 32 << 10
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit (without the payload) if refers_to is given."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict((k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:]))
    n = int(headers["content-length"])
    if len(rest) != n + 4:
        raise ValueError(f"{headers.get('warc-record-id')}: a block of {len(rest) - 4} bytes, {n} announced")
    return headers, rest[:n]


class _Archive:
    """Buffers records until the dictionary can be trained, then writes a frame for each."""

    def __init__(self, folder: fs.FileSystem, path: str) -> None:
        self.folder, self.path = folder, path
        self.waiting: list[bytes] = []
        self.size = self.records = 0
        self.out = self.compressor = None

    def _start(self) -> None:
        self.out = self.folder.open_output_stream(self.path)
        shared = None
        if len(self.waiting) >= 8:
            try:
                shared = zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, self.waiting)) // 8 + 256), self.waiting, k=512, d=8)
            except zstandard.ZstdError:  # the samples have nothing in common
                shared = None
        if shared is not None:
            packed = zstandard.ZstdCompressor(level=9).compress(shared.as_bytes())
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True)
        for x in self.waiting:
            self.out.write(self.compressor.compress(x))
        self.waiting = []

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.records += 1
        if self.out is not None:
            self.out.write(self.compressor.compress(data))
            return
        self.waiting.append(data)
        if self.size >= SAMPLE_BYTES:
            self._start()

    def close(self) -> int:
        if self.out is None:
            self._start()
        at = self.out.tell()
        self.out.close()
        return at


def frames(stream) -> Iterator[bytes]:
    """The content of each frame of an archive, with its embedded dictionary."""
    head = stream.read(8)
    shared, rest = None, head
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
        shared = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(stream.read(struct.unpack("<II", head)[1])))
        rest = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=shared)
    d, parts = decompressor.decompressobj(), []
    while True:
        if not rest and not (rest := stream.read(1 << 20)):
            break
        parts.append(d.decompress(rest))
        rest = b""
        if d.eof:
            rest = d.unused_data
            yield b"".join(parts)
            d, parts = decompressor.decompressobj(), []
    if any(parts):
        raise ValueError("the archive ends inside a frame")


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """id_, refers_to: the pages whose payload a page with a larger id has."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keys = pages.select(
        F.col("page_id").cast("bigint").alias("id_"), F.sha2(payload.cast("binary"), 256).alias("key"), F.octet_length(payload).alias("n")
    ).where(F.col("id_").isNotNull() & (F.col("n") >= min_bytes)).select("id_", "key")
    kept = keys.groupBy("key").agg(
        F.max("id_").alias("refers_to"), F.min("id_").alias("least")
    ).where(F.col("least") < F.col("refers_to")).select("key", "refers_to")
    return keys.join(kept, "key").where(F.col("id_") < F.col("refers_to")).select("id_", "key", "refers_to").distinct()


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write the archives; path, records, payload_bytes, archive_bytes of each."""
    python_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.cast("binary").alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("key"),
    )
    again = revisits(pages, min_bytes).withColumnRenamed("key", "key_")
    rows = rows.join(again, (rows["page_id"] == again["id_"]) & (rows["key"] == again["key_"]), "left").select("page_id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = folder_of(folder)
        store.create_dir(root, recursive=True)
        attempt, k, made, now = uuid.uuid4().hex, 0, [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None:
                    now = _Archive(store, f"{root}/{attempt}-{k:05d}.warc.zst")
                now.add(record(*row))
                if now.size >= ARCHIVE_BYTES:
                    made.append((now.path, now.records, now.size, now.close()))
                    now, k = None, k + 1
        if now is not None:
            made.append((now.path, now.records, now.size, now.close()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[i] for m in made], pa.int64() if i else pa.string()) for i in range(4)], names=["path", "records", "record_bytes", "archive_bytes"]
        )

    return stored(rows.mapInArrow(run, "path string, records bigint, record_bytes bigint, archive_bytes bigint"), "archives")


def read(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Rows of archived records: page_id, url, record_type, payload_bytes, payload_digest, refers_to (and html)."""
    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint" + ", html binary" * payloads

    def number(name: str | None) -> int | None:
        text = name.removeprefix("<urn:page:").removesuffix(">") if name else "null"
        return None if text == "null" else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = folder_of(folder)
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: 6 + payloads]
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html"][: 6 + payloads]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                out = []
                with store.open_input_stream(path) as stream:
                    for data in frames(stream):
                        h, block = parse(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n, said = int(re.search(rb"Content-Length: (\d+)", http)[1]), h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response" and (len(payload) != n or digest(payload) != said):
                            raise ValueError(f"{path}: the payload of {h['warc-record-id']} is damaged")
                        row = (number(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], n, said, number(h.get("warc-refers-to")))
                        out.append((*row, payload if h["warc-type"] == "response" else None) if payloads else row)
                        if len(out) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    tasks = max(1, min(archives.count(), 10_000))  # an archive is a task's work
    return archives.select("path").repartition(tasks, "path").mapInArrow(run, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    archives = write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM m
""",
}
