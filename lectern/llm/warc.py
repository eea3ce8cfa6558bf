"""WARC archives compressed record by record with a dictionary of their own.

Each archive begins with a skippable frame (``0x184D2A5D``) that holds a Zstandard dictionary,
itself compressed; every record after it is a frame of its own made with that dictionary, so a record can be
fetched alone. The dictionary is trained on the archive's first records (``SAMPLE_BYTES`` at most);
where they are too few to train on, the sample itself serves as dictionary.

Which records are revisits is settled beforehand with one grouping by payload digest, whose partial
sums make a digest that a third of all rows share cost no more than any other; its result is stored and joined back. A revisit's block
holds the response's HTTP header only; its ``Content-Length`` is that of the full payload.

An archive's name holds the task's attempt; only archives in the manifest count, so a task that runs
again leaves nothing that is read twice.

Defined cases: a null payload is empty; a null url becomes a urn; payloads of under ``LEAST_REVISIT``
bytes are never revisits; rows that share both page id and payload are all what the first is; a null
page id is archived as such and comes last among its equals; other columns are left alone; an empty
table writes no archive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

LEAST_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pages")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``(id, url, payload, digest, refers_to)``: ``refers_to`` is set for rows that revisit another."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= LEAST_REVISIT
    first = rows.where(long).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # stored: Spark then sends it to every task if it is small, and can split a digest that many rows share if it isn't
    first = storage.keep(first, "digests").withColumnRenamed("digest", "key")
    # short payloads match nothing, and are spread
    keyed = rows.withColumn("key", F.when(long, F.col("digest")).otherwise(F.concat(F.lit("short "), F.xxhash64("id", "url").cast("string"))))
    joined = keyed.join(first, "key", "left")
    return joined.select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page} {digest}')}>"


def _headers(first: str, fields: list[tuple[str, object]]) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed."""
    http = _headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http if refers_to is not None else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page}"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Profile", PROFILE), ("Refers-To-Page-Id", refers_to)]
    fields += [("Page-Id", "" if page is None else page), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _headers("WARC/1.1", fields) + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
        except zstandard.ZstdError:  # too little or too uniform a sample
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes one archive; records are held until there are enough for a dictionary."""

    def __init__(self, stream):
        self.stream, self.waiting, self.size, self.records, self.compressor = stream, [], 0, 0, None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.compressor is not None:
            self._write(self.compressor.compress(data))
            return
        self.waiting.append(data)
        self.size += len(data)
        if self.size >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        samples, self.waiting, self.size = self.waiting, [], 0
        own = dictionary(samples)
        frame = zstandard.ZstdCompressor(level=LEVEL).compress(own.as_bytes())
        self._write(struct.pack("<II", SKIPPABLE, len(frame)) + frame)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=own)
        for data in samples:
            self._write(self.compressor.compress(data))

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.compressor is None and self.waiting:
            self._begin()
        self.stream.close()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes archives below ``folder``; returns the manifest ``(archive, records)``, already stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = storage.filesystem(folder)
        fs.create_dir(root, recursive=True)
        archive, name, k = None, "", 0
        for batch in batches:
            columns = [batch.column(c) for c in range(5)]
            for i in range(len(batch)):
                if archive is None:
                    name, k = f"{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}.warc.zst", k + 1
                    archive = Archive(fs.open_output_stream(f"{root}/{name}", compression=None))
                archive.add(record(*(c[i].as_py() for c in columns)))
                if archive.compressor is not None and archive.size >= ARCHIVE_BYTES:
                    archive.close()
                    yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [archive.records]})
                    archive = None
        if archive is not None:
            archive.close()
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [archive.records]})

    return storage.keep(with_revisits(pages, id_col, url_col, payload_col).mapInArrow(run, "archive string, records long"), "manifest")


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, one by one."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive has no dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(stream.read(size), max_output_size=DICTIONARY_BYTES * 2)
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    decompressor = zstandard.ZstdDecompressor(dict_data=own)
    one, parts = decompressor.decompressobj(), []
    while data := stream.read(1 << 20):
        while data:
            parts.append(one.decompress(data))
            data = b""
            if one.eof:
                yield b"".join(parts)
                data, one, parts = one.unused_data, decompressor.decompressobj(), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> dict:
    """Fields of a record; the payload of a response, and of a revisit the size of what it stands for."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload doesn't match its digest")
    return {"page_id": int(fields["Page-Id"]) if fields["Page-Id"] else None, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": int(fields["Refers-To-Page-Id"]) if "Refers-To-Page-Id" in fields else None, "url": fields["WARC-Target-URI"], "payload": payload if fields["WARC-Type"] == "response" else None}


def read(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives; digests are checked on the way."""
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()} | ({"payload": pa.binary()} if with_payload else {})
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def drain():
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=[*kinds])
            rows.clear()
            return out

        rows, held = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = storage.filesystem(name)
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream):
                        rows.append(parse(data))
                        held += len(data) if with_payload else 200
                        if held >= 4_000_000:
                            yield drain()
                            held = 0
        if rows:
            yield drain()

    spread = manifest.select("archive").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2)
    return spread.mapInArrow(run, schema)
