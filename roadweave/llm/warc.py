"""Operator 5: a WARC writer with a Zstandard dictionary in each archive, and its reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each
record is a Zstandard frame of its own, compressed with it. The dictionary is trained on records
of the archive itself, spread evenly over it, up to ``SAMPLE_BYTES`` (a documented bound: it
changes sizes, never contents). Tasks write whole archives of up to ``ARCHIVE_BYTES`` of payload
under a temporary name and rename them, so a repeated task replaces its own files with the same
content. Spark reads the archives back as binary files.

Of records with equal payloads of ``least`` bytes or more, that with the greatest page_id is a
response and the others revisit it.

Defined results: null html is an empty payload; very long html is one record; null urls get no
target URI; rows without page_id never are what others revisit unless all copies lack one, then all
are responses; rows that repeat the greatest page_id all are responses; an empty table gives an
empty folder and no rows; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looked_up, materialize, portions, qualified, scratch_dir

DICTIONARY_MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 112 << 10
#: Bytes of an archive that are unpacked at first and at most at once.
SLICE_BYTES = 2 << 10
MOST_SLICE_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit if it refers to another page."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("X-Page-ID", page_id),
        ("X-Refers-To-Page-ID", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on records spread evenly over ``records``; plain content where there are too few."""
    total, wanted = sum(map(len, records)), []
    step = max(1, -(-total // SAMPLE_BYTES))
    for r in records[::step]:
        wanted.append(r[: zstandard.BLOCKSIZE_MAX])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, wanted)
    except (zstandard.ZstdError, MemoryError):
        content = b"".join(wanted)[:DICTIONARY_BYTES]
        return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None


def archive(records: list[bytes], level: int = 3) -> bytes:
    shared = dictionary(records)
    raw = shared.as_bytes() if shared else b""
    packer = zstandard.ZstdCompressor(level=level, dict_data=shared) if shared else zstandard.ZstdCompressor(level=level)
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw + b"".join(packer.compress(r) for r in records)


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    magic, n = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't start with a dictionary frame")
    raw, at = data[8 : 8 + n], 8 + n
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind)) if n else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        # slices that double: what a frame leaves of its last one is given back as a copy
        one, parts, step = reader.decompressobj(), [], SLICE_BYTES
        while not one.eof:
            if at == len(data):
                raise ValueError("the archive ends within a frame")
            parts.append(one.decompress(view[at : at + step]))
            at, step = min(len(data), at + step), min(2 * step, MOST_SLICE_BYTES)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parsed(raw: bytes) -> dict:
    """A record's fields; digest and length of a response come from the payload itself."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda k: int(fields[k]) if k in fields else None
    out = {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID")}
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if out["record_type"] == "revisit":
        return out | {"payload": None, "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload_digest": stated}
    digest = hashlib.sha1(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"payload digest of page {out['page_id']} doesn't hold")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}


def decided(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html, digest and refers_to (the response's page_id for revisits)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(html, "UTF-8").alias("html")).withColumn("digest", F.sha1("html"))
    repeated = (
        rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last")).where("n > 1 and last is not null").select("digest", "last")
    )
    found = looked_up(rows, materialize(repeated), "digest", F.struct("page_id", "url"))
    return found.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")))


def write(pages: DataFrame, directory: str, least: int = 1000) -> DataFrame:
    """Write archives under ``directory``, which all executors share; one row (file, records) each.

    A path without a scheme is one of the session's default file system, for writer and reader alike.
    """
    directory = qualified(pages.sparkSession, directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(directory)
        fs.create_dir(root, recursive=True)
        context, files, held, size = TaskContext.get(), 0, [], 0

        def put() -> pa.RecordBatch:
            name = f"part-{context.partitionId():06d}-{files:04d}.warc.zst"
            attempt = f"{root}/_{name}.{context.taskAttemptId()}"
            with fs.open_output_stream(attempt) as out:
                out.write(archive(held))
            fs.move(attempt, f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "records": [len(held)]})

        for b in portions(batches, "html"):
            for page_id, url, html, digest, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                held.append(record(page_id, url, html, digest, refers_to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield put()
                    files, held, size = files + 1, [], 0
        if held:
            yield put()

    rows = decided(pages, least).sortWithinPartitions("page_id", "digest", "url")
    return materialize(rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "file string, records long"))


def read(spark: SparkSession, directory: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``directory``; without ``payloads`` that column is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for data in b.column("content"):
                held, size = [], 0
                for raw in records_of(data.as_py()):
                    held.append(parsed(raw) if payloads else parsed(raw) | {"payload": None})
                    size += len(raw)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return spark.read.format("binaryFile").load(f"{directory}/part-*.warc.zst").select("content").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) in the shared folder and read the archives back."""
    spark = pages.sparkSession
    directory = f"{scratch_dir(spark)}-warc"
    files = write(pages, directory, least)
    if files.count() == 0:
        return spark.createDataFrame([], RECORD)
    return read(spark, directory, payloads=False)


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""
