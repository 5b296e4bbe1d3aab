"""WARC archives compressed with Zstandard.

An archive begins with a skippable frame that holds the dictionary; then each record is a frame of its own.  Writers
name their files at random and report them as rows; only what a successful task reported is in the manifest, so a
task run twice, or lost half-way, leaves nothing that a reader sees.  Readers stream: a record at a time is in
memory."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import settle, shared_path
from .common import bounded_sample, text_or_empty

#: Fixed values of the format: magic numbers of the dictionary's skippable frame and of a Zstandard frame, version,
#: line end, header names that every record must have, types of records.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
END = b"\r\n"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")

#: Fixed by the contract: payloads of this many bytes or more are stored once.
REVISIT_BYTES = 1000


@dataclass(frozen=True)
class WarcConfig:
    """``dictionary_rows`` payloads, in hash order, train a dictionary of ``dictionary_bytes``; an archive is closed
    once ``archive_bytes`` have been written to it.  ``date`` is the time of capture, which the pages do not have."""

    dictionary_rows: int = 512
    dictionary_bytes: int = 64 << 10
    archive_bytes: int = 128 << 20
    level: int = 3
    date: str = "1970-01-01T00:00:00Z"
    block: int = 64 << 10


def frame_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION] + [f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return END.join(lines) + END + END + block + END + END


def split_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; ValueError says what is wrong with it."""
    head, found, rest = record.partition(END + END)
    lines = head.split(END)
    if not found or lines[0] != VERSION:
        raise ValueError(f"no {VERSION.decode()} header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or len(name.split()) != 1 or name != name.strip():
            raise ValueError(f"header line without a name: {line[:80]!r}")
        headers[name] = value.strip()
    if missing := [n for n in NEEDED if n not in headers]:
        raise ValueError(f"headers missing: {', '.join(missing)}")
    if headers["WARC-Type"] not in TYPES:
        raise ValueError(f"unknown record type {headers['WARC-Type']!r}")
    length = headers["Content-Length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != END + END:
        raise ValueError(f"Content-Length is {length}, the block has {len(rest) - 4} bytes")
    return headers, rest[:-4]


def split_http(block: bytes) -> bytes:
    """Payload of an HTTP response."""
    head, found, payload = block.partition(END + END)
    if not found or not head.startswith(b"HTTP/"):
        raise ValueError("response block without an HTTP header")
    for line in head.split(END)[1:]:
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length" and int(value) != len(payload):
            raise ValueError(f"HTTP Content-Length is {int(value)}, the payload has {len(payload)} bytes")
    return payload


def read_frames(stream, block: int) -> Iterator[bytes]:
    """Records of an archive, one for each frame.  A missing dictionary frame, a frame that is cut off and bytes
    that are no frame are errors."""
    start = stream.read(8)
    if len(start) < 8 or struct.unpack("<I", start[:4])[0] != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    size = struct.unpack("<I", start[4:])[0]
    raw = stream.read(size)
    if len(raw) != size:
        raise ValueError("the dictionary frame is cut off")
    if len(raw) >= 4 and struct.unpack("<I", raw[:4])[0] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    left = stream.read(block)
    while left:
        frame, parts = decoder.decompressobj(), []
        while True:
            parts.append(frame.decompress(left))
            if frame.eof:
                left = frame.unused_data or stream.read(block)
                break
            left = stream.read(block)
            if not left:
                raise ValueError("the last frame is cut off")
        yield b"".join(parts)


def _page_record(page: int | None, payload: bytes, digest: str, refers_to: int | None, config: WarcConfig) -> bytes:
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", config.date)]
    if page is not None:
        headers.append(("WARC-Page-ID", str(page)))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", str(refers_to))]
        block = http + b"\r\n"
    else:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    return frame_record([*headers, ("Content-Type", "application/http; msgtype=response")], block)


def _write(batches: Iterator[pa.RecordBatch], folder: str, dictionary: bytes, config: WarcConfig) -> Iterator[pa.RecordBatch]:
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    coder = zstandard.ZstdCompressor(level=config.level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    out, name, records, size = None, "", 0, 0

    def close():
        out.close()
        return pa.RecordBatch.from_pydict({"path": [name], "records": [records], "bytes": [size]})

    for batch in batches:
        for page, html, digest, refers_to in zip(*(batch.column(c) for c in ("page_id", "payload", "digest", "refers_to"))):
            if out is None:
                name, records = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0
                out = store.open_output_stream(f"{base}/{name.rpartition('/')[2]}", compression=None)
                out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                size = 8 + len(dictionary)
            frame = coder.compress(_page_record(page.as_py(), html.as_py().encode(), digest.as_py(), refers_to.as_py(), config))
            out.write(frame)
            records, size = records + 1, size + len(frame)
            if size >= config.archive_bytes:
                yield close()
                out = None
    if out is not None:
        yield close()


DICTIONARY_TEXT = 16384  # characters of a payload that the dictionary learns from; the archives hold all of it


def train_dictionary(pages: DataFrame, config: WarcConfig = WarcConfig()) -> bytes:
    """From a bounded number of payloads; empty where they are too few to train on."""
    keyed = pages.where(F.length("html") > 0).select(F.xxhash64("page_id", "html").alias("__key"))
    picked = bounded_sample(keyed.distinct(), config.dictionary_rows, "__key")  # 8 bytes a row, so it may be broadcast
    texts = pages.select(F.xxhash64("page_id", "html").alias("__key"), F.substring("html", 1, DICTIONARY_TEXT).alias("__text"))
    found = texts.join(F.broadcast(picked), "__key").dropDuplicates(["__key"]).orderBy("__key").collect()
    samples = [r["__text"].encode() for r in found]
    try:
        return zstandard.train_dictionary(config.dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_pages(pages: DataFrame, config: WarcConfig = WarcConfig()) -> DataFrame:
    """Archive page_id and html of every row; returns the manifest (path, records, bytes).

    Null html is an empty payload.  Of rows with equal payloads of REVISIT_BYTES or more those with the largest
    page_id are responses and the others revisits of them; where all their ids are null, all are responses.  Other
    columns are left behind; no rows, no archives."""
    spark = pages.sparkSession
    html = text_or_empty("html")
    rows = pages.select(
        "page_id", html.alias("payload"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size")
    )
    large = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n"))
    repeated = settle(large.where("n > 1").select("digest", "size", "kept"), "repeated")
    other = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    placed = rows.join(repeated, ["digest", "size"], "left").select("page_id", "payload", "digest", F.when(other, F.col("kept")).alias("refers_to"))
    folder, dictionary = shared_path(spark, "warc"), train_dictionary(pages, config)
    return settle(placed.mapInArrow(lambda it: _write(it, folder, dictionary, config), "path string, records long, bytes long"), "manifest")


READ = "path string, record_type string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"


def _read_record(record: bytes) -> dict:
    headers, block = split_record(record)
    kind, payload = headers["WARC-Type"], None
    digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    length = int(headers["WARC-Payload-Length"]) if "WARC-Payload-Length" in headers else None
    if kind == "response":
        payload = split_http(block)
        found = hashlib.sha1(payload).hexdigest()
        if digest not in (None, found):
            raise ValueError(f"payload digest is {digest}, the payload's is {found}")
        if length not in (None, len(payload)):
            raise ValueError(f"payload length is {length}, the payload has {len(payload)} bytes")
        digest, length = found, len(payload)
    number = lambda name: int(headers[name]) if name in headers else None
    return {
        "record_type": kind, "page_id": number("WARC-Page-ID"), "payload_bytes": length, "payload_digest": digest,
        "refers_to": number("WARC-Refers-To-Page-ID"), "payload": payload,
    }


def read_archives(spark: SparkSession, paths: DataFrame, strict: bool = True, payloads: bool = True, block: int = 64 << 10) -> DataFrame:
    """Records of the archives named in the column ``path``.  Headers, lengths and digests are checked: a record
    that fails ends the job or, not ``strict``, is a row with ``error`` (an archive that cannot be read on is one
    such row).  ``payload`` is null for revisits, whose length and digest are those of their headers, and throughout without
    ``payloads``.  Null paths are skipped, a path named twice is read twice, no paths give no rows."""
    names = [f.split()[0] for f in READ.split(", ")]
    schema = pa.schema([("path", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])

    def records(path):
        store, inner = fs.FileSystem.from_uri(path)
        with store.open_input_stream(inner, compression=None) as stream:
            frames = read_frames(stream, block)
            while True:
                try:
                    record = next(frames, None)
                    if record is None:
                        return
                except (ValueError, zstandard.ZstdError) as wrong:
                    if strict:
                        raise ValueError(f"{path}: {wrong}") from wrong
                    yield {"path": path, "error": str(wrong)}
                    return
                try:
                    row = _read_record(record)
                except ValueError as wrong:
                    if strict:
                        raise ValueError(f"{path}: {wrong}") from wrong
                    row = {"error": str(wrong)}
                yield {**row, "path": path}

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for row in records(path):
                    size += len(row.get("payload") or b"")
                    held.append(row if payloads else {**row, "payload": None})
                    if size >= 4 << 20 or len(held) >= 4096:
                        yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in held], schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in held], schema)

    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return paths.select("path").where(F.col("path").isNotNull()).repartition(files, "path").mapInArrow(read, READ)
