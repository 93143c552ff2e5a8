"""WARC records of pages in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames. The first holds the warcinfo record, each other one records of FRAME_BYTES or a
little more, so a reader decompresses only what it needs. Two skippable frames follow, which plain Zstandard readers pass over:

    map         record identifier (16 bytes), frame, offset of the record in the frame's decompressed bytes, length; sorted by identifier
    seek table  compressed and decompressed size of each frame before, their number, magic (the public seekable format)

A record is found by a binary search of the map and one frame. Identifiers are UUIDs of version 8 that carry the page_id, so a
revisit's WARC-Refers-To names its page without a lookup.

Of records with equal payloads (by SHA-256) of at least MIN_PAYLOAD bytes, that with the largest page_id is the response; the others
revisit it: they keep their HTTP header and digest, and leave the payload out. The join with the repeated payloads' pages is a
plain left join: Spark splits a payload that many pages share. Names of files carry the task's attempt, the table of bundles names
those of attempts that were committed, and files that it doesn't name are deleted. Reading is dealt by ranges of frames, not by files.
Reading computes each response's digest from its payload and fails where it isn't the stated one, or where a revisit states another digest or size
than the response that it refers to.

Defined cases: a null html is the empty payload, a null url an empty address. Rows that share the largest page_id of a payload are all
responses; rows without page_id are responses, and nothing refers to them. Repeated rows are records of their own, under one identifier. A payload
may be of any length that a row holds; its frame is as long. Line breaks and blanks in an address are percent-encoded. An empty table writes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netframe.llm.common import materialize, raw_texts, shared_path, sliced

MIN_PAYLOAD = 1000
FRAME_BYTES = 256 << 10
#: Frames that a reading task's row names.
FRAMES_A_SPLIT = 32
LEVEL = 3
#: The pages table has no times: every record states this one.
DATE = "2024-01-01T00:00:00Z"

# fixed values of the Zstandard and seekable formats
SKIPPABLE_MAP, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_HEAD, _SEEK, _FOOT = struct.Struct("<II"), struct.Struct("<II"), struct.Struct("<IBI")
_ENTRY = np.dtype([("id", "V16"), ("frame", "<u4"), ("at", "<u4"), ("length", "<u8")])
# fixed values of the WARC format
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_CONTROL = re.compile(rb"[\x00-\x20\x7f]")


def record_id(page_id: int | None, extra: bytes = b"") -> bytes:
    """16 bytes of a version 8 UUID: the page_id's 64 bits, around version and variant, then a mark; without page_id a hash of extra."""
    if page_id is None:
        raw = int.from_bytes(hashlib.sha256(extra).digest()[:8], "big") << 2 | 2
    else:
        raw = (page_id & (1 << 64) - 1) << 2 | 1
    high, middle, low = raw >> 18 & (1 << 48) - 1, raw >> 6 & (1 << 12) - 1, raw & 63
    return (high << 80 | 8 << 76 | middle << 64 | 2 << 62 | low << 56).to_bytes(16, "big")


def page_of(identifier: bytes) -> int | None:
    """The page_id that record_id() has put into an identifier."""
    n = int.from_bytes(identifier, "big")
    raw = n >> 80 << 18 | (n >> 64 & (1 << 12) - 1) << 6 | n >> 56 & 63
    if raw & 3 != 1:
        return None
    value = raw >> 2
    return value - (1 << 64) if value >> 63 else value


def urn(identifier: bytes) -> bytes:
    h = identifier.hex()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>".encode()


def of_urn(text: bytes) -> bytes:
    return bytes.fromhex(text.decode().strip("<>").removeprefix("urn:uuid:").replace("-", ""))


def warc_digest(sha1_hex: str) -> bytes:
    return b"sha1:" + base64.b32encode(bytes.fromhex(sha1_hex))


def make_record(identifier: bytes, url: bytes, payload: bytes, sha1_hex: str, refers_to: bytes | None) -> bytes:
    """A response, or the revisit of a record: its block is the HTTP header, and for a response the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    lines = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if refers_to else b"response"),
        b"WARC-Record-ID: " + urn(identifier),
        b"WARC-Date: " + DATE.encode(),
        b"WARC-Target-URI: " + _CONTROL.sub(lambda m: b"%%%02X" % m[0][0], url),
        b"WARC-Payload-Digest: " + warc_digest(sha1_hex),
        *([b"WARC-Refers-To: " + urn(refers_to), b"WARC-Profile: " + REVISIT_PROFILE] if refers_to else []),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    return b"\r\n".join(lines) + _END + block + _END


def make_info(file: str) -> bytes:
    body = b"software: netframe\r\nformat: WARC File Format 1.1\r\n"
    identifier = record_id(None, file.encode())
    lines = [VERSION, b"WARC-Type: warcinfo", b"WARC-Record-ID: " + urn(identifier), b"WARC-Date: " + DATE.encode(), b"Content-Type: application/warc-fields", b"Content-Length: %d" % len(body)]
    return b"\r\n".join(lines) + _END + body + _END


class Record(NamedTuple):
    headers: dict[bytes, bytes]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers[b"warc-type"].decode()

    def http(self) -> tuple[int, bytes]:
        """The stated length of the payload, and the payload that is here."""
        head, _, payload = self.block.partition(_END)
        return int(re.search(rb"\r\nContent-Length: (\d+)", head)[1]), payload


def parse_record(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at an offset, and where the next one begins."""
    end = data.index(_END, at)
    version, *lines = data[at:end].split(b"\r\n")
    if version != VERSION:
        raise ValueError(f"no WARC record at offset {at}")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
    begin = end + len(_END)
    stop = begin + int(headers[b"content-length"])
    if data[stop : stop + len(_END)] != _END:
        raise ValueError(f"the record at offset {at} has another length than it states")
    return Record(headers, data[begin:stop]), stop + len(_END)


class BundleWriter:
    """Appends records; a frame's bytes, the map and the seek table are in memory."""

    def __init__(self, out, name: str, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.frame_bytes = out, frame_bytes
        self.coder = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame, self.entries, self.seek, self.n_records, self.at = bytearray(make_info(name)), bytearray(), bytearray(), 0, 0
        self._flush()

    def add(self, identifier: bytes, record: bytes) -> None:
        self.entries += identifier + struct.pack("<IIQ", len(self.seek) // 8, len(self.frame), len(record))
        self.frame += record
        self.n_records += 1
        if len(self.frame) >= self.frame_bytes:
            self._flush()

    def _put(self, data: bytes, decompressed: int) -> None:
        self.out.write(data)
        self.seek += _SEEK.pack(len(data), decompressed)
        self.at += len(data)

    def _flush(self) -> None:
        if self.frame:
            self._put(self.coder.compress(bytes(self.frame)), len(self.frame))
            self.frame = bytearray()

    @property
    def n_frames(self) -> int:
        """Frames of records, after close(): all but the map."""
        return len(self.seek) // 8 - 1

    def close(self) -> None:
        self._flush()
        entries = np.frombuffer(bytes(self.entries), _ENTRY)
        key = entries["id"].tobytes()
        order = sorted(range(len(entries)), key=lambda k: key[16 * k : 16 * k + 16])
        body = entries[order].tobytes()
        self._put(_HEAD.pack(SKIPPABLE_MAP, len(body)) + body, 0)
        table = bytes(self.seek) + _FOOT.pack(len(self.seek) // 8, 0, SEEKABLE)
        self.out.write(_HEAD.pack(SKIPPABLE_SEEK, len(table)) + table)
        self.at += 8 + len(table)


class BundleReader:
    """Finds frames by the seek table and records by the map; source is an open file with seek() and size()."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - _FOOT.size)
        n, _, magic = _FOOT.unpack(source.read(_FOOT.size))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        source.seek(size - _FOOT.size - 8 * n)
        sizes = np.frombuffer(source.read(8 * n), "<u4").reshape(n, 2).astype(np.int64)
        self.starts, self.sizes, self.n_frames = np.cumsum(sizes[:, 0]) - sizes[:, 0], sizes, n - 1
        self.coder, self.map = zstandard.ZstdDecompressor(), None

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.starts[k]))
        return self.coder.decompress(self.source.read(int(self.sizes[k, 0])), max_output_size=int(self.sizes[k, 1]))

    def records(self, first: int = 0, n: int | None = None) -> Iterator[tuple[int, int, Record]]:
        """(frame, offset, record) of n frames; warcinfo is left out."""
        for k in range(first, self.n_frames if n is None else min(first + n, self.n_frames)):
            data, at = self.frame(k), 0
            while at < len(data):
                begin = at
                record, at = parse_record(data, at)
                if record.kind != "warcinfo":
                    yield k, begin, record

    def entries(self) -> list[tuple[bytes, int, int, int]]:
        """(identifier, frame, offset, length), sorted by identifier."""
        if self.map is None:
            self.source.seek(int(self.starts[-1]))
            body = self.source.read(int(self.sizes[-1, 0]))[_HEAD.size :]
            self.map = [(body[at : at + 16], *struct.unpack_from("<IIQ", body, at + 16)) for at in range(0, len(body), 32)]
        return self.map

    def find(self, identifier: bytes) -> list[Record]:
        """The records of an identifier, one frame read for each."""
        entries = self.entries()
        low, high = 0, len(entries)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if entries[middle][0] < identifier else (low, middle)
        found = []
        while low < len(entries) and entries[low][0] == identifier:
            found.append(parse_record(self.frame(entries[low][1]), entries[low][2])[0])
            low += 1
        return found


def with_referred(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, url, html, n_bytes, digest, refers_to): refers_to is the page whose payload a page repeats, or null."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("n_bytes", F.octet_length("html").cast("long"))
    same = F.when((F.col("n_bytes") >= min_payload) & F.col("page_id").isNotNull(), F.sha2("html", 256))
    repeated = rows.select(same.alias("same"), "page_id").where("same IS NOT NULL").groupBy("same").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.withColumn("digest", F.sha1("html")).withColumn("same", same).join(repeated.select("same", "last"), "same", "left")
    return met.select("page_id", "url", "html", "n_bytes", "digest", F.when(F.col("last") != F.col("page_id"), F.col("last")).alias("refers_to"))


def write_bundles(pages: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Writes the bundles under path and returns (file, n_frames, n_records, n_bytes), a row for each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = sliced(batches)
        first = next(batches, None)
        if first is None:
            return
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"bundle-{context.partitionId():06d}-{context.taskAttemptId()}.warc.zst"
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            writer = BundleWriter(out, name, frame_bytes)
            _add(writer, first)
            for batch in batches:
                _add(writer, batch)
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"]), *(pa.array([x], pa.int64()) for x in (writer.n_frames, writer.n_records, writer.at))], ["file", "n_frames", "n_records", "n_bytes"])

    rows = with_referred(pages, min_payload=min_payload).sortWithinPartitions("page_id", "digest")
    made = materialize(rows.mapInArrow(write, "file string, n_frames long, n_records long, n_bytes long"), "bundles")
    _sweep(made, path)
    return made


def _add(writer: BundleWriter, batch: pa.RecordBatch) -> None:
    columns = (batch.column("page_id").to_pylist(), raw_texts(batch, "url"), raw_texts(batch, "html"), batch.column("digest").to_pylist(), batch.column("refers_to").to_pylist())
    for page_id, url, html, digest, last in zip(*columns, strict=True):
        identifier = record_id(page_id, url + b"\n" + digest.encode())
        writer.add(identifier, make_record(identifier, url, html, digest, None if last is None else record_id(last)))


def _sweep(bundles: DataFrame, path: str) -> None:
    """Deletes what attempts that weren't committed have left; the driver sees names of bundles alone."""
    store, root = fs.FileSystem.from_uri(path)
    kept = {r.file for r in bundles.select("file").collect()}
    for found in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if found.path not in kept:
            store.delete_file(found.path)


_READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, frame int, at long"


def read_bundles(bundles: DataFrame, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the files: what its headers say, digest and size of the full payload, and where it stands; with_payload: a revisit's is null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                with store.open_input_file(name) as source:
                    rows, held = [], 0
                    for frame, at, record in BundleReader(source).records(first, FRAMES_A_SPLIT):
                        rows.append(_row(record) | {"file": name, "frame": frame, "at": at})
                        held += len(record.block)
                        if len(rows) >= 4096 or held > 16 << 20:
                            yield _batch(rows, with_payload)
                            rows, held = [], 0
                    yield _batch(rows, with_payload)

    splits = bundles.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1, F.lit(FRAMES_A_SPLIT).cast("long"))).alias("first"))
    n = max(1, min(bundles.agg(F.sum(F.ceil(F.col("n_frames") / FRAMES_A_SPLIT))).first()[0] or 1, 100_000))
    return splits.repartition(int(n)).mapInArrow(read, _READ + ", payload binary" * with_payload)


def _row(record: Record) -> dict:
    h = record.headers
    n, payload = record.http()
    stated = base64.b32decode(h[b"warc-payload-digest"].removeprefix(b"sha1:")).hex()
    if record.kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != stated):
        raise ValueError(f"payload of {h[b'warc-record-id'].decode()} isn't the stated one")
    refers = h.get(b"warc-refers-to")
    return {
        "page_id": page_of(of_urn(h[b"warc-record-id"])),
        "url": h[b"warc-target-uri"].decode(errors="replace"),
        "record_type": record.kind,
        "refers_to": page_of(of_urn(refers)) if refers else None,
        "payload_bytes": n,
        "payload_digest": stated,
        "payload": payload if record.kind == "response" else None,
    }


def _batch(rows: list[dict], with_payload: bool) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "file": pa.string(), "frame": pa.int32(), "at": pa.int64()}
    kinds |= {"payload": pa.binary()} if with_payload else {}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))


def record_map(bundles: DataFrame, path: str) -> DataFrame:
    """(identifier, page_id, file, frame, at, length) from the maps alone; no frame is decompressed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_file(name) as source:
                    entries = BundleReader(source).entries()
                for k in range(0, len(entries), 65_536):
                    ids, frames, at, length = zip(*entries[k : k + 65_536], strict=True)
                    columns = pa.array(ids, pa.binary()), pa.array(map(page_of, ids), pa.int64()), pa.array([name] * len(ids)), pa.array(frames, pa.int32()), pa.array(at, pa.int64()), pa.array(length, pa.int64())
                    yield pa.RecordBatch.from_arrays(list(columns), ["identifier", "page_id", "file", "frame", "at", "length"])

    return bundles.select("file").mapInArrow(read, "identifier binary, page_id long, file string, frame int, at long, length long")


def check_revisits(records: DataFrame) -> None:
    """An error where a revisit states another digest or size than the response that it refers to, or there is none. A response's revisits are one row before they meet it."""
    said = records.where("record_type = 'revisit'").select("refers_to", "payload_bytes", "payload_digest").distinct()
    there = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    bad = said.join(there, ["refers_to", "payload_bytes", "payload_digest"], "left_anti").limit(1).collect()
    if bad:
        raise ValueError(f"a revisit of page {bad[0].refers_to} doesn't agree with its response")


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the bundles, reads them back and checks the revisits; the columns of read_bundles()."""
    path = path or shared_path(pages.sparkSession, "warc")
    records = materialize(read_bundles(write_bundles(pages, path), path), "records")
    check_revisits(records)
    return records
