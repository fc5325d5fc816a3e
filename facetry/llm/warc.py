"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames, frames into bundles.  A bundle ends with a skippable frame
that holds the seek table (compressed and decompressed size of each frame), so it can be read as one stream by any
Zstandard tool, or from any frame.  An index maps record ids to bundle, frame, offset and length in that frame.

Of records with equal payloads the one with the largest id is a response; the others are revisit records that
refer to it and hold headers only.  Bundles are rows of a table that Spark writes in the shared folder, so a lost
executor or a repeated task leaves no half-written archive; ``export`` writes them as files.

Defined results: null html is an empty payload; rows that share the largest id and the payload are all responses;
a row without an id is a response unless a row with an id has its payload; every row has a record, repeated ones too;
an empty table gives no bundle; a payload of any length is one record in a frame of its own.  Other columns are not
looked at.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm.spark_utils import skew_safe_left_join

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
BUNDLE_TYPE = "bundle string, content binary, records array<struct<record_id:string,frame:int,offset:bigint,length:bigint>>"
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"urn:x-page:{'none' if page_id is None else page_id}"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; with ``refers_to`` a revisit, whose block ends after the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{record_id(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http if refers_to is not None else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record."""
    end = raw.index(b"\r\n\r\n")
    fields = lambda b: {k.lower(): v for k, _, v in (x.partition(": ") for x in b.decode().split("\r\n")[1:])}
    head = fields(raw[:end])
    block = raw[end + 4 : end + 4 + int(head["content-length"])]
    if len(raw) != end + 4 + len(block) + 4:
        raise ValueError("a record of the wrong length")
    cut = block.index(b"\r\n\r\n")
    return head, fields(block[:cut]), block[cut + 4 :]


class Bundle:
    """Collects records; ``finish`` gives the content and the index."""

    def __init__(self):
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[dict] = []
        self.open: list[bytes] = []
        self.raw = self.packed = 0
        self.packer = zstandard.ZstdCompressor(level=3)

    def add(self, name: str, record: bytes) -> None:
        self.index.append({"record_id": name, "frame": len(self.frames), "offset": self.raw, "length": len(record)})
        self.open.append(record)
        self.raw += len(record)
        if self.raw >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.raw))
            self.packed += len(frame)
            self.open, self.raw = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """Start, compressed size and decompressed size of each frame, read from the footer."""
    n, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    begin, at, out = len(content) - 9 - 8 * n, 0, []
    if struct.unpack("<II", content[begin - 8 : begin]) != (SKIPPABLE, 8 * n + 9):
        raise ValueError("a broken seek table")
    for k in range(n):
        packed, raw = struct.unpack_from("<II", content, begin + 8 * k)
        out.append((at, packed, raw))
        at += packed
    return out


def read_records(content: bytes, wanted: list[dict]) -> Iterator[tuple[str, bytes]]:
    """The raw records at the given frames and offsets; each frame is unpacked once, others are skipped."""
    frames, unpacker, at, raw = seek_table(content), zstandard.ZstdDecompressor(), None, b""
    for x in sorted(wanted, key=lambda x: (x["frame"], x["offset"])):
        if x["frame"] != at:
            at = x["frame"]
            start, packed, size = frames[at]
            raw = unpacker.decompress(content[start : start + packed], max_output_size=size)
        yield x["record_id"], raw[x["offset"] : x["offset"] + x["length"]]


def _write(batches):
    from pyspark import TaskContext

    part, made, bundle = TaskContext.get().partitionId(), 0, Bundle()

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{part:06d}-{made:06d}"]), pa.array([bundle.finish()], pa.binary()), pa.array([bundle.index], pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))],
            names=["bundle", "content", "records"],
        )

    for batch in batches:
        for page_id, url, html, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            payload = (html or "").encode()
            bundle.add(record_id(page_id), warc_record(page_id, url, payload, base32_sha1(payload), refers_to))
            if bundle.packed >= BUNDLE_BYTES:
                yield row()
                made, bundle = made + 1, Bundle()
    if bundle.index:
        yield row()


def payload_key(html: Column) -> Column:
    return F.sha1(F.encode(F.coalesce(html.cast("string"), F.lit("")), "utf-8"))


def bundles(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """``bundle, content, records``: archives with one record for each page.

    Payloads below ``least_bytes`` are always stored as responses.
    """
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    large = F.octet_length(text) >= least_bytes
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), text.alias("html"), F.when(large, payload_key(text)).alias("digest"))
    counts = rows.filter("digest is not null").groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    dealt = skew_safe_left_join(rows, counts, ["digest"], "n", pages.count())
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")), F.col("first"))
    return dealt.select("id", "url", "html", refers.alias("refers_to")).mapInArrow(_write, BUNDLE_TYPE)


def _read(batches):
    for batch in batches:
        for content, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out = []
            for name, raw in read_records(content, records):
                head, http, payload = parse_record(raw)
                number = lambda x: None if x.endswith(":none") else int(x.rpartition(":")[2])
                kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                size, refers = int(http["content-length"]), head.get("warc-refers-to")
                if head["warc-record-id"] != f"<{name}>" or (kind == "response" and (len(payload) != size or base32_sha1(payload) != digest)):
                    raise ValueError(f"record {name} is not what its headers say")
                out.append((number(name), size, digest, kind, number(refers.strip("<>")) if refers else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=list(names))


def read_all(archives: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record, with digests verified."""
    return archives.select("content", "records").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def fetch(archives: DataFrame, wanted: DataFrame, record: str = "record_id") -> DataFrame:
    """``record_id, raw`` of the wanted records only: the index is joined first, then only their frames are unpacked."""
    ids = wanted.select(F.col(record).alias("record_id")).distinct()
    hits = archives.select("bundle", F.explode("records").alias("r")).join(ids, F.col("r.record_id") == F.col("record_id"))
    hits = hits.groupBy("bundle").agg(F.collect_list("r").alias("records"))

    def run(batches):
        for batch in batches:
            for content, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = list(read_records(content, records))
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.string()), pa.array([r for _, r in got], pa.binary())], names=["record_id", "raw"])

    return archives.select("bundle", "content").join(hits, "bundle").select("content", "records").mapInArrow(run, "record_id string, raw binary")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as ``<bundle>.warc.zst`` into a folder that all executors share; ``bundle, path``."""

    def run(batches):
        for batch in batches:
            names, paths = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1).to_pylist(), strict=True):
                path = os.path.join(folder, f"{name}.warc.zst")
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(content)
                os.replace(f.name, path)  # whole files only, also if a task is run twice
                paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(paths)], names=["bundle", "path"])

    return archives.select("bundle", "content").mapInArrow(run, "bundle string, path string")
