"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about ``frame_bytes``; a bundle
ends in a seek table (a skippable frame, in the public seekable format), and an
index maps each record to its frame and its place in the frame. A record is read
by decompressing one frame. Records with equal payloads are stored once: the
one with the largest page_id is a response, the others are revisits that name it.

Defined cases: null html is an empty payload; rows without a page_id take no
part; equal payloads of equal page_ids are all responses if that page_id is the
largest, else all revisits; an empty table gives no bundles and no rows; other
columns are not read (``url`` is, where it is there; null is left out).
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm.common import as_bytes, fresh_path, slices

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = "bundle string, page_id long, frame long, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit without."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if refers_to is None:
        body += payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:loomstead:page:{page_id}>",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:loomstead:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace") + body + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record that starts at a place."""
    end = data.index(b"\r\n\r\n", at)
    head = data[at:end].decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) for line in head[1:])
    start = end + 4
    stop = start + int(fields["Content-Length"])
    return fields, data[data.index(b"\r\n\r\n", start) + 4 : stop], stop + 4


class BundleWriter:
    """Writes frames to a bundle and, on close, the seek table."""

    def __init__(self, path: str, level: int = 3):
        import zstandard

        self.filesystem, self.name = pafs.FileSystem.from_uri(path)
        self.filesystem.create_dir(self.name.rpartition("/")[0], recursive=True)
        self.out = self.filesystem.open_output_stream(f"{self.name}.part")
        self.compressor, self.frames = zstandard.ZstdCompressor(level=level), []

    def frame(self, data: bytes) -> None:
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data)))

    def close(self) -> None:
        table = b"".join(struct.pack("<II", a, b) for a, b in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        self.filesystem.move(f"{self.name}.part", self.name)


class Bundle:
    """Random access to a bundle by its seek table."""

    def __init__(self, path: str):
        import zstandard

        filesystem, name = pafs.FileSystem.from_uri(path)
        self.file = filesystem.open_input_file(name)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        assert magic == SEEKABLE_MAGIC, "no seek table"
        table = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.sizes = [struct.unpack_from("<II", table, 8 * i) for i in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        packed, size = self.sizes[number]
        return self.decompressor.decompress(self.file.read_at(packed, self.starts[number]), max_output_size=size)

    def record(self, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        fields, payload, _ = parse_record(self.frame(frame)[offset : offset + length])
        return fields, payload


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html and the page_id that holds the payload (``original``)."""
    has_url = "url" in pages.columns
    rows = pages.where("page_id is not null").select("page_id", (F.col("url") if has_url else F.lit(None).cast("string")).alias("url"), "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("key"))
    largest = rows.groupBy("key").agg(F.max("page_id").alias("original"))  # hot payloads are combined before the shuffle
    return rows.join(largest, "key").drop("key")


def write_archives(pages: DataFrame, path: str, frame_bytes: int = 128 << 10, bundle_bytes: int = 256 << 20) -> DataFrame:
    """Write a record per page to bundles below ``path``; returns the index, also kept there as Parquet.

    A task that is run again writes bundles of other names; the index, which Spark
    commits, has only those of the attempts that count.
    """
    spark = pages.sparkSession

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        writer, name, frame, rows, size = None, "", b"", [], 0

        def index():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.string()] + [pa.int64()] * 4)], names=["bundle", "page_id", "frame", "offset", "length"])

        for whole in batches:
            for batch in slices(whole, "html"):
                for page_id, url, payload, original in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist()):
                    if writer is None:
                        name = f"{path}/{part:06d}-{uuid.uuid4().hex}.warc.zst"
                        writer, size = BundleWriter(name), 0
                    record = record_bytes(page_id, url, payload, payload_digest(payload), len(payload), None if page_id == original else original)
                    rows.append((name, page_id, len(writer.frames), len(frame), len(record)))
                    frame += record
                    if len(frame) >= frame_bytes:
                        size += len(frame)
                        writer.frame(frame)
                        frame = b""
                        if size >= bundle_bytes:
                            writer.close()
                            writer = None
                if rows:
                    yield index()
                    rows = []
        if writer is not None:
            if frame:
                writer.frame(frame)
            writer.close()

    with_originals(pages).mapInArrow(run, INDEX).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every indexed record, read back frame by frame; digests of responses are checked."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        bundle, path, frame, number = None, None, b"", -1
        for batch in batches:
            out = []
            for name, f, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if name != path:
                    bundle, path, number = Bundle(name), name, -1
                if f != number:
                    frame, number = bundle.frame(f), f
                fields, payload, _ = parse_record(frame[offset : offset + length])
                page_id = int(fields["WARC-Record-ID"].rpartition(":")[2][:-1])
                refers = fields.get("WARC-Refers-To")
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if refers is None and payload_digest(payload) != digest:
                    raise ValueError(f"record {page_id} of {name}: its payload doesn't have its digest")
                out.append((page_id, fields.get("WARC-Target-URI"), fields["WARC-Type"], int(refers.rpartition(":")[2][:-1]) if refers else None, int(fields["X-Payload-Length"]), digest, payload if payloads else None))
            if out:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    placed = index.select("bundle", "frame", "offset", "length").repartition(n, "bundle", F.expr("frame div 32")).sortWithinPartitions("bundle", "frame", "offset")
    return placed.mapInArrow(run, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read every record back."""
    return read_archives(write_archives(pages, fresh_path(spark, "warc")), payloads=False)
