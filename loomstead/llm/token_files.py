"""Token files of directly addressable codes: any token by its place, without decoding a block.

An id is split into chunks of ``bits`` bits. Level 0 holds the lowest chunk of
every id; a bitmap says which ids go on, and level 1 holds the next chunk of
those alone, and so on. A rank directory (a running count for each 64 bytes of
bitmap) finds an id's place in the next level in constant time.

File: magic, JSON header length, JSON header (levels, counts, documents),
then for each level its chunks, its bitmap and its directory. All integers are
little-endian.

Defined cases: a null text counts as empty and gives the end id alone; rows
without a doc_id take no part; rows with equal doc_id go by text; an empty
table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm.common import as_bytes, fresh_path, slices
from loomstead.llm.tokens import encoder

MAGIC = b"LSDAC001"
#: Bytes of bitmap for each entry of a rank directory.
STEP = 64


def encode_levels(ids: np.ndarray, bits: int = 8) -> list[tuple[bytes, bytes, bytes]]:
    """(chunks, bitmap, directory) of each level; ids of any size below 2 ** 32."""
    levels, rest = [], ids.astype(np.uint32)
    kind = np.uint8 if bits <= 8 else np.uint16
    while True:
        chunks = (rest & np.uint32((1 << bits) - 1)).astype(kind)
        rest = rest >> np.uint32(bits)
        more = rest > 0
        bitmap = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(np.bitwise_count(bitmap), np.arange(0, len(bitmap), STEP), dtype=np.uint64) if len(bitmap) else np.zeros(0, np.uint64)
        directory = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])
        levels.append((chunks.tobytes(), bitmap.tobytes(), directory.astype("<u8").tobytes()))
        rest = rest[more]
        if not len(rest):
            return levels


def write_file(path: str, doc_ids: list[int], documents: list[np.ndarray], bits: int = 8) -> int:
    """Write documents (uint32 ids) to a file; its number of ids. The name appears once it is whole."""
    ids = np.concatenate([np.zeros(0, "<u4"), *documents])
    levels = encode_levels(ids, bits)
    starts = np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype("<i8")
    head = json.dumps({"bits": bits, "ids": len(ids), "documents": len(doc_ids), "levels": [[len(p) for p in level] for level in levels]}).encode()
    filesystem, name = pafs.FileSystem.from_uri(path)
    filesystem.create_dir(name.rpartition("/")[0], recursive=True)
    with filesystem.open_output_stream(f"{name}.part") as out:
        out.write(MAGIC + struct.pack("<I", len(head)) + head)
        out.write(np.asarray(doc_ids, "<i8").tobytes() + starts.tobytes())
        for level in levels:
            for part in level:
                out.write(part)
    filesystem.move(f"{name}.part", name)
    return len(ids)


class TokenFile:
    """Reads a token file: one token by its place (a few bytes of each level are read), or all."""

    def __init__(self, path: str):
        filesystem, name = pafs.FileSystem.from_uri(path)
        self.file = filesystem.open_input_file(name)
        lead = self._read(0, 12)
        assert lead[:8] == MAGIC, "not a token file"
        (n,) = struct.unpack_from("<I", lead, 8)
        head = json.loads(self._read(12, n))
        self.bits, self.n, self.documents = head["bits"], head["ids"], head["documents"]
        self.kind = np.dtype(np.uint8 if self.bits <= 8 else np.uint16)
        self._table = at = 12 + n
        at += 8 * (2 * self.documents + 1)
        #: of each level: where its chunks, its bitmap and its directory begin, and the sizes of these
        self.levels = []
        for sizes in head["levels"]:
            self.levels.append((at, at + sizes[0], at + sizes[0] + sizes[1], sizes))
            at += sum(sizes)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    @property
    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self._read(self._table, 8 * self.documents), "<i8")

    @property
    def starts(self) -> np.ndarray:
        """Where each document begins, and the end."""
        return np.frombuffer(self._read(self._table + 8 * self.documents, 8 * (self.documents + 1)), "<i8")

    def token(self, place: int) -> int:
        """The id at a place: one chunk a level, with a rank in the directory between levels."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = 0
        for level, (chunks, bitmap, directory, _) in enumerate(self.levels):
            width = self.kind.itemsize
            value |= int.from_bytes(self._read(chunks + width * place, width), "little") << level * self.bits
            byte, bit = divmod(place, 8)
            block = byte // STEP
            inside = self._read(bitmap + block * STEP, byte + 1 - block * STEP)
            if not inside[-1] >> bit & 1:
                break
            below = int.from_bytes(self._read(directory + 8 * block, 8), "little")
            inside = inside[:-1] + bytes([inside[-1] & (1 << bit) - 1])
            place = below + int.from_bytes(inside, "little").bit_count()
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out, alive = np.zeros(self.n, np.uint32), np.arange(self.n)
        for level, (chunks, bitmap, _, sizes) in enumerate(self.levels):
            out[alive] |= np.frombuffer(self._read(chunks, sizes[0]), self.kind).astype(np.uint32) << np.uint32(level * self.bits)
            goes_on = np.frombuffer(self._read(bitmap, sizes[1]), np.uint8)
            alive = alive[np.unpackbits(goes_on, count=len(alive), bitorder="little").astype(bool)]
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, kind: str = "word", end_id: int = 2, bits: int = 8, partitions: int | None = None, file_ids: int = 4 << 20) -> DataFrame:
    """Encode (doc_id, text) in ascending doc_id order to token files below ``path``.

    Returns a row for each file: path, first doc_id, its place in the order, ids and
    documents. A file's ids are bounded by ``file_ids`` and one document; a task that
    is run again writes other names, and only the listed names count.
    """
    spark = docs.sparkSession

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, doc_ids, documents, size, number = encoder(tokenizer_path, kind), [], [], 0, 0
        end = np.asarray([end_id], "<u4")

        def flush():
            name = f"{path}/{part:06d}-{number:06d}-{uuid.uuid4().hex}.dac"
            ids = write_file(name, doc_ids, documents, bits)
            return pa.RecordBatch.from_pydict({"path": [name], "part": [part], "number": [number], "ids": [ids], "documents": [len(doc_ids)]})

        for whole in batches:
            for batch in slices(whole, "text"):
                for i, ids in zip(batch.column(0).to_pylist(), enc.encode_all(as_bytes(batch.column(1)))):
                    doc_ids.append(i)
                    documents.append(np.append(ids, end))
                    size += len(ids) + 1
                    if size >= file_ids:
                        yield flush()
                        doc_ids, documents, size, number = [], [], 0, number + 1
        if doc_ids:
            yield flush()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").where("doc_id is not null").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(run, "path string, part long, number long, ids long, documents long")
    files.write.parquet(f"{path}/files")
    return spark.read.parquet(f"{path}/files")


def read_tokens(files: DataFrame) -> DataFrame:
    """Documents of the listed files: doc_id, start (ids of all before it), ids (uint32 bytes)."""
    from pyspark.sql import Window

    # one row a file of millions of ids: the order of files is found in one task
    placed = files.withColumn("base", F.sum("ids").over(Window.orderBy("part", "number")) - F.col("ids"))

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with TokenFile(path) as f:
                    data, doc_ids, starts = f.all().astype("<u4").tobytes(), f.doc_ids, f.starts
                for at in range(0, len(doc_ids), 2000):
                    to = min(at + 2000, len(doc_ids))
                    s = starts[at : to + 1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[at:to]), pa.array(base + s[:-1]), pa.array([data[4 * a : 4 * b] for a, b in zip(s[:-1].tolist(), s[1:].tolist())], pa.binary())],
                        names=["doc_id", "start", "ids"],
                    )

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("path", "base").repartition(n, "path").mapInArrow(run, "doc_id long, start long, ids binary")


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents as read_tokens gives them."""
    return documents.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write all documents to token files in the shared folder and read them back."""
    return read_tokens(write_tokens(docs, fresh_path(spark, "tokens"), tokenizer_path, **options))
