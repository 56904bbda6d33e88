"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

A seeded hash of the row (its document id and its place in the input) deals rows
to tasks and orders them there; each ``group_docs`` rows in that order, or fewer
with GROUP_BYTES of text, are a group that is packed on its own. Nothing is
gathered beyond a group, repeats of one document id are spread like other rows,
and a lost task is simply run again. Within a group,
whole sequences are cut off long documents, the tails go through first-fit
decreasing, and what the fullest bins still lack is cut from the emptiest ones.
The last tokens of a group fill sequences whose lengths are powers of two, which
need no padding; no sequence is padded.

Defined cases: a null text counts as empty and gives its end id alone; rows
without a doc_id take no part; repeated rows are packed as often as they occur;
equal lengths go by doc_id, then by the ids' checksum; an empty table gives no
pieces; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import as_bytes, slices
from loomstead.llm.tokens import encoder

#: Bytes of text from which a group is closed.
GROUP_BYTES = 16 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Capacities:
    """A tournament tree over bins: finds the first bin with room for an item in O(log n)."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.room = [0] * self.width + [capacity] * bins + [0] * (self.width - bins)
        for i in range(self.width - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])

    def place(self, length: int) -> int:
        """The first bin with room for length; its room shrinks."""
        i = 1
        while i < self.width:
            i = 2 * i if self.room[2 * i] >= length else 2 * i + 1
        self.room[i] -= length
        bin_ = i - self.width
        while i > 1:
            i //= 2
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])
        return bin_


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indexes; items are taken by falling length, ties in the given order."""
    tree = Capacities(max(1, len(lengths)), capacity)
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = tree.place(lengths[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def pack(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) for items of the given lengths, cut freely.

    Every sequence is full or has a power of two of tokens.
    """
    sequences = [[(i, s, capacity)] for i, n in enumerate(lengths) for s in range(0, n - capacity + 1, capacity)]
    tails = [(i, n - n % capacity, n % capacity) for i, n in enumerate(lengths) if n % capacity]
    bins = first_fit_decreasing([n for _, _, n in tails], capacity)
    filled = [sum(tails[t][2] for t in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: -filled[b])
    total = sum(filled)
    whole = order[: total // capacity]
    spare = [tails[t] for b in order[total // capacity :] for t in bins[b]][::-1]

    def pour(sequence: list, room: int) -> list:
        while room:
            i, s, n = spare.pop()
            take = min(n, room)
            sequence.append((i, s, take))
            room -= take
            if take < n:
                spare.append((i, s + take, n - take))
        return sequence

    for b in whole:
        sequences.append(pour([tails[t] for t in bins[b]], capacity - filled[b]))
    rest = total % capacity
    for power in range(capacity.bit_length() - 1, -1, -1):
        if rest >> power & 1:
            sequences.append(pour([], 1 << power))
    return sequences


def pack_documents(
    docs: DataFrame, tokenizer_path: str, kind: str = "byte", end_id: int = 1, capacity: int = 2048,
    group_docs: int = 256, seed: int = 7, keep_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents (doc_id, text) packed to sequences of at most ``capacity`` tokens (a power of two)."""

    def packed(rows: list[tuple[int, np.ndarray]], first: int) -> tuple[pa.RecordBatch, int]:
        data = sorted(((i, zlib.crc32(ids), ids.tobytes()) for i, ids in rows), key=lambda r: r[:2])
        out, q = [], first
        for q, sequence in enumerate(pack([len(ids) // 4 for _, _, ids in data], capacity), first):
            at = 0
            for i, start, length in sequence:
                doc, _, ids = data[i]
                piece = ids[4 * start : 4 * (start + length)]
                out.append((doc, start, length, zlib.crc32(piece), len(ids) // 4, q, at, piece if keep_ids else None))
                at += length
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        kinds = [pa.int64()] * 7 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names), q + 1

    def run(batches):
        from pyspark import TaskContext

        enc, end = encoder(tokenizer_path, kind), np.asarray([end_id], "<u4")
        rows, size, q = [], 0, TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = as_bytes(batch.column(1))
                for i, text, ids in zip(batch.column(0).to_pylist(), texts, enc.encode_all(texts)):
                    rows.append((i, np.append(ids, end)))
                    size += len(text)
                    if len(rows) >= group_docs or size >= GROUP_BYTES:
                        out, q = packed(rows, q)
                        yield out
                        rows, size = [], 0
        if rows:
            yield packed(rows, q)[0]

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id())
    dealt = docs.select("doc_id", "text", row.alias("h")).where("doc_id is not null").repartition(n, "h").sortWithinPartitions("h", "doc_id")
    return dealt.select("doc_id", "text").mapInArrow(run, PIECES)
