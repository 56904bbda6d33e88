"""Near copies by exact Jaccard similarity of word shingles, found through SimHash deletion variants.

A text is the set of its runs of five words (A-Z lower-cased; a shorter text is
one run). Texts of the same words are one class. A class has a SimHash of 512 bits
over its set, in 32 segments of 16. Sets of similarity 0.8 differ in some 15 % of
the bits, so a segment is indexed by its variants with one bit deleted: each of the
32 segments of two such sets meets with a chance of 0.28, and all fail to with one
of 3e-5 (3e-3 for sets of four and five shingles, whose sums often tie; less for
more similar sets). A variant leaves one half of its segment whole. Only that half is
moved, with the class; the eight variants of the other are made in the task that
has all classes of the half, and equal variants are compared by size and by 256
bits, of which 64 may differ (a chance of 2e-5; 76 for tiny sets; unrelated sets differ in 128 +- 8).
What a task finds are forests, not pairs.

Components of these candidates are compared exactly: every two classes of a
component, not only those that met. A component of two is a pair; a larger one goes
to a task with its sets, in blocks beyond a bound. Components of the links of
similarity 0.8 or more are the groups.

Defined cases: null and empty texts are one class; rows without a doc_id are in
no group and left out; repeated rows are of one class; rows with one doc_id and
different texts are of their own classes; an empty table gives no
rows; other columns are not read, unless they are asked for. Classes and shingles are named by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import as_bytes, discard, mix, scanned, slices, staged
from loomstead.llm.components import components, rooted
from loomstead.llm.minhash import HELD, MEMBERS, compared, lowered, runs

#: Bytes of a fingerprint; a segment is two of them.
BYTES = 64
#: Bits that may differ in the first 64 and in the first 256; the latter for sets of at most TINY shingles, too.
FIRST, FAR, FAR_TINY, TINY = 24, 64, 76, 8
#: Members from which a bucket is searched member by member instead of by all pairs.
HOT_BUCKET = 1024
#: Buckets and members that are compared at once.
TOGETHER, AT_ONCE = 32, 1 << 16
#: Edges (16 bytes each) up to which one task finds the components; more take rounds in the cluster.
FEW_EDGES = 1 << 18

MEMBER = np.dtype([("node", "<i8"), ("size", "<i4"), ("bits", "<u8", 4), ("other", "u1")])
_FACTORS = mix(np.arange(1, BYTES // 8 + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def fingerprint(found: np.ndarray) -> bytes:
    """SimHash of a set of 64-bit hashes: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(8 * BYTES, np.int64)
    for at in range(0, len(found), 255):  # sums of so many bits fit a byte
        h = mix(found[at : at + 255, None] * _FACTORS)
        counts += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(found), bitorder="little").tobytes()


def signatures(rows: DataFrame) -> DataFrame:
    """row, doc_id, node (hash of the words), size (of the set) and bits of every row of (row, doc_id, text)."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for whole in batches:
            for batch in slices(whole, "text"):
                nodes, sizes, bits = np.zeros(batch.num_rows, np.uint64), [], []
                for i, text in enumerate(as_bytes(batch.column(2))):
                    words = lowered(text)
                    nodes[i] = xxh3_64_intdigest(words.line)
                    found = np.unique(runs(words))
                    sizes.append(len(found))
                    bits.append(fingerprint(found))
                made = [pa.array(nodes.view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["row", "doc_id", "node", "size", "bits"])

    return rows.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, node long, size long, bits binary")


def _dealt(batches):
    """(node, size, bits) to (bucket, members): for each byte of the bits, the classes by its value, with the segment's other byte."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, BYTES)
        members = np.zeros(n, MEMBER)
        members["node"] = np.asarray(batch.column(0))
        members["size"] = np.minimum(np.asarray(batch.column(1)), (1 << 31) - 1)
        members["bits"] = np.ascontiguousarray(bits[:, :32]).view("<u8")
        for at in range(BYTES):
            members["other"] = bits[:, at ^ 1]
            order = np.argsort(bits[:, at], kind="stable")
            half = bits[order, at]
            first = np.flatnonzero(np.r_[True, half[1:] != half[:-1]])
            ends = np.append(first, n) * MEMBER.itemsize
            data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(members[order].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(half[first].astype(np.int32) + 256 * at), data], names=["bucket", "members"])


def _alike(bits: np.ndarray, size: np.ndarray, a, b) -> np.ndarray:
    """Whether members a and b (of no smaller sets) may be of similarity 0.8."""
    far = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=-1, dtype=np.int64)
    return far <= np.where(np.maximum(size[a], size[b]) <= TINY, FAR_TINY, FAR)


def met(members: np.ndarray, group: np.ndarray, hot: int = HOT_BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, node) that connect what meets in a variant; group: number of each member's bucket, below TOGETHER."""
    order = np.argsort(members["size"], kind="stable")
    members, group = members[order], group[order].astype(np.uint16)
    node, bits, size = (np.ascontiguousarray(members[x]) for x in ("node", "bits", "size"))
    size, start = size.astype(np.int64), np.ascontiguousarray(bits[:, 0])
    bit = np.arange(8, dtype=np.uint16)
    variants = members["other"][:, None].astype(np.uint16) & ~(np.uint16(1) << bit)
    keys = ((group[:, None] << np.uint16(11)) | (bit << np.uint16(8)) | variants).ravel()
    order = np.argsort(keys, kind="stable")  # of one variant by size
    keys, who = keys[order], order >> 3
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    n = np.diff(np.append(first, len(keys)))
    ends = np.repeat(np.where(n <= hot, first + n, 0), n)
    pairs, left, d = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], np.arange(len(keys)), 1
    while len(left):
        left = left[left + d < ends[left]]
        a, b = who[left], who[left + d]
        fits = 5 * size[a] >= 4 * size[b]  # the next ones are larger still
        left, a, b = left[fits], a[fits], b[fits]
        near = np.bitwise_count(start[a] ^ start[b]) <= FIRST
        a, b = a[near], b[near]
        near = _alike(bits, size, a, b)
        pairs.append((a[near], b[near]))
        d += 1
    for at, count in zip(first[n > hot].tolist(), n[n > hot].tolist()):
        rest = who[at : at + count]
        while len(rest):
            frontier, rest = [rest[0]], rest[1:]
            while frontier and len(rest):
                u = frontier.pop()
                hit = _alike(bits, size, u, rest) & (5 * np.minimum(size[u], size[rest]) >= 4 * np.maximum(size[u], size[rest]))
                if hit.any():
                    pairs.append((np.full(int(hit.sum()), u), rest[hit]))
                    frontier += rest[hit].tolist()
                    rest = rest[~hit]
    a, b = (np.concatenate([x[i] for x in pairs]) for i in (0, 1))
    return rooted(node[a], node[b])


def _buckets(hot: int):
    """(bucket, members) in order of the bucket to edges (a, b)."""

    def run(batches):
        parts, groups, held, last = [], [], 0, None

        def closed():
            members = np.frombuffer(b"".join(parts), MEMBER)
            a, b = met(members, np.repeat(groups, [len(p) // MEMBER.itemsize for p in parts]), hot)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != last:
                    if parts and (groups[-1] == TOGETHER - 1 or held >= AT_ONCE):
                        yield closed()
                        parts, groups, held = [], [], 0
                    last, number = bucket, groups[-1] + 1 if groups else 0
                parts.append(data.as_py())
                groups.append(number)
                held += len(parts[-1]) // MEMBER.itemsize
        if parts:
            yield closed()

    return run


def candidates(classes: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """Edges (a, b) that connect the classes (node, size, bits) whose fingerprints meet and are near."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = classes.select("node", "size", "bits").repartition(n, "node").mapInArrow(_dealt, "bucket int, members binary")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_buckets(hot), "a long, b long").distinct()


def links(classes: DataFrame, rows: DataFrame, members: int = MEMBERS, held: int = HELD, hot: int = HOT_BUCKET, scratch: list[str] | None = None, few: int = FEW_EDGES) -> DataFrame:
    """Links (a, b) that connect all similar classes. classes: node, first (with a row of the class), size, bits; rows: row, text."""
    roots = components(candidates(classes, hot), scratch=scratch, few=few)
    found = classes.select("node", "first.row", "size").join(roots.select("node", F.col("root").alias("key")), "node")
    found = staged(found, "candidates", scratch)
    weights = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"))
    together = found.join(weights, "key")
    pairs = together.where("n = 2").groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b")
    fits = (F.col("n") <= members) & (F.col("weight") <= held)
    several = together.where(fits & (F.col("n") > 2)).select(F.col("key").alias("bucket"), F.lit(0).alias("i"), F.lit(0).alias("j"), "node")
    return compared(together, pairs, several, together.where(~fits & (F.col("n") > 2)), rows, members, held, scratch)


def _grouped(docs: DataFrame, few: int = FEW_EDGES, **bounds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with their numbers; row, doc_id, node of each; of each class, the first (doc_id, row) of its group."""
    scratch: list[str] = []
    rows = scanned(docs).where("doc_id is not null").withColumn("row", F.monotonically_increasing_id())
    prints = staged(signatures(rows), "signatures")
    classes = staged(prints.groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("size").alias("size"), F.first("bits").alias("bits")), "classes", scratch)
    roots = components(links(classes, rows, scratch=scratch, few=few, **bounds), scratch=scratch, few=few)
    placed = classes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("group"))
    groups = staged(placed.join(firsts, "root").select("node", "group"), "groups")
    discard(docs.sparkSession, scratch)
    return rows, prints, groups


def near_copies(docs: DataFrame, **bounds) -> DataFrame:
    """doc_id, node, component_id (smallest doc_id of the group) of every row of (doc_id, text)."""
    _, prints, groups = _grouped(docs, **bounds)
    return prints.select("doc_id", "node").join(groups, "node").select("doc_id", "node", F.col("group.doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, columns: list[str], **bounds) -> DataFrame:
    """The named columns of one row of each group: that of the smallest doc_id, the first in the input if there are several."""
    rows, _, groups = _grouped(docs, **bounds)
    return rows.join(groups.select(F.col("group.row").alias("row")).distinct(), "row", "left_semi").select(*columns)
