"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits: of two fingerprints
within three bits, one segment differs by one bit at most. Each distinct
fingerprint is indexed by 64 variants, a segment with one bit deleted; equal
variants meet in a bucket and are verified. A bucket gives edges that connect
its linked members (a forest), not all pairs. A bucket of very many members is
indexed again, by one-bit-deleted variants of the halves of the other segment,
which bounds what a task can meet. Components of the edges are the groups.

Defined cases: null and empty texts have fingerprint 0 and link like any other;
rows without a doc_id are in no group and left out; repeated rows and equal texts
share a fingerprint; ties do not occur (the smallest doc_id names a group); an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import as_bytes, discard, in_few_files, slices, staged
from loomstead.llm.components import components

#: Members from which a bucket is split by variants of the other segment.
HOT_BUCKET = 2048


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a text: A-Z lower-cased, words, shingles with repeats, XXH64."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    hashes = np.array([xxh64_intdigest(line[s:e], seed) for s, e in zip(starts, stops)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp of every row of (doc_id, text)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in as_bytes(batch.column(1))], pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "doc_id long, fp long")


def _near(a: np.ndarray, b: np.uint64, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def forest(members: np.ndarray, distance: int = 3) -> list[tuple[int, int]]:
    """Edges that connect linked members of a bucket: members less components many."""
    left, edges = members.astype(np.uint64), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            u = frontier.pop()
            hit = _near(left, u, distance)
            found = left[hit]
            if len(found):
                edges += [(int(u), int(v)) for v in found]
                frontier += list(found)
                left = left[~hit]
    return edges


def _edges(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate([x[i] for x in pairs] or [np.zeros(0, np.int64)]) for i in (0, 1)]


def _bucket_edges(batches):
    for batch in batches:
        found = [(np.array(e, np.uint64).view(np.int64)[:, 0], np.array(e, np.uint64).view(np.int64)[:, 1]) for members in batch.column(0).to_pylist() if (e := forest(np.array(members, np.int64).view(np.uint64)))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _edges(found)], names=["a", "b"])


def _buckets(hot: int, distance: int = 3):
    """Sorted (key, fp) to edges (a, b) of each bucket; of a bucket of more than ``hot`` members the rows themselves (hot_key, hot_fp)."""

    def run(batches):
        key, open_ = None, []  # the bucket that the next batch may go on with

        def closed(keys: np.ndarray, fps: np.ndarray):
            """Edges and hot rows of whole buckets."""
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            n = np.diff(np.append(first, len(keys)))
            two = first[n == 2]
            near = np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= distance
            pairs, rows = [(fps[two[near]], fps[two[near] + 1])], [np.zeros(0, np.int64)]
            for at, size in zip(first[n > 2].tolist(), n[n > 2].tolist()):
                if size > hot:
                    rows.append(np.arange(at, at + size))
                elif found := forest(fps[at : at + size].view(np.uint64), distance):
                    e = np.array(found, np.uint64).view(np.int64)
                    pairs.append((e[:, 0], e[:, 1]))
            rows = np.concatenate(rows).astype(np.int64)
            return *_edges(pairs), keys[rows], fps[rows]

        def given(a, b, hot_key, hot_fp):
            none = pa.nulls(len(hot_key), pa.int64()), pa.nulls(len(a), pa.int64())
            columns = [pa.concat_arrays([pa.array(x), none[0]]) for x in (a, b)] + [pa.concat_arrays([none[1], pa.array(x)]) for x in (hot_key, hot_fp)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "hot_key", "hot_fp"])

        spilled = False  # the open bucket is hot already, its first members are given
        empty = np.zeros(0, np.int64)
        for batch in batches:
            keys, fps = (np.asarray(batch.column(i)) for i in (0, 1))
            if not len(keys):
                continue
            if open_ and keys[0] != key:
                if not spilled:
                    held = np.concatenate(open_)
                    yield given(*closed(np.full(len(held), key), held))
                open_, spilled = [], False
            last = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            if open_ and last > 0:  # the open bucket ends in this batch
                end = int(np.searchsorted(keys, key, side="right"))
                if spilled:
                    yield given(empty, empty, keys[:end], fps[:end])
                else:
                    held = np.concatenate([*open_, fps[:end]])
                    yield given(*closed(np.full(len(held), key), held))
                open_, spilled = [], False
                keys, fps, last = keys[end:], fps[end:], last - end
            if last > 0:
                yield given(*closed(keys[:last], fps[:last]))
            key = int(keys[-1])
            open_.append(fps[last:])
            if spilled or sum(map(len, open_)) > hot:
                held, spilled = np.concatenate(open_), True
                yield given(empty, empty, np.full(len(held), key), held)
                open_ = [empty]
        if open_ and not spilled:
            held = np.concatenate(open_)
            yield given(*closed(np.full(len(held), key), held))

    return run


def links(distinct: DataFrame, hot: int = HOT_BUCKET, scratch: list[str] | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all within three bits.

    Each variant is moved once, with its fingerprint; a task reads its buckets in order.
    """
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = F.col("p")
    seg = F.when(p < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    variants = distinct.repartition(n, "fp").select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")).select(
        F.expr("shiftleft(cast(p as bigint), 32)").bitwiseOR(seg.bitwiseAND(F.expr("~shiftleft(1L, p % 32)"))).alias("key"), "fp"
    )
    met = variants.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_buckets(hot), "a long, b long, hot_key long, hot_fp long")
    met = staged(met, "edges", scratch)
    # hot buckets: the other segment's halves, each less one bit, with the key; 2 ** 18 fingerprints share one at most
    more = met.where("hot_key is not null").select(F.col("hot_key").alias("key"), F.col("hot_fp").alias("fp"))
    other = F.when(F.shiftright("key", 37) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    half = F.expr("shiftright(other, if(q < 16, 0, 16)) & 65535 & ~shiftleft(1, q % 16)")
    again = (
        more.select("fp", "key", other.alias("other"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("q"))
        .select("fp", "key", "q", half.alias("half")).groupBy("key", "q", "half").agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1).select("members").mapInArrow(_bucket_edges, "a long, b long")
    )
    pairs = met.where("a is not null").select("a", "b")
    return pairs.unionByName(again).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links) of every row of (doc_id, text)."""
    scratch: list[str] = []
    prints = staged(fingerprints(docs), "fingerprints")
    rows = prints.count()
    classes = staged(in_few_files(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), rows), "classes", scratch)
    roots = components(links(classes.select("fp"), hot, scratch), scratch=scratch)
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = staged(in_few_files(placed.join(names, "root").select("fp", "component_id"), rows), "groups")
    discard(docs.sparkSession, scratch)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
