"""Near copies by exact Jaccard similarity of word shingles, found through MinHash bands.

A text is the set of its runs of five words (A-Z lower-cased; a shorter text is
one run). Texts of the same words are one class. A class has BANDS keys of ROWS
minima each: of two sets of similarity 0.8 all keys differ with a chance of
5e-5, of more similar ones less. Classes that share a key are a bucket; buckets of
the same classes are one. A bucket of two is a pair; a larger one goes to a task
with its sets, which counts the common shingles of its members and returns a forest
that connects those of 0.8 or more, not their pairs. A bucket of more than MEMBERS
classes, or of more than HELD shingles, is cut into blocks; each task gets two of
them, so that all members meet and no task holds more. Components of the links are
the groups.

The pipeline finds its near copies by SimHash (``similar``), with the exact comparison of this module.

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

from loomstead.llm.common import Words, as_bytes, discard, mix, scanned, slices, staged
from loomstead.llm.components import components

SHINGLE = 5
BANDS, ROWS = 25, 5
#: Classes and shingles that a task compares at once, at most; a larger bucket is cut into blocks of half as many.
MEMBERS, HELD = 2048, 8 << 20
#: Columns of the matrix by which common shingles are counted.
WIDE = 4096
#: Shingles that are hashed at once.
CHUNK = 256

_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def runs(words: Words) -> np.ndarray:
    """Hashes of the shingles of a text, with repeats."""
    return words.run_hashes(min(SHINGLE, words.n)) if words.n else np.zeros(0, np.uint64)


def lowered(text: bytes) -> Words:
    return Words(text.lower())  # bytes.lower() changes A-Z alone


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    return np.unique(runs(lowered(text)))


def band_keys(found: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles; repeats do not matter."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        least = np.minimum(least, (found[at : at + CHUNK] * _FACTORS[:, None]).min(axis=1))
    keys = (mix(least) * _FACTORS).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return mix(keys + np.arange(BANDS, dtype=np.uint64))


def signatures(rows: DataFrame) -> DataFrame:
    """row, doc_id, node (hash of the words), size (of the set) and keys of every row of (row, doc_id, text)."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for whole in batches:
            for batch in slices(whole, "text"):
                nodes, sizes, keys = np.zeros(batch.num_rows, np.uint64), [], []
                for i, text in enumerate(as_bytes(batch.column(2))):
                    words = lowered(text)
                    nodes[i] = xxh3_64_intdigest(words.line)
                    found = runs(words)
                    sizes.append(len(found))
                    keys.append(band_keys(found).view(np.int64))
                made = [pa.array(nodes.view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["row", "doc_id", "node", "size", "keys"])

    return rows.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, node long, size long, keys array<long>")


def _sets(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            found = [shingles(t).view(np.int64) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "found"])


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common shingles of each two of some sorted sets."""
    n = len(sets)
    shingle, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1  # a shingle of one set alone is common to none
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    keep = times[place] > 1
    owner, place = owner[keep], column[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((n, n), np.float32)
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, WIDE):
        a, b = np.searchsorted(place, [first, first + WIDE])
        has = np.zeros((n, min(WIDE, int(place[-1]) + 1 - first)), np.float32)
        has[owner[a:b], place[a:b] - first] = 1
        out += has @ has.T
    return out


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the sets of similarity 0.8 or more: sets less groups many."""
    sizes = np.array([len(s) for s in sets])
    near = 9 * common_shingles(sets) >= 4 * (sizes[:, None] + sizes)
    left, links = np.ones(len(sets), bool), []
    for start in range(len(sets)):
        if not left[start]:
            continue
        left[start], frontier = False, [start]
        while frontier:
            u = frontier.pop()
            found = np.flatnonzero(near[u] & left)
            left[found] = False
            links += [(u, int(v)) for v in found]
            frontier += found.tolist()
    return links


def _compared(table: pa.Table) -> pa.Table:
    """Links among the classes of a bucket or of two blocks."""
    nodes = table.column("node").to_pylist()
    sets = [np.asarray(x.values) for x in table.column("found").combine_chunks()]
    links = [tuple(sorted((nodes[u], nodes[v]))) for u, v in forest(sets)] if len(sets) > 1 else []
    return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def links(classes: DataFrame, rows: DataFrame, members: int = MEMBERS, held: int = HELD, scratch: list[str] | None = None) -> DataFrame:
    """Links (a, b) that connect all similar classes. classes: node, first (with a row of the class), size, keys; rows: row, text."""
    bands = classes.select("node", "first.row", "size", F.explode("keys").alias("key"))
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight")).where("n > 1")
    met = staged(bands.join(buckets, "key"), "met", scratch)
    fits = (F.col("n") <= members) & (F.col("weight") <= held)
    whole = met.where(fits).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes")).select("nodes").distinct()
    whole = staged(whole, "buckets", scratch)
    pairs = whole.where("size(nodes) = 2").select(F.col("nodes")[0].alias("a"), F.col("nodes")[1].alias("b"))
    several = whole.where("size(nodes) > 2").select(F.xxhash64("nodes").alias("bucket"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.explode("nodes").alias("node"))
    return compared(met, pairs, several, met.where(~fits), rows, members, held, scratch)


def compared(met: DataFrame, pairs: DataFrame, several: DataFrame, large: DataFrame, rows: DataFrame, members: int, held: int, scratch: list[str] | None) -> DataFrame:
    """Links (a, b) that connect all classes of similarity 0.8 or more among those that met.

    met: row, node of all; pairs: a, b; several: bucket, i, j, node of what one task
    compares; large: key, node, n, weight of the buckets that are cut into blocks.
    """
    # blocks of half a task's load; a member goes to a task with each other block of its bucket
    blocks = F.greatest(F.lit(2), F.ceil(F.col("n") * 2 / members), F.ceil(F.col("weight") * 2 / held)).cast("int")
    block = large.select("key", "node", blocks.alias("m"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"))
    spread = block.select("key", "node", "own", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other")).where("own <> other")
    spread = spread.select(F.col("key").alias("bucket"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node")
    wanted = met.select("row", "node").distinct()
    sets = staged(rows.select("row", "text").join(wanted, "row").select("node", "text").mapInArrow(_sets, "node long, found array<long>"), "sets", scratch)
    left, right = (sets.select(F.col("node").alias(x), F.col("found").alias(f"{x}_found"), F.size("found").alias(f"{x}_n")) for x in "ab")
    both = pairs.join(right, "b").join(left, "a").where("5 * least(a_n, b_n) >= 4 * greatest(a_n, b_n)")
    two = both.where("9 * size(array_intersect(a_found, b_found)) >= 4 * (a_n + b_n)").select("a", "b")
    more = several.unionByName(spread).join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(_compared, "a long, b long")
    return two.unionByName(more).distinct()


def _grouped(docs: DataFrame, **bounds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with their numbers; row, doc_id, node of each; of each class, the first (doc_id, row) of its group."""
    scratch: list[str] = []
    rows = scanned(docs).where("doc_id is not null").withColumn("row", F.monotonically_increasing_id())
    prints = staged(signatures(rows), "signatures")
    classes = staged(prints.groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys")), "classes", scratch)
    roots = components(links(classes, rows, scratch=scratch, **bounds), scratch=scratch)
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
