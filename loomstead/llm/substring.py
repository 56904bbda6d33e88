"""Substring dedup by suffix trees over the suffixes that can repeat, partitioned by variable-length keys.

A window is ``min_words`` consecutive words. A word goes if it lies in a window
that also starts in a document with a smaller doc_id (judged on the input).

1. Each text is read once: a 128-bit hash of its words, and its anchors. Texts equal
   word by word form classes; all but the smallest doc_id go whole and take no
   further part.
2. Each window has an anchor: among the runs of k words in it, the leftmost with
   the least hash. Equal windows have equal anchors, so a window can repeat
   only if its anchor occurs in two texts: the rest of the corpus is not moved.
3. The suffixes that start at such windows are dealt out by keys of variable
   length: by the anchor's k words where it has few occurrences, by all words of the
   window where it has many. Equal suffixes are combined before the shuffle.
4. A task takes its keys in order, a memory-sized group at a time, and builds the
   group's suffix tree: sorted suffixes with the lengths of common prefixes. Its
   internal nodes at a depth of ``min_words`` or more are the repeats; each has the
   smallest doc_id below it.
5. Each text gets its windows' nodes back and drops the covered words.

The keys of step 3 are not prefixes of the suffixes, as suffix trees partitioned by
prefix have them: an anchor may start at any of the first words of a window. Prefix
keys would move every suffix of the corpus.

Hashes route and filter; a repeat is one of equal words (a suffix is known
by 128 bits of hash when its node is handed back, and so is a text that goes whole).

Defined cases: null and empty texts have no words; rows without a doc_id are left
out; repeated rows do not remove each other (no smaller doc_id), nor do rows with
one doc_id and different texts; texts of fewer words than a window stay whole;
an empty table gives no rows. Columns beyond doc_id and text are not read, unless
named in ``carry``; they come back in the struct column ``carry``.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import Words, as_bytes, discard, slices, staged

#: Occurrences of an anchor from which its suffixes are dealt by the whole window.
HOT_ANCHOR = 4096
#: Suffix rows of a memory-sized group.
GROUP_ROWS = 1 << 15


def content_hash(line: bytes) -> tuple[int, int]:
    """128 bits that stand for the words of a text."""
    return struct.unpack("<qq", hashlib.md5(line).digest())


def run_length(min_words: int) -> int:
    """Words of an anchor."""
    return max(1, min_words - 8)


def anchors(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window: its anchor's hash (48 bits, as int64) and first word."""
    n = words.n - min_words + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = run_length(min_words)
    h = (words.run_hashes(k) >> np.uint64(16)).view(np.int64)
    width = min_words - k + 1
    place = np.empty(n, np.int64)
    for at in range(0, n, 1 << 15):
        to = min(n, at + (1 << 15))
        view = np.lib.stride_tricks.sliding_window_view(h[at : to + width - 1], width)
        place[at:to] = view.argmin(axis=1) + np.arange(at, to)
    return h[place], place


def anchor_runs(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where the runs of windows of one anchor begin."""
    return np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(h) else np.zeros(0, np.int64)


def _read(min_words: int):
    """(doc_id, content, high, anchors, times) of each text of a window at least: distinct anchors and their occurrences."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, hashes, lists, times = [], [], [], []
                for i, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                    words = Words(text)
                    if words.n >= min_words:
                        h, place = anchors(words, min_words)
                        found, n = np.unique(h[anchor_runs(h, place)], return_counts=True)
                        ids.append(i)
                        hashes.append(content_hash(words.line))
                        lists.append(found)
                        times.append(n)
                if ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                    columns = [pa.array(ids, pa.int64()), *(pa.array([x[k] for x in hashes], pa.int64()) for k in (0, 1)), pa.ListArray.from_arrays(offsets, np.concatenate(lists)), pa.ListArray.from_arrays(offsets, np.concatenate(times).astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "content", "high", "anchors", "times"])

    return run


def suffix_rows(words: Words, wanted: dict[int, bool], min_words: int):
    """(route, first word, windows, suffix text) of the windows whose anchor is wanted (value: hot).

    Windows in a row with one anchor share a row, whose text holds them all; with a
    hot anchor each has its own, routed by the whole window.
    """
    h, place = anchors(words, min_words)
    if not len(h):
        return
    starts = anchor_runs(h, place)
    ends = np.r_[starts[1:], len(h)]
    line, first, last = words.line, words.starts, words.ends
    whole = None
    for s, e, anchor in zip(starts.tolist(), ends.tolist(), h[starts].tolist()):
        hot = wanted.get(anchor)
        if hot is None:
            continue
        if hot:
            whole = words.run_hashes(min_words).view(np.int64) if whole is None else whole
            for w in range(s, e):
                yield int(whole[w]), w, 1, line[first[w] : last[w + min_words - 1]]
        else:
            yield anchor, s, e - s, line[first[s] : last[e + min_words - 2]]


def suffix_key(route: int, suffix: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(suffix, digest_size=8).digest(), "little", signed=True)


def _suffixes(min_words: int, combine: bool):
    """combine: (route, suffix, doc_id), the smallest doc_id of equal ones; else (doc_id, content, at, route, key)."""

    def run(batches):
        for whole in batches:
            found: dict[tuple[int, bytes], int] = {}
            columns: list[list] = [[], [], [], [], []]
            for batch in slices(whole, "text"):
                for i, text, listed, hots, copies in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), *(batch.column(c).to_pylist() for c in (2, 3, 4))):
                    wanted = dict.fromkeys(listed or (), False) | dict.fromkeys(hots or (), True)
                    if not wanted:
                        continue
                    words = Words(text)
                    content = content_hash(words.line)[0]
                    if copies and content in copies:
                        continue
                    for route, at, _, suffix in suffix_rows(words, wanted, min_words):
                        if combine:
                            found[route, suffix] = min(i, found.get((route, suffix), i))
                        else:
                            for column, x in zip(columns, (i, content, at, route, suffix_key(route, suffix))):
                                column.append(x)
                if len(found) > 200_000:
                    yield _combined(found)
                    found = {}
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "content", "at", "route", "key"])
                    columns = [[], [], [], [], []]
            if found:
                yield _combined(found)

    return run


def _combined(found: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r for r, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary()), pa.array(list(found.values()), pa.int64())], names=["route", "suffix", "doc_id"]
    )


class Subtree:
    """The suffix tree of some rows of words: their sorted suffixes and the lengths of common prefixes.

    Only suffixes of ``min_words`` words or more are in it. An internal node is a run of
    suffixes with a common prefix of its depth.
    """

    def __init__(self, rows: list[bytes], min_words: int):
        self.min_words, names = min_words, {}
        word = np.array([names.setdefault(w, len(names)) for w in b" ".join(rows).split(b" ")], np.int64)
        sizes = np.array([r.count(b" ") + 1 for r in rows], np.int64)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(word))
        self.starts = np.flatnonzero(left >= min_words)
        self.row = np.repeat(np.arange(len(rows)), sizes)[self.starts]
        self.windows = np.maximum(0, sizes - min_words + 1)  # suffixes of each row
        left = left[self.starts]
        # several words a sort key; 0: the row has ended
        bits = len(names).bit_length()
        each, deepest = 63 // bits, int(left.max(initial=0))
        keys, long = [], np.append(word + 1, np.zeros(deepest + each, np.int64))
        for at in range(0, deepest, each):
            key = np.zeros(len(self.starts), np.int64)
            for j in range(at, at + each):
                key = (key << bits) | np.where(j < left, long[self.starts + j], 0)
            keys.append(key)
        self.order = np.lexsort(keys[::-1]) if keys else np.zeros(0, np.int64)
        #: words that each sorted suffix shares with the one before it
        self.common = np.zeros(len(self.order), np.int64)
        same = np.ones(max(0, len(self.order) - 1), bool)
        for key in keys:
            key = key[self.order]
            for shift in range(bits * (each - 1), -1, -bits):
                part = (key >> shift) & ((1 << bits) - 1)
                same &= (part[1:] == part[:-1]) & (part[1:] > 0)
                self.common[1:] += same

    def deep_nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, end, depth) of the topmost nodes of a depth of ``min_words`` or more; a leaf alone has its own."""
        first = np.flatnonzero(self.common < self.min_words)
        end = np.append(first[1:], len(self.order))
        inner = np.where(np.arange(len(self.common)) == np.repeat(first, end - first), np.iinfo(np.int64).max, self.common)
        return first, end, np.minimum.reduceat(inner, first) if len(first) else first

    def least(self, owners: np.ndarray) -> np.ndarray:
        """Of each suffix, by its place in the rows: the smallest owner below its deep node."""
        first, end, _ = self.deep_nodes()
        out = np.empty(len(self.order), np.int64)
        if len(first):
            out[self.order] = np.repeat(np.minimum.reduceat(owners[self.row[self.order]], first), end - first)
        return out


def _subtrees(min_words: int):
    """Sorted (route, suffix, doc_id) to (route, key, nodes): a memory-sized group of whole routes at a time."""

    def answer(rows: dict[tuple[int, bytes], int]):
        keys = list(rows)
        tree = Subtree([s for _, s in keys], min_words)
        least = tree.least(np.fromiter(rows.values(), np.int64, len(rows)))
        nodes = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(tree.windows)]).astype(np.int32), least)
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in keys], pa.int64()), pa.array([suffix_key(r, s) for r, s in keys], pa.int64()), nodes], names=["route", "key", "nodes"])

    def run(batches):
        rows: dict[tuple[int, bytes], int] = {}
        last = None
        for batch in batches:
            for route, suffix, doc_id in zip(*(c.to_pylist() for c in batch.columns)):
                if route != last and len(rows) >= GROUP_ROWS:
                    yield answer(rows)
                    rows = {}
                last = route
                had = rows.get((route, suffix))
                rows[route, suffix] = doc_id if had is None else min(had, doc_id)
        if rows:
            yield answer(rows)

    return run


def _cleaned(min_words: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                texts, out = as_bytes(batch.column(1)), {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": [], "spans": []}
                for text, found, copies in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    words = text.split()
                    n = len(words)
                    line = b" ".join(words)
                    if not found and not copies:
                        for name, x in (("n_words", n), ("n_removed", 0), ("kept_sha256", hashlib.sha256(line).hexdigest()), ("kept", text), ("spans", [])):
                            out[name].append(x)
                        continue
                    content = content_hash(line)[0]
                    cover = np.zeros(n + 1, np.int64)
                    if copies and content in copies and n >= min_words:
                        cover[0], cover[n] = 1, -1
                    for f in found or ():
                        if f["content"] == content:
                            for j, gone in enumerate(f["gone"]):
                                if gone:
                                    cover[f["at"] + j] += 1
                                    cover[f["at"] + j + min_words] -= 1
                    gone = np.cumsum(cover[:n]) > 0 if n else np.zeros(0, bool)
                    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                    edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                    removed = int(gone.sum())
                    for name, x in (("n_words", n), ("n_removed", removed), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept if removed else text), ("spans", [{"start": s, "length": e - s} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())])):
                        out[name].append(x)
                span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
                kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "spans": span}
                columns = [pa.array(out[k], kinds[k]) for k in out]
                columns[3] = columns[3].cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *([batch.column(4)] if batch.num_columns > 4 else [])], names=["doc_id", *out, *(["carry"] if batch.num_columns > 4 else [])])

    return run


def dedup(docs: DataFrame, min_words: int = 13, carry: list[str] | None = None, hot: int = HOT_ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the text; as it was if nothing goes), spans (words that go) [, carry]."""
    texts = docs.where("doc_id is not null").select("doc_id", "text", *([F.struct(*carry).alias("carry")] if carry else []))
    plain = texts.select("doc_id", "text")
    scratch: list[str] = []
    read = staged(plain.mapInArrow(_read(min_words), "doc_id long, content long, high long, anchors array<long>, times array<long>"), "anchors", scratch)
    contents = read.select("doc_id", "content", "high")
    firsts = contents.groupBy("content", "high").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = contents.join(firsts, ["content", "high"]).where("doc_id > first").select("doc_id", F.col("content").alias("copy")).distinct()

    used = read.select("content", F.explode(F.arrays_zip("anchors", "times")).alias("x")).select("content", F.col("x.anchors").alias("anchor"), F.col("x.times").alias("times"))
    shared = used.groupBy("anchor").agg(F.min("content").alias("a"), F.max("content").alias("b"), F.sum("times").alias("n")).where("a <> b")
    shared = staged(shared.select("anchor", (F.col("n") > hot).alias("hot")), "shared", scratch)

    has = read.select("doc_id", F.explode("anchors").alias("anchor"))
    none = F.lit(None).cast("long")
    noted = has.join(shared, "anchor").select("doc_id", F.when(~F.col("hot"), F.col("anchor")).alias("cold"), F.when(F.col("hot"), F.col("anchor")).alias("hot"), none.alias("copy"))
    noted = noted.unionByName(copies.select("doc_id", none.alias("cold"), none.alias("hot"), "copy"))
    notes = staged(noted.groupBy("doc_id").agg(F.collect_list("cold").alias("cold"), F.collect_list("hot").alias("hot"), F.collect_list("copy").alias("copies")), "notes")
    discard(docs.sparkSession, scratch)

    marked = texts.join(notes, "doc_id").select("doc_id", "text", "cold", "hot", "copies")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = marked.mapInArrow(_suffixes(min_words, True), "route long, suffix binary, doc_id long").repartition(n, "route").sortWithinPartitions("route")
    nodes = groups.mapInArrow(_subtrees(min_words), "route long, key long, nodes array<long>")
    places = marked.mapInArrow(_suffixes(min_words, False), "doc_id long, content long, at long, route long, key long")
    gone = places.join(nodes, ["route", "key"]).where("exists(nodes, x -> x < doc_id)")
    found = gone.groupBy("doc_id").agg(F.collect_list(F.struct("content", "at", F.expr("transform(nodes, x -> x < doc_id)").alias("gone"))).alias("found"))
    joined = texts.join(found, "doc_id", "left").join(notes.where("size(copies) > 0").select("doc_id", "copies"), "doc_id", "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start: long, length: long>>"
    if carry:
        schema += f", carry {joined.schema['carry'].dataType.simpleString()}"
    return joined.select("doc_id", "text", "found", "copies", *(["carry"] if carry else [])).mapInArrow(_cleaned(min_words), schema)
