"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words (runs of letters) and word starts of four letters. The
examples are a bounded sample of labelled rows, toxic and other, over all of their
terms. A term's weight in a text is (1 + ln tf) times its inverse document
frequency, counted over all documents, times its relevance frequency
log2(2 + a / c): a toxic and c other examples have it (each counts for the rows it
stands for). Vectors have unit length.

The inverted index holds a posting list for each term, cut into blocks of examples
that are next to each other; each block of a list has its largest weight. The few
lists that name an eighth of the examples or more have a place for each example, and
are added up first. A text's bound for a block is the largest sum there and the
largest weights of its other terms. Blocks of high bounds are visited first, then all
others whose bound reaches the k-th best cosine; the rest cannot hold a nearer example. Neighbours vote by closeness, and
they are returned as evidence. The calibration (isotonic) is cross-fitted: each
fold of the examples is scored with weights and an index made from the others.

Defined cases: null and empty texts, and texts without a term of the examples, get the
rate of toxicity; rows without a doc_id are left out; repeated rows are each scored;
labels that are null are ignored, repeated labels of a document count once (toxic if
any is); of labelled rows with one doc_id the least text counts; equal cosines go to
the earlier example; without any label every score is 0; an empty table gives no
rows. Other columns are not read, unless named in ``carry`` (returned in a struct
column).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import as_bytes, parts_of, slices

#: Labelled rows that the index is fitted on, at most: toxic ones, others, and the bytes of such a row.
MOST_TOXIC, MOST_OTHERS, LONGEST = 1000, 2000, 1 << 16
NEIGHBOURS, BLOCK, FOLDS = 15, 64, 3
#: Letters of a word start; the share of examples from which a list has a place for each.
START, FULL_SHARE = 4, 8
#: Postings that are gathered at once, and tasks that count document frequencies at most.
GATHERED, COUNTERS = 1 << 18, 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of each word in some texts: the text it is in, its number among the distinct words, and these.

    Words are runs of ASCII letters and of characters beyond ASCII without the signs of
    U+0080 to U+00BF, general and CJK punctuation, and the two signs among Latin-1's letters.
    """
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n\n\n", np.uint8)]
    letter = _LETTER[data]
    at = np.flatnonzero(data == 0xC3)
    after = data[at + 1]
    upper = (after < 0x9F) & (after != 0x97)
    data[at[upper] + 1] += 0x20
    for first, seconds in ((0xC2, None), (0xC3, (0x97, 0xB7)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        at = np.flatnonzero(data == first)
        at = at if seconds is None else at[np.isin(data[at + 1], seconds)]
        for k in range(3 if first > 0xDF else 2):
            letter[at + k] = False
    change = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    edges = np.concatenate([[0], change] if letter[0] else [change]).astype(np.int32)
    if not len(edges):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    # words and the gaps after them in turn; the text ends with a gap
    both = pa.BinaryArray.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(np.append(edges, np.int32(len(data)))), pa.py_buffer(data)]).dictionary_encode()
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    return np.searchsorted(begins, edges[::2], side="right") - 1, np.asarray(both.indices)[::2].astype(np.int64), both.dictionary.to_pylist()


def word_terms(word: bytes) -> tuple[bytes, ...]:
    """The terms of a word: itself and its start (with a mark)."""
    if word.isascii():
        return (word, word[:START] + b"-") if len(word) > START else (word,)
    text = word.decode().lower()
    word = text.encode()
    return (word, text[:START].encode() + b"-") if len(text) > START else (word,)


def sample_terms(texts: list[bytes]) -> list[dict[bytes, int]]:
    """Terms and counts of each text."""
    doc, word, words = split(texts)
    out: list[dict[bytes, int]] = [{} for _ in texts]
    pairs, n = np.unique(doc * max(1, len(words)) + word, return_counts=True)
    for pair, count in zip(pairs.tolist(), n.tolist()):
        i, w = divmod(pair, len(words))
        for term in word_terms(words[w]):
            out[i][term] = out[i].get(term, 0) + count
    return out


class Reader:
    """Counts of known terms in texts."""

    def __init__(self, terms: list[bytes]):
        self.ids, self.size = {t: i for i, t in enumerate(terms)}, max(1, len(terms))

    def _keys(self, texts: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc, word, words = split(texts)
        get, keys, first = self.ids.get, [], owners[doc] * self.size
        terms = [(w, w[:START] + b"-" if len(w) > START else b"") if w.isascii() else (*word_terms(w), b"")[:2] for w in words]
        for k in (0, 1):
            term = np.array([get(t[k], -1) for t in terms], np.int64)[word] if terms else np.zeros(0, np.int64)
            keys.append((first + term)[term >= 0])
        return np.unique(np.concatenate(keys), return_counts=True)

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of known terms, by text and term."""
        found = [self._keys(some, owners) for some, owners in parts_of(texts)]
        keys = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.int64)
        n = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)
        if len(found) > 1:
            keys, back = np.unique(keys, return_inverse=True)
            n = np.bincount(back, n, len(keys)).astype(np.int64)
        return keys // self.size, keys % self.size, n


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_others: int = MOST_OTHERS, longest: int = LONGEST):
    """(doc_id, toxic, weight, terms, counts) of a bounded sample of labelled rows; weight: rows that one stands for."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r.n for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit(5), "doc_id")
    chosen = known.where("toxic > 0").orderBy(order, "doc_id").limit(most_toxic).unionByName(known.where("toxic <= 0").orderBy(order, "doc_id").limit(most_others))
    # at most most_toxic + most_others rows of two numbers are broadcast; as many texts of bounded length are read
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))

    def run(batches):
        kind = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        for whole in batches:
            for batch in slices(whole, "text"):
                terms = sample_terms(as_bytes(batch.column(1)))
                columns = [batch.column(0), batch.column(2).cast(pa.int64()), [list(t) for t in terms], [list(t.values()) for t in terms]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kind)], names=["doc_id", "toxic", "terms", "counts"])

    found = rows.mapInArrow(run, "doc_id long, toxic long, terms array<binary>, counts array<long>").toArrow().sort_by("doc_id")
    toxic = np.asarray(found.column("toxic").combine_chunks(), np.int64)
    stands = np.array([totals.get(k, 0) / max(1, int((toxic == k).sum())) for k in (0, 1)])
    return found, toxic, stands[toxic]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] numbers), starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """A block-max inverted index of some examples: rows (example, term, count) with their toxicity and weight."""

    def __init__(self, rows, idf: np.ndarray, ids: np.ndarray, toxic: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, block: int = BLOCK):
        example, term, count = rows
        size = len(idf)
        have = [np.bincount(term[toxic[example] == t], weight[example[toxic[example] == t]], size) for t in (0, 1)]
        unit = float(weight[toxic == 0].min()) if (toxic == 0).any() else 1.0
        self.importance = idf * np.log2(2 + have[1] / np.maximum(unit, have[0]))
        self.k, self.block, self.n = k, block, len(ids)
        # examples of one kind, one most frequent term and about one length are neighbours: their blocks have low bounds for other texts
        w = self._weights(example, term, count, len(ids))
        common = np.zeros(len(ids), np.int64)
        order = np.lexsort((term, count, example))
        common[example[order]] = term[order]  # the last of each example stays
        placed = np.lexsort((ids, np.bincount(example, count, len(ids)), common, toxic))
        place = np.empty(len(ids), np.int32)
        place[placed] = np.arange(len(ids))
        self.ids, self.toxic, self.weight = ids[placed], toxic[placed].astype(np.float64), weight[placed]
        self.blocks = -(-len(ids) // block)
        keep = w > 0
        term, spot, w = term[keep], place[example[keep]], w[keep]
        # lists with a place for each example
        full = np.bincount(term, minlength=size) >= max(block, len(ids) // FULL_SHARE)
        self.full = np.where(full, np.cumsum(full) - 1, -1)
        self.lists = np.zeros((int(full.sum()), self.blocks * block))
        dense = full[term]
        self.lists[self.full[term[dense]], spot[dense]] = w[dense]
        # the others by term, each by place; entries are the blocks of the lists
        order = np.lexsort((spot[~dense], term[~dense]))
        term, self.place, self.post = term[~dense][order], spot[~dense][order].astype(np.int32), w[~dense][order]
        entry = term.astype(np.int64) * max(1, self.blocks) + self.place // block
        first = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]]) if len(entry) else np.zeros(0, np.int64)
        self.entry_start = np.append(first, len(entry))
        self.entry_block = (entry[first] % max(1, self.blocks)).astype(np.int32)
        self.entry_most = np.maximum.reduceat(self.post, first) if len(first) else np.zeros(0)
        self.list_start = np.searchsorted(entry[first] // max(1, self.blocks), np.arange(size + 1))
        self.list_posts = np.bincount(term, minlength=size)
        total = self.weight.sum()
        self.rate = float((self.weight * self.toxic).sum() / total) if total else 0.0
        self.levels, self.rates = np.zeros(0), np.zeros(0)

    def _weights(self, text, term, count, n: int) -> np.ndarray:
        w = (1 + np.log(np.maximum(1, count))) * self.importance[term]
        length = np.sqrt(np.bincount(text, w * w, n))
        return w / np.where(length > 0, length, 1)[text]

    def nearest(self, text: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (-1: none) and cosines of the k nearest examples of n texts, exactly; terms of texts by text."""
        places, cosines = np.full((n, self.k), -1, np.int64), np.zeros((n, self.k))
        if not self.n or not len(text):
            return places, cosines
        q = self._weights(text, term, count, n)
        # as many texts at once as have GATHERED postings
        load = np.cumsum(np.bincount(text, self.list_posts[term] + 1, n) + self.blocks * self.block)
        edge = np.searchsorted(text, np.arange(n + 1))
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(load, (load[a - 1] if a else 0) + GATHERED, side="right")))
            s = slice(edge[a], edge[b])
            places[a:b], cosines[a:b] = self._nearest(text[s] - a, term[s], q[s], b - a)
            a = b
        return places, cosines

    def _nearest(self, text, term, q, n: int):
        width, k = self.blocks * self.block, min(self.k, self.n)
        full = self.full[term]
        dense = full >= 0
        rows = np.zeros((n, len(self.lists)))
        rows[text[dense], full[dense]] = q[dense]
        scores = rows @ self.lists
        text, term, q = text[~dense], term[~dense], q[~dense]
        sizes = self.list_start[term + 1] - self.list_start[term]
        entries = _ranges(self.list_start[term], sizes)
        owner, weight = np.repeat(text, sizes), np.repeat(q, sizes)
        cell = owner * self.blocks + self.entry_block[entries]
        bound = scores.reshape(n, self.blocks, self.block).max(axis=2) + np.bincount(cell, weight * self.entry_most[entries], n * self.blocks).reshape(n, self.blocks)
        visited, kth = np.zeros((n, self.blocks), bool), np.zeros(n)
        for first in (2, 6, self.blocks):
            open_ = ~visited & (bound > 0) & (bound >= kth[:, None] - 1e-12)
            now = open_
            if first < self.blocks:
                ranked = np.argpartition(np.where(open_, -bound, 1.0), first - 1, axis=1)[:, :first]
                now = np.zeros_like(visited)
                np.put_along_axis(now, ranked, True, axis=1)
                now &= open_
            if not now.any():
                break
            hit = np.flatnonzero(now.ravel()[cell])
            starts = self.entry_start[entries[hit]]
            sizes = self.entry_start[entries[hit] + 1] - starts
            at = _ranges(starts, sizes)
            scores += np.bincount(np.repeat(owner[hit] * width, sizes) + self.place[at], np.repeat(weight[hit], sizes) * self.post[at], n * width).reshape(n, width)
            visited |= now
            seen = np.where(np.repeat(visited, self.block, axis=1), scores, 0.0)
            kth = np.partition(seen, width - k, axis=1)[:, width - k]
        rounded = np.round(seen, 12) if visited.any() else np.zeros((n, width))
        kth = np.partition(rounded, width - k, axis=1)[:, width - k]
        places, cosines = np.full((n, self.k), -1, np.int64), np.zeros((n, self.k))
        row, place = np.nonzero((rounded >= kth[:, None]) & (rounded > 0))
        order = np.lexsort((place, -rounded[row, place], row))
        row, place = row[order], place[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        near = rank < k
        places[row[near], rank[near]] = place[near]
        cosines[row[near], rank[near]] = rounded[row[near], place[near]]
        return places, cosines

    def votes(self, places: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Share of toxicity among the neighbours by closeness; the rate of toxicity without any."""
        w = np.where(places >= 0, self.weight[places] * cosines, 0.0) if self.n else np.zeros_like(cosines)
        total = w.sum(axis=1)
        return np.where(total > 0, (w * self.toxic[places]).sum(axis=1) / np.where(total > 0, total, 1), self.rate) if self.n else np.zeros(len(places))

    def score(self, text, term, count, n: int):
        """Calibrated scores, places and cosines of the neighbours."""
        places, cosines = self.nearest(text, term, count, n)
        p = self.votes(places, cosines)
        none = places[:, 0] < 0
        p = np.where(none, p, np.interp(p, self.levels, self.rates)) if len(self.levels) else p
        return np.clip(p, 0.0, 1.0), places, cosines


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of x and rising rates of y by pooling adjacent violators."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([x[i] * weight[i], y[i] * weight[i], weight[i]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def document_frequencies(docs: DataFrame, terms: list[bytes]) -> tuple[int, np.ndarray]:
    """Documents, and documents with each term, over all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # the terms of a bounded sample

    def run(batches):
        reader, n, df = Reader(shared.value), 0, np.zeros(len(shared.value), np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                n += batch.num_rows
                df += np.bincount(reader.counts(as_bytes(batch.column(0)))[1], minlength=len(df))
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(df[hit], n))], names=["term", "n"])

    # a row for each task and term: the tasks are bounded
    counted = docs.select("text").coalesce(COUNTERS).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (np.asarray(counted.column(c).combine_chunks(), np.int64) for c in ("term", "n"))
    df = np.zeros(len(terms), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), df


class Fitted:
    """The terms and the index of all examples, calibrated."""

    def __init__(self, terms: list[bytes], index: Index):
        self.terms, self.index = terms, index


def fit(docs: DataFrame, labels: DataFrame, **bounds) -> Fitted:
    found, toxic, weight = labelled_sample(docs, labels, **bounds)
    ids, n = np.asarray(found.column("doc_id").combine_chunks(), np.int64), len(found)
    if not n:
        empty = np.zeros(0, np.int32)
        return Fitted([], Index((empty, empty, empty), np.zeros(0), ids, toxic, weight))
    lists = found.column("terms").combine_chunks()
    flat = lists.flatten().dictionary_encode()
    terms = flat.dictionary.to_pylist()
    example = np.repeat(np.arange(n, dtype=np.int32), np.asarray(lists.value_lengths()))
    term, count = np.asarray(flat.indices, np.int32), np.asarray(found.column("counts").combine_chunks().flatten()).astype(np.int32)
    del found, lists, flat
    total, df = document_frequencies(docs, terms) if terms else (0, np.zeros(0, np.int64))
    idf = np.log((1 + total) / (1 + df))
    fold, votes = np.arange(n) % FOLDS, np.zeros(n)
    for f in range(FOLDS if n >= FOLDS else 0):
        number = (np.cumsum(fold != f) - 1).astype(np.int32)
        rest, own = fold[example] != f, fold[example] == f
        part = Index((number[example[rest]], term[rest], count[rest]), idf, ids[fold != f], toxic[fold != f], weight[fold != f])
        number = np.cumsum(fold == f) - 1
        votes[fold == f] = part.votes(*part.nearest(number[example[own]], term[own], count[own], int((fold == f).sum())))
        del part, rest, own  # one index at a time is held
    index = Index((example, term, count), idf, ids, toxic, weight)
    index.levels, index.rates = isotonic(votes, toxic.astype(np.float64), weight)
    return Fitted(terms, index)


def score(docs: DataFrame, fitted: Fitted, carry: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, score, evidence (neighbours: doc_id, cosine, toxic) of every row [, text] [, carry]."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # bounded by the sample

    def run(batches):
        index, reader = shared.value.index, Reader(shared.value.terms)
        for whole in batches:
            for batch in slices(whole, "text"):
                text, term, count = reader.counts(as_bytes(batch.column(1)))
                p, places, cosines = index.score(text, term, count, batch.num_rows)
                near = places >= 0
                flat = pa.StructArray.from_arrays([pa.array(index.ids[places[near]], pa.int64()), pa.array(cosines[near]), pa.array(index.toxic[places[near]].astype(np.int32))], names=["doc_id", "cosine", "toxic"])
                evidence = pa.ListArray.from_arrays(np.cumsum([0, *near.sum(axis=1)]).astype(np.int32), flat)
                more = batch.schema.names[1 if with_text else 2 :]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), evidence, *map(batch.column, more)], names=["doc_id", "score", "evidence", *more])

    rows = docs.where("doc_id is not null").select("doc_id", "text", *([F.struct(*carry).alias("carry")] if carry else []))
    schema = "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>"
    if with_text:
        schema += ", text string"
    if carry:
        schema += f", carry {rows.schema['carry'].dataType.simpleString()}"
    return rows.mapInArrow(run, schema)
