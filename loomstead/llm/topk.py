"""Exact top-k inner products by MaxScore over shards of integer vectors.

A vector's components are terms; a shard keeps for each term the postings of all
its vectors (a column) and the term's largest and smallest value, which bound
what the term can add to a score. A query takes its terms by falling bound: the
first, essential ones are traversed for all vectors of the shard; the rest are
probed only for vectors whose partial score plus the bounds of the terms still
to come reaches the k-th best score so far. Shards' results are merged by score,
then by smaller vec_id.

Vectors are moved once: each shard's vectors reach one task, which holds them while
the queries, a small share of the rows, stream past it, a batch at a time.

Defined cases: vectors that are null or hold null or non-finite components take no
part; so do rows without a vec_id. Empty vectors score 0 with each other. Vectors are
scored only against vectors of their own length. Components of any finite size are
exact (doubles, 64-bit integers or Python's integers, as the sizes ask); a score
beyond a long is ranked exactly and given as the nearest long. Repeated rows are separate
candidates; as queries, equal rows are asked once; a query's own
vec_id is never its candidate. Fewer candidates than k: all of them. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard: what a task holds.
SHARD_ROWS = 1 << 17
HITS = "query_id long, asked long, vec_id long, score long, rank_key binary"
_LONG = (1 << 63) - 1


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of double) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    ok = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))), F.lit(False))
    return vectors.where(F.col("vec_id").isNotNull() & ok).select("vec_id", x.alias("x"))


def exact(x, scale: int) -> list[int]:
    """floor(scale * c) of finite doubles, as Python integers (a power of two as scale adds no rounding)."""
    return [math.floor(scale * c) if abs(c) < 2.0**900 else int(c) * scale for c in x]


def rank_key(score: int) -> bytes:
    """Bytes that sort as the integers do."""
    size = (score.bit_length() + 8) // 8
    if score >= 0:
        return b"\x01" + size.to_bytes(2, "big") + score.to_bytes(size, "big")
    return b"\x00" + (0xFFFF - size).to_bytes(2, "big") + (score + (1 << 8 * size)).to_bytes(size, "big")


def max_score(ids: np.ndarray, columns: np.ndarray, query_id: int, query: np.ndarray, k: int, step: int = 8, spans: tuple | None = None):
    """The k best (score, id) of a shard. ids ascend; columns[d, i] is component d of vector i; spans: each term's largest and smallest value."""
    high, low = spans or (columns.max(axis=1), columns.min(axis=1))
    if float(np.abs(query).max()) * float(max(high.max(), -low.min())) * len(query) >= 2.0**52:  # beyond exact doubles
        columns, query, high, low = (x.astype(np.int64) for x in (columns, query, high, low))
    most, least = np.maximum(query * high, query * low), np.minimum(query * high, query * low)
    order = np.argsort(least - most, kind="stable")
    rest, worst = (np.append(np.cumsum(x[order][::-1])[::-1], 0) for x in (most, least))
    # the essential terms are traversed for all vectors
    at = min(3 * step, len(order))
    scores = query[order[:at]] @ columns[order[:at]]
    alive = np.flatnonzero(ids != query_id)
    scores = scores[alive]
    while at < len(order):
        if len(alive) > k:
            reached = np.partition(scores, len(scores) - k)[len(scores) - k] + worst[at]
            keep = scores + rest[at] >= reached
            alive, scores = alive[keep], scores[keep]
        to = len(order) if len(alive) <= 4 * k else min(at + step, len(order))
        terms = order[at:to]
        scores = scores + query[terms] @ columns[np.ix_(terms, alive)]
        at = to
    best = np.lexsort((ids[alive], -scores))[:k]
    return scores[best].astype(np.int64), ids[alive][best]


class Shard:
    """Vectors of one length: columns of those whose products fit 64 bits, and Python integers for the others."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, scale: int):
        """x: a row for each vector."""
        dims = x.shape[1]
        self.scale, self.limit = scale, 2.0 ** ((62 - max(1, dims).bit_length()) // 2)
        small = np.abs(x).max(axis=1, initial=0) * scale < self.limit
        order = np.lexsort((ids,))
        self.order = order[small[order]]
        self.ids = ids[self.order]
        self.columns = np.ascontiguousarray(np.floor(x[self.order] * scale).T)
        self.spans = (self.columns.max(axis=1), self.columns.min(axis=1)) if self.columns.size else None
        self.x, self.all_ids = x, ids
        self.large = [(int(ids[i]), exact(x[i].tolist(), scale)) for i in np.flatnonzero(~small)]

    def best(self, query_id: int, x: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, vec_id), ties to the smaller."""
        if len(x) and float(np.abs(x).max()) * self.scale >= self.limit:
            q, rows = exact(x.tolist(), self.scale), ((int(i), exact(row.tolist(), self.scale)) for i, row in zip(self.all_ids, self.x))
            found = [(sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != query_id]
        else:
            found = []
            if len(self.ids) and len(x):
                scores, ids = max_score(self.ids, self.columns, query_id, np.floor(x * self.scale), k, spans=self.spans)
                found = list(zip(scores.tolist(), ids.tolist()))
            elif len(self.ids):
                found = [(0, i) for i in self.ids[self.ids != query_id][:k].tolist()]
            if self.large:
                q = exact(x.tolist(), self.scale)
                found += [(sum(a * b for a, b in zip(q, v)), i) for i, v in self.large if i != query_id]
        return sorted(found, key=lambda f: (-f[0], f[1]))[:k]


def _search(k: int, scale: int):
    """Rows sorted by (shard, kind): a shard's vectors (kind 0), then the queries (kind 1)."""

    def vectors(ids: list, xs: list) -> dict[int, Shard]:
        held, sizes, x = np.concatenate(ids), np.concatenate([n for n, _ in xs]), np.concatenate([v for _, v in xs])
        starts, out = np.cumsum(sizes) - sizes, {}
        for d in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == d)
            out[d] = Shard(held[rows], x[starts[rows][:, None] + np.arange(d)], scale)
        return out

    def run(batches):
        shard, ids, xs, held = None, [], [], {}
        for batch in batches:
            shards, kinds = (np.asarray(batch.column(i)) for i in (0, 1))
            edges = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if shards[a] != shard:
                    shard, ids, xs, held = shards[a], [], [], {}
                column = batch.column(4).slice(a, b - a)
                sizes, flat = np.asarray(column.value_lengths()).astype(np.int64), np.asarray(column.flatten())
                if kinds[a] == 0:
                    ids.append(np.asarray(batch.column(2))[a:b])
                    xs.append((sizes, flat))
                    continue
                if ids:
                    held, ids, xs = vectors(ids, xs), [], []
                out, at = [], 0
                for query_id, asked, n in zip(batch.column(2).slice(a, b - a).to_pylist(), batch.column(3).slice(a, b - a).to_pylist(), sizes.tolist()):
                    for score, i in held[n].best(query_id, flat[at : at + n], k) if n in held else ():
                        out.append((query_id, asked, i, max(-_LONG - 1, min(_LONG, score)), rank_key(score)))
                    at += n
                if out:
                    kinds_out = [pa.int64()] * 4 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds_out)], names=["query_id", "asked", "vec_id", "score", "rank_key"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, shards: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows of ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    candidates, asked = taking_part(vectors), taking_part(queries).dropDuplicates(["vec_id", "x"])
    n = candidates.count() if shards is None else 0
    shards = shards or max(1, -(-n // SHARD_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 2048))
    # a row's shard depends on its place in the input, so that repeats of one vec_id are spread as well
    left = candidates.select(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", F.lit(0).cast("long").alias("asked"), "x")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", F.xxhash64("x").alias("asked"), "x")
    met = left.unionByName(right).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind")
    hits = met.mapInArrow(_search(k, scale), HITS)
    # at most k rows from each shard; the limit of k a query is applied before their shuffle, too
    best = Window.partitionBy("query_id", "asked").orderBy(F.col("rank_key").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
