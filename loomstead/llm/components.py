"""Connected components by alternating large-star and small-star steps, all in the cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import discard, in_few_files, staged


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least of its component, without those from a node to itself."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        if (p == q).all():
            break
        # of two roots the larger goes below the smaller: two rounds halve the roots that are not settled
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _at_once(batches):
    """All edges (u, v) to those of the settled stars."""
    held = [(np.asarray(batch.column(0)), np.asarray(batch.column(1))) for batch in batches if batch.num_rows]
    if held:
        u, v = rooted(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def components(edges: DataFrame, most_rounds: int = 60, scratch: list[str] | None = None, few: int = 0) -> DataFrame:
    """node, root (the smallest node of its component) of every node of edges (a, b).

    Each round is written to the shared folder, which cuts lineage, in few files if there are few edges. A star step
    takes a minimum for each node, combined before the shuffle, and joins it back;
    a node with very many neighbours is split by the join's skew handling. Self
    edges are ignored; an empty table gives no rows. Paths of what the result is read from are added to ``scratch``.

    Up to ``few`` distinct edges (none unless it is given) are settled by one task instead, with the same result: each
    round has seven shuffles, which the driver plans, compiles and keeps the records of, however few the rows.
    """
    spark, old, new = edges.sparkSession, [], []
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", new)
    state = None
    for _ in range(most_rounds):
        check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == check:
            break
        first, state = state is None, check
        discard(spark, old)
        old, new = new, []
        if first and check[0] <= few:
            now = staged(now.coalesce(1).mapInArrow(_at_once, "u long, v long"), "edges", new)
            break
        # large star: neighbours above a node go to the smallest node around it
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its neighbours below it go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(in_few_files(joined.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), check[0]), "edges", new)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    discard(spark, old)
    if scratch is not None:
        scratch += new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
