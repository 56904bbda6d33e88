"""Numbers in an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive keys that are numbered by one window.
BUCKET = 4096


def numbered(rows: DataFrame, key: str, name: str = "place") -> DataFrame:
    """Adds the place (from 0) of each row by a whole-number key without repeats.

    Places within buckets of keys, then the buckets' running totals: only these, a row a bucket, meet in one task.
    """
    cut = rows.withColumn("_bucket", F.floor(F.col(key) / BUCKET))
    inner = cut.withColumn("_at", F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1)
    totals = cut.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = totals.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    return inner.join(before, "_bucket").withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_bucket", "_at", "_before")


def after_first(rows: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """All rows but the first n by keys without repeats: those above the n-th row's keys."""
    if n <= 0:
        return rows
    last = rows.select(*keys).orderBy(*keys).limit(n).agg(F.max(F.struct(*keys)).alias("_last"))  # one row
    return rows.crossJoin(F.broadcast(last)).where(F.col("_last").isNotNull() & (F.struct(*keys) > F.col("_last"))).drop("_last")
