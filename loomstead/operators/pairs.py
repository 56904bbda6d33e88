"""Minimal-pair metrics: margins of matched against mismatched contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.text import canonical_category

#: Below this a margin is a near tie.
NEAR = 1e-6


def union_files(frames: list[DataFrame]) -> DataFrame:
    """Rows of files in order (each with a column line), by name, with row_index over all."""
    out = None
    for k, f in enumerate(frames):
        f = f.withColumn("file", F.lit(k))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    totals = out.groupBy("file").agg(F.count(F.lit(1)).alias("n"))  # a row a file
    before = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    return out.withColumn("at", inner).join(before, "file").withColumn("row_index", (F.col("at") + F.col("before")).cast("long")).drop("file", "line", "at", "before")


def conditional_logps(logps, context_tokens):
    """Log probabilities of a target's tokens, of those of context + " " + target (BOS before it): all after as many as the context has alone."""
    return F.slice(logps, context_tokens + 1, F.size(logps))


def reduce_scores(logps, how: str):
    """Sum or mean of an array of token log probabilities; empty: 0."""
    if how not in ("sum", "mean"):
        raise ValueError("sum or mean")
    total = F.aggregate(logps, F.lit(0.0), lambda a, x: a + x)
    return total if how == "sum" else F.when(F.size(logps) > 0, total / F.size(logps)).otherwise(0.0)


def margins(scores: DataFrame) -> DataFrame:
    """Adds m1 = s11 - s12, m2 = s22 - s21, their mean m, and flags of each: correct, near tie."""
    rows = scores.withColumn("m1", F.col("s11") - F.col("s12")).withColumn("m2", F.col("s22") - F.col("s21"))
    rows = rows.withColumn("m", (F.col("m1") + F.col("m2")) / 2)
    for name in ("m1", "m2", "m"):
        rows = rows.withColumn(f"correct_{name}", F.col(name) > 0).withColumn(f"near_tie_{name}", F.abs(name) < NEAR)
    return rows


def _share(flag: str):
    return F.avg(F.col(flag).cast("double"))


def domain_metrics(rows: DataFrame) -> DataFrame:
    """n, accuracies and margin statistics of each domain; ``first_row`` gives the domains' order of appearance."""
    return rows.groupBy("domain").agg(
        F.min("row_index").alias("first_row"), F.count(F.lit(1)).alias("n"), _share("correct_m1").alias("acc1"), _share("correct_m2").alias("acc2"),
        _share("correct_m").alias("acc_combined"), F.avg("m").alias("mean_signed_m"), F.avg(F.abs("m")).alias("mean_abs_m"), F.avg((F.col("m") == 0).cast("double")).alias("tie_rate_m"),
    )


def macro_average(domains: DataFrame) -> DataFrame:
    """Unweighted means over domains. full_second repeats acc1, as the published metric does; acc2 is the corrected one."""
    return domains.agg(
        F.sum("n").alias("n"), F.avg("acc1").alias("acc1"), F.avg("acc1").alias("full_second"), F.avg("acc2").alias("acc2"), F.avg("acc_combined").alias("acc_combined"),
        F.avg("mean_signed_m").alias("mean_signed_m"), F.avg("mean_abs_m").alias("mean_abs_m"), F.avg("tie_rate_m").alias("tie_rate_m"),
    )


def category_metrics(rows: DataFrame, categories: DataFrame, columns: list[str]) -> DataFrame:
    """column, category, n, acc1, acc2 for each of several category columns, joined by row_index, and an average over categories."""
    joined = rows.select("row_index", "correct_m1", "correct_m2").join(categories.select("row_index", *(canonical_category(F.col(c)).alias(c) for c in columns)), "row_index")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("category")) for c in columns))).alias("p")
    each = joined.select(pairs, "correct_m1", "correct_m2").groupBy("p.column", "p.category").agg(F.count(F.lit(1)).alias("n"), _share("correct_m1").alias("acc1"), _share("correct_m2").alias("acc2"))
    average = each.groupBy("column").agg(F.lit("average").alias("category"), F.sum("n").alias("n"), F.avg("acc1").alias("acc1"), F.avg("acc2").alias("acc2"))
    return each.unionByName(average)
