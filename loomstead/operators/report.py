"""Report series: what plots of a run are drawn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.functions.columns import finite

# Accuracy of a word-vector baseline by domain.
BASELINE = {
    "social-interactions": 0.69, "social-properties": 0.73, "material-dynamics": 0.62, "social-relations": 0.51, "quantitative-properties": 0.54, "physical-dynamics": 0.62,
    "agent-properties": 0.51, "physical-interactions": 0.54, "material-properties": 0.52, "physical-relations": 0.51, "spatial-relations": 0.42,
}


def has_evaluation(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records with any of the evaluation columns."""
    there = F.lit(False)
    for k in keys:
        there = there | F.col(k).isNotNull()
    return records.where(there)


def reductions(records: DataFrame, total: str, mean: str) -> DataFrame:
    """Which score reductions occur at all."""
    return records.agg(F.max(F.col(total).isNotNull()).alias("has_sum"), F.max(F.col(mean).isNotNull()).alias("has_mean"))


def scalar_long(records: DataFrame, fields: list[str]) -> DataFrame:
    """step, field, value of finite scalars."""
    rows = records.select("step", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields))).alias("r"))
    return rows.select("step", "r.field", "r.value").where(finite(F.col("value")))


def domain_long(records: DataFrame, column: str) -> DataFrame:
    """step, domain, value of a map column's finite entries."""
    return records.select("step", F.explode(column).alias("domain", "value")).where(finite(F.col("value")))


def pair_average(records: DataFrame, column: str) -> DataFrame:
    """step, domain, value: mean of a map's pairs, without the entry "average"."""
    rows = records.select("step", F.explode(column).alias("domain", "pair")).where("domain <> 'average'")
    return rows.select("step", "domain", ((F.col("pair")[0] + F.col("pair")[1]) / 2).alias("value")).where(finite(F.col("value")))


def average_with_fallback(records: DataFrame, column: str) -> DataFrame:
    """step, average: the entry "average", else the mean of the finite entries, else nothing."""
    rows = domain_long(records, column)
    explicit, mean = F.max(F.when(F.col("domain") == "average", F.col("value"))), F.avg(F.when(F.col("domain") != "average", F.col("value")))
    return rows.groupBy("step").agg(F.coalesce(explicit, mean).alias("average")).where("average is not null")


def with_baseline(rows: DataFrame, baseline: dict[str, float] | None = None) -> DataFrame:
    """Adds baseline by domain, null where there is none."""
    table = F.create_map(*(F.lit(x) for kv in (baseline or BASELINE).items() for x in kv))
    return rows.withColumn("baseline", F.try_element_at(table, F.col("domain")))


def labelled_union(**series: DataFrame) -> DataFrame:
    """Series below one another under their names."""
    out = None
    for name, df in series.items():
        df = df.withColumn("label", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def category_series(rows: DataFrame) -> DataFrame:
    """Points of (step, category, value) of the categories that the last step has."""
    last = rows.agg(F.max("step").alias("last"))
    kept = rows.join(F.broadcast(last), rows["step"] == last["last"]).select("category").distinct()
    return rows.join(kept, "category", "left_semi").where(finite(F.col("value")))


def last_write(rows: DataFrame) -> DataFrame:
    """The last value in the input for each step."""
    return rows.groupBy("step").agg(F.max_by("value", "input_pos").alias("value"), F.count(F.lit(1)).alias("n"))


def payload(record: Column, name: str, reduction: str) -> Column:
    """A record's entry (a map column) for a reduction: of sums the bare name where the key with "_sum" is absent; one that is null stays null."""
    if reduction not in ("sum", "mean"):
        raise ValueError("sum or mean")
    key = F.lit(f"{name}_{reduction}")
    own = F.try_element_at(record, key)
    return own if reduction == "mean" else F.when(F.map_contains_key(record, f"{name}_sum"), own).otherwise(F.try_element_at(record, F.lit(name)))


def margin_series(records: DataFrame, column: str) -> DataFrame:
    """step, domain, mean_signed_m, mean_abs_m of a map of statistics, where both are finite."""
    rows = records.select("step", F.explode(column).alias("domain", "s")).select("step", "domain", F.col("s.mean_signed_m").alias("mean_signed_m"), F.col("s.mean_abs_m").alias("mean_abs_m"))
    return both_finite(rows, "mean_signed_m", "mean_abs_m")


def both_finite(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Points of two values that are drawn together."""
    return rows.where(finite(F.col(a)) & finite(F.col(b)))


def step_record(step: int, sums: DataFrame, means: DataFrame, final: bool = False, train_loss: float | None = None) -> DataFrame:
    """One record of an evaluation: maps by domain for each reduction, the sums also under their old names.

    sums and means: domain, acc1, mean_signed_m, mean_abs_m. A final record has no training loss.
    """

    def maps(rows: DataFrame, suffix: str) -> DataFrame:
        entries = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct("domain", v.alias("v")))))
        return rows.agg(entries(F.col("acc1")).alias(f"eval_official_{suffix}"), entries(F.struct("mean_signed_m", "mean_abs_m")).alias(f"eval_margin_stats_{suffix}"))

    one = maps(sums, "sum").crossJoin(F.broadcast(maps(means, "mean")))  # one row each
    one = one.withColumn("eval_official", F.col("eval_official_sum")).withColumn("eval_margin_stats", F.col("eval_margin_stats_sum"))
    loss = F.lit(None if final else train_loss).cast("double")
    return one.withColumn("step", F.lit(step).cast("long")).withColumn("final", F.lit(final)).withColumn("train_loss_last", loss)
