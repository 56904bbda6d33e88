"""Run logs: tolerant step parsing, trimming, de-duplication, resuming, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.operators.order import after_first


def json_step(line: Column, key: str = "step") -> Column:
    """The integer step of a JSON line: numbers truncate, digits in strings parse, true/false and the rest give null."""
    value = F.get_json_object(line, f"$.{key}")
    typed = F.regexp_extract(F.coalesce(line, F.lit("")), rf'"{key}"\s*:\s*(".*?"|[^,}}\]\s]+)', 1)
    boolean = typed.isin("true", "false", "null", "")
    whole = F.when(typed.startswith('"'), value.try_cast("bigint")).otherwise(value.try_cast("double").try_cast("bigint"))
    return F.when(~boolean, whole)


def line_kind(line: Column) -> Column:
    """blank, invalid, object or other."""
    ok = F.try_parse_json(line)
    return F.when(F.trim(F.coalesce(line, F.lit(""))) == "", "blank").when(ok.isNull(), "invalid").when(F.trim(line).startswith("{"), "object").otherwise("other")


def trimmed_lines(lines: DataFrame, last_step: int) -> DataFrame:
    """Adds kind, step and removed to lines (column value): only objects with a later step go."""
    rows = lines.withColumn("kind", line_kind(F.col("value")))
    rows = rows.withColumn("step", F.when(F.col("kind") == "object", json_step(F.col("value"))))
    return rows.withColumn("removed", F.coalesce(F.col("step") > last_step, F.lit(False)))


def trim_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("removed").alias("removed"), F.count_if(~F.col("removed")).alias("kept"), F.count_if(F.col("kind") == "invalid").alias("invalid_lines_kept"))


def trimmed_list(texts: DataFrame, last_step: int) -> DataFrame:
    """Of JSON texts (column value) that are lists of records: kept (the list without later steps), removed, n_kept, rewrite.

    Running it fails for a text that is no list; a text is rewritten only if something goes.
    """
    listed = F.when(F.trim(F.coalesce("value", F.lit(""))).startswith("["), F.from_json("value", "array<string>"))
    rows = texts.withColumn("records", F.coalesce(listed, F.raise_error(F.lit("not a list of records")).cast("array<string>")))
    late = lambda r: F.coalesce(json_step(r) > last_step, F.lit(False))
    rows = rows.withColumn("left", F.filter("records", lambda r: ~late(r))).withColumn("removed", F.size("records") - F.size("left"))
    kept = F.when(F.col("removed") > 0, F.concat(F.lit("["), F.array_join("left", ","), F.lit("]"))).otherwise(F.col("value"))
    return rows.withColumn("kept", kept).withColumn("n_kept", F.size("left")).withColumn("rewrite", F.col("removed") > 0).drop("records", "left")


def flattened(texts: DataFrame, depth: int = 8) -> DataFrame:
    """The objects in JSON texts (column value) that are an object or lists of such, nested up to ``depth``; path gives their order.

    Anything else, null included, holds no object.
    """
    rows = texts.withColumn("path", F.array().cast("array<int>"))
    for _ in range(depth):
        inner = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", "array<string>")).otherwise(F.array("value"))
        rows = rows.select(*(c for c in rows.columns if c not in ("value", "path")), "path", F.posexplode(inner).alias("at", "value"))
        rows = rows.withColumn("path", F.concat("path", F.array("at"))).drop("at")
    return rows.where(F.startswith(F.ltrim("value"), F.lit("{")))


def trimmed(records: DataFrame, last_step: int) -> DataFrame:
    """Records up to a step; those without one stay."""
    return records.where(F.col("step").isNull() | (F.col("step") <= last_step))


def one_per_step(records: DataFrame) -> DataFrame:
    """Of (step, final, ts, input_pos): not final before final, then the latest, then the last in the input; adds duplicates."""
    step = Window.partitionBy("step")
    order = step.orderBy(F.col("final").asc(), F.col("ts").desc_nulls_last(), F.col("input_pos").desc())
    rows = records.where("step is not null").withColumn("k", F.row_number().over(order)).withColumn("duplicates", F.count(F.lit(1)).over(step))
    return rows.where("k = 1").drop("k")


def throughput(rows: DataFrame, world: int, keys: list[str]) -> DataFrame:
    """tokens_per_sec between neighbouring rows of (ts, tokens): 0 differences count as a nanosecond."""
    order = Window.partitionBy(*keys).orderBy("ts", "input_pos")
    dt = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order)) / 1e6
    dn = F.col("tokens") - F.lag("tokens").over(order)
    return rows.withColumn("tokens_per_sec", world * dn / F.greatest(dt, F.lit(1e-9)))


def normalised(value: Column) -> Column:
    """Config values as text: whole numbers without a point, true/false kept."""
    number = value.try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(F.lower(value).isin("true", "false"), F.lower(value)).when(whole, number.cast("decimal(20,0)").cast("string")).otherwise(value)


def config_differences(current: DataFrame, saved: DataFrame) -> DataFrame:
    """key, current, saved, status of (key, value) rows: match, mismatch or missing."""
    joined = current.select("key", F.col("value").alias("current")).join(saved.select("key", F.col("value").alias("saved"), F.lit(True).alias("there")), "key", "left")
    same = normalised(F.col("current")).eqNullSafe(normalised(F.col("saved")))
    return joined.select("key", "current", "saved", F.when(F.col("there").isNull(), "missing").when(same, "match").otherwise("mismatch").alias("status"))


def skip_count(opt_step: Column, micro_steps_seen: Column, grad_accum: int) -> Column:
    """Items to skip on resuming: the explicit count, else steps times accumulation."""
    if grad_accum <= 0:
        raise ValueError("grad_accum must be positive")
    return F.coalesce(F.when(micro_steps_seen >= 0, micro_steps_seen), opt_step * grad_accum)


def fast_forward(schedule: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """A deterministic schedule (its keys do not repeat) without its first n items."""
    return after_first(schedule, n, keys)


def fast_forward_report(schedule: DataFrame, n: int) -> DataFrame:
    """asked, skipped, left, exhausted: whether the schedule ends before n items."""
    total = F.count(F.lit(1))
    return schedule.agg(F.lit(n).cast("long").alias("asked"), F.least(F.lit(n).cast("long"), total).alias("skipped"), F.greatest(total - n, F.lit(0).cast("long")).alias("left"), (total < n).alias("exhausted"))


def architecture(config: DataFrame, asked: list[tuple[str, list[str], int]]) -> DataFrame:
    """label, found, expected, status of (label, alternative keys, expected) against (key, value) rows.

    The first alternative that is there counts; a label without any is left out.
    """
    spark = config.sparkSession
    wanted = spark.createDataFrame([(label, i, key, int(expected)) for label, keys, expected in asked for i, key in enumerate(keys)], "label string, i int, key string, expected long")
    there = wanted.join(config.select("key", F.col("value").try_cast("double").cast("long").alias("found")), "key")
    first = there.groupBy("label", "expected").agg(F.min_by("found", "i").alias("found"))
    return first.select("label", "found", "expected", F.when(F.col("found").eqNullSafe(F.col("expected")), "match").otherwise("mismatch").alias("status"))


def checkpoints(names: DataFrame) -> DataFrame:
    """The checkpoint of the greatest step (then latest) of (name, mtime); others have no step."""
    step = F.regexp_extract("name", r"^ckpt_.*_step(\d+)$", 1)
    rows = names.select("name", "mtime", F.when(step != "", step.cast("long")).alias("step")).where("step is not null")
    return rows.agg(F.max(F.struct("step", "mtime", "name")).alias("b")).select("b.*")


def model_order(models: DataFrame) -> DataFrame:
    """Models with a config file (column has_config) once each, by step in the name (-1 without one), then name."""
    step = F.regexp_extract("name", r"step_?(\d+)", 1)
    rows = models.where("has_config").select("name").distinct().withColumn("step", F.when(step != "", step.cast("long")).otherwise(-1))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("step", "name")) - 1)


def exposures(batches: DataFrame) -> DataFrame:
    """A record for each step with its micro-batch spans in order."""
    span = F.struct("place", "shard_idx", "block_idx", "start", "end")
    return batches.groupBy("step").agg(F.array_sort(F.collect_list(span)).alias("micro_batches"))


def exposure_rows(records: DataFrame) -> DataFrame:
    return records.select("step", F.explode("micro_batches").alias("m")).select("step", "m.*")


def learning_rate(step: Column, top: float, warmup: int, n: int, least: float) -> Column:
    """Linear warm-up, then a cosine to ``least`` of the top rate."""
    low = top * least
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / F.lit(float(max(1, n - warmup)))))
    cosine = low + 0.5 * (1 + F.cos(F.lit(math.pi) * ratio)) * (top - low)
    return F.when(step < warmup, top * (step + 1) / F.lit(float(max(1, warmup)))).when((step > n) | F.lit(n <= warmup), low).otherwise(cosine)


def l2_norms(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Root of the sum of squares over all components of a group's vectors."""
    square = F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)) ** 2)
    return rows.groupBy(*keys).agg(F.sqrt(F.sum(F.coalesce(square, F.lit(0.0)))).alias("l2_norm"), F.count(F.lit(1)).alias("n_rows"))


def run_name(prefix: Column, keep: Column, mode: Column) -> Column:
    return F.concat_ws("_", prefix, mode, F.concat(F.lit("k"), F.lpad(F.bround(keep * 1000).cast("int").cast("string"), 4, "0")))
