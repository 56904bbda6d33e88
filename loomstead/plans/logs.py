"""Queries on run logs and report series."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstead.operators import report, runlog, selection
from loomstead.plans.corpus import table

ENTRIES: list = []


def entry(sql: str | None = None):
    def add(f):
        ENTRIES.append((f.__name__, f, sql))
        return f

    return add


def records(spark, sf_dir):
    """Events as log records: ten a step, without a step where the type is signup."""
    e = table(spark, sf_dir, "events")
    step = F.when(F.col("event_type") != "signup", F.expr("event_id div 10"))
    return e.select("event_id", F.col("event_id").alias("input_pos"), step.alias("step"), (F.col("event_type") == "error").alias("final"), "ts", "user_id", "event_type", "value", F.floor(F.col("value") * 1000).cast("long").alias("tokens"), "props")


_REC = "rec AS (SELECT event_id, event_id AS input_pos, CASE WHEN event_type <> 'signup' THEN event_id // 10 END AS step, event_type = 'error' AS final, ts, user_id, event_type, value, CAST(floor(value * 1000) AS BIGINT) AS tokens, props FROM events)"


@entry(f"WITH {_REC} SELECT count(*) AS n, count(*) FILTER (step IS NULL) AS n_without, max(step) AS last FROM rec WHERE step IS NULL OR step <= 500")
def log_trim_by_step(spark, sf_dir):
    return runlog.trimmed(records(spark, sf_dir), 500).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("step").isNull()).alias("n_without"), F.max("step").alias("last"))


@entry("""WITH l AS (SELECT props, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS step FROM events)
SELECT count(*) FILTER (coalesce(step > 50, false)) AS removed, count(*) FILTER (NOT coalesce(step > 50, false)) AS kept, count(*) FILTER (NOT json_valid(props)) AS invalid_lines_kept FROM l""")
def log_trim_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.replace("props", F.lit('"k"'), F.lit('"step"')).alias("value"))
    return runlog.trim_counts(runlog.trimmed_lines(lines, 50))


@entry("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS step FROM events")
def log_json_step_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", runlog.json_step(F.col("props"), "k").alias("step"))


@entry(f"WITH {_REC}, r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY final, ts DESC NULLS LAST, input_pos DESC) AS k, count(*) OVER (PARTITION BY step) AS duplicates FROM rec WHERE step IS NOT NULL) SELECT step, input_pos, final, duplicates FROM r WHERE k = 1")
def log_dedupe_by_step(spark, sf_dir):
    return runlog.one_per_step(records(spark, sf_dir)).select("step", "input_pos", "final", "duplicates")


@entry(f"WITH {_REC} SELECT event_id, round(8 * (tokens - lag(tokens) OVER w) / greatest((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 1e-9), 4) AS tokens_per_sec FROM rec WINDOW w AS (PARTITION BY user_id ORDER BY ts, input_pos)")
def log_throughput(spark, sf_dir):
    return runlog.throughput(records(spark, sf_dir), 8, ["user_id"]).select("event_id", F.round("tokens_per_sec", 4).alias("tokens_per_sec"))


@entry(f"WITH {_REC} SELECT CAST(floor((step - 1) / 200) AS BIGINT) AS window_idx, round(sum(value * (1 + user_id % 7)) / sum(1 + user_id % 7), 6) AS window_loss, count(*) AS n_steps FROM rec WHERE step >= 1 GROUP BY 1")
def log_window_avg(spark, sf_dir):
    steps = records(spark, sf_dir).where("step >= 1").select("step", F.col("value").alias("loss"), (1 + F.col("user_id") % 7).alias("weight"))
    return selection.window_averages(steps, 200).withColumn("window_loss", F.round("window_loss", 6))


@entry(f"WITH {_REC} SELECT step, count(*) AS n, min(input_pos) AS first_pos, max(input_pos) AS last_pos FROM rec WHERE step IS NOT NULL GROUP BY step")
def exposure_coverage(spark, sf_dir):
    batches = records(spark, sf_dir).where("step is not null").select("step", F.col("input_pos").alias("place"), F.col("user_id").alias("shard_idx"), F.lit(0).alias("block_idx"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    back = runlog.exposure_rows(runlog.exposures(batches))
    return back.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_pos"), F.max("place").alias("last_pos"))


@entry("""WITH c AS (SELECT 'n' || n_nationkey AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation), s AS (SELECT 'n' || n_nationkey AS key, CASE WHEN n_nationkey % 5 = 3 THEN 'x' ELSE n_regionkey || '.0' END AS value FROM nation WHERE n_nationkey % 4 <> 1)
SELECT c.key, c.value AS current, s.value AS saved, CASE WHEN s.key IS NULL THEN 'missing' WHEN s.value = c.value || '.0' THEN 'match' ELSE 'mismatch' END AS status FROM c LEFT JOIN s USING (key)""")
def config_diff(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = F.concat(F.lit("n"), "n_nationkey").alias("key")
    saved = n.where("n_nationkey % 4 <> 1").select(key, F.when(F.col("n_nationkey") % 5 == 3, "x").otherwise(F.concat("n_regionkey", F.lit(".0"))).alias("value"))
    return runlog.config_differences(n.select(key, F.col("n_regionkey").cast("string").alias("value")), saved)


@entry(f"WITH {_REC} SELECT step, coalesce(CASE WHEN max(user_id) - 50 >= 0 THEN max(user_id) - 50 END, step * 15) AS skip FROM rec WHERE step IS NOT NULL GROUP BY step")
def resume_skip_count(spark, sf_dir):
    rows = records(spark, sf_dir).where("step is not null").groupBy("step").agg((F.max("user_id") - 50).alias("seen"))
    return rows.select("step", runlog.skip_count(F.col("step"), F.col("seen"), 15).alias("skip"))


@entry("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k > 1000")
def resume_fast_forward(spark, sf_dir):
    return runlog.fast_forward(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), 1000, ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@entry("WITH c AS (SELECT 'ckpt_run_step' || (s_suppkey % 37) AS name, s_suppkey % 11 AS mtime, s_suppkey % 37 AS step FROM supplier WHERE s_suppkey % 3 <> 0) SELECT step, mtime, name FROM c ORDER BY step DESC, mtime DESC, name DESC LIMIT 1")
def checkpoint_pick(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("other"), "s_suppkey")).otherwise(F.concat(F.lit("ckpt_run_step"), F.col("s_suppkey") % 37))
    return runlog.checkpoints(s.select(name.alias("name"), (F.col("s_suppkey") % 11).alias("mtime"))).select("step", "mtime", "name")


@entry("WITH m AS (SELECT DISTINCT CASE WHEN s_suppkey % 4 = 0 THEN 'base' || (s_suppkey % 3) ELSE 'run_step_' || (s_suppkey % 29) END AS name FROM supplier WHERE s_suppkey % 6 <> 5), t AS (SELECT name, CASE WHEN name LIKE 'run%' THEN CAST(substr(name, 10) AS BIGINT) ELSE -1 END AS step FROM m) SELECT name, step, row_number() OVER (ORDER BY step, name) - 1 AS place FROM t")
def model_list(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("base"), k % 3)).otherwise(F.concat(F.lit("run_step_"), k % 29))
    return runlog.model_order(table(spark, sf_dir, "supplier").select(name.alias("name"), (k % 6 != 5).alias("has_config"))).withColumn("place", F.col("place").cast("long"))


@entry("SELECT step, round(CASE WHEN step < 40 THEN 0.001 * (step + 1) / 40.0 WHEN step > 400 THEN 0.0001 ELSE 0.0001 + 0.5 * (1 + cos(pi() * least(1.0, greatest(0.0, (step - 40) / 360.0)))) * 0.0009 END, 9) AS lr FROM (SELECT unnest(range(450)) AS step)")
def lr_schedule(spark, sf_dir):
    steps = spark.range(450).select(F.col("id").alias("step"))
    return steps.select("step", F.round(runlog.learning_rate(F.col("step"), 0.001, 40, 400, 0.1), 9).alias("lr"))


@entry("SELECT label, round(sqrt(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS l2_norm, count(*) AS n_rows FROM embeddings GROUP BY label")
def l2_norm(spark, sf_dir):
    return runlog.l2_norms(table(spark, sf_dir, "embeddings"), ["label"], "embedding").withColumn("l2_norm", F.round("l2_norm", 6))


@entry("SELECT p_partkey, 'run_delta_k' || lpad(CAST(CAST(round_even((p_size % 20) / 20.0 * 1000, 0) AS INTEGER) AS VARCHAR), 4, '0') AS name FROM part")
def run_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", runlog.run_name(F.lit("run"), (F.col("p_size") % 20) / F.lit(20.0), F.lit("delta")).alias("name"))


# ---- report series: a step is a month of orders, a domain is a market segment


def _mean(column):
    """Mean of amounts in whole cents: the sum is exact in any order."""
    return (F.sum(F.round(F.col(column) * 100).cast("long")) / F.count(F.lit(1))) / 100


def _monthly(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    step = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    return rows.groupBy(step.alias("step"), F.col("c_mktsegment").alias("domain")).agg(_mean("o_totalprice").alias("value"), _mean("c_acctbal").alias("other"), F.count(F.lit(1)).alias("n"))


def _maps(spark, sf_dir):
    """Step records with maps by domain; every third step has an explicit average."""
    rows = _monthly(spark, sf_dir)
    entries = lambda v: F.map_from_entries(F.collect_list(F.struct("domain", v)))
    maps = rows.groupBy("step").agg(entries(F.floor("value").cast("double").alias("value")).alias("official"), entries(F.array(F.floor("value").cast("double"), F.floor("other").cast("double")).alias("pair")).alias("full"))
    return maps.withColumn("official", F.when(F.col("step") % 3 == 0, F.map_concat("official", F.create_map(F.lit("average"), F.col("step").cast("double")))).otherwise(F.col("official")))


_MON = """mon AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS step, c_mktsegment AS domain, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS value, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS other, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
lng AS (SELECT step, domain, floor(value) AS value FROM mon UNION ALL SELECT DISTINCT step, 'average', CAST(step AS DOUBLE) FROM mon WHERE step % 3 = 0)"""


@entry(f"WITH {_MON} SELECT step, domain, value FROM lng")
def report_domain_long(spark, sf_dir):
    return report.domain_long(report.has_evaluation(_maps(spark, sf_dir), ["official", "full"]), "official")


@entry(f"WITH {_MON} SELECT step, domain, round((floor(value) + floor(other)) / 2, 4) AS value FROM mon")
def report_pair_average(spark, sf_dir):
    return report.pair_average(_maps(spark, sf_dir), "full").withColumn("value", F.round("value", 4))


@entry(f"WITH {_MON} SELECT step, round(coalesce(max(value) FILTER (domain = 'average'), avg(value) FILTER (domain <> 'average')), 4) AS average FROM lng GROUP BY step")
def report_avg_fallback(spark, sf_dir):
    return report.average_with_fallback(_maps(spark, sf_dir), "official").withColumn("average", F.round("average", 4))


@entry(f"WITH {_MON} SELECT step, domain, value, CASE domain WHEN 'BUILDING' THEN CAST(0.5 AS DOUBLE) WHEN 'MACHINERY' THEN CAST(0.25 AS DOUBLE) END AS baseline FROM lng")
def report_baseline_overlay(spark, sf_dir):
    return report.with_baseline(report.domain_long(_maps(spark, sf_dir), "official"), {"BUILDING": 0.5, "MACHINERY": 0.25})


@entry(f"WITH {_MON} SELECT domain || '/' || step AS step, field, value FROM (SELECT domain, step, 'value' AS field, value FROM mon UNION ALL SELECT domain, step, 'other', other FROM mon UNION ALL SELECT domain, step, 'n', CAST(n AS DOUBLE) FROM mon)")
def report_scalar_long(spark, sf_dir):
    """All segments; the record of a month and segment is named by both."""
    rows = _monthly(spark, sf_dir).withColumn("step", F.concat_ws("/", "domain", "step"))
    return report.scalar_long(rows, ["value", "other", "n"])


@entry(f"WITH {_MON} SELECT step, domain, value, 'primary' AS label FROM mon UNION ALL SELECT step, domain, other, 'compare' FROM mon")
def report_run_compare(spark, sf_dir):
    rows = _monthly(spark, sf_dir)
    return report.labelled_union(primary=rows.select("step", "domain", "value"), compare=rows.select("step", "domain", F.col("other").alias("value")))


@entry(f"WITH {_MON} SELECT step, domain, CASE step % 3 WHEN 0 THEN floor(value) WHEN 1 THEN floor(other) END AS sums, CASE WHEN step % 2 = 0 THEN floor(other) END AS means FROM mon")
def report_payload(spark, sf_dir):
    """Records of three kinds: with the new name, with the old one alone, with the new one empty."""
    rows, k = _monthly(spark, sf_dir), F.col("step") % 3
    value, other = F.floor("value").cast("double"), F.floor("other").cast("double")
    named = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    none = F.lit(None).cast("double")
    sums = F.when(k == 0, named("official_sum", value, "official", other)).when(k == 1, named("official", other)).otherwise(named("official_sum", none, "official", other))
    record = F.map_concat(sums, F.when(F.col("step") % 2 == 0, named("official_mean", other)).otherwise(named("official_none", other)))
    return rows.select("step", "domain", report.payload(record, "official", "sum").alias("sums"), report.payload(record, "official", "mean").alias("means"))


@entry(f"WITH {_MON} SELECT step, domain, floor(value) AS mean_signed_m, floor(other) AS mean_abs_m FROM mon WHERE step % 4 <> 0 AND step % 5 <> 0")
def report_margin_series(spark, sf_dir):
    """A map of statistics a month; every fourth month has no second one, every fifth no number."""
    signed = F.when(F.col("step") % 5 != 0, F.floor("value").cast("double")).otherwise(F.lit(float("nan")))
    size = F.when(F.col("step") % 4 != 0, F.floor("other").cast("double"))
    stats = F.struct(signed.alias("mean_signed_m"), size.alias("mean_abs_m"))
    records_ = _monthly(spark, sf_dir).groupBy("step").agg(F.map_from_entries(F.collect_list(F.struct("domain", stats.alias("s")))).alias("stats"))
    return report.margin_series(records_, "stats")


@entry(f"WITH {_MON} SELECT step, domain, round(value / 1e6, 9) AS accuracy, round(other / 1e6, 9) AS accuracy_norm FROM mon WHERE n % 7 <> 0")
def report_choice_series(spark, sf_dir):
    rows = _monthly(spark, sf_dir).select("step", "domain", F.round(F.col("value") / 1e6, 9).alias("accuracy"), F.when(F.col("n") % 7 != 0, F.round(F.col("other") / 1e6, 9)).alias("accuracy_norm"))
    return report.both_finite(rows, "accuracy", "accuracy_norm")


@entry(f"WITH {_MON} SELECT step, domain, value, 'sum' AS label FROM mon UNION ALL SELECT step, domain, other, 'mean' FROM mon")
def report_sum_vs_mean(spark, sf_dir):
    rows = _monthly(spark, sf_dir)
    return report.labelled_union(sum=rows.select("step", "domain", "value"), mean=rows.select("step", "domain", F.col("other").alias("value")))


@entry(f"WITH {_MON} SELECT max(value IS NOT NULL) AS has_sum, max(CASE WHEN step < 0 THEN other END IS NOT NULL) AS has_mean FROM mon")
def report_reductions(spark, sf_dir):
    return report.reductions(_monthly(spark, sf_dir).withColumn("mean", F.when(F.col("step") < 0, F.col("other"))), "value", "mean")


@entry(f"WITH {_MON}, c AS (SELECT step, domain AS category, value FROM mon WHERE NOT (domain = 'BUILDING' AND step = (SELECT max(step) FROM mon))) SELECT step, category, value FROM c WHERE category IN (SELECT category FROM c WHERE step = (SELECT max(step) FROM c))")
def report_category_series(spark, sf_dir):
    rows = _monthly(spark, sf_dir).select("step", F.col("domain").alias("category"), "value")
    last = rows.agg(F.max("step").alias("top"))
    some = rows.crossJoin(F.broadcast(last)).where("not (category = 'BUILDING' and step = top)").drop("top")
    return report.category_series(some)


@entry(f"WITH {_REC} SELECT step, arg_max(value, input_pos) AS value, count(*) AS n FROM rec WHERE step IS NOT NULL GROUP BY step")
def report_last_write(spark, sf_dir):
    return report.last_write(records(spark, sf_dir).where("step is not null").select("step", "value", "input_pos"))


@entry("WITH l AS (SELECT user_id, count(*) AS n, count(*) FILTER (k > 50) AS removed FROM (SELECT user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1) SELECT user_id, CAST(removed AS INTEGER) AS removed, CAST(n - removed AS INTEGER) AS n_kept, removed > 0 AS rewrite FROM l")
def log_trim_list(spark, sf_dir):
    """A JSON list of records for each user."""
    step = F.replace("props", F.lit('"k"'), F.lit('"step"'))
    texts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(step), ","), F.lit("]")).alias("value"))
    return runlog.trimmed_list(texts, 50).select("user_id", "removed", "n_kept", "rewrite")


@entry("SELECT event_id, CAST(place AS INTEGER) AS place, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM (SELECT event_id, props, unnest(range(CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END)) AS place FROM events)")
def meta_flatten(spark, sf_dir):
    """Metadata as an object, a list, a list in lists, and as nothing of the kind."""
    p, k = F.col("props"), F.col("event_id") % 4
    value = F.when(k == 0, p).when(k == 1, F.concat(F.lit("["), p, F.lit(", "), p, F.lit("]"))).when(k == 2, F.concat(F.lit("[["), p, F.lit("], [["), p, F.lit("], "), p, F.lit(", 7]]"))).otherwise(F.lit("null"))
    rows = runlog.flattened(table(spark, sf_dir, "events").select("event_id", value.alias("value")))
    ordered = rows.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias("all")).select("event_id", F.posexplode("all").alias("place", "r"))
    return ordered.select("event_id", "place", runlog.json_step(F.col("r.value"), "k").alias("k"))


@entry("SELECT CAST(asked AS BIGINT) AS asked, least(asked, n) AS skipped, greatest(n - asked, 0) AS \"left\", n < asked AS exhausted FROM (SELECT count(*) AS n FROM orders), (SELECT unnest([1000, 1000000000]) AS asked)")
def resume_exhaustion(spark, sf_dir):
    schedule = table(spark, sf_dir, "orders").select("o_orderkey")
    return runlog.fast_forward_report(schedule, 1000).unionByName(runlog.fast_forward_report(schedule, 1_000_000_000))


@entry("""WITH c AS (SELECT n_nationkey AS i, n_regionkey AS v FROM nation WHERE n_nationkey % 4 <> 1), a AS (SELECT r_regionkey AS r, unnest([5 * r_regionkey + 1, 5 * r_regionkey + 2]) AS i FROM region),
f AS (SELECT r, first(v ORDER BY a.i) AS v FROM a JOIN c USING (i) GROUP BY r) SELECT 'r' || r AS label, CAST(v AS BIGINT) AS found, CAST(2 AS BIGINT) AS expected, CASE WHEN v = 2 THEN 'match' ELSE 'mismatch' END AS status FROM f""")
def config_architecture(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 1")
    config = n.select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return runlog.architecture(config, [(f"r{r}", [f"n{5 * r + 1}", f"n{5 * r + 2}"], 2) for r in range(5)])
