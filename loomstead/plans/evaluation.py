"""Queries on benchmark scores: minimal pairs and multiple choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstead.functions.text import BOS, canonical_category, safe_name, word_ids, words
from loomstead.operators import choices, order, pairs, report, scoring
from loomstead.plans.corpus import table

ENTRIES: list = []
#: Ids of an input of a multiple-choice candidate, at most.
LONGEST = 32


def entry(sql: str | None = None):
    def add(f):
        ENTRIES.append((f.__name__, f, sql))
        return f

    return add


def pair_scores(spark, sf_dir, how="sum", scorer=None):
    """row_index, domain, category and the four scores of an item a document.

    Contexts are two benchmark items (by the document's id modulo their number), targets the two halves of the text.
    """
    scorer = scorer or scoring.formula()
    items = order.numbered(table(spark, sf_dir, "benchmark").select("item_id", word_ids(F.col("text")).alias("c")), "item_id")
    n = items.agg(F.count(F.lit(1)).alias("n_items"))  # one row
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", word_ids(F.col("text")).alias("ids")).crossJoin(F.broadcast(n)).where("n_items > 0")
    docs = docs.withColumn("a", F.pmod("doc_id", "n_items")).withColumn("b", F.pmod(F.col("doc_id") + 1, "n_items"))
    rows = docs.join(items.select(F.col("place").alias("a"), F.col("c").alias("c1")), "a").join(items.select(F.col("place").alias("b"), F.col("c").alias("c2")), "b")
    half = F.expr("(size(ids) + 1) div 2").cast("int")
    targets = (F.slice("ids", 1, half), F.slice("ids", half + 1, F.size("ids")))

    def score(target, context):
        logps = scorer(F.concat(F.array(F.lit(BOS)), F.col(context), target))
        return F.round(pairs.reduce_scores(pairs.conditional_logps(logps, F.size(context)), how), 9)

    each = [score(t, c).alias(f"s{i}{j}") for i, t in enumerate(targets, 1) for j, c in enumerate(("c1", "c2"), 1)]
    return rows.select(F.col("doc_id").alias("row_index"), F.col("lang").alias("domain"), F.col("source").alias("category"), *each)


_WORDS = "list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), lambda w: CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 50256)"


def _score(t: str, c: str, how: str) -> str:
    total = f"list_sum(list_transform(list_zip({t}, list_concat([coalesce({c}[len({c})], {BOS})], {t}[:len({t}) - 1])), lambda z: -ln(1.0 + ((z[1] * 31 + z[2] * 17) % 97))))"
    return f"round(CASE WHEN len({t}) > 0 THEN {total}{'' if how == 'sum' else f' / len({t})'} ELSE 0 END, 9)"


def _pairs_sql(how: str = "sum") -> str:
    return f"""heads AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS place, {_WORDS} AS c FROM benchmark),
w AS (SELECT doc_id, lang, source, {_WORDS} AS ids, (SELECT count(*) FROM benchmark) AS n_items FROM documents),
d AS (SELECT *, ids[1:(len(ids) + 1) // 2] AS t1, ids[(len(ids) + 1) // 2 + 1:] AS t2 FROM w WHERE n_items > 0),
sc AS (SELECT doc_id AS row_index, lang AS domain, source AS category, {_score('t1', 'h1.c', how)} AS s11, {_score('t1', 'h2.c', how)} AS s12, {_score('t2', 'h1.c', how)} AS s21, {_score('t2', 'h2.c', how)} AS s22
  FROM d JOIN heads h1 ON h1.place = doc_id % n_items JOIN heads h2 ON h2.place = (doc_id + 1) % n_items),
m AS (SELECT *, s11 - s12 AS m1, s22 - s21 AS m2, (s11 - s12 + (s22 - s21)) / 2 AS m FROM sc),
dom AS (SELECT domain, min(row_index) AS first_row, count(*) AS n, avg(CAST(m1 > 0 AS DOUBLE)) AS acc1, avg(CAST(m2 > 0 AS DOUBLE)) AS acc2, avg(CAST(m > 0 AS DOUBLE)) AS acc_combined,
  avg(m) AS mean_signed_m, avg(abs(m)) AS mean_abs_m, avg(CAST(m = 0 AS DOUBLE)) AS tie_rate_m FROM m GROUP BY domain)"""


_FLAGS = ", ".join(f"{x} > 0 AS correct_{x}, abs({x}) < 1e-6 AS near_tie_{x}" for x in ("m1", "m2", "m"))
_METRICS = ("acc1", "acc2", "acc_combined", "mean_signed_m", "mean_abs_m", "tie_rate_m")


@entry(f"WITH {_pairs_sql()} SELECT row_index, domain, round(m1, 6) AS m1, round(m2, 6) AS m2, round(m, 6) AS m, {_FLAGS} FROM m")
def pair_margins(spark, sf_dir):
    out = pairs.margins(pair_scores(spark, sf_dir))
    return out.select("row_index", "domain", *(F.round(c, 6).alias(c) for c in ("m1", "m2", "m")), *(f"{k}_{c}" for c in ("m1", "m2", "m") for k in ("correct", "near_tie")))


@entry(f"WITH {_pairs_sql()} SELECT row_index, round(s11, 6) AS s11, round(s12, 6) AS s12, round(s21, 6) AS s21, round(s22, 6) AS s22, abs(m1) < 1e-6 AS tie_1, abs(m2) < 1e-6 AS tie_2 FROM m")
def pair_full_scores(spark, sf_dir):
    """The records of an item with all four scores, and its ties."""
    out = pairs.margins(pair_scores(spark, sf_dir))
    return out.select("row_index", *(F.round(c, 6).alias(c) for c in ("s11", "s12", "s21", "s22")), F.col("near_tie_m1").alias("tie_1"), F.col("near_tie_m2").alias("tie_2"))


@entry(f"WITH {_pairs_sql()} SELECT domain, first_row, n, {', '.join(f'round({c}, 6) AS {c}' for c in _METRICS)} FROM dom")
def pair_domain_metrics(spark, sf_dir):
    out = pairs.domain_metrics(pairs.margins(pair_scores(spark, sf_dir)))
    return out.select("domain", "first_row", "n", *(F.round(c, 6).alias(c) for c in _METRICS))


@entry(f"WITH {_pairs_sql('mean')} SELECT domain, first_row, n, {', '.join(f'round({c}, 6) AS {c}' for c in _METRICS)} FROM dom")
def pair_domain_metrics_mean(spark, sf_dir):
    out = pairs.domain_metrics(pairs.margins(pair_scores(spark, sf_dir, "mean")))
    return out.select("domain", "first_row", "n", *(F.round(c, 6).alias(c) for c in _METRICS))


@entry(f"WITH {_pairs_sql()} SELECT CAST(sum(n) AS BIGINT) AS n, round(avg(acc1), 6) AS full_second, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _METRICS)} FROM dom")
def pair_macro_avg(spark, sf_dir):
    out = pairs.macro_average(pairs.domain_metrics(pairs.margins(pair_scores(spark, sf_dir))))
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("full_second", *_METRICS)))


@entry(f"""WITH {_pairs_sql()}, l AS (SELECT 'category' AS "column", coalesce(replace(trim(category), '_', ' '), '<NA>') AS category, m1, m2 FROM m UNION ALL SELECT 'domain', coalesce(replace(trim(domain), '_', ' '), '<NA>'), m1, m2 FROM m),
e AS (SELECT "column", category, count(*) AS n, avg(CAST(m1 > 0 AS DOUBLE)) AS acc1, avg(CAST(m2 > 0 AS DOUBLE)) AS acc2 FROM l GROUP BY 1, 2),
a AS (SELECT * FROM e UNION ALL SELECT "column", 'average', CAST(sum(n) AS BIGINT), avg(acc1), avg(acc2) FROM e GROUP BY 1)
SELECT "column", category, n, round(acc1, 6) AS acc1, round(acc2, 6) AS acc2 FROM a""")
def pair_category_metrics(spark, sf_dir):
    rows = pairs.margins(pair_scores(spark, sf_dir))
    out = pairs.category_metrics(rows, rows.select("row_index", "category", "domain"), ["category", "domain"])
    return out.select("column", "category", "n", F.round("acc1", 6).alias("acc1"), F.round("acc2", 6).alias("acc2"))


@entry("SELECT page_id, trim(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g')) AS name FROM pages")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", safe_name(F.col("url")).alias("name"))


@entry("SELECT doc_id, coalesce(replace(trim(source), '_', ' '), '<NA>') AS category FROM documents")
def category_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", canonical_category(F.col("source")).alias("category"))


def examples(spark, sf_dir):
    """An example a turn: the text as context, its four quarters (by words) as endings."""
    t = table(spark, sf_dir, "conversations").withColumn("w", words(F.col("text")))
    quarter = lambda i: F.expr(f"cast({i} * size(w) div 4 as int)")
    endings = F.array(*(F.array_join(F.slice("w", quarter(i) + 1, quarter(i + 1) - quarter(i)), " ") for i in range(4)))
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("example_idx"), choices.context(F.col("text"), F.col("role")).alias("prompt"), endings.alias("endings"), (F.col("turn") % 4).cast("int").alias("label"))


def _clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), ' [title]', '. '), '\\[[^\\]]*\\]', '', 'g'), '\\s+', ' ', 'g'))"


_QUARTERS = ", ".join(f"array_to_string(w[{i} * len(w) // 4 + 1:{i + 1} * len(w) // 4], ' ')" for i in range(4))
_EX = f"""ex AS (SELECT conv_id * 1000 + turn AS example_idx, trim({_clean('text')} || ' ' || upper(substr({_clean('role')}, 1, 1)) || substr({_clean('role')}, 2)) AS prompt,
  [{_QUARTERS}] AS endings, CAST(turn % 4 AS INTEGER) AS label FROM (SELECT *, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM conversations)),
cand AS (SELECT example_idx, prompt, label, CAST(i AS INTEGER) AS choice_idx, ' ' || {_clean('endings[i + 1]')} AS continuation FROM (SELECT *, unnest(range(4)) AS i FROM ex)),
ids AS (SELECT example_idx, label, choice_idx, {_WORDS.replace('text', 'prompt')} AS p, {_WORDS.replace('text', 'continuation')} AS c0 FROM cand),
o AS (SELECT *, len(p) + len(c) - {LONGEST} AS over FROM (SELECT *, CASE WHEN len(c0) = 0 THEN [{BOS}] ELSE c0 END AS c FROM ids)),
fit AS (SELECT *, CASE WHEN over <= 0 THEN p WHEN over >= len(p) THEN CAST([] AS INTEGER[]) ELSE p[over + 1:] END AS head, CASE WHEN over >= len(p) THEN c[:{LONGEST}] ELSE c END AS cont FROM o),
inp AS (SELECT example_idx, label, choice_idx, CASE WHEN len(head) + len(cont) < 2 THEN list_concat([{BOS}], list_concat(head, cont)) ELSE list_concat(head, cont) END AS x, len(head) + CASE WHEN len(head) + len(cont) < 2 THEN 1 ELSE 0 END AS start_ FROM fit),
each_ AS (SELECT model, example_idx, label, choice_idx, len(x) - greatest(start_, 1) AS length, round(coalesce(list_sum(list_transform(range(greatest(start_, 1), len(x)), lambda k: -ln(1.0 + ((CAST(x[k + 1] AS BIGINT) * 31 * model + x[k] * 17) % 97)))), 0), 9) AS score
  FROM inp, (SELECT unnest([1, 2, 3]) AS model)),
sc AS (SELECT * FROM each_ WHERE model = 1),
pr AS (SELECT example_idx, min(label) AS label, first(choice_idx ORDER BY score DESC, choice_idx) AS pred, first(choice_idx ORDER BY score / greatest(length, 1) DESC, choice_idx) AS pred_norm FROM sc GROUP BY 1)"""


def _mc_scored(spark, sf_dir, models=1):
    """Every candidate through truncation, padding, the scorer and the continuation's mask; models: a number or a column of the examples."""
    rows = choices.candidates(examples(spark, sf_dir))
    if isinstance(models, list):
        rows = rows.withColumn("model", F.explode(F.array(*map(F.lit, models))))
    head, cont = choices.fitted(word_ids(F.col("prompt")), word_ids(F.col("continuation")), LONGEST, BOS)
    ids, start = choices.padded(head, cont, BOS)
    fit = rows.withColumn("x", ids).withColumn("at", start)
    logps = scoring.formula(F.col("model") if isinstance(models, list) else models)(F.col("x"))
    total, length = choices.sequence_score(choices.continuation_logps(logps, F.col("at")))
    keys = ["model"] if isinstance(models, list) else []
    return fit.select(*keys, "example_idx", "label", "choice_idx", F.round(total, 9).alias("score"), length.alias("length"))


@entry(f"WITH {_EX} SELECT example_idx, choice_idx, round(score, 6) AS score, CAST(length AS INTEGER) AS length FROM sc")
def mc_scores(spark, sf_dir):
    return _mc_scored(spark, sf_dir).select("example_idx", "choice_idx", F.round("score", 6).alias("score"), "length")


@entry(f"WITH {_EX} SELECT example_idx, prompt FROM ex")
def mc_clean_text(spark, sf_dir):
    return examples(spark, sf_dir).select("example_idx", "prompt")


@entry(f"WITH {_EX} SELECT example_idx, choice_idx, label, continuation FROM cand")
def mc_candidates(spark, sf_dir):
    return choices.candidates(examples(spark, sf_dir)).select("example_idx", "choice_idx", "label", "continuation")


@entry(f"WITH {_EX} SELECT example_idx, choice_idx, CAST(len(head) AS INTEGER) AS prompt_tokens, CAST(len(cont) AS INTEGER) AS continuation_tokens, CAST(coalesce(list_sum(head), 0) AS BIGINT) AS prompt_sum FROM fit")
def mc_truncation(spark, sf_dir):
    c = choices.candidates(examples(spark, sf_dir))
    head, cont = choices.fitted(word_ids(F.col("prompt")), word_ids(F.col("continuation")), LONGEST, BOS)
    fit = c.select("example_idx", "choice_idx", head.alias("p"), cont.alias("c"))
    return fit.select("example_idx", "choice_idx", F.size("p").alias("prompt_tokens"), F.size("c").alias("continuation_tokens"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("prompt_sum"))


@entry(f"WITH {_EX} SELECT * FROM pr")
def mc_argmax(spark, sf_dir):
    return choices.predictions(_mc_scored(spark, sf_dir))


@entry(f"WITH {_EX} SELECT count(*) AS num_examples, round(coalesce(avg(CAST(pred = label AS DOUBLE)), 0), 6) AS accuracy, round(coalesce(avg(CAST(pred_norm = label AS DOUBLE)), 0), 6) AS accuracy_norm FROM pr")
def mc_accuracy(spark, sf_dir):
    out = choices.accuracy(choices.predictions(_mc_scored(spark, sf_dir)))
    return out.select("num_examples", F.round("accuracy", 6).alias("accuracy"), F.round("accuracy_norm", 6).alias("accuracy_norm"))


@entry(f"WITH {_EX}, p2 AS (SELECT model, example_idx, min(label) AS label, first(choice_idx ORDER BY score DESC, choice_idx) AS pred, first(choice_idx ORDER BY score / greatest(length, 1) DESC, choice_idx) AS pred_norm FROM each_ GROUP BY 1, 2) SELECT model, count(*) AS num_examples, round(avg(CAST(pred = label AS DOUBLE)), 6) AS accuracy, round(avg(CAST(pred_norm = label AS DOUBLE)), 6) AS accuracy_norm FROM p2 GROUP BY 1")
def mc_model_sweep(spark, sf_dir):
    out = choices.accuracy(choices.predictions(_mc_scored(spark, sf_dir, [1, 2, 3]), ["model", "example_idx"]), ["model"])
    return out.select("model", "num_examples", F.round("accuracy", 6).alias("accuracy"), F.round("accuracy_norm", 6).alias("accuracy_norm"))


@entry("SELECT round(sum(l_discount * l_quantity) / greatest(1.0, sum(l_quantity)), 6) AS val_loss, count(*) AS n_batches FROM lineitem")
def val_loss_weighted(spark, sf_dir):
    out = choices.weighted_loss(table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("loss"), F.col("l_quantity").alias("n")))
    return out.select(F.round("val_loss", 6).alias("val_loss"), "n_batches")


@entry("WITH b AS (SELECT l_orderkey, l_linenumber, l_discount, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 50) SELECT round(sum(l_discount * l_quantity) / greatest(1.0, sum(l_quantity)), 6) AS val_loss, count(*) AS n_batches FROM b")
def val_loss_first_batches(spark, sf_dir):
    """The validation loss as it is logged: over the first 50 batches in order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("loss"), F.col("l_quantity").alias("n"))
    out = choices.weighted_loss(choices.first_batches(rows, 50, ["l_orderkey", "l_linenumber"]))
    return out.select(F.round("val_loss", 6).alias("val_loss"), "n_batches")


@entry(f"""WITH {_pairs_sql()}, s AS (SELECT domain, acc1, mean_abs_m FROM dom), r AS (SELECT domain, acc1 AS a, mean_abs_m AS m FROM s)
SELECT CAST(7 AS BIGINT) AS step, true AS final, key, domain, round(CASE WHEN key LIKE '%margin%' THEN m ELSE a END, 6) AS value FROM r, (SELECT unnest(['eval_official', 'eval_official_sum', 'eval_margin_stats', 'eval_margin_stats_sum']) AS key)
UNION ALL SELECT 7, true, 'eval_official_mean', domain, round(acc1, 6) FROM dom""")
def pair_step_record(spark, sf_dir):
    """The last record of a run, read back key by key (the signs of sums and means agree, so that they share accuracies)."""
    sums, means = (pairs.domain_metrics(pairs.margins(pair_scores(spark, sf_dir, how))) for how in ("sum", "mean"))
    one = report.step_record(7, sums, means, final=True).where("train_loss_last is null")
    value = lambda key: F.map_entries(key) if "margin" not in key else F.map_entries(F.transform_values(key, lambda k, s: s["mean_abs_m"]))
    keys = ["eval_official", "eval_official_sum", "eval_margin_stats", "eval_margin_stats_sum", "eval_official_mean"]
    rows = one.select("step", "final", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), value(k).alias("e")) for k in keys))).alias("r"))
    return rows.select("step", "final", "r.key", F.explode("r.e").alias("x")).select("step", "final", "key", F.col("x.key").alias("domain"), F.round("x.value", 6).alias("value"))
