"""Queries on the tokenised corpus: shards, blocks, assignment, losses, selection, packing.

Each is a thin use of operators over whole tables; the SQL says the same in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions.text import BOS
from loomstead.operators import blocks, losses, rows, scoring, selection, tokenize

# Fixed values of the scaled-down layout.
S, V, B, T = 10_000, 1, 4, 64
BT = B * T
ENTRIES: list = []


def entry(sql: str | None = None):
    def add(f):
        ENTRIES.append((f.__name__, f, sql))
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark, sf_dir):
    return tokenize.with_offsets(tokenize.document_tokens(table(spark, sf_dir, "documents")))


def tokens(spark, sf_dir):
    return tokenize.sharded(placed(spark, sf_dir), S, V)


def shards(spark, sf_dir):
    return tokenize.shard_lengths(placed(spark, sf_dir).select("start", "n_tokens"), S, V, BT)


def laid(spark, sf_dir):
    """The tokenised corpus, kept (in memory, else on disk) for the several reads of a query that scores it."""
    return placed(spark, sf_dir).persist()


def targets(spark, sf_dir):
    return blocks.target_pairs(laid(spark, sf_dir), S, V, B, T)


def scored(spark, sf_dir):
    return losses.ngram_losses(targets(spark, sf_dir), laid(spark, sf_dir))


TOK = f"""
docs AS (SELECT doc_id, list_prepend({BOS}, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), lambda w: CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % {BOS})) AS ids FROM documents),
offs AS (SELECT doc_id, ids, CAST(len(ids) AS BIGINT) AS n, CAST(sum(len(ids)) OVER (ORDER BY doc_id) - len(ids) AS BIGINT) AS start FROM docs),
tok AS (SELECT doc_id, start + i AS pos, ids[i + 1] AS token_id FROM (SELECT doc_id, start, ids, unnest(range(n)) AS i FROM offs)),
tokens AS (SELECT CASE WHEN pos // {S} < {V} THEN 'val' ELSE 'train' END AS split, pos // {S} AS shard_idx, pos % {S} AS token_index, token_id, doc_id FROM tok),
shards AS (SELECT split, shard_idx, count(*) AS n_tokens, count(*) FILTER (token_id = {BOS}) AS n_heads, CAST(CASE WHEN count(*) >= {BT + 1} THEN 1 + (count(*) - {BT + 1}) // {BT} ELSE 0 END AS BIGINT) AS n_blocks FROM tokens GROUP BY split, shard_idx)
"""
TARGETS = f"""{TOK},
targets AS (SELECT t.split, t.shard_idx, t.token_index, t.x, t.token_id AS y, (token_index - 1) // {BT} AS block_idx, ((token_index - 1) % {BT}) // {T} AS row_idx, (token_index - 1) % {T} AS col_idx
  FROM (SELECT *, lag(token_id) OVER (PARTITION BY shard_idx ORDER BY token_index) AS x FROM tokens) t JOIN shards USING (shard_idx) WHERE token_index BETWEEN 1 AND n_blocks * {BT})
"""
SCORED = f"""{TARGETS},
single AS (SELECT token_id, count(*) AS n FROM tokens GROUP BY 1),
pair AS (SELECT x, y, count(*) AS n FROM targets GROUP BY 1, 2),
scored AS (SELECT t.*, round(-ln(CAST(a.n + 1 AS DOUBLE) / ((SELECT count(*) FROM tokens) + {BOS + 1})), 9) AS ref_loss, round(-ln(CAST(p.n + 1 AS DOUBLE) / (b.n + {BOS + 1})), 9) AS student_loss
  FROM targets t JOIN single a ON t.y = a.token_id JOIN single b ON t.x = b.token_id JOIN pair p ON t.x = p.x AND t.y = p.y)
"""


@entry(f"WITH {TOK} SELECT doc_id, n AS n_tokens, start FROM offs")
def tok_doc_stats(spark, sf_dir):
    return placed(spark, sf_dir).select("doc_id", "n_tokens", "start")


@entry(f"WITH {TOK} SELECT * FROM shards")
def tok_shard_counts(spark, sf_dir):
    return tokenize.shard_summary(placed(spark, sf_dir), S, V, BT)


@entry(f"WITH {TOK} SELECT split, count(*) AS n_shards, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(sum(n_heads) AS BIGINT) AS n_docs FROM shards GROUP BY split")
def tok_split_counts(spark, sf_dir):
    counts = tokenize.shard_summary(placed(spark, sf_dir), S, V, BT)
    return counts.groupBy("split").agg(F.count(F.lit(1)).alias("n_shards"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_heads").alias("n_docs"))


@entry("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def tok_doc_limit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(100)


@entry(f"WITH {TOK} SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, CAST((sum(n) + {S - 1}) // {S} AS BIGINT) AS n_shards, count(*) FILTER (list_min(ids) < 0 OR list_max(ids) >= 65536) AS n_out_of_range FROM offs")
def tok_rollup(spark, sf_dir):
    n = F.sum(F.size("ids").cast("long"))
    bad = F.count_if(~F.forall("ids", lambda t: (t >= 0) & (t < 65536)))
    return tokenize.checked(tokenize.document_tokens(table(spark, sf_dir, "documents"))).agg(F.count(F.lit(1)).alias("n_docs"), n.alias("n_tokens"), F.ceil(n / S).alias("n_shards"), bad.alias("n_out_of_range"))


@entry()
def tok_bpe_shard_counts(spark, sf_dir):
    import public_tokenizers

    docs = tokenize.bpe_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return tokenize.shard_summary(tokenize.with_offsets(docs), 100_000, V, BT)


@entry(f"WITH {TOK} SELECT split, shard_idx, n_tokens, n_blocks FROM shards")
def block_counts(spark, sf_dir):
    return shards(spark, sf_dir)


@entry(f"WITH {TOK} SELECT split, shard_idx, block_idx, block_idx * {BT} AS start, block_idx * {BT} + {BT + 1} AS \"end\" FROM (SELECT split, shard_idx, unnest(range(n_blocks)) AS block_idx FROM shards)")
def block_spans(spark, sf_dir):
    return blocks.spans(shards(spark, sf_dir), BT)


@entry(f"WITH {TARGETS} SELECT shard_idx, token_index, x, y FROM targets")
def next_token_pairs(spark, sf_dir):
    return targets(spark, sf_dir).select("shard_idx", "token_index", "x", "y")


@entry(f"WITH {TARGETS} SELECT shard_idx, block_idx, row_idx, min(token_index) AS first_target, max(token_index) AS last_target, max(col_idx) AS last_col FROM targets GROUP BY ALL")
def position_map(spark, sf_dir):
    return targets(spark, sf_dir).groupBy("shard_idx", "block_idx", "row_idx").agg(F.min("token_index").alias("first_target"), F.max("token_index").alias("last_target"), F.max("col_idx").alias("last_col"))


_ASSIGN = f"""{TOK}, placed_ AS (SELECT split, shard_idx, row_number() OVER (PARTITION BY split ORDER BY shard_idx) - 1 AS ord, count(*) OVER (PARTITION BY split) AS n FROM shards),
ranked AS (SELECT split, shard_idx, ord, n, CAST(ord % 4 AS INTEGER) AS rank FROM placed_ WHERE n >= 4 UNION ALL SELECT split, shard_idx, ord, n, CAST(unnest(range(4)) AS INTEGER) FROM placed_ WHERE n < 4),
assigned AS (SELECT split, shard_idx, rank, CAST(ntile(3) OVER (PARTITION BY split, rank ORDER BY ord) - 1 AS INTEGER) AS worker, n < 4 AS share_shards FROM ranked)"""


@entry(f"WITH {_ASSIGN} SELECT * FROM assigned")
def rank_worker_assignment(spark, sf_dir):
    return blocks.assignment(shards(spark, sf_dir), 4, 3)


_SCHEDULE = f"""{_ASSIGN}, spans AS (SELECT split, shard_idx, block_idx, block_idx * {BT} AS start, block_idx * {BT} + {BT + 1} AS "end" FROM (SELECT split, shard_idx, unnest(range(n_blocks)) AS block_idx FROM shards)),
sched AS (SELECT * FROM spans JOIN assigned USING (split, shard_idx) WHERE NOT share_shards OR block_idx % 4 = rank)"""


@entry(f"WITH {_SCHEDULE} SELECT split, shard_idx, block_idx, start, \"end\", rank, worker, share_shards, {B} AS batch_size, {T} AS seq_len FROM sched")
def batch_provenance(spark, sf_dir):
    s = shards(spark, sf_dir)
    return blocks.rank_blocks(blocks.spans(s, BT), blocks.assignment(s, 4, 3), 4).withColumn("batch_size", F.lit(B)).withColumn("seq_len", F.lit(T))


@entry(f"WITH {_SCHEDULE} SELECT split, rank, worker, shard_idx, block_idx FROM (SELECT *, row_number() OVER (PARTITION BY split, rank, worker ORDER BY shard_idx, block_idx) AS k FROM sched) WHERE k <= 50")
def capped_schedule(spark, sf_dir):
    s = shards(spark, sf_dir)
    return blocks.capped(blocks.rank_blocks(blocks.spans(s, BT), blocks.assignment(s, 4, 3), 4), 50).select("split", "rank", "worker", "shard_idx", "block_idx")


@entry(f"WITH {_SCHEDULE} SELECT epoch, shard_idx, block_idx, row_number() OVER (PARTITION BY epoch, shard_idx ORDER BY md5('17|' || epoch || '|' || shard_idx || '|' || block_idx)) AS place FROM (SELECT shard_idx, block_idx, unnest(range(3)) AS epoch FROM spans)")
def seeded_shuffle(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("epoch", "shard_idx").orderBy("order_key")
    mixed = blocks.shuffled(blocks.spans(shards(spark, sf_dir), BT), 17, 3)
    return mixed.select(F.col("epoch").cast("long"), "shard_idx", "block_idx", F.row_number().over(order).cast("long").alias("place"))


@entry()
def replayed_shuffle(spark, sf_dir):
    s = shards(spark, sf_dir)
    return blocks.numpy_shuffled(blocks.rank_blocks(blocks.spans(s, BT), blocks.assignment(s, 4, 3), 4), 17)


@entry(f"WITH {TOK} SELECT shard_idx, n_tokens, n_blocks FROM shards WHERE shard_idx NOT IN (SELECT doc_id FROM labels)")
def pending_shards(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("shard_idx"))
    return blocks.pending(shards(spark, sf_dir), done, "shard_idx").select("shard_idx", "n_tokens", "n_blocks")


@entry(f"""WITH RECURSIVE {TOK}, queue AS MATERIALIZED (SELECT shard_idx, n_blocks, row_number() OVER (ORDER BY n_blocks DESC, shard_idx) AS k FROM shards),
fold AS (SELECT CAST(0 AS BIGINT) AS k, CAST([0, 0, 0] AS BIGINT[]) AS loads, CAST(NULL AS BIGINT) AS shard_idx, 0 AS rank, CAST(0 AS BIGINT) AS n_blocks
  UNION ALL SELECT q.k, list_transform(f.loads, lambda l, i: CASE WHEN i = list_position(f.loads, list_min(f.loads)) THEN l + q.n_blocks ELSE l END), q.shard_idx, list_position(f.loads, list_min(f.loads)) - 1, q.n_blocks
  FROM fold f JOIN queue q ON q.k = f.k + 1)
SELECT shard_idx, CAST(rank AS INTEGER) AS rank, n_blocks FROM fold WHERE k > 0""")
def lpt_assignment(spark, sf_dir):
    return blocks.longest_first(shards(spark, sf_dir), 3)


@entry("SELECT CAST(w AS BIGINT) AS world, CAST(greatest(1, (491520 + w * 4096 - 1) // (w * 4096)) AS BIGINT) AS grad_accum, CAST(greatest(1, (491520 + w * 4096 - 1) // (w * 4096)) * w * 4096 AS BIGINT) AS effective_tokens, CAST(greatest(1, (491520 + w * 4096 - 1) // (w * 4096)) * 4096 AS BIGINT) AS tokens_per_rank FROM (SELECT unnest(range(1, 17)) AS w)")
def batch_math(spark, sf_dir):
    return spark.createDataFrame([(w, *blocks.batch_math(491_520, w, 4, 1024).values()) for w in range(1, 17)], "world long, grad_accum long, effective_tokens long, tokens_per_rank long")


@entry(f"WITH {SCORED} SELECT t.shard_idx, t.token_index, t.split, t.token_id, round(s.ref_loss, 6) AS ref_loss FROM tokens t LEFT JOIN scored s USING (shard_idx, token_index)")
def ref_loss_table(spark, sf_dir):
    return losses.aligned(tokenize.sharded(laid(spark, sf_dir), S, V), scored(spark, sf_dir)).withColumn("ref_loss", F.round("ref_loss", 6))


@entry(f"WITH {TOK} SELECT split, shard_idx, n_tokens, n_blocks, n_blocks * {BT} AS covered, n_tokens - n_blocks * {BT} AS unfilled, round(n_blocks * {BT} / greatest(1, n_tokens), 6) AS coverage_fraction FROM shards")
def coverage_stats(spark, sf_dir):
    return losses.coverage(shards(spark, sf_dir), BT).withColumn("coverage_fraction", F.round("coverage_fraction", 6))


def _meta(s):
    """Loss metadata with planted faults: every fifth shard has none, every third another batch size, every seventh another length."""
    i = F.col("shard_idx")
    return s.where(i % 5 != 4).select(
        "shard_idx", F.col("n_tokens").alias("source_num_tokens"), F.when(i % 7 == 6, F.col("n_tokens") - 1).otherwise(F.col("n_tokens")).alias("num_tokens"),
        F.when(i % 3 == 2, 8).otherwise(B).alias("batch_size"), F.lit(T).alias("seq_len"), F.lit(BT).alias("stride_tokens"), F.lit(BT + 1).alias("block_tokens"),
    )


@entry(f"WITH {TOK} SELECT shard_idx, 'missing' AS error FROM shards WHERE shard_idx % 5 = 4 UNION ALL SELECT shard_idx, 'length' FROM shards WHERE shard_idx % 5 <> 4 AND shard_idx % 7 = 6 UNION ALL SELECT shard_idx, 'batch_size' FROM shards WHERE shard_idx % 5 <> 4 AND shard_idx % 3 = 2")
def alignment_errors(spark, sf_dir):
    s = shards(spark, sf_dir)
    return losses.alignment_errors(s, _meta(s), {"seq_len": T, "batch_size": B, "stride_tokens": BT, "block_tokens": BT + 1})


@entry(f"WITH {TOK} SELECT split, count(*) AS total, count(*) FILTER (shard_idx % 5 <> 4) AS skipped, count(*) FILTER (shard_idx % 5 = 4) AS pending FROM shards GROUP BY split")
def loss_run_summary(spark, sf_dir):
    s = shards(spark, sf_dir)
    return losses.run_summary(s, _meta(s))


_P = ", ".join(str(p / 100) for p in losses.PERCENTILES)
_N = ", ".join(f"'p{p}'" for p in losses.PERCENTILES)


@entry(f"WITH {SCORED} SELECT unnest([{_N}]) AS name, unnest(list_transform(quantile_cont(ref_loss, [{_P}]), lambda x: round(x, 6))) AS value FROM scored")
def loss_percentiles(spark, sf_dir):
    return losses.percentiles(scored(spark, sf_dir)).withColumn("value", F.round("value", 6))


@entry(f"WITH {SCORED} SELECT count(*) AS n, round(avg(ref_loss), 6) AS mean, round(stddev_pop(ref_loss), 6) AS std, round(min(ref_loss), 6) AS lowest, round(max(ref_loss), 6) AS highest FROM scored")
def loss_mean_std(spark, sf_dir):
    out = losses.mean_std(scored(spark, sf_dir))
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "lowest", "highest")))


@entry(f"WITH {SCORED} SELECT r.p AS position, count(s.ref_loss) AS n, round(avg(s.ref_loss), 6) AS mean_loss FROM (SELECT unnest(range({T})) AS p) r LEFT JOIN scored s ON (s.token_index - 1) % {T} = r.p GROUP BY 1")
def loss_by_position(spark, sf_dir):
    return losses.by_position(scored(spark, sf_dir), T).withColumn("mean_loss", F.round("mean_loss", 6))


@entry(f"WITH {SCORED} SELECT count(*) FILTER (y = {BOS}) AS n_bos, count(*) FILTER (y <> {BOS}) AS n_other, round(avg(ref_loss) FILTER (y = {BOS}), 6) AS mean_bos, round(avg(ref_loss) FILTER (y <> {BOS}), 6) AS mean_other FROM scored")
def loss_bos_split(spark, sf_dir):
    out = losses.head_split(scored(spark, sf_dir))
    return out.select("n_bos", "n_other", F.round("mean_bos", 6).alias("mean_bos"), F.round("mean_other", 6).alias("mean_other"))


def _tail_sql(direction: str) -> str:
    return f"tail_ AS (SELECT * FROM scored ORDER BY ref_loss {direction}, shard_idx, token_index LIMIT 128)"


@entry(f"WITH {SCORED}, {_tail_sql('ASC')} SELECT split, shard_idx, token_index, y AS token_id, y = {BOS} AS is_bos, round(ref_loss, 6) AS ref_loss FROM tail_")
def loss_tail_low(spark, sf_dir):
    return losses.tail(scored(spark, sf_dir), 128, False).select("split", "shard_idx", "token_index", F.col("y").alias("token_id"), (F.col("y") == BOS).alias("is_bos"), F.round("ref_loss", 6).alias("ref_loss"))


@entry(f"WITH {SCORED}, {_tail_sql('DESC')} SELECT split, shard_idx, token_index, y AS token_id, y = {BOS} AS is_bos, round(ref_loss, 6) AS ref_loss FROM tail_")
def loss_tail_high(spark, sf_dir):
    return losses.tail(scored(spark, sf_dir), 128, True).select("split", "shard_idx", "token_index", F.col("y").alias("token_id"), (F.col("y") == BOS).alias("is_bos"), F.round("ref_loss", 6).alias("ref_loss"))


@entry(f"""WITH {SCORED}, {_tail_sql('DESC')} SELECT h.shard_idx, h.token_index, h.y AS token_id,
coalesce(string_agg(CAST(t.token_id AS VARCHAR), ' ' ORDER BY t.token_index) FILTER (t.token_index < h.token_index), '') AS left_context,
coalesce(string_agg(CAST(t.token_id AS VARCHAR), ' ' ORDER BY t.token_index) FILTER (t.token_index > h.token_index), '') AS right_context
FROM tail_ h JOIN tokens t ON t.shard_idx = h.shard_idx AND t.token_index BETWEEN h.token_index - 24 AND h.token_index + 24 GROUP BY 1, 2, 3""")
def loss_tail_context(spark, sf_dir):
    high = losses.tail(scored(spark, sf_dir), 128, True).select("shard_idx", "token_index", F.col("y").alias("token_id"))
    return losses.with_context(high, tokenize.sharded(laid(spark, sf_dir), S, V), 24)


@entry(f"WITH {SCORED}, e AS (SELECT min(ref_loss) AS lo, max(ref_loss) AS hi FROM scored) SELECT CAST(CASE WHEN hi > lo THEN least(200, floor((ref_loss - lo) / (hi - lo) * 200) + 1) ELSE 1 END AS INTEGER) AS bin, count(*) AS n FROM scored, e GROUP BY 1")
def loss_histogram(spark, sf_dir):
    return losses.histogram(scored(spark, sf_dir), 200)


@entry(f"WITH {SCORED}, r AS (SELECT ref_loss, row_number() OVER (ORDER BY ref_loss) AS k, count(*) OVER () AS n FROM scored) SELECT round(ref_loss, 6) AS ref_loss, max(k) AS last_rank, round(max(k) / max(n), 9) AS share FROM r GROUP BY r.ref_loss")
def loss_ecdf(spark, sf_dir):
    return losses.distribution(scored(spark, sf_dir)).select(F.round("ref_loss", 6).alias("ref_loss"), "last_rank", F.round("share", 9).alias("share"))


@entry(f"""WITH {SCORED}, cov AS (SELECT shard_idx, n_blocks * {BT} AS c, sum(n_blocks * {BT}) OVER (ORDER BY shard_idx) - n_blocks * {BT} AS before FROM shards),
draws AS (SELECT j AS draw, CAST('0x' || substr(md5('0|' || j), 1, 15) AS BIGINT) % (SELECT CAST(sum(c) AS BIGINT) FROM cov) AS place FROM (SELECT unnest(range(5000)) AS j))
SELECT d.draw, round(s.ref_loss, 6) AS ref_loss FROM draws d JOIN cov v ON d.place >= v.before AND d.place < v.before + v.c JOIN scored s ON s.shard_idx = v.shard_idx AND s.token_index = d.place - v.before + 1""")
def loss_sample(spark, sf_dir):
    return losses.drawn(laid(spark, sf_dir), scored(spark, sf_dir), 5_000, S, BT).withColumn("ref_loss", F.round("ref_loss", 6))


@entry(f"WITH {TARGETS} SELECT shard_idx, block_idx, token_index, round(ln(1.0 + ((CAST(y AS BIGINT) * 31 + x * 17) % 97)), 6) AS loss FROM targets")
def loss_by_scorer(spark, sf_dir):
    """Blocks as a scorer reads them: their ids in one array, a loss for each target."""
    ids = F.array_sort(F.collect_list(F.struct("token_index", "x", "y")))  # a block has a fixed number of targets
    whole = targets(spark, sf_dir).groupBy("shard_idx", "block_idx").agg(ids.alias("p"))
    whole = whole.select("shard_idx", "block_idx", F.concat(F.array(F.col("p")[0]["x"]), F.transform("p", lambda z: z["y"])).alias("ids"))
    out = scoring.block_losses(whole, scoring.formula(), ["shard_idx", "block_idx"])
    return out.select("shard_idx", "block_idx", (F.col("block_idx") * BT + F.col("at")).alias("token_index"), F.round("loss", 6).alias("loss"))


def _rho_sql(score: str, frac: float, cap: float) -> str:
    under = "true" if cap <= 0 else f"ref_loss <= {cap}"
    return f"""{SCORED}, r1 AS (SELECT *, round({score}, 9) AS score, {under} AS under FROM scored),
r2 AS (SELECT *, CASE WHEN count(*) FILTER (under) OVER (PARTITION BY shard_idx, block_idx) > 0 THEN under ELSE true END AS candidate FROM r1),
r3 AS (SELECT *, greatest(1, ceil(CAST({frac} AS DOUBLE) * count(*) FILTER (candidate) OVER (PARTITION BY shard_idx, block_idx))) AS k, rank() OVER (PARTITION BY shard_idx, block_idx, candidate ORDER BY score DESC) AS rk FROM r2),
sel AS (SELECT *, candidate AND rk <= k AS kept FROM r3),
stats AS (SELECT split, shard_idx, block_idx, count(*) AS n_tokens, count(*) FILTER (candidate) AS n_candidates, count(*) FILTER (kept) AS n_kept, count(*) FILTER (kept) / count(*) AS keep_share,
  coalesce(sum(student_loss) FILTER (kept), 0) / greatest(1, count(*) FILTER (kept)) AS loss, avg(ref_loss) AS mean_ref FROM sel GROUP BY 1, 2, 3)"""


_STATS = "SELECT split, shard_idx, block_idx, n_tokens, n_candidates, n_kept, round(keep_share, 6) AS keep_share, round(loss, 6) AS loss, round(mean_ref, 6) AS mean_ref FROM stats"
_DELTA, _REF, _CAP = _rho_sql("student_loss - ref_loss", 0.7, 0), _rho_sql("-ref_loss", 0.55, 0), _rho_sql("student_loss - ref_loss", 0.6, 8.0)


def _rounded(stats):
    return stats.select(*selection.BLOCK, "n_tokens", "n_candidates", "n_kept", *(F.round(c, 6).alias(c) for c in ("keep_share", "loss", "mean_ref")))


@entry(f"WITH {_DELTA} SELECT shard_idx, token_index, round(score, 9) AS score, kept FROM sel")
def rho_delta(spark, sf_dir):
    return selection.select_tokens(selection.whole_blocks(scored(spark, sf_dir), BT), 0.7).select("shard_idx", "token_index", "score", "kept")


@entry(f"WITH {_REF} {_STATS}")
def rho_ref_only(spark, sf_dir):
    return _rounded(selection.block_stats(selection.select_tokens(scored(spark, sf_dir), 0.55, "ref_only")))


@entry(f"WITH {_CAP} {_STATS}")
def rho_capped(spark, sf_dir):
    return _rounded(selection.block_stats(selection.select_tokens(scored(spark, sf_dir), 0.6, cap=8.0)))


@entry(f"WITH {_DELTA} {_STATS}")
def rho_block_stats(spark, sf_dir):
    return _rounded(selection.block_stats(selection.select_tokens(scored(spark, sf_dir), 0.7)))


@entry(f"WITH {SCORED} SELECT split, shard_idx, block_idx, count(*) AS n_tokens, count(*) AS n_candidates, count(*) AS n_kept, CAST(1 AS DOUBLE) AS keep_share, round(avg(student_loss), 6) AS loss, CAST(NULL AS DOUBLE) AS mean_ref FROM scored GROUP BY 1, 2, 3")
def rho_warmup(spark, sf_dir):
    return _rounded(selection.plain_stats(scored(spark, sf_dir)))


@entry(f"""WITH {_DELTA}, st AS (SELECT *, (row_number() OVER (PARTITION BY split, shard_idx ORDER BY block_idx) - 1) // 15 AS step FROM stats)
SELECT split, shard_idx, step, round(avg(loss), 6) AS mean_loss, round(avg(keep_share), 6) AS mean_keep_share, CAST(round_even(avg(n_kept), 0) AS BIGINT) AS mean_kept, round(sum(loss * n_kept) / sum(n_kept), 6) AS weighted_loss FROM st GROUP BY 1, 2, 3""")
def rho_step_rollup(spark, sf_dir):
    steps = selection.step_rollup(selection.block_stats(selection.select_tokens(scored(spark, sf_dir), 0.7)), 15)
    return steps.select("split", "shard_idx", "step", F.round("mean_loss", 6).alias("mean_loss"), F.round("mean_keep_share", 6).alias("mean_keep_share"), "mean_kept", F.round("weighted_loss", 6).alias("weighted_loss"))


#: Lanes that are packed side by side.
LANES = 8


def _packed(spark, sf_dir):
    return rows.pack(placed(spark, sf_dir).select("doc_id", "n_tokens"), seq_len=1024, lanes=LANES)


@entry()
def pack_rows(spark, sf_dir):
    return _packed(spark, sf_dir)


@entry()
def pack_crop_stats(spark, sf_dir):
    return rows.crop_stats(_packed(spark, sf_dir))


@entry()
def packed_row_blocks(spark, sf_dir):
    """Whole blocks of B packed rows, with their first and last row."""
    whole = _packed(spark, sf_dir).select("lane", "row_id").distinct().groupBy("lane").agg(F.floor(F.count(F.lit(1)) / B).alias("n_blocks")).where("n_blocks > 0")
    each = whole.select("lane", F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("block_idx"))
    return each.select("lane", "block_idx", (F.col("block_idx") * B).alias("first_row"), (F.col("block_idx") * B + B - 1).alias("last_row"))


@entry()
def packed_shards(spark, sf_dir):
    """Packed rows in shards of 20,000 tokens: rows, pieces and tokens of each."""
    pieces = rows.in_shards(_packed(spark, sf_dir), rows.shard_rows(1024, 20_000))
    return pieces.groupBy("lane", "shard_idx").agg((F.max("row_in_shard") + 1).alias("n_rows"), F.count(F.lit(1)).alias("n_pieces"), F.sum("used").alias("n_tokens"))


@entry(f"WITH {_SCHEDULE} SELECT CAST(rank AS INTEGER) AS rank, shard_idx, block_idx FROM (SELECT * FROM spans WHERE split = 'val' ORDER BY shard_idx, block_idx LIMIT 50), (SELECT unnest(range(4)) AS rank)")
def validation_schedule(spark, sf_dir):
    return blocks.validation(blocks.spans(blocks.require_blocks(shards(spark, sf_dir)), BT), 4, 50).select("rank", "shard_idx", "block_idx")


@entry(f"WITH {TOK} SELECT split, shard_idx, n_tokens, n_blocks FROM shards ORDER BY shard_idx LIMIT 5")
def shard_cap(spark, sf_dir):
    return blocks.first_shards(shards(spark, sf_dir), 5)
