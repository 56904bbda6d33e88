"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources get targets by weight, none above ``cap`` times its size. A source's
documents are dealt to shards by a hash, laid end to end in a seeded order, and
cut into blocks of equal size. Blocks are apportioned to sources by the highest
quotients v / (2 a + 1), then a source's blocks to groups of GROUP_SHARDS shards
and a group's to its shards in the same way.
A shard takes each of its blocks quota div n times, and the first quota mod n
in seeded order once more. All of it is DataFrame work on (id, source, size).

Quotients are compared near the natural quota alone: at one vote a block no
source's seats can differ from its quota by more than the stated margin, so as
many rows are ranked as there are sources (or groups, or shards of a group), not blocks.

Defined cases: a null text has size 0; a null source is a source of its own,
last by code point; rows of size 0 take nothing; rows without a doc_id count
like others (their text deals them to shards); repeated rows are separate rows; if all sizes are 0, nothing is
taken; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm.common import WORD, discard, staged

# Fixed values of the production mix.
WEIGHTS, CAP, BLOCK, SHARD_WORDS, GROUP_SHARDS, SEED = (5, 2, 1), 3, 128, 1 << 16, 1024, "mix-1"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (that deals a row to its shard), size (words of the whole text)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    return docs.select("doc_id", "source", key.alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """A row a source: rank, source, source_size, target.

    The excess over caps is reshared by weight until none is above: the rate of
    the uncapped sources follows from running sums over sources by cap / weight.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source is ordered in one task
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = each.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("double")
    )
    limit = (F.lit(cap) * F.col("source_size")).cast("double")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy((limit / F.col("weight")).asc(), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    nil = F.lit(0.0)
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum(limit).over(before), nil)
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), nil)
    rates = ranked.withColumn("rate", left / weight_left).withColumn("capped", limit / F.col("weight") < F.col("rate"))
    rate = F.min(F.when(~F.col("capped"), F.struct((limit / F.col("weight")).alias("r"), F.col("rank").alias("k"), F.col("rate").alias("rate")))).over(everything)["rate"]
    return rates.withColumn("target", F.least(limit, F.col("weight") * F.coalesce(rate, nil))).select("rank", "source", "source_size", "target")


def apportioned(rows: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Adds ``quota``: ``seats`` given to the rows of each ``by`` group by the highest quotients votes / (2 a + 1).

    votes are in seats (their sum is near ``seats``); no row gets more than ``most``.
    """
    group = Window.partitionBy(*by)
    n, seats = F.count(F.lit(1)).over(group), F.greatest(F.col("seats"), F.lit(1))
    margin = F.col("votes") * 3 * (n + 1) / seats + 2
    low = F.greatest(F.lit(0), F.least(F.col("most"), F.floor(F.col("votes") - margin))).cast("long")
    high = F.greatest(low, F.least(F.col("most"), F.ceil(F.col("votes") + margin))).cast("long")
    bounded = rows.withColumn("low", low).withColumn("high", high).withColumn("open", F.col("seats") - F.sum("low").over(group))
    tried = bounded.withColumn("a", F.explode_outer(F.when(F.col("high") > F.col("low"), F.sequence(F.col("low"), F.col("high") - 1))))
    best = Window.partitionBy(*by).orderBy(F.when(F.col("a").isNull(), 1).otherwise(0), (F.col("votes") / (2 * F.col("a") + 1)).desc(), *key, "a")
    won = tried.withColumn("won", (F.col("a").isNotNull() & (F.row_number().over(best) <= F.col("open"))).cast("long"))
    keep = [c for c in rows.columns]
    return won.groupBy(*keep, "low").agg(F.sum("won").alias("more")).select(*keep, (F.col("low") + F.col("more")).alias("quota"))


def mix(
    docs: DataFrame, weights=WEIGHTS, cap: int = CAP, block: int = BLOCK, shard_words: int = SHARD_WORDS,
    group_shards: int = GROUP_SHARDS, seed: str = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of (doc_id, source, text)."""
    scratch: list[str] = []
    rows = staged(sized(docs), "sizes", scratch)
    plan = staged(targets(rows, weights, cap).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")), "targets", scratch)
    dealt = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    hashed = F.md5(F.concat_ws("|", F.lit(seed), "key"))
    dealt = dealt.withColumn("h", hashed).withColumn("shard", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.col("shards")))
    line = Window.partitionBy("rank", "shard").orderBy(F.substring("h", 9, 24), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = staged(dealt.withColumn("at", F.sum("size").over(line) - F.col("size")).drop("h", "key", "shards"), "laid")

    shards = laid.groupBy("rank", "shard", "source_size", "target").agg(F.sum("size").alias("words")).where("words > 0")
    shards = staged(shards.withColumn("blocks", F.ceil(F.col("words") / block).cast("long")), "shards", scratch)
    sources = shards.groupBy("rank", "source_size", "target").agg(F.sum("blocks").alias("blocks"))
    sources = sources.withColumn("votes", F.col("target") * F.col("blocks") / F.col("source_size")).withColumn("most", F.col("blocks") * cap).withColumn("one", F.lit(1))
    all_sources = Window.partitionBy("one")
    sources = sources.withColumn("seats", F.round(F.sum(F.round("votes", 6)).over(all_sources)).cast("long"))
    quotas = apportioned(sources, ["one"], ["rank"]).select("rank", F.col("blocks").alias("of"), F.col("quota").alias("seats"))
    shards = shards.withColumn("group", F.expr(f"shard div {group_shards}"))
    groups = shards.groupBy("rank", "group").agg(F.sum("blocks").alias("blocks")).join(quotas, "rank")
    groups = groups.withColumn("votes", F.col("seats") * F.col("blocks") / F.col("of")).withColumn("most", F.col("blocks") * cap)
    group_quotas = apportioned(groups.select("rank", "group", "blocks", "seats", "votes", "most"), ["rank"], ["group"])
    group_quotas = group_quotas.select("rank", "group", F.col("blocks").alias("of"), F.col("quota").alias("seats"))
    each = shards.join(group_quotas, ["rank", "group"]).withColumn("votes", F.col("seats") * F.col("blocks") / F.col("of")).withColumn("most", F.col("blocks") * cap)
    shard_quotas = staged(apportioned(each.select("rank", "group", "shard", "words", "blocks", "seats", "votes", "most"), ["rank", "group"], ["shard"]).drop("group"), "quotas")
    discard(docs.sparkSession, scratch)

    b = shard_quotas.withColumn("b", F.explode(F.expr("sequence(0L, blocks - 1)")))
    seeded = Window.partitionBy("rank", "shard").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "rank", "shard", "b")), "b")
    times = F.floor(F.col("quota") / F.col("blocks")) + (F.row_number().over(seeded) <= F.col("quota") % F.col("blocks")).cast("long")
    cut = b.select("rank", "shard", "b", times.alias("times"), F.expr("(b * words) div blocks").alias("from"), F.expr("((b + 1) * words) div blocks").alias("to"))

    some = laid.where("size > 0").join(shard_quotas.select("rank", "shard", "words", "blocks"), ["rank", "shard"])
    spans = some.withColumn("b", F.explode(F.expr("sequence(((at + 1) * blocks - 1) div words, ((at + size) * blocks - 1) div words)")))
    overlap = (F.least(F.col("at") + F.col("size"), F.col("to")) - F.greatest("at", "from")) * F.col("times")
    base = ["doc_id", "source", "size", "source_size", "target"]
    # both sides are exploded: their sizes are not those of the small tables they come from, so neither is broadcast
    taken = spans.join(cut.hint("merge"), ["rank", "shard", "b"]).groupBy("rank", "shard", "at", *base).agg(F.sum(overlap).alias("taken"))
    nothing = laid.where("size = 0").select(*base, F.lit(0).cast("long").alias("taken"))
    return taken.select(*base, "taken").unionByName(nothing)


#: The same for DuckDB, step by step; ``{documents}`` is the input.
ORACLE = """
WITH rows_ AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), 'none' || md5(coalesce(text, ''))) AS key, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {documents}),
each_ AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM each_),
weighted AS (SELECT *, CAST([5, 2, 1][(rnk - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS lim FROM ranked),
rates AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(lim) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS rate
  FROM weighted WINDOW p AS (ORDER BY lim / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final_rate AS (SELECT arg_min(rate, (lim / weight, rnk)) AS r FROM rates WHERE NOT lim / weight < rate),
plan_ AS (SELECT rnk, source, source_size, least(lim, weight * coalesce((SELECT r FROM final_rate), 0.0)) AS target,
  greatest(1, CAST(ceil(source_size / 65536) AS BIGINT)) AS shards FROM weighted),
dealt AS (SELECT d.doc_id, d.source, d.size, p.rnk, p.source_size, p.target, p.shards, md5('mix-1|' || d.key) AS h
  FROM rows_ d JOIN plan_ p ON d.source IS NOT DISTINCT FROM p.source),
laid AS (SELECT *, CAST(sum(size) OVER (PARTITION BY rnk, shard ORDER BY substr(h, 9, 24), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS at_
  FROM (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % shards AS shard FROM dealt)),
shards_ AS (SELECT rnk, shard, source_size, target, CAST(sum(size) AS BIGINT) AS words, CAST(ceil(sum(size) / 128) AS BIGINT) AS blocks FROM laid GROUP BY ALL HAVING sum(size) > 0),
src AS (SELECT rnk, source_size, target, CAST(sum(blocks) AS BIGINT) AS blocks, target * sum(blocks) / source_size AS votes FROM shards_ GROUP BY rnk, source_size, target),
src_seats AS (SELECT *, (SELECT CAST(round(sum(round(votes, 6))) AS BIGINT) FROM src) AS seats FROM src),
src_try AS (SELECT rnk, votes, seats, unnest(range(3 * blocks)) AS a FROM src_seats),
src_won AS (SELECT rnk FROM (SELECT rnk, row_number() OVER (ORDER BY votes / (2 * a + 1) DESC, rnk, a) AS k, seats FROM src_try) WHERE k <= seats),
src_quota AS (SELECT s.rnk, s.blocks AS of_, count(w.rnk) AS seats FROM src s LEFT JOIN src_won w USING (rnk) GROUP BY ALL),
gr AS (SELECT s.rnk, s.shard // 1024 AS grp, CAST(sum(s.blocks) AS BIGINT) AS blocks, q.seats, q.seats * sum(s.blocks) / q.of_ AS votes FROM shards_ s JOIN src_quota q USING (rnk) GROUP BY s.rnk, s.shard // 1024, q.seats, q.of_),
gr_try AS (SELECT rnk, grp, seats, votes, unnest(range(3 * blocks)) AS a FROM gr),
gr_won AS (SELECT rnk, grp FROM (SELECT rnk, grp, seats, row_number() OVER (PARTITION BY rnk ORDER BY votes / (2 * a + 1) DESC, grp, a) AS k FROM gr_try) WHERE k <= seats),
gr_quota AS (SELECT g.rnk, g.grp, g.blocks AS of_, count(w.rnk) AS seats FROM gr g LEFT JOIN gr_won w ON g.rnk = w.rnk AND g.grp = w.grp GROUP BY g.rnk, g.grp, g.blocks),
sh AS (SELECT s.rnk, q.grp, s.shard, s.words, s.blocks, q.seats, q.seats * s.blocks / q.of_ AS votes FROM shards_ s JOIN gr_quota q ON s.rnk = q.rnk AND s.shard // 1024 = q.grp),
sh_try AS (SELECT rnk, grp, shard, seats, votes, unnest(range(3 * blocks)) AS a FROM sh),
sh_won AS (SELECT rnk, shard FROM (SELECT rnk, shard, seats, row_number() OVER (PARTITION BY rnk, grp ORDER BY votes / (2 * a + 1) DESC, shard, a) AS k FROM sh_try) WHERE k <= seats),
quota AS (SELECT s.rnk, s.shard, s.words, s.blocks, count(w.rnk) AS quota FROM sh s LEFT JOIN sh_won w ON s.rnk = w.rnk AND s.shard = w.shard GROUP BY ALL),
cut AS (SELECT rnk, shard, b, words, blocks, quota // blocks + CASE WHEN row_number() OVER (PARTITION BY rnk, shard ORDER BY md5('mix-1|' || rnk || '|' || shard || '|' || b), b) <= quota % blocks THEN 1 ELSE 0 END AS times
  FROM (SELECT *, unnest(range(blocks)) AS b FROM quota)),
spans AS (SELECT l.*, q.words, q.blocks, unnest(range(((at_ + 1) * q.blocks - 1) // q.words, ((at_ + size) * q.blocks - 1) // q.words + 1)) AS b
  FROM laid l JOIN quota q USING (rnk, shard) WHERE size > 0),
some_ AS (SELECT s.doc_id, s.source, s.size, s.source_size, s.target, CAST(sum((least(s.at_ + s.size, ((s.b + 1) * s.words) // s.blocks) - greatest(s.at_, (s.b * s.words) // s.blocks)) * c.times) AS BIGINT) AS taken
  FROM spans s JOIN cut c ON s.rnk = c.rnk AND s.shard = c.shard AND s.b = c.b GROUP BY s.rnk, s.shard, s.at_, s.doc_id, s.source, s.size, s.source_size, s.target)
SELECT * FROM some_ UNION ALL SELECT doc_id, source, size, source_size, target, CAST(0 AS BIGINT) FROM laid WHERE size = 0
"""
