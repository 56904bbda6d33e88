"""Per-token losses of a scorer, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.columns import finite
from loomstead.functions.text import BOS
from loomstead.operators.blocks import whole_blocks

# The percentiles that a loss summary has.
PERCENTILES = [0.1, 1, 5, 10, 25, 50, 75, 90, 95, 99, 99.9]


def ngram_losses(targets: DataFrame, documents: DataFrame, vocabulary: int = BOS + 1) -> DataFrame:
    """Adds ref_loss (add-one unigram) and student_loss (add-one bigram) to (x, y) pairs.

    Counts are over all tokens of documents (ids); they are aggregated before they are joined.
    The unigram counts have a row a vocabulary entry at most and are broadcast.
    """
    single = documents.select(F.explode("ids").alias("token_id")).groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))
    total = documents.agg(F.sum(F.size("ids").cast("long")).alias("total"))  # one row
    pair = targets.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_xy"))
    single_y, single_x = (F.broadcast(single.select(F.col("token_id").alias(c), F.col("n").alias(f"n_{c}"))) for c in "yx")
    rows = targets.join(pair, ["x", "y"]).join(single_y, "y").join(single_x, "x").crossJoin(F.broadcast(total))
    ref = -F.log((F.col("n_y") + 1).cast("double") / (F.col("total") + vocabulary))
    student = -F.log((F.col("n_xy") + 1).cast("double") / (F.col("n_x") + vocabulary))
    return rows.withColumn("ref_loss", F.round(ref, 9)).withColumn("student_loss", F.round(student, 9)).drop("n_x", "n_y", "n_xy", "total")


def aligned(tokens: DataFrame, scored: DataFrame) -> DataFrame:
    """Every token with its loss, null where no block has it as a target."""
    return tokens.select("split", "shard_idx", "token_index", "token_id").join(scored.select("shard_idx", "token_index", "ref_loss"), ["shard_idx", "token_index"], "left")


def coverage(shards: DataFrame, stride: int) -> DataFrame:
    covered = F.col("n_blocks") * stride
    return shards.select(
        "split", "shard_idx", "n_tokens", "n_blocks", covered.alias("covered"), (F.col("n_tokens") - covered).alias("unfilled"),
        (covered / F.greatest(F.lit(1), F.col("n_tokens"))).alias("coverage_fraction"),
    )


def alignment_errors(shards: DataFrame, meta: DataFrame, expected: dict[str, int]) -> DataFrame:
    """shard_idx, error of every shard whose loss metadata is missing or does not fit."""
    joined = shards.select("shard_idx", F.col("n_tokens").alias("have")).join(meta, "shard_idx", "left")
    missing = F.when(F.col("source_num_tokens").isNull() & F.col("num_tokens").isNull(), F.lit("missing"))
    wrong = [F.when(F.col("num_tokens") != F.col("have"), F.lit("length")), F.when(F.col("source_num_tokens") != F.col("have"), F.lit("source_num_tokens"))]
    wrong += [F.when(F.col(k) != v, F.lit(k)) for k, v in expected.items()]
    return joined.select("shard_idx", F.explode(F.array_compact(F.array(missing, *wrong))).alias("error"))


def run_summary(shards: DataFrame, done: DataFrame) -> DataFrame:
    """By split: shards, those finished before, those to do."""
    joined = shards.join(done.select("shard_idx", F.lit(True).alias("done")).distinct(), "shard_idx", "left")
    finished = F.count_if(F.coalesce("done", F.lit(False)))
    return joined.groupBy("split").agg(F.count(F.lit(1)).alias("total"), finished.alias("skipped"), (F.count(F.lit(1)) - finished).alias("pending"))


def percentiles(scored: DataFrame) -> DataFrame:
    """name, value: linear-interpolated percentiles, exactly: each is read off the ranks of the distinct losses beside it."""
    place = lambda p: (F.col("total") - 1) * F.lit(p / 100)
    asked = F.array(*(F.struct(F.lit(f"p{p}").alias("name"), place(p).alias("h")) for p in PERCENTILES))
    inside = lambda k: (k >= F.col("last_rank") - F.col("n")) & (k < F.col("last_rank"))
    near = F.filter(asked, lambda a: inside(F.floor(a["h"])) | inside(F.ceil(a["h"])))
    rows = _ranked(scored).select("ref_loss", "n", "last_rank", F.explode(near).alias("a"))
    low, high = (F.max(F.when(inside(f(F.col("a.h"))), F.col("ref_loss"))) for f in (F.floor, F.ceil))
    found = rows.groupBy("a.name").agg(low.alias("low"), high.alias("high"), F.max("a.h").alias("h"))
    return found.select("name", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("h") - F.floor("h"))).alias("value"))


def mean_std(scored: DataFrame) -> DataFrame:
    x = scored.where(finite(F.col("ref_loss")))
    return x.agg(F.count(F.lit(1)).alias("n"), F.avg("ref_loss").alias("mean"), F.stddev_pop("ref_loss").alias("std"), F.min("ref_loss").alias("lowest"), F.max("ref_loss").alias("highest"))


def by_position(scored: DataFrame, seq_len: int) -> DataFrame:
    """Mean loss of each place in a sequence, null for a place without any."""
    found = scored.where(finite(F.col("ref_loss"))).groupBy(((F.col("token_index") - 1) % seq_len).alias("position")).agg(F.count(F.lit(1)).alias("n"), F.avg("ref_loss").alias("mean_loss"))
    places = scored.sparkSession.range(seq_len).select(F.col("id").alias("position"))
    return places.join(found, "position", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def head_split(scored: DataFrame, bos: int = BOS) -> DataFrame:
    """Mean loss of document heads and of other tokens."""
    x = scored.where(finite(F.col("ref_loss")))
    head = F.col("y") == bos
    return x.agg(F.count_if(head).alias("n_bos"), F.count_if(~head).alias("n_other"), F.avg(F.when(head, F.col("ref_loss"))).alias("mean_bos"), F.avg(F.when(~head, F.col("ref_loss"))).alias("mean_other"))


def tail(scored: DataFrame, k: int, highest: bool) -> DataFrame:
    """The k lowest or highest losses, exactly; equal ones by place."""
    order = F.col("ref_loss").desc() if highest else F.col("ref_loss").asc()
    return scored.where(finite(F.col("ref_loss"))).orderBy(order, "shard_idx", "token_index").limit(k)


def with_context(places: DataFrame, tokens: DataFrame, width: int) -> DataFrame:
    """left and right context (ids joined by spaces) of a few places, clipped to the shard.

    Each place asks for the indexes around it, so an equi-join fetches them.
    """
    asked = places.select("shard_idx", F.col("token_index").alias("center"), F.explode(F.sequence(F.col("token_index") - width, F.col("token_index") + width)).alias("token_index"))
    around = asked.join(tokens.select("shard_idx", "token_index", "token_id"), ["shard_idx", "token_index"])
    part = lambda keep: F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("token_index", "token_id")))), lambda s: s["token_id"].cast("string")))
    text = around.groupBy("shard_idx", "center").agg(part(F.col("token_index") < F.col("center")).alias("left_context"), part(F.col("token_index") > F.col("center")).alias("right_context"))
    return places.join(text.withColumnRenamed("center", "token_index"), ["shard_idx", "token_index"])


def histogram(scored: DataFrame, bins: int = 200) -> DataFrame:
    """bin (from 1), n: equal bins between the least and the greatest loss, which is in the last one."""
    x = scored.where(finite(F.col("ref_loss"))).select("ref_loss")
    ends = x.agg(F.min("ref_loss").alias("lo"), F.max("ref_loss").alias("hi"))  # one row
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins), F.floor((F.col("ref_loss") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1)).otherwise(1)
    return x.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _ranked(scored: DataFrame) -> DataFrame:
    """ref_loss, n, last_rank, total of each distinct loss: counts first, running sums in parts, then over the parts' totals."""
    each = scored.where(finite(F.col("ref_loss"))).groupBy("ref_loss").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.floor(F.col("ref_loss") * 8))
    parts = each.groupBy("part").agg(F.sum("n").alias("in_part"))
    above = parts.withColumn("before", F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).withColumn("total", F.sum("in_part").over(Window.partitionBy()))
    rank = F.sum("n").over(Window.partitionBy("part").orderBy("ref_loss")) + F.col("before")
    return each.join(above.select("part", "before", "total"), "part").select("ref_loss", "n", rank.alias("last_rank"), "total")


def distribution(scored: DataFrame) -> DataFrame:
    """ref_loss, last_rank, share: the empirical distribution at each distinct loss.

    Equal losses have ranks of their own, of which the last is kept.
    """
    return _ranked(scored).select("ref_loss", "last_rank", (F.col("last_rank") / F.col("total")).alias("share"))


def drawn(placed: DataFrame, scored: DataFrame, n: int, shard_tokens: int, block_tokens: int, seed: int = 0) -> DataFrame:
    """draw, ref_loss of n places drawn with replacement among all covered places; those without a finite loss are left out.

    A seeded hash of the draw's number is the place: no pass over the losses counts them first.
    """
    total = placed.agg(F.max(F.col("start") + F.col("n_tokens")).alias("total"))  # one row
    covered = lambda tokens: f"{whole_blocks(tokens, block_tokens)} * {block_tokens}L"
    sizes = total.select(F.expr(f"total div {shard_tokens}").alias("full"), F.expr(covered(f"{shard_tokens}L")).alias("each"), F.expr(covered(f"(total % {shard_tokens})")).alias("rest")).where("full * each + rest > 0")
    draws = placed.sparkSession.range(n).select(F.col("id").alias("draw"), F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "id")), 1, 15), 16, 10).cast("long").alias("h"))
    at = draws.crossJoin(F.broadcast(sizes)).withColumn("place", F.expr("h % (full * each + rest)"))
    at = at.withColumn("shard_idx", F.expr("if(each > 0, least(place div greatest(each, 1L), full), full)"))
    at = at.select("draw", "shard_idx", F.expr("place - shard_idx * each + 1").alias("token_index"))
    return at.join(scored.select("shard_idx", "token_index", "ref_loss"), ["shard_idx", "token_index"]).where(finite(F.col("ref_loss"))).select("draw", "ref_loss")


def sequence_length(asked: int | None, meta: dict) -> int:
    """The asked length, else that of the loss metadata, else 1024."""
    return asked or meta.get("seq_len") or 1024
