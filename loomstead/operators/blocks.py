"""Blocks of a shard, rows of a block, and who works on what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_shape(batch: int, seq_len: int, stride: int | None = None) -> None:
    if batch <= 0 or seq_len <= 0 or (stride is not None and stride <= 0):
        raise ValueError("batch, sequence length and stride must be positive")


def require_blocks(shards: DataFrame) -> DataFrame:
    """The same shards; running it fails if none of them holds a block."""
    most = shards.agg(F.coalesce(F.max("n_blocks"), F.lit(0)).alias("_most"))  # one row
    checked = shards.crossJoin(F.broadcast(most)).withColumn("n_blocks", F.when(F.col("_most") > 0, F.col("n_blocks")).otherwise(F.raise_error(F.lit("no shard holds a block")).cast("long")))
    return checked.drop("_most")


def spans(shards: DataFrame, block_tokens: int, stride: int | None = None) -> DataFrame:
    """split, shard_idx, block_idx, start, end of every block; end is one past its last target."""
    step = block_tokens if stride is None else stride
    check_shape(1, block_tokens, step)
    rows = shards.where("n_blocks > 0").select("split", "shard_idx", F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("block_idx"))
    return rows.withColumn("start", F.col("block_idx") * step).withColumn("end", F.col("start") + block_tokens + 1)


def whole_blocks(n: str, block_tokens: int) -> str:
    """SQL for the blocks (block_tokens inputs and one more target) of a shard of n tokens."""
    return f"if({n} > {block_tokens}, ({n} - 1) div {block_tokens}, 0L)"


def target_pairs(placed: DataFrame, shard_tokens: int, val_shards: int, batch: int, seq_len: int) -> DataFrame:
    """Each covered target token y with its input token x and its shard, block, row and column.

    placed: doc_id, ids, n_tokens, start. A document's tokens are paired inside its array; the token
    before a document comes from the one that ends there. Places are arithmetic on the total alone.
    """
    check_shape(batch, seq_len)
    bt = batch * seq_len
    total = placed.agg(F.max(F.col("start") + F.col("n_tokens")).alias("total"))  # one row
    ends = placed.where("n_tokens > 0").select((F.col("start") + F.col("n_tokens")).alias("start"), F.element_at("ids", -1).alias("before"))
    inputs = F.concat(F.array("before"), F.slice("ids", 1, F.greatest(F.size("ids") - 1, F.lit(0))))
    rows = placed.join(ends, "start", "left").select("start", F.posexplode(F.arrays_zip(inputs.alias("x"), F.col("ids").alias("y"))).alias("at", "t"))
    rows = rows.crossJoin(F.broadcast(total)).select(F.expr(f"(start + at) div {shard_tokens}").alias("shard_idx"), F.expr(f"(start + at) % {shard_tokens}").alias("token_index"), "t.x", "t.y", "total")
    covered = whole_blocks(f"least({shard_tokens}L, total - shard_idx * {shard_tokens})", bt)
    rows = rows.where(F.expr(f"token_index between 1 and {covered} * {bt}"))
    split = F.when(F.col("shard_idx") < val_shards, "val").otherwise("train").alias("split")
    return rows.select(
        split, "shard_idx", "token_index", "x", "y",
        F.expr(f"(token_index - 1) div {bt}").alias("block_idx"), F.expr(f"((token_index - 1) % {bt}) div {seq_len}").alias("row_idx"), F.expr(f"(token_index - 1) % {seq_len}").alias("col_idx"),
    )


def assignment(shards: DataFrame, world: int, workers: int) -> DataFrame:
    """rank and worker of each shard of a split: round robin over ranks, then contiguous even parts over workers.

    Where a split has fewer shards than ranks, every rank has all of them and takes every world-th block.
    """
    order = Window.partitionBy("split").orderBy("shard_idx")
    whole = Window.partitionBy("split")
    placed = shards.withColumn("ord", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(whole))
    alone = placed.where(F.col("n") >= world).withColumn("rank", (F.col("ord") % world).cast("int"))
    shared = placed.where(F.col("n") < world).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(world - 1))))
    both = alone.unionByName(shared)
    mine = Window.partitionBy("split", "rank")
    return both.withColumn("worker", (F.ntile(workers).over(mine.orderBy("ord")) - 1).cast("int")).select(
        "split", "shard_idx", "rank", "worker", (F.col("n") < world).alias("share_shards")
    )


def rank_blocks(blocks: DataFrame, assigned: DataFrame, world: int) -> DataFrame:
    """The blocks of each rank and worker."""
    joined = blocks.join(assigned, ["split", "shard_idx"])
    return joined.where(~F.col("share_shards") | (F.col("block_idx") % world == F.col("rank")))


def capped(schedule: DataFrame, most: int) -> DataFrame:
    """The first ``most`` blocks of each rank and worker."""
    order = Window.partitionBy("split", "rank", "worker").orderBy("shard_idx", "block_idx")
    return schedule.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def shuffled(blocks: DataFrame, seed: int, epochs: int) -> DataFrame:
    """Every block once an epoch, in an order that seed and epoch fix; order is kept as a column."""
    rows = blocks.select("split", "shard_idx", "block_idx", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    return rows.withColumn("order_key", F.md5(F.concat_ws("|", F.lit(str(seed)), "epoch", "shard_idx", "block_idx")))


def numpy_shuffled(schedule: DataFrame, seed: int) -> DataFrame:
    """Exact replay of a generator seeded by rank and worker: one group is one worker's own schedule."""
    import numpy as np

    def run(key, pdf):
        pdf = pdf.sort_values(["shard_idx", "block_idx"]).reset_index(drop=True)
        order = np.arange(len(pdf))
        np.random.default_rng(seed + 1000 * int(key[0]) + int(key[1])).shuffle(order)
        return pdf.iloc[order].assign(place=range(len(pdf)))[["rank", "worker", "shard_idx", "block_idx", "place"]]

    return schedule.select("rank", "worker", "shard_idx", "block_idx").groupBy("rank", "worker").applyInPandas(run, "rank int, worker int, shard_idx long, block_idx long, place long")


def pending(shards: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Shards without a finished result."""
    return shards.join(done.select(key).distinct(), key, "left_anti")


def validation(blocks: DataFrame, world: int, most: int) -> DataFrame:
    """The first blocks of the validation split in order, the same for every rank."""
    first = blocks.where("split = 'val'").orderBy("shard_idx", "block_idx").limit(most)
    return first.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(world - 1))))


def first_shards(shards: DataFrame, most: int) -> DataFrame:
    """A cap for trial runs: the first shards in order."""
    return shards.orderBy("shard_idx").limit(most)


def longest_first(shards: DataFrame, world: int) -> DataFrame:
    """Greedy assignment: shards by falling blocks, each to the least loaded rank (the lowest of equals).

    The rule is sequential: one task reads one row a shard in order and holds the ranks' loads alone.
    """
    import pyarrow as pa

    def run(batches):
        import heapq

        loads = [(0, rank) for rank in range(world)]
        for batch in batches:
            ranks = []
            for n in batch.column(1).to_pylist():
                load, rank = loads[0]
                heapq.heapreplace(loads, (load + n, rank))
                ranks.append(rank)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranks, pa.int32()), batch.column(1)], names=["shard_idx", "rank", "n_blocks"])

    ordered = shards.select("shard_idx", F.col("n_blocks").cast("long")).repartition(1).sortWithinPartitions(F.col("n_blocks").desc(), "shard_idx")
    return ordered.mapInArrow(run, "shard_idx long, rank int, n_blocks long")


def batch_math(total: int, world: int, batch: int, seq_len: int) -> dict[str, int]:
    """Gradient accumulation for a wanted number of tokens a step, and the tokens that gives."""
    step = world * batch * seq_len
    accumulation = max(1, -(-total // step))
    return {"grad_accum": accumulation, "effective_tokens": accumulation * step, "tokens_per_rank": accumulation * batch * seq_len}
