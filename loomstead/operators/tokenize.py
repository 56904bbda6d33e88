"""Tokenise documents and lay their tokens out in fixed-size shards."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.text import BOS, word_ids

#: Documents that share a local running sum in the two-phase prefix sum.
BUCKET = 256


def document_tokens(docs: DataFrame, bos: int = BOS) -> DataFrame:
    """doc_id, ids: the head mark, then the word ids (a document without words has the mark alone)."""
    return docs.select("doc_id", F.concat(F.array(F.lit(bos)), word_ids(F.col("text"))).alias("ids"))


def _encoding(ranks_path: str, pattern: str):
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_tokens(docs: DataFrame, ranks_path: str, pattern: str, bos: int = BOS) -> DataFrame:
    """doc_id, ids by byte-pair ranks, in Arrow batches."""
    import pyarrow as pa

    def run(batches):
        encode = _encoding(ranks_path, pattern).encode_ordinary
        for batch in batches:
            ids = [[bos, *encode(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def detokenized(tokens: DataFrame, ranks_path: str, pattern: str, bos: int = BOS) -> DataFrame:
    """Adds text: the bytes of ids, decoded in Arrow batches; the head mark has none."""


    @F.pandas_udf("string")
    def decode(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(ranks_path, pattern)
        for column in columns:
            yield pd.Series(encoding.decode_batch([[i for i in ids if i != bos] for ids in column], num_threads=1), dtype=object)

    return tokens.withColumn("text", decode("ids"))


def checked(tokens: DataFrame, limit: int = 1 << 16) -> DataFrame:
    """The same rows; running it fails if an id does not fit the file type."""
    fits = F.forall("ids", lambda t: (t >= 0) & (t < limit))
    return tokens.withColumn("ids", F.when(fits, F.col("ids")).otherwise(F.raise_error(F.lit("token id out of range"))))


def with_offsets(tokens: DataFrame) -> DataFrame:
    """Adds n_tokens and start: tokens of all documents before it in doc_id order.

    Two phases: running sums within buckets of consecutive ids, then over the
    buckets' totals, so that no window holds all documents.
    """
    sized = tokens.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("bucket", F.floor(F.col("doc_id") / BUCKET))
    inner = Window.partitionBy("bucket").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    local = sized.withColumn("start", F.sum("n_tokens").over(inner) - F.col("n_tokens"))
    totals = sized.groupBy("bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    blocks = totals.withColumn("block", F.floor(F.col("bucket") / 4096))
    each = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    tops = blocks.groupBy("block").agg(F.sum("in_bucket").alias("in_block"))
    above = tops.withColumn("base", F.sum("in_block").over(Window.orderBy("block")) - F.col("in_block")).select("block", "base")
    bases = blocks.withColumn("before", F.sum("in_bucket").over(each) - F.col("in_bucket")).join(above, "block")
    joined = local.join(bases.select("bucket", (F.col("before") + F.col("base")).alias("base")), "bucket")
    return joined.withColumn("start", F.col("start") + F.col("base")).drop("bucket", "base")


def sharded(placed: DataFrame, shard_tokens: int, val_shards: int) -> DataFrame:
    """split, shard_idx, token_index, token_id, doc_id: documents laid end to end and cut every ``shard_tokens``."""
    rows = placed.select("doc_id", "start", F.posexplode("ids").alias("at", "token_id"))
    place = F.col("start") + F.col("at")
    shard = F.expr(f"(start + at) div {shard_tokens}")
    return rows.select(
        F.when(shard < val_shards, "val").otherwise("train").alias("split"), shard.alias("shard_idx"), (place % shard_tokens).alias("token_index"), "token_id", "doc_id"
    )


def shard_counts(tokens: DataFrame, block_tokens: int, stride: int | None = None) -> DataFrame:
    """split, shard_idx, n_tokens, n_heads, n_blocks (whole blocks of block_tokens inputs and their targets)."""
    step = stride or block_tokens
    n = F.count(F.lit(1))
    blocks = F.when(n >= block_tokens + 1, 1 + F.floor((n - (block_tokens + 1)) / step)).otherwise(0).cast("long")
    return tokens.groupBy("split", "shard_idx").agg(n.alias("n_tokens"), F.count_if(F.col("token_id") == BOS).alias("n_heads"), blocks.alias("n_blocks"))


def shard_lengths(placed: DataFrame, shard_tokens: int, val_shards: int, block_tokens: int) -> DataFrame:
    """shard_counts without a row a token: from the total alone (n_heads left out)."""
    total = placed.agg(F.max(F.col("start") + F.col("n_tokens")).alias("total")).where("total > 0")
    rows = total.select("total", F.explode(F.expr(f"sequence(0L, (total - 1) div {shard_tokens})")).alias("shard_idx"))
    n = F.least(F.lit(shard_tokens).cast("long"), F.col("total") - F.col("shard_idx") * shard_tokens)
    blocks = F.when(n >= block_tokens + 1, 1 + F.floor((n - (block_tokens + 1)) / block_tokens)).otherwise(0).cast("long")
    return rows.select(F.when(F.col("shard_idx") < val_shards, "val").otherwise("train").alias("split"), "shard_idx", n.alias("n_tokens"), blocks.alias("n_blocks"))


def shard_summary(placed: DataFrame, shard_tokens: int, val_shards: int, block_tokens: int) -> DataFrame:
    """shard_counts without a row a token: lengths from the total, heads from the documents' starts."""
    heads = placed.where("n_tokens > 0").groupBy(F.expr(f"start div {shard_tokens}").alias("shard_idx")).agg(F.count(F.lit(1)).alias("n_heads"))
    lengths = shard_lengths(placed, shard_tokens, val_shards, block_tokens)
    return lengths.join(heads, "shard_idx", "left").select("split", "shard_idx", "n_tokens", F.coalesce("n_heads", F.lit(0).cast("long")).alias("n_heads"), "n_blocks")
