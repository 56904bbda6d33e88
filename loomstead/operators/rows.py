"""Best-fit row packing: rows of exactly seq_len + 1 tokens that start at a document's head.

The rule is sequential: a buffer of candidates is refilled in order, the longest
that fits is taken (the first of equals); if none fits, the shortest is cropped to
what is left and its rest is discarded. Documents are dealt to lanes; one lane
follows the rule over all documents, more lanes follow it side by side.
"""

from __future__ import annotations

from bisect import bisect_right, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "lane long, row_id long, piece long, doc_id long, doc_len long, used long"


def pack_lane(documents: list[tuple[int, int]], row_tokens: int, buffer_docs: int):
    """(row, piece, doc_id, doc_len, used) of whole rows; documents are (doc_id, length) in order.

    The buffer is kept sorted by length, among equals the latest first, so that both picks are a search.
    """
    source, buffer, row = iter(enumerate(documents)), [], 0

    def refill():
        while len(buffer) < buffer_docs and (nxt := next(source, None)) is not None:
            place, (doc_id, n) = nxt
            insort(buffer, (n, -place, doc_id))

    refill()
    while buffer:
        pieces, left = [], row_tokens
        while left and buffer:
            k = bisect_right(buffer, (left, 1)) - 1
            if k < 0:
                k = bisect_right(buffer, (buffer[0][0], 1)) - 1
            n, _, doc_id = buffer.pop(k)
            refill()
            used = min(n, left)
            pieces.append((row, len(pieces), doc_id, n, used))
            left -= used
        if left == 0:
            yield from pieces
            row += 1


def pack(documents: DataFrame, seq_len: int, buffer_docs: int = 1000, lanes: int = 1) -> DataFrame:
    """Pieces of packed rows of documents (doc_id, n_tokens)."""
    import pandas as pd

    def run(key, pdf):
        pdf = pdf.sort_values("doc_id")
        out = list(pack_lane(list(zip(pdf["doc_id"].tolist(), pdf["n_tokens"].tolist())), seq_len + 1, buffer_docs))
        frame = pd.DataFrame(out, columns=["row_id", "piece", "doc_id", "doc_len", "used"])
        return frame.assign(lane=key[0])[["lane", "row_id", "piece", "doc_id", "doc_len", "used"]]

    lane = F.pmod(F.col("doc_id"), F.lit(lanes)).alias("lane")
    return documents.select(lane, "doc_id", F.col("n_tokens").cast("long")).groupBy("lane").applyInPandas(run, PIECES)


def crop_stats(pieces: DataFrame) -> DataFrame:
    """rows, written, cropped, crop_fraction."""
    written, cropped = F.sum("used"), F.sum(F.col("doc_len") - F.col("used"))
    return pieces.agg(
        F.countDistinct("lane", "row_id").alias("n_rows"), written.alias("written"), cropped.alias("cropped"), F.coalesce(cropped / (cropped + written), F.lit(0.0)).alias("crop_fraction")
    )


def row_blocks(n_rows: int, batch: int) -> int:
    """Whole blocks of ``batch`` rows."""
    return n_rows // batch


def shard_rows(seq_len: int, shard_tokens: int = 100_000_000, asked: int | None = None) -> int:
    """Rows of a packed shard: those asked for, else as many as shard_tokens hold."""
    rows = asked or shard_tokens // (seq_len + 1)
    if rows <= 0:
        raise ValueError("a shard must hold a row")
    return rows


def in_shards(pieces: DataFrame, rows: int) -> DataFrame:
    """Adds shard_idx and row_in_shard to packed rows, by their numbers within a lane."""
    return pieces.withColumn("shard_idx", F.expr(f"row_id div {rows}")).withColumn("row_in_shard", F.expr(f"row_id % {rows}"))


def check_packed(n_tokens: int, seq_len: int, meta: dict) -> int:
    """Rows of a packed shard of n_tokens; an error where the metadata or the size do not fit."""
    if seq_len <= 0 or meta.get("seq_len", seq_len) != seq_len:
        raise ValueError(f"sequence length {seq_len}, metadata {meta.get('seq_len')}")
    if meta.get("row_tokens", seq_len + 1) != seq_len + 1:
        raise ValueError(f"rows of {seq_len + 1} tokens, metadata {meta.get('row_tokens')}")
    if n_tokens % (seq_len + 1):
        raise ValueError(f"{n_tokens} tokens are no whole rows of {seq_len + 1}")
    return n_tokens // (seq_len + 1)
