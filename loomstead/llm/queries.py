"""The registered queries of the corpus operators, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm import extraction, mixing, packing, quality, simhash, substring, token_files, topk, toxicity, warc


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.rules(documents, quality.fit(documents, _table(spark, sf_dir, "labels")))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(spark, _table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    scored = toxicity.score(documents, toxicity.fit(documents, _table(spark, sf_dir, "labels")))
    held_out = toxicity.held_out(F.col("doc_id"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(token_files.round_trip(spark, _table(spark, sf_dir, "documents"), tokenizer_path=_vocabulary("word_bpe_49k.json")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), keep_ids=False).drop("ids")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


_OP8 = "SELECT doc_id, size, source_size, target, taken FROM (" + mixing.ORACLE.format(documents="documents") + ")"

_OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 5
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_substring, op3_warc, op4_extraction, op5_toxicity, op6_token_files, op7_packing, op8_mixing, op9_simhash, op10_topk)}


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": _OP8, "op10_topk": _OP10}
