"""The corpus pipeline: toxicity, SimHash near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
run() writes what each returns as Parquet and reads it again for the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm import mixing, packing, similar, substring, toxicity
from loomstead.llm.common import discard, give_back, scratch, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document of this score or more is rejected.
REJECT = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below REJECT; rows without a doc_id stay unscored."""
    index = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, index, carry=["lang", "source", "n_chars"], with_text=True).where(F.col("score") < REJECT)
    del index  # it is broadcast
    give_back()
    return scored.select("doc_id", "text", "carry.*").unionByName(docs.where("doc_id is null").select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id.

    Near copies are found by SimHash over five-word shingles and have a similarity of 0.8 by an exact check.
    Rows with one doc_id and different texts stay as long as they are in different groups.
    """
    kept = similar.first_of_each(docs, COLUMNS)
    return kept.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that an earlier document has; n_chars follows the text."""
    clean = substring.dedup(docs, carry=["lang", "source", "n_chars"])
    n = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("carry.n_chars"))
    kept = clean.select("doc_id", F.col("kept").alias("text"), "carry.lang", "carry.source", n.alias("n_chars"))
    return kept.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: taken words over size, the rest of a pass by the seeded hash.

    A document of which the mix takes nothing goes, but for those without a word,
    which have no words to take and stay. A copy keeps its doc_id.
    """
    taken = mixing.mix(docs).where("taken > 0 or size = 0").select("doc_id", "size", "taken")
    whole = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.greatest("size", F.lit(1)))).cast("int")
    rest = F.when(F.col("size") == 0, 0).otherwise(F.col("taken") % F.greatest("size", F.lit(1)))
    chance = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("copy"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = whole + F.when(chance * F.greatest("size", F.lit(1)) < rest, 1).otherwise(0)
    wanted = taken.withColumn("times", times).where("times > 0").groupBy("doc_id").agg(F.max("times").alias("times"))
    kept = docs.select(*COLUMNS).join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"])).drop(wanted["doc_id"])
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, str(public_tokenizers.path("byte_bpe_50k.json")), keep_ids=False).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has neither the toxicity index nor SimHash nor byte-pair encoding: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it staged is deleted once a result is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with scratch() as used:
            made: list[str] = []
            docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"), made)
            discard(spark, [p for p in [*used, *last] if p not in made])
            last = made
    return docs
