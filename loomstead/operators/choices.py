"""Multiple-choice metrics: contexts, candidates, length normalisation, arg-max, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.text import clean_choice_text, first_upper


def context(a: Column, b: Column) -> Column:
    """Cleaned a and b, b with its first character in upper case."""
    return F.trim(F.concat_ws(" ", clean_choice_text(F.coalesce(a, F.lit(""))), first_upper(clean_choice_text(F.coalesce(b, F.lit(""))))))


def candidates(examples: DataFrame) -> DataFrame:
    """A row for each ending of (example_idx, prompt, endings, label); endings start with a space."""
    rows = examples.select("example_idx", "prompt", "label", F.posexplode("endings").alias("choice_idx", "ending"))
    return rows.withColumn("continuation", F.concat(F.lit(" "), clean_choice_text(F.col("ending")))).drop("ending")


def fitted(prompt: Column, continuation: Column, longest: int, eos: int) -> tuple[Column, Column]:
    """prompt and continuation ids cut to ``longest``: the prompt loses its head first; an empty continuation is eos."""
    cont = F.when(F.size(continuation) == 0, F.array(F.lit(eos))).otherwise(continuation)
    over = F.size(prompt) + F.size(cont) - longest
    head = F.when(over <= 0, prompt).when(over >= F.size(prompt), F.slice(prompt, 1, 0)).otherwise(F.slice(prompt, F.greatest(over, F.lit(0)) + 1, F.size(prompt)))
    return head, F.when(over >= F.size(prompt), F.slice(cont, 1, longest)).otherwise(cont)


def padded(prompt: Column, continuation: Column, pad: int) -> tuple[Column, Column]:
    """Input ids and where the continuation starts in them (from 0); an input of one id has ``pad`` before it."""
    ids = F.concat(prompt, continuation)
    short = F.size(ids) < 2
    return F.when(short, F.concat(F.array(F.lit(pad).cast("int")), ids)).otherwise(ids), F.size(prompt) + short.cast("int")


def continuation_logps(logps: Column, start: Column) -> Column:
    """The scored part of an input's log probabilities (of its second id to its last).

    ``start`` is the continuation's place among the ids; where it is 0 the first id has no log probability and goes unscored.
    """
    return F.slice(logps, F.greatest(start - 1, F.lit(0)) + 1, F.size(logps))


def sequence_score(logps: Column) -> tuple[Column, Column]:
    """Sum and length of the scored part."""
    return F.aggregate(logps, F.lit(0.0), lambda a, x: a + x), F.size(logps)


def predictions(scored: DataFrame, keys: list[str] = ["example_idx"]) -> DataFrame:  # noqa: B006
    """pred and pred_norm of (example_idx, choice_idx, label, score, length); equal scores go to the lowest choice."""
    best = lambda s: -F.max(F.struct(s.alias("s"), (-F.col("choice_idx")).alias("c")))["c"]
    norm = F.col("score") / F.greatest(F.col("length"), F.lit(1))
    return scored.groupBy(*keys).agg(F.min("label").alias("label"), best(F.col("score")).alias("pred"), best(norm).alias("pred_norm"))


def accuracy(predicted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """num_examples, accuracy, accuracy_norm; 0 without examples."""
    share = lambda c: F.coalesce(F.avg((F.col(c) == F.col("label")).cast("double")), F.lit(0.0))
    return predicted.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("num_examples"), share("pred").alias("accuracy"), share("pred_norm").alias("accuracy_norm"))


def weighted_loss(rows: DataFrame) -> DataFrame:
    """Token-weighted mean of (loss, n)."""
    return rows.agg((F.sum(F.col("loss") * F.col("n")) / F.greatest(F.lit(1.0), F.sum("n"))).alias("val_loss"), F.count(F.lit(1)).alias("n_batches"))


def first_batches(rows: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The first n rows in order; where there are fewer, the order starts again until n are there."""
    head = rows.orderBy(*keys).limit(n)
    place = head.withColumn("_k", F.row_number().over(Window.orderBy(*keys)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))  # n rows
    times = F.expr(f"({n} - _k - 1) div _n + 1")
    return place.withColumn("_t", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop("_k", "_n", "_t")


def longest_input(model_max: int | None, tokenizer_max: int | None, default: int = 2048) -> int:
    """The shorter of two limits; a tokenizer's placeholder of a million or more is none."""
    known = [n for n in (model_max, tokenizer_max if tokenizer_max and tokenizer_max < 1_000_000 else None) if n]
    return min(known, default=default)
