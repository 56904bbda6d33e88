"""Scorers: functions from a column of token ids to log probabilities of every id after the first.

Any model fits that interface (an Arrow function that calls one, too); the
queries use a fixed formula, so that SQL can say the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[Column], Column]


def formula(model: Column | int = 1) -> Scorer:
    """A stand-in for a model: -ln(1 + (31 m t + 17 p) mod 97) of id t after id p."""
    m = F.lit(model) if isinstance(model, int) else model

    def logps(ids: Column) -> Column:
        rest = F.greatest(F.size(ids) - 1, F.lit(0))
        return F.zip_with(F.slice(ids, 2, rest), F.slice(ids, 1, rest), lambda t, p: -F.log(1.0 + ((t.cast("long") * 31 * m + p * 17) % 97)))

    return logps


def block_losses(blocks: DataFrame, scorer: Scorer, keys: list[str]) -> DataFrame:
    """keys, at (from 1), loss of each target in blocks (column ids: a block's inputs and its last target)."""
    return blocks.select(*keys, F.posexplode(scorer(F.col("ids"))).alias("at", "logp")).select(*keys, (F.col("at") + 1).alias("at"), (-F.col("logp")).alias("loss"))
