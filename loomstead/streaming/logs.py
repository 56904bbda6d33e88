"""An extension: the log queries over a growing folder of JSON lines (the reference data is batch only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scalars(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Scalar records as they are appended."""
    return spark.readStream.schema(schema).json(folder).where(F.col("type") == "scalars")


def loss_windows(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Token-weighted loss by window of event time; records later than ``late`` are left out."""
    weighted = F.sum(F.col("loss") * F.col("n")) / F.sum("n")
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(weighted.alias("loss"), F.sum("n").alias("n"))
