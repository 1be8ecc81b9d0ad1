"""Affine quantisation of vectors: train, encode, decode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 255


def train(samples: DataFrame, vector_col: str = "embedding", levels: int = LEVELS) -> DataFrame:
    """Calibration in one row: arrays ``lo`` and ``scale``, by dimension.

    A partial aggregation by dimension; the result has as many values as a
    vector has, so encoding may broadcast it.
    """
    flat = samples.select(F.posexplode(vector_col).alias("i", "x"))
    by_dim = flat.groupBy("i").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi"))
    row = F.array_sort(F.collect_list(F.struct("i", "lo", ((F.col("hi") - F.col("lo")) / levels).alias("scale"))))
    return by_dim.agg(row.alias("c")).select(F.transform("c", lambda s: s["lo"]).alias("lo"), F.transform("c", lambda s: s["scale"]).alias("scale"))


def _calibrated(df: DataFrame, calibration: DataFrame) -> DataFrame:
    key = F.lit(0).alias("_one")
    return df.select("*", key).join(F.broadcast(calibration.select("lo", "scale", key)), "_one").drop("_one")


def encode(df: DataFrame, calibration: DataFrame, vector_col: str = "embedding", levels: int = LEVELS) -> DataFrame:
    """Adds ``code array<int>``: each component as a step from 0 to ``levels``, values out of range clamped."""
    step = F.zip_with(
        F.arrays_zip(F.col(vector_col).alias("x"), F.col("lo").alias("l")),
        "scale",
        lambda p, s: F.when(s == 0, F.lit(0)).otherwise(F.least(F.greatest(F.floor((p["x"].cast("double") - p["l"]) / s + 0.5), F.lit(0)), F.lit(levels))).cast("int"),
    )
    return _calibrated(df, calibration).withColumn("code", step).drop("lo", "scale")


def decode(df: DataFrame, calibration: DataFrame, code_col: str = "code") -> DataFrame:
    """Adds ``decoded array<double>``, within half a step of what was encoded."""
    back = F.zip_with(F.arrays_zip(F.col(code_col).alias("q"), F.col("lo").alias("l")), "scale", lambda p, s: p["l"] + p["q"] * s)
    return _calibrated(df, calibration).withColumn("decoded", back).drop("lo", "scale")
