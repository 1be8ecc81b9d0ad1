"""The model and data-source roles: a linear model on columns, and batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class LinearModel:
    """``prediction = bias + sum(weight * feature)``; parameters are on the driver, one number a feature."""

    weights: Mapping[str, float]
    bias: float = 0.0

    def prediction(self) -> Column:
        return reduce(lambda s, kv: s + F.lit(float(kv[1])) * F.col(kv[0]), self.weights.items(), F.lit(float(self.bias)))

    def forward(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.prediction())

    def compute_loss(self, df: DataFrame, label: str) -> DataFrame:
        """One row: the mean squared error ``loss``."""
        gap = self.prediction() - F.col(label)
        return df.agg(F.avg(gap * gap).alias("loss"))

    def backward(self, df: DataFrame, label: str) -> DataFrame:
        """One row: the gradient of the loss by parameter (``bias`` and each feature)."""
        gap = self.prediction() - F.col(label)
        return df.agg((2 * F.avg(gap)).alias("bias"), *[(2 * F.avg(gap * F.col(x))).alias(x) for x in self.weights])

    def apply_delta(self, delta: Mapping[str, float]) -> LinearModel:
        weights = {x: w + delta.get(x, 0.0) for x, w in self.weights.items()}
        return replace(self, weights=weights, bias=self.bias + delta.get("bias", 0.0))

    def load_parameters(self, params: Mapping[str, float]) -> LinearModel:
        return LinearModel({x: params[x] for x in params if x != "bias"}, params.get("bias", 0.0))

    def params(self) -> dict[str, float]:
        return {"bias": self.bias, **self.weights}

    def step(self, df: DataFrame, label: str, rate: float) -> LinearModel:
        """One round of gradient descent; a single row of sums comes to the driver."""
        grad = self.backward(df, label).first().asDict()
        return self.apply_delta({x: -rate * g for x, g in grad.items()})


def fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares in closed form: one row ``slope, intercept``."""
    return df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def _place(value: Column, bounds: Sequence[float], low: int = 0, high: int | None = None) -> Column:
    """How many of the sorted bounds lie below the value, by a tree of comparisons."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(value <= F.lit(bounds[mid]), _place(value, bounds, low, mid)).otherwise(_place(value, bounds, mid + 1, high))


@dataclass(frozen=True)
class BatchSource:
    """Numbered batches of a table, in a defined order.

    The first order column, a number, is cut at its quantiles into as many
    ranges as the session has shuffle partitions.  Rows are ranked inside their
    range and offset by the counts of the ranges before, so no task ranks the
    whole table; only one count a range comes to the driver.
    """

    df: DataFrame
    order: Sequence[str]
    size: int

    def numbered(self) -> tuple[DataFrame, int]:
        """The rows with ``batch_id`` and ``position`` from 0, and their number."""
        key = F.col(self.order[0])
        ranges = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cuts = self.df.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)] or [0.5], 10_000)).first()[0]
        place = _place(key, sorted(set(cuts or [])))
        counts = {r["_b"]: r["n"] for r in self.df.groupBy(place.alias("_b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        before, total = [], 0
        for b in sorted(counts):
            before += [F.lit(b), F.lit(total)]
            total += counts[b]
        rank = F.row_number().over(Window.partitionBy("_b").orderBy(*self.order))
        start = F.element_at(F.create_map(*before), F.col("_b")) if before else F.lit(0)
        position = (start + rank - 1).cast("long")
        rows = self.df.withColumn("_b", place).withColumn("position", position)
        return rows.withColumn("batch_id", F.floor(F.col("position") / self.size)).drop("_b"), total

    def batches(self) -> DataFrame:
        return self.numbered()[0]

    def next_batch(self, number: int) -> DataFrame:
        return self.batches().filter(F.col("batch_id") == number)

    def reset(self) -> BatchSource:
        """The source from its beginning; reading again is all it takes."""
        return replace(self)

    def on_data_loaded(self) -> DataFrame:
        """One row once all is read: ``rows, batches``."""
        n = F.count(F.lit(1))
        return self.df.agg(n.alias("rows"), F.ceil(n / self.size).alias("batches"))
