"""Scalar expressions of the air-quality domain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sigmoid of the W126 index, ratio limit, exposure bins.
W126_A, W126_B = 4403.0, 126.0
RATIO_LIMIT = 3.0
OUTLIER_RATIO = 5.0
BIN_EDGES = (40.0, 50.0, 60.0, 70.0, 80.0)
BIN_LABELS = ("< 40", "40-50", "50-60", "60-70", "70-80", "> 80")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """Missing values are NULL inside every table; NaN only exists in files."""
    return F.when(F.isnan(col(c)), None).otherwise(col(c))


def ppb_to_ppm(c: str | Column) -> Column:
    return col(c) / 1000


def w126_weight(ppm: str | Column) -> Column:
    return col(ppm) / (1 + W126_A * F.exp(-W126_B * col(ppm)))


def model_bias(model: str | Column, observed: str | Column) -> Column:
    return col(model) - col(observed)


def response_ratio(observed: str | Column, model: str | Column) -> Column:
    """Observed over modelled; NULL where the model is zero."""
    return F.when(col(model) != 0, col(observed) / col(model))


def cap_ratio(ratio: str | Column, limit: float = RATIO_LIMIT) -> Column:
    """Ratios above the limit become the limit; NULL stays NULL."""
    return F.when(col(ratio) > limit, F.lit(limit)).otherwise(col(ratio))


def additive_fusion(model: str | Column, bias: str | Column) -> Column:
    return col(model) - col(bias)


def ratio_fusion(model: str | Column, ratio: str | Column) -> Column:
    return col(model) * col(ratio)


def quotient_fusion(model: str | Column, obs: str | Column, mod: str | Column) -> Column:
    """Model scaled by interpolated observation over interpolated model."""
    return F.when(col(mod) != 0, col(model) * col(obs) / col(mod))


def exposure_bin(c: str | Column) -> Column:
    """Right-closed bins, the lowest includes zero; negative and NULL have no bin."""
    value = col(c)
    out = F.when(value < 0, None)
    for edge, label in zip(BIN_EDGES, BIN_LABELS):
        out = out.when(value <= edge, F.lit(label))
    return out.when(value.isNotNull(), F.lit(BIN_LABELS[-1]))


def min_max_scale(c: str | Column, low: str | Column, high: str | Column) -> Column:
    return F.when(col(high) > col(low), (col(c) - col(low)) / (col(high) - col(low)))


def all_present(columns: list[str]) -> Column:
    """1 where every listed column has a value, else NULL."""
    return F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]), 1)


def valid_flag(c: str | Column) -> Column:
    """2 for a value, 1 for a missing one."""
    return F.when(col(c).isNotNull(), 2).otherwise(1)


def whole_number_or_same(c: str | Column) -> Column:
    """Text form without a fraction where that loses nothing."""
    value = col(c)
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(
        value.cast("string")
    )


def row_spread(columns: list[str]) -> tuple[Column, Column]:
    """Sample standard deviation and mean over the non-null columns of a row."""
    present = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda v: v.isNotNull())
    n = F.size(present)
    mean = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v) / n
    squares = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
    return F.when(n > 1, F.sqrt(squares / (n - 1))), F.when(n > 0, mean)
