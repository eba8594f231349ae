"""Equi-joins that match null keys, built so Spark keeps them hashable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", extra: Column | None = None
) -> DataFrame:
    """Join on ``left.key <=> right.key``; the key columns appear once, taken from the left side."""
    renamed = right.select(
        *[F.col(f"`{k}`").alias(f"_right_{k}") for k in keys],
        *[F.col(f"`{c}`") for c in right.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_right_{k}`")) for k in keys]
    )
    if extra is not None:
        condition = condition & extra
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])
