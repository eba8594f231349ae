"""Similarities of many rows by one call per distinct pair of words.

Rows repeat the same words, so they are first reduced to distinct pairs. Equal words (1) and words without a common
letter (0) are settled by expressions; the similarity function sees every other distinct pair once, and its results are
joined back. Written tables in between have a known size, so Spark broadcasts them only below its own threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio_bound, similarity_ratio
from ..plans.scratch import materialize
from ..session import ship_package


def open_pairs(pairs: DataFrame) -> DataFrame:
    """The distinct pairs (``_a``, ``_b``) whose ratio no expression gives."""
    a, b = F.col("_a"), F.col("_b")
    return pairs.select(a, b).where((a != b) & (ratio_bound(a, b) > 0)).distinct()


def pair_ratios(pairs: DataFrame) -> DataFrame:
    """Written table (``_a``, ``_b``, ``_ratio``) of the open pairs, one call of the similarity function each."""
    ship_package(pairs.sparkSession)
    return materialize(open_pairs(pairs).withColumn("_ratio", similarity_ratio("_a", "_b")), "ratios")


def _with_ratios(pairs: DataFrame, ratios: DataFrame) -> DataFrame:
    settled = F.when(F.col("_a") == F.col("_b"), 1.0).when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 0.0)
    joined = pairs.join(ratios, ["_a", "_b"], "left")
    return joined.withColumn("_ratio", F.coalesce("_ratio", settled))


def add_ratio(rows: DataFrame, a: str, b: str, out: str = "ratio") -> DataFrame:
    """Add ``out``: the ratio of the texts ``a`` and ``b`` of each row; null when either is null."""
    pairs = rows.withColumn("_a", F.col(a)).withColumn("_b", F.col(b))
    return _with_ratios(pairs, pair_ratios(pairs)).withColumnRenamed("_ratio", out).drop("_a", "_b")
