"""The tables behind the result charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import tolerant_number, true_or_false
from ..plans.quantiles import with_order_statistics
from ..plans.scratch import materialize

CHART_BUCKETS = ("simple", "medium", "complex")


def number(rows: DataFrame, column: str) -> Column:
    """The column as a double; unparsable text and an absent column are null."""
    return tolerant_number(F.col(column)) if column in rows.columns else F.lit(None).cast("double")


def flag(rows: DataFrame, column: str) -> Column:
    """The flag with null as false; an absent column is all false."""
    return true_or_false(F.col(column)) if column in rows.columns else F.lit(False)


def flag_rate(value: Column) -> Column:
    """Share of true; an empty group has rate 0."""
    return F.coalesce(F.avg(value.cast("int")), F.lit(0.0))


def numeric_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Coerce the named columns to doubles."""
    return rows.withColumns({c: number(rows, c) for c in columns})


def flag_rates(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Rate of each flag per group."""
    return rows.groupBy(*keys).agg(*[flag_rate(flag(rows, c)).alias(c) for c in columns])


def numeric_stats(rows: DataFrame, column: str, prefix: str, keys: list[str]) -> DataFrame:
    """Mean, interpolated median and linear 95th percentile; null where a group has no value."""
    values = materialize(rows.select(*keys, number(rows, column).alias(column)), "numbers")
    summary = values.groupBy(*keys).agg(F.avg(column).alias(f"{prefix}_mean"))
    return with_order_statistics(
        summary, values, keys,
        {f"{prefix}_median": (column, "cont", 0.5), f"{prefix}_p95": (column, "cont", 0.95)},
    )


def metrics_by_dataset(rows: DataFrame, engine: str) -> DataFrame:
    """The per-dataset measures of one engine; rows without a dataset form their own group.

    ``ex_and_success_rate`` counts a question that did not run as a miss, unlike the summary's
    ``ex_given_success``.
    """
    if engine not in ("mysql", "mariadb"):
        raise ValueError(f"unknown engine: {engine}")
    values = rows.select(
        "dataset",
        flag(rows, f"{engine}_pred_success").alias("f_pred"),
        flag(rows, f"{engine}_gold_success").alias("f_gold"),
        flag(rows, f"{engine}_ex").alias("f_ex"),
        flag(rows, f"{engine}_ex_given_success").alias("f_exgs"),
        number(rows, f"{engine}_pred_execution_time_s").alias("pred_time"),
        number(rows, f"{engine}_gold_execution_time_s").alias("gold_time"),
        number(rows, "gen_time_s").alias("gen_time"),
        number(rows, "prompt_tokens").alias("prompt_size"),
        number(rows, "tables_in_schema_compact").alias("tables"),
        number(rows, "schema_num_columns").alias("columns"),
    )
    values = materialize(values, "chart-input")
    summary = values.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"),
        flag_rate(F.col("f_pred")).alias("pred_exec_rate"),
        flag_rate(F.col("f_gold")).alias("gold_exec_rate"),
        flag_rate(F.col("f_ex")).alias("ex"),
        flag_rate(F.col("f_exgs")).alias("ex_and_success_rate"),
        F.avg("pred_time").alias("pred_exec_time_mean_s"),
        F.avg("gold_time").alias("gold_exec_time_mean_s"),
        F.avg("gen_time").alias("gen_time_mean_s"),
        F.avg("prompt_size").alias("prompt_size_mean"),
        F.avg("tables").alias("schema_tables_mean"),
        F.avg("columns").alias("schema_cols_mean"),
    )
    return with_order_statistics(
        summary, values, ["dataset"],
        {
            "pred_exec_time_median_s": ("pred_time", "cont", 0.5),
            "pred_exec_time_p95_s": ("pred_time", "cont", 0.95),
            "gen_time_median_s": ("gen_time", "cont", 0.5),
            "gen_time_p95_s": ("gen_time", "cont", 0.95),
        },
    )


def match_rate(rows: DataFrame) -> DataFrame:
    """Cross-engine match rate over compared rows; rows without a dataset are left out."""
    return (
        rows.where("mysql_vs_mariadb_match is not null and dataset is not null")
        .groupBy("dataset")
        .agg(F.avg(F.col("mysql_vs_mariadb_match").cast("int")).alias("match_rate"))
    )


def rate_by_complexity(rows: DataFrame, column: str) -> DataFrame:
    """``bucket_order, bucket, rate`` for simple, medium and complex; a missing bucket has rate 0."""
    rates = rows.groupBy(F.col("complexity_bucket").alias("bucket")).agg(
        flag_rate(flag(rows, column)).alias("rate")
    )
    spark = rows.sparkSession
    names = reduce(
        DataFrame.union,
        [
            spark.range(1).select(F.lit(i).alias("bucket_order"), F.lit(b).alias("bucket"))
            for i, b in enumerate(CHART_BUCKETS)
        ],
    )
    return names.join(rates, "bucket", "left").select(
        "bucket_order", "bucket", F.coalesce("rate", F.lit(0.0)).alias("rate")
    )


def ranked_series(table: DataFrame, value: str) -> DataFrame:
    """Datasets with one measure, largest first."""
    return table.select("dataset", F.col(value).alias("value")).orderBy(
        F.col("value").desc_nulls_last(), F.col("dataset").asc_nulls_last()
    )


def schema_compactness(rows: DataFrame) -> DataFrame:
    """Mean tables and columns per prompt by dataset, for the inputs that exist."""
    named = {"tables_in_schema_compact": "mean_tables", "schema_num_columns": "mean_columns"}
    means = [F.avg(number(rows, c)).alias(n) for c, n in named.items() if c in rows.columns]
    if not means:
        raise ValueError("no schema size columns")
    return rows.groupBy("dataset").agg(*means)
