"""Summary tables of a run log: success, accuracy, agreement, timings, by dataset and complexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.quantiles import with_order_statistics
from ..plans.scratch import materialize
from ..sources.runlog import ENGINES

# Report order of the buckets.
BUCKETS = ("simple", "medium", "complex", "unknown")
KEYS = ["dataset"]


def _true(c: str) -> Column:
    return F.count_if(F.col(c))


def _known(c: str) -> Column:
    return F.count(F.col(c))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)


def _n() -> Column:
    return F.count(F.lit(1))


def success_rates(rows: DataFrame) -> DataFrame:
    """Share of questions whose prediction ran, per dataset and engine."""
    return rows.groupBy(*KEYS).agg(
        *[_ratio(_true(f"{e}_pred_success"), _n()).alias(f"{e}_pred_success_rate") for e in ENGINES]
    )


def execution_accuracy(rows: DataFrame) -> DataFrame:
    """Share of questions whose result equals the gold result."""
    return rows.groupBy(*KEYS).agg(
        *[_ratio(_true(f"{e}_ex"), _n()).alias(f"{e}_execution_accuracy_ex") for e in ENGINES]
    )


def accuracy_given_success(rows: DataFrame) -> DataFrame:
    """Accuracy among predictions that ran and were compared; null when there are none."""
    return rows.groupBy(*KEYS).agg(
        *[
            _ratio(_true(f"{e}_ex_given_success"), _known(f"{e}_ex_given_success")).alias(
                f"{e}_ex_given_success"
            )
            for e in ENGINES
        ]
    )


def _agreement() -> tuple[Column, Column]:
    match = F.when(F.col("pred_both_success"), F.col("mysql_vs_mariadb_match"))
    return F.count_if(match), F.count(match)


def engine_agreement(rows: DataFrame) -> DataFrame:
    """Share of equal results where both engines ran the prediction and were compared."""
    true, known = _agreement()
    return rows.groupBy(*KEYS).agg(_ratio(true, known).alias("mysql_vs_mariadb_match_rate"))


_SIDES = {
    "mysql_only_success_rate": "pred_mysql_only_success",
    "mariadb_only_success_rate": "pred_mariadb_only_success",
    "both_success_rate": "pred_both_success",
    "neither_success_rate": "pred_neither_success",
}


def asymmetry_rates(rows: DataFrame) -> DataFrame:
    """Shares of one-sided, two-sided and no success."""
    return rows.groupBy(*KEYS).agg(*[_ratio(_true(c), _n()).alias(name) for name, c in _SIDES.items()])


_QUANTILES = {
    "gen_time_median_s": ("gen_time_s", "disc", 0.5),
    "gen_time_p90_s": ("gen_time_s", "disc", 0.9),
    "mysql_exec_time_median_s": ("mysql_pred_execution_time_s", "disc", 0.5),
    "mariadb_exec_time_median_s": ("mariadb_pred_execution_time_s", "disc", 0.5),
    "schema_tables_median": ("tables_in_schema_compact", "disc", 0.5),
}


def _stats(rows: DataFrame, means: dict[str, str], quantiles: list[str]) -> DataFrame:
    rows = materialize(rows.select(*KEYS, *sorted(set(means.values()))), "times")
    summary = rows.groupBy(*KEYS).agg(*[F.avg(c).alias(name) for name, c in means.items()])
    return with_order_statistics(summary, rows, KEYS, {q: _QUANTILES[q] for q in quantiles})


def generation_times(rows: DataFrame) -> DataFrame:
    """Mean, nearest-rank median and 90th percentile of the generation time."""
    return _stats(rows, {"gen_time_mean_s": "gen_time_s"}, ["gen_time_median_s", "gen_time_p90_s"])


def execution_times(rows: DataFrame) -> DataFrame:
    """Mean and nearest-rank median of the prediction's execution time per engine."""
    means = {f"{e}_exec_time_mean_s": f"{e}_pred_execution_time_s" for e in ENGINES}
    return _stats(rows, means, [f"{e}_exec_time_median_s" for e in ENGINES])


def schema_sizes(rows: DataFrame) -> DataFrame:
    """Mean and nearest-rank median of the tables per prompt."""
    return _stats(rows, {"schema_tables_mean": "tables_in_schema_compact"}, ["schema_tables_median"])


def complexity_breakdown(rows: DataFrame) -> DataFrame:
    """Counts, success and accuracy per dataset and bucket; ``bucket_order`` gives the report order."""
    order = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("complexity_bucket"))
    return (
        rows.groupBy(*KEYS, "complexity_bucket")
        .agg(
            _n().alias("n_questions"),
            *[_ratio(_true(f"{e}_pred_success"), _n()).alias(f"{e}_pred_success_rate") for e in ENGINES],
            *[_ratio(_true(f"{e}_ex"), _n()).alias(f"{e}_execution_accuracy_ex") for e in ENGINES],
        )
        .withColumn("bucket_order", order.cast("int"))
        .withColumnRenamed("complexity_bucket", "bucket")
    )


_MEANS = {
    "gen_time_mean_s": "gen_time_s",
    **{f"{e}_exec_time_mean_s": f"{e}_pred_execution_time_s" for e in ENGINES},
    "schema_tables_mean": "tables_in_schema_compact",
}


_SUMMARY_INPUT = [
    *KEYS, "complexity_bucket", "mysql_vs_mariadb_match", *_SIDES.values(), *_MEANS.values(),
    *[f"{e}_{c}" for e in ENGINES for c in ("pred_success", "ex", "ex_given_success")],
]


def _rates(total: Column, true: dict[str, Column]) -> list[Column]:
    return [_ratio(c, total).alias(name) for name, c in true.items()]


def summarize(rows: DataFrame) -> DataFrame:
    """One row per dataset followed by its bucket rows (``breakdown``, ``bucket``), see ``in_report_order``.

    The log is read once: the few columns needed are written as a narrow table. Counts and sums are taken per
    dataset and bucket and the dataset rows add those few up; only the quantiles scan the narrow table again.
    """
    rows = materialize(rows.select(*_SUMMARY_INPUT), "summary-input")
    true_agree, known_agree = _agreement()
    counts = {f"t_{e}_success": _true(f"{e}_pred_success") for e in ENGINES}
    counts |= {f"t_{e}_ex": _true(f"{e}_ex") for e in ENGINES}
    counts |= {f"t_{e}_exgs": _true(f"{e}_ex_given_success") for e in ENGINES}
    counts |= {f"k_{e}_exgs": _known(f"{e}_ex_given_success") for e in ENGINES}
    counts |= {"t_agree": true_agree, "k_agree": known_agree}
    counts |= {f"t_{name}": _true(c) for name, c in _SIDES.items()}
    counts |= {f"k_{name}": _known(c) for name, c in _MEANS.items()}
    counts |= {f"s_{name}": F.sum(F.col(c).cast("double")) for name, c in _MEANS.items()}
    cells = rows.groupBy(*KEYS, F.col("complexity_bucket").alias("bucket")).agg(
        _n().alias("n_questions"), *[c.alias(name) for name, c in counts.items()]
    )

    shared = {f"{e}_pred_success_rate": F.col(f"t_{e}_success") for e in ENGINES}
    shared |= {f"{e}_execution_accuracy_ex": F.col(f"t_{e}_ex") for e in ENGINES}
    n = F.col("n_questions")
    buckets = cells.select(
        *KEYS, "n_questions", F.lit("complexity").alias("breakdown"), "bucket", *_rates(n, shared)
    )
    totals = cells.groupBy(*KEYS).agg(
        F.sum("n_questions").alias("n_questions"), *[F.sum(name).alias(name) for name in counts]
    )
    whole = totals.select(
        *KEYS,
        "n_questions",
        *_rates(n, shared),
        *[_ratio(F.col(f"t_{e}_exgs"), F.col(f"k_{e}_exgs")).alias(f"{e}_ex_given_success") for e in ENGINES],
        _ratio(F.col("t_agree"), F.col("k_agree")).alias("mysql_vs_mariadb_match_rate"),
        *_rates(n, {name: F.col(f"t_{name}") for name in _SIDES}),
        *[_ratio(F.col(f"s_{name}"), F.col(f"k_{name}")).alias(name) for name in _MEANS],
    )
    whole = with_order_statistics(whole, rows, KEYS, _QUANTILES)
    return whole.unionByName(buckets, allowMissingColumns=True)


def in_report_order(summary: DataFrame) -> DataFrame:
    """Datasets sorted, each dataset row before its buckets, buckets in report order."""
    order = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket"))
    return summary.orderBy("dataset", F.coalesce(order, F.lit(0)))
