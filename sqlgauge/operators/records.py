"""Run-log records: attaching predictions and outcomes to prepared questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import schema_counts
from .execution import FALLBACK_SQL, OUTCOME_STRUCT


def attach_predictions(questions: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Left-join ``pred_sql_raw, prompt_tokens, completion_tokens, gen_time_s``; a missing one is a failed generation."""
    fields = ["pred_sql_raw", "prompt_tokens", "completion_tokens", "gen_time_s"]
    kept = [c for c in questions.columns if c not in fields]
    joined = questions.select(*kept).join(predictions.select(*keys, *fields), keys, "left")
    return joined.select(
        *kept,
        F.coalesce("pred_sql_raw", F.lit(FALLBACK_SQL)).alias("pred_sql_raw"),
        F.when(F.col("pred_sql_raw").isNull(), 0).otherwise(F.col("prompt_tokens")).alias("prompt_tokens"),
        F.when(F.col("pred_sql_raw").isNull(), 0).otherwise(F.col("completion_tokens")).alias(
            "completion_tokens"
        ),
        F.round("gen_time_s", 6).alias("gen_time_s"),
    )


def outcome_fields(prefix: str, outcome: str, spelling: str = "dotted") -> list[Column]:
    """Flat columns of an outcome struct in one of the two spellings; no outcome is a failure with a fixed text."""
    o = F.col(outcome)
    success = F.coalesce(o["success"], F.lit(False))
    if spelling == "dotted":
        return [
            success.alias(f"{prefix}.success"),
            o["time_s"].alias(f"{prefix}.execution_time_s"),
            F.when(o.isNull(), "NO_EXECUTION_ATTEMPT").otherwise(o["error"]).alias(f"{prefix}.error"),
        ]
    if spelling == "underscored":
        error = F.when(o["error"] != "", o["error"])
        return [
            success.alias(f"{prefix}_success"),
            F.when(o.isNull(), "Not executed").otherwise(error).alias(f"{prefix}_error_msg"),
            F.coalesce(o["time_s"], F.lit(0.0)).alias(f"{prefix}_time_s"),
            F.coalesce(o["rows"], F.lit(0)).cast("long").alias(f"{prefix}_rows"),
        ]
    raise ValueError(f"unknown spelling: {spelling}")


def flatten_outcomes(rows: DataFrame, outcomes: dict[str, str], spelling: str = "dotted") -> DataFrame:
    """Replace outcome structs by flat columns; ``outcomes`` maps a prefix to its struct column."""
    gone = set(outcomes.values())
    flat = [c for prefix, name in outcomes.items() for c in outcome_fields(prefix, name, spelling)]
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in gone], *flat)


def assemble_records(rows: DataFrame, llm: str, rdbms: str, spelling: str = "dotted") -> DataFrame:
    """Complete run-log records from questions with predictions, ``pred`` and ``gold`` outcomes and ``match``."""
    if "schema_num_tables" not in rows.columns:
        rows = rows.withColumn("_counts", schema_counts(F.col("schema_compact")))
        rows = rows.withColumn("schema_num_tables", F.col("_counts.tables")).withColumn(
            "schema_num_columns", F.col("_counts.columns")
        )
    no_outcome = F.lit(None).cast(OUTCOME_STRUCT)
    for name in ("pred", "gold"):
        if name not in rows.columns:
            rows = rows.withColumn(name, no_outcome)
    wanted = [
        "id", "dataset", "question_text", "question_text_filled", "question_variables", "query_split",
        "question_split", "gold_sql_first", "gold_sql_exec", "gold_sql_variants", "schema_compact",
        "schema_num_tables", "schema_num_columns", "prompt_tokens", "completion_tokens", "pred_sql_raw",
        "pred_sql", "pred_repairs", "gen_time_s", "difficulty",
    ]
    renamed = {"question_variables": "variables", "gold_sql_variants": "sql_variants"}
    columns = [
        F.col(renamed.get(c, c)).alias(c) for c in wanted if renamed.get(c, c) in rows.columns
    ]
    return rows.select(
        *columns,
        F.lit(llm).alias("llm"),
        F.lit(rdbms).alias("rdbms"),
        *outcome_fields(f"{rdbms}_pred", "pred", spelling),
        *outcome_fields(f"{rdbms}_gold", "gold", spelling),
        F.coalesce("match", F.lit(False)).alias(f"{rdbms}_pred_vs_gold_match"),
    )
