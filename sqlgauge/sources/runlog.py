"""Run logs (JSON lines) and metrics tables (CSV)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.flags import tolerant_boolean

ENGINES = ("mysql", "mariadb")
_NESTED = "struct<success:variant,execution_time_s:double>"

FLAG_COLUMNS = [
    f"{engine}_{flag}" for engine in ENGINES for flag in ("pred_success", "gold_success", "ex", "ex_given_success")
]


def runlog_schema() -> str:
    """Every field of the three record spellings; flags keep their JSON type per value (variant) and are read later."""
    fields = [
        "id long", "dataset string", "llm string", "rdbms string", "rdbms_mode string",
        "question_text string", "question_text_filled string", "question_variables map<string,string>",
        "query_split string", "question_split string", "difficulty string",
        "gold_sql_first string", "gold_sql_exec string", "gold_sql_variants array<string>",
        "schema_compact string", "schema_num_tables int", "schema_num_columns int",
        "prompt_tokens int", "completion_tokens int",
        "pred_sql_raw string", "pred_sql string",
        "pred_repairs array<struct<`from`:string,`to`:string,ratio:double>>", "gen_time_s double",
        "mysql_vs_mariadb_match variant",
    ]
    for engine in ENGINES:
        fields += [f"{engine} {_NESTED}", f"{engine}_gold {_NESTED}", f"{engine}_pred_vs_gold_match variant"]
        for side in ("pred", "gold"):
            p = f"{engine}_{side}"
            fields += [
                f"`{p}.success` variant", f"`{p}.execution_time_s` double", f"`{p}.error` string",
                f"{p}_success variant", f"{p}_time_s double", f"{p}_error_msg string", f"{p}_rows long",
            ]
    return ", ".join(fields)


def read_runlog(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, a malformed one fails the job."""
    return spark.read.schema(runlog_schema()).option("mode", "FAILFAST").json(path)


def read_metrics_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Per-question metrics with a header; the flag columns read null as false."""
    rows = spark.read.option("header", True).schema(schema).csv(path)
    if "dataset" not in rows.columns:
        raise ValueError("the table must contain a 'dataset' column")
    return fill_flags(rows)


def fill_flags(rows: DataFrame) -> DataFrame:
    """Null is false in the flag columns that are present."""
    flags = {
        c: F.coalesce(tolerant_boolean(F.col(c)), F.lit(False)) for c in FLAG_COLUMNS if c in rows.columns
    }
    return rows.withColumns(flags) if flags else rows
