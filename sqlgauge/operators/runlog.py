"""From run-log records of any spelling to one flat metrics row per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, VariantType

from ..functions.flags import tolerant_boolean, variant_boolean, variant_set
from ..functions.sqltext import complexity_bucket, schema_tables
from ..sources.runlog import ENGINES


def _field(df: DataFrame, name: str) -> Column | None:
    return F.col(f"`{name}`") if name in df.columns else None


def _flag(df: DataFrame, value: Column) -> tuple[Column, Column]:
    """Whether a flag is set, and what it says: texts, booleans, numbers or variants of these."""
    kind = df.select(value).schema.fields[0].dataType
    if isinstance(kind, VariantType):
        return variant_set(value), variant_boolean(value)
    return value.isNotNull(), tolerant_boolean(value, isinstance(kind, NumericType))


def _first(df: DataFrame, names: list[str], nested: tuple[str, str], kind: str) -> Column:
    found = [F.col(nested[0])[nested[1]]] if nested[0] in df.columns else []
    found += [c for c in (_field(df, n) for n in names) if c is not None]
    if not found:
        return F.lit(None).cast(kind)
    if kind == "boolean":
        flags = [_flag(df, c) for c in found]
        read = [F.when(known, F.struct(flag.alias("flag"))) for known, flag in flags]  # the first one set decides
        return F.coalesce(*read)["flag"]
    return F.coalesce(*[c.cast(kind) for c in found])


def canonical_runlog(records: DataFrame) -> DataFrame:
    """One spelling for the execution facts of every engine.

    Reads ``E.success`` structs, ``E_pred.success`` and ``E_pred_success`` fields; whichever is set wins in
    that order. Adds ``E_{pred,gold}_success``, ``E_{pred,gold}_execution_time_s``, ``E_ex``.
    """
    facts: dict[str, Column] = {}
    for engine in ENGINES:
        for side in ("pred", "gold"):
            p = f"{engine}_{side}"
            nested = engine if side == "pred" else f"{engine}_gold"
            facts[f"{p}_success"] = _first(
                records, [f"{p}.success", f"{p}_success"], (nested, "success"), "boolean"
            )
            facts[f"{p}_execution_time_s"] = _first(
                records, [f"{p}.execution_time_s", f"{p}_time_s"], (nested, "execution_time_s"), "double"
            )
        match = _field(records, f"{engine}_pred_vs_gold_match")
        facts[f"{engine}_ex"] = (
            _flag(records, match)[1] if match is not None else F.lit(None).cast("boolean")
        )
    cross = _field(records, "mysql_vs_mariadb_match")
    facts["mysql_vs_mariadb_match"] = (
        _flag(records, cross)[1] if cross is not None else F.lit(None).cast("boolean")
    )
    drop = set(facts) | set(ENGINES) | {f"{e}_gold" for e in ENGINES}
    drop |= {f"{e}_pred_vs_gold_match" for e in ENGINES}
    keep = [
        c for c in records.columns
        if c not in drop
        and not any(c.startswith((f"{e}_{s}.", f"{e}_{s}_")) for e in ENGINES for s in ("pred", "gold"))
    ]
    return records.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(k) for k, v in facts.items()])


def ex_given_success(success: Column, ex: Column) -> Column:
    """The match where the prediction ran, else null."""
    return F.when(success, ex)


def asymmetry(a: Column, b: Column) -> dict[str, Column]:
    """Which engine ran the prediction; an unknown outcome matches none of the four."""
    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    return {"a_only": flag(a & ~b), "b_only": flag(b & ~a), "both": flag(a & b), "neither": flag(~a & ~b)}


def question_rows(records: DataFrame) -> DataFrame:
    """The flat metrics row of every record of a canonical run log."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in records.columns else F.lit("")

    def empty_to_null(c: Column) -> Column:
        return F.when(c != "", c)

    pred = F.coalesce(
        *[F.col(c) for c in ("pred_sql", "pred_sql_raw") if c in records.columns], F.lit("")
    )
    bucket_text = F.coalesce(empty_to_null(text("gold_sql_exec")), empty_to_null(text("gold_sql_first")), pred)
    sides = asymmetry(F.col("mysql_pred_success"), F.col("mariadb_pred_success"))
    extra = [c for c in ("llm", "rdbms", "prompt_tokens", "schema_num_columns") if c in records.columns]
    return records.select(
        "id", text("dataset").alias("dataset"), text("rdbms_mode").alias("rdbms_mode"), *extra,
        text("query_split").alias("query_split"), text("question_split").alias("question_split"),
        text("question_text").alias("question_text"),
        F.size(schema_tables(text("schema_compact"))).alias("tables_in_schema_compact"),
        complexity_bucket(bucket_text).alias("complexity_bucket"),
        pred.alias("pred_sql"), text("gold_sql_exec").alias("gold_sql_exec"),
        F.col("gen_time_s").cast("double").alias("gen_time_s"),
        *[f"{e}_pred_success" for e in ENGINES],
        *[f"{e}_gold_success" for e in ENGINES],
        *[f"{e}_pred_execution_time_s" for e in ENGINES],
        *[f"{e}_gold_execution_time_s" for e in ENGINES],
        *[f"{e}_ex" for e in ENGINES],
        *[
            ex_given_success(F.col(f"{e}_pred_success"), F.col(f"{e}_ex")).alias(f"{e}_ex_given_success")
            for e in ENGINES
        ],
        "mysql_vs_mariadb_match",
        sides["a_only"].alias("pred_mysql_only_success"),
        sides["b_only"].alias("pred_mariadb_only_success"),
        sides["both"].alias("pred_both_success"),
        sides["neither"].alias("pred_neither_success"),
    )
