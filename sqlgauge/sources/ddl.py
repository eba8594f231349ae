"""CREATE TABLE texts as a schema catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STATEMENT = r"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?`?(\w+)`?\s*\((.*?)\n\)[^;\n]*;"
_COLUMN = r"(?is)^`?(\w+)`?\s+(\w+(?:\s*\([^)]*\))?)(.*)$"
_KEY_LINE = r"(?i)^(PRIMARY\s+KEY|UNIQUE|KEY|INDEX|FULLTEXT|CONSTRAINT|FOREIGN\s+KEY)\b"
_FOREIGN = r"(?is)FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s*`?(\w+)`?\s*\(([^)]*)\)"


def read_ddl(spark: SparkSession, root: str, dialect: str, fallback: str = "mysql") -> DataFrame:
    """``dataset, ddl`` of ``root/<dialect>/<dataset>.schema.sql``; missing ones come from the fallback dialect."""
    texts = (
        spark.read.text(f"{root}/*/*.schema.sql", wholetext=True)
        .select(
            F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1).alias("dialect"),
            F.regexp_extract("_metadata.file_name", r"^(.*)\.schema\.sql$", 1).alias("dataset"),
            F.col("value").alias("ddl"),
        )
    )
    return choose_dialect(texts, dialect, fallback)


def choose_dialect(texts: DataFrame, dialect: str, fallback: str = "mysql") -> DataFrame:
    """Per dataset the text of ``dialect``, else that of ``fallback``; one row per dataset."""
    return (
        texts.where(F.col("dialect").isin(dialect, fallback))
        .groupBy("dataset")
        .agg(
            F.coalesce(
                F.max(F.when(F.col("dialect") == dialect, F.col("ddl"))),
                F.max(F.when(F.col("dialect") == fallback, F.col("ddl"))),
            ).alias("ddl")
        )
        .where("ddl is not null")
    )


def _names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\w+)(?:`?\s*(?:\(\d+\))?)"), F.lit(1))


def _statements(ddl: DataFrame) -> DataFrame:
    return ddl.select(
        "dataset", F.explode(F.regexp_extract_all("ddl", F.lit(_STATEMENT), F.lit(0))).alias("_st")
    ).select(
        "dataset",
        F.regexp_extract("_st", _STATEMENT, 1).alias("table"),
        F.filter(
            F.transform(
                F.split(F.regexp_extract("_st", _STATEMENT, 2), r",?\s*\n\s*", -1),
                lambda line: F.regexp_replace(F.trim(line), ",$", ""),
            ),
            lambda line: line != "",
        ).alias("_parts"),
    )


def parse_columns(ddl: DataFrame) -> DataFrame:
    """Catalog rows (see the catalog operators) of ``dataset, ddl`` texts, one definition per line."""
    tables = _statements(ddl).withColumn(
        "_pk",
        F.coalesce(
            F.get(
                F.transform(
                    F.filter("_parts", lambda p: p.rlike(r"(?i)^PRIMARY\s+KEY")),
                    lambda p: _names(F.regexp_extract(p, r"\((.*)\)", 1)),
                ),
                F.lit(0),
            ),
            F.array().cast("array<string>"),
        ),
    )
    columns = tables.select(
        "dataset", "table", "_pk", F.posexplode(F.filter("_parts", lambda p: ~p.rlike(_KEY_LINE))).alias("col_pos", "_p")
    )
    rest = F.regexp_extract("_p", _COLUMN, 3)
    default = F.regexp_extract(rest, r"(?i)\bDEFAULT\s+('(?:[^']|'')*'|\S+)", 1)
    name = F.regexp_extract("_p", _COLUMN, 1)
    at = F.array_position("_pk", name)
    return columns.select(
        "dataset",
        "table",
        "col_pos",
        name.alias("column"),
        F.regexp_extract("_p", _COLUMN, 2).alias("type"),
        (~rest.rlike(r"(?i)\bNOT\s+NULL\b")).alias("nullable"),
        F.when((default != "") & (F.upper(default) != "NULL"), default).alias("default"),
        F.when(at > 0, at.cast("int") - 1).alias("pk_pos"),
    )


def parse_foreign_keys(ddl: DataFrame) -> DataFrame:
    """Foreign-key rows of ``dataset, ddl`` texts."""
    keys = _statements(ddl).select(
        "dataset", "table", F.posexplode(F.filter("_parts", lambda p: p.rlike(_FOREIGN))).alias("fk_pos", "_p")
    )
    return keys.select(
        "dataset",
        "table",
        "fk_pos",
        _names(F.regexp_extract("_p", _FOREIGN, 1)).alias("columns"),
        F.regexp_extract("_p", _FOREIGN, 2).alias("ref_table"),
        _names(F.regexp_extract("_p", _FOREIGN, 3)).alias("ref_columns"),
    )


def spark_type(ddl_type: Column) -> Column:
    """The Spark type name of a DDL type; clock times stay text."""
    low = F.lower(ddl_type)
    return (
        F.when(low.rlike(r"^(int|smallint|tinyint|mediumint)\b"), "int")
        .when(low.rlike(r"^bigint\b"), "bigint")
        .when(
            low.rlike(r"^(float|decimal)\s*\(\d+,\s*\d+\)"),
            F.concat(F.lit("decimal"), F.regexp_extract(low, r"(\(.*\))", 1)),
        )
        .when(low.rlike(r"^(float|double)"), "double")
        .otherwise("string")
    )
