"""The session catalog as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CATALOG = (
    "dataset string, table string, col_pos int, column string, type string, nullable boolean, "
    "default string, pk_pos int"
)


def databases(spark: SparkSession) -> DataFrame:
    """``database``: the visible databases."""
    return spark.createDataFrame([(d.name,) for d in spark.catalog.listDatabases()], "database string")


def introspect(spark: SparkSession, dataset: str, tables: list[str] | None = None) -> DataFrame:
    """One row per column of the visible tables, columns in order."""
    names = tables or sorted(t.name for t in spark.catalog.listTables())
    rows = [
        (dataset, name, at, field.name, field.dataType.simpleString(), field.nullable, None, None)
        for name in names
        for at, field in enumerate(spark.table(name).schema.fields)
    ]
    return spark.createDataFrame(rows, CATALOG)
