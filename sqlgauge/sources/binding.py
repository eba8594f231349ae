"""Datasets as folders of parquet tables bound to temporary views of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def bind_tables(spark: SparkSession, folder: str, tables: list[str], ignore_case: bool = False) -> None:
    """Make ``folder/<table>.parquet`` visible under the table names.

    ``ignore_case`` gives text columns a collation that compares letters of either case as equal, as the
    usual MySQL and MariaDB collations do.
    """
    for table in tables:
        rows = spark.read.parquet(f"{folder}/{table}.parquet")
        if ignore_case:
            rows = rows.select(
                *[
                    F.collate(f"`{f.name}`", "UTF8_LCASE").alias(f.name)
                    if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`")
                    for f in rows.schema.fields
                ]
            )
        rows.createOrReplaceTempView(table)
