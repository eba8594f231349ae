"""Registration of queries and their checks, and table references both engines understand."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.spread import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its check, with ``@table`` for a given table."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = re.sub(r"@(\w+)", r"\1", sql).strip()
        return function

    return register


def run(spark: SparkSession, folder: str, sql: str, busy: str | None = None) -> DataFrame:
    """Run an input recipe over the parquet tables of ``folder``.

    ``busy`` names the table whose rows get costly text work; a small file of it is spread over the cores.
    """
    if busy is not None:
        view = f"busy_{busy}"
        spread(spark.read.parquet(f"{folder}/{busy}.parquet")).createOrReplaceTempView(view)
        sql = re.sub(rf"@{busy}\b", view, sql)
    return spark.sql(re.sub(r"@(\w+)", lambda m: f"parquet.`{folder}/{m.group(1)}.parquet`", sql))
