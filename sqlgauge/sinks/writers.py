"""Run-log and table sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize


RUN_KEYS = ("llm", "dataset", "rdbms")


#: Records in one file of a run log, so that a large run is read by several tasks although its files cannot be split.
FILE_RECORDS = 200_000


def write_runlog(records: DataFrame, path: str, partitioned: bool = False, compression: str = "gzip") -> None:
    """One JSON object per record with nulls written, compressed unless ``compression`` is ``none``.

    Keys repeat in every record, so plain text takes many times the space. Spark's JSON reader opens either form.

    Without ``partitioned`` records are added to what is there. With it they go to llm/dataset/rdbms folders, one per run,
    and a rerun is idempotent: it replaces the folders of the runs it has records of and leaves all others alone. Spark
    swaps the folders when the job commits, so a run that fails or loses executors leaves the earlier records in place.
    """
    writer = records.write.option("ignoreNullFields", "false").option("compression", compression)
    writer = writer.option("maxRecordsPerFile", FILE_RECORDS)
    if partitioned:
        writer = writer.partitionBy(*RUN_KEYS).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode("append")
    writer.json(path)


def write_csv(tables: list[DataFrame], path: str) -> None:
    """The union of tables under a header of their sorted column names; no rows is an error."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    merged = materialize(merged.select(*[f"`{c}`" for c in sorted(merged.columns)]), "csv")  # computed once
    if merged.isEmpty():
        raise ValueError("No rows to write.")
    merged.write.option("header", True).csv(path)


def runlog_name(llm: Column, dataset: Column, rdbms: Column, kind: str = "benchmark") -> Column:
    """``<llm>_<kind>_<dataset>_<rdbms>``; kind is ``benchmark`` or ``baseline``."""
    return F.concat_ws("_", llm, F.lit(kind), dataset, rdbms)
