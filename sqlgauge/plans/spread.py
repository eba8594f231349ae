"""Use all cores for small inputs, where the caller asks for it."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Session setting with the number of partitions; unset, nothing is spread.
SETTING = "spark.sqlgauge.spread"


def spread(scan: DataFrame) -> DataFrame:
    """Repartition a scan as the session asks; local sessions do, since a small file is one split."""
    parts = scan.sparkSession.conf.get(SETTING, None)
    return scan.repartition(int(parts)) if parts else scan
