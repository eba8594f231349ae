"""Session defaults for local runs; on a cluster the submitted configuration wins."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sqlgauge")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sqlgauge.spread", str(shuffle_partitions))
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the Python functions that run there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    if not home.is_dir():
        return  # running from an archive that was shipped already
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='sqlgauge-code-')}/sqlgauge", "zip", home.parent, home.name
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
