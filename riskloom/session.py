"""Session settings the plans rely on."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # file contents may be megabytes each, so Arrow batches are cut by size too
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
    # the quick mode ranks 10,000 files per repository; keep that a group limit
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='riskloom-')}/{package.name}", "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "riskloom", master: str | None = None, **options: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **options}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
