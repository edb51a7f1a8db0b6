"""Loading of named tables."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package once per application, so that Python workers import it wherever they run."""
    if (app := spark.sparkContext.applicationId) in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='lumenframe-')}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; projections and filters on it reach the scan."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
