"""Sessions, and making this package known to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once per application, so that they need no shared Python path."""
    sc = spark.sparkContext
    if getattr(sc, "_chronolink_shipped", None) != sc.applicationId:
        path = os.path.join(tempfile.mkdtemp(), "chronolink_src.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(_ROOT.rglob("*.py")):
                z.write(p, p.relative_to(_ROOT.parent))
        sc.addPyFile(os.path.abspath(path))
        sc._chronolink_shipped = sc.applicationId
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # rows may be long texts
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("chronolink")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
