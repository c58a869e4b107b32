"""SparkSession factory with the settings the operators assume."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows hold texts or images, so Arrow batches are bounded by bytes; Spark's default is 64 MB.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, so that kernels can import it.

    Also bounds Arrow batches by bytes, unless the session has a bound of its own.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_BYTES, None) in (None, "67108864b"):
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="latticework-")) / "latticework.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def get_session(app: str = "latticework", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster pass the master and sizes by spark-submit instead."""
    cpus = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
