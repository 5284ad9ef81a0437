"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def build_session(app_name: str = "citeweave", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume.

    On a cluster leave ``master`` and the shuffle partition count to
    spark-submit; AQE coalesces small shuffles and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, reading it from the session first.

    ``spark.checkpoint.dir`` names the shared folder on a cluster. Only a local
    session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a shared folder before running iterative jobs.")
        configured = tempfile.mkdtemp(prefix="citeweave-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a session.

    Batch functions refer to module code, so executors need the package
    wherever the driver was started from. Done once per application.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    handle, archive = tempfile.mkstemp(prefix="citeweave-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(archive, "w") as target:
        for path in sorted(root.rglob("*.py")):
            target.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)


def stored(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored_table(df: DataFrame) -> DataFrame:
    """Like ``stored`` for large tables of many short rows: columns are written compressed."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
