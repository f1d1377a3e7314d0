"""Session defaults for the engine."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Adaptive execution sizes shuffle partitions, splits skewed ones and turns a
# join into a broadcast one only after measuring the shuffled side.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "quillspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def local_session(cpus: int | str = "*", memory: str | None = None) -> SparkSession:
    """A single-process session for tests and the benchmark."""
    threads = os.cpu_count() if cpus == "*" else int(cpus)
    return session(
        master=f"local[{cpus}]",
        spark__driver__memory=memory or os.environ.get("QUILLSPARK_DRIVER_MEMORY", "8g"),
        spark__sql__shuffle__partitions=str(threads),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once per application.

    Batch functions are unpickled by import, so every worker needs the package.
    """
    context = spark.sparkContext
    if not getattr(context, "_quillspark_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="quillspark-ship-"), "quillspark")
        archive = shutil.make_archive(
            target, "zip", os.path.dirname(package), os.path.basename(package)
        )
        context.addPyFile(archive)
        context._quillspark_shipped = True
    return spark
