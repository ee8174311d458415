"""Session construction with the settings the engine relies on."""

from __future__ import annotations

import io
import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark.scratch import scratch_path

#: Settings every session of the engine should have.  Cluster-sized values
#: (executors, memory, shuffle partitions, checkpoint folder) stay with the
#: deployment; nothing here caps them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session.

    ``master`` is only set when given, so ``spark-submit`` decides on a
    cluster.  Keyword settings use ``__`` for dots
    (``spark__driver__memory="8g"``).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def local_session(cpus: int | None = None, app: str = "tidemark") -> SparkSession:
    """A ``local[n]`` session for tests and the bench."""
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = build_session(
        app,
        master=f"local[{n}]",
        spark__sql__shuffle__partitions=str(n),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers that do not share the driver's path.

    The zipped package (a few dozen kB) is put in the shared folder, from where
    Spark hands it to the executors as with ``--py-files``.  Once per application.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package, archive = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    path = f"{scratch_path(spark, 'package')}/tidemark.zip"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(archive.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
