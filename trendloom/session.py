"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


# The JVM leaves larger methods uncompiled; a wide projection fused into one method then runs
# several times slower than the same projection generated piece by piece.
HOTSPOT_METHOD_LIMIT = 8000


@contextmanager
def small_methods(spark: SparkSession):
    """Keep generated methods compilable while wide rows are written."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, HOTSPOT_METHOD_LIMIT)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trendloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.codegen.hugeMethodLimit", str(HOTSPOT_METHOD_LIMIT))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared directory named in ``spark.checkpoint.dir``.

    Every executor must see it, so a machine-local folder is used only in local mode.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="trendloom-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/trendloom/{label}-{uuid.uuid4().hex}")
    # With its scheme, so that Spark and Arrow mean the same file system.
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
