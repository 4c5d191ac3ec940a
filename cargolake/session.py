"""Session settings the operators are written for."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str = "cargolake", cores: str = "*", partitions: int = 8,
                  memory: str = "8g", **extra: str) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(partitions)))
    if "spark.checkpoint.dir" not in extra:  # one machine is its own shared folder
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="cargolake-")
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: While a step is written, shuffle files of a finished job are removed at once, so that those of
#: several steps do not add up on disk.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    with _held(spark, CLEANUP, "true", "false"):
        yield


#: The JVM compiles no method of more than 8,000 bytes. Spark generates such for rows of many columns, which are
#: then interpreted; with this limit it falls back to a method for each expression.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    with _held(spark, METHOD_LIMIT, "8000", "65535"):
        yield


@contextmanager
def _held(spark: SparkSession, name: str, value: str, default: str) -> Iterator[None]:
    before = spark.conf.get(name, default)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. ``local_session`` sets it for
    sessions of one machine; a local session made otherwise gets a folder there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="cargolake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")
