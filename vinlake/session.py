"""Spark sessions with the settings that results and speed depend on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: UTC keeps day buckets the same everywhere; adaptive execution sizes shuffles and splits skewed joins at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM compiles no method of over 8,000 bytes: beyond that, generated code in many small methods is faster than one that stays interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; `more` overrides them, with dots as double underscores."""
    builder = SparkSession.builder.appName("vinlake")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, and a local one only where that is unset and all run in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
