"""Folders for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``); only local sessions may do without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not hasattr(scratch, "own"):
            scratch.own = tempfile.mkdtemp(prefix="spark-bars-")
        shared = f"file://{scratch.own}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
