"""A new folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path in spark.checkpoint.dir; only a session in one process (tests) may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="pulsegrid-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/pulsegrid/{name}-{uuid.uuid4().hex}"
