"""Shared scratch space and small Arrow helpers of the llm operators.

Every intermediate table that cuts lineage is written as Parquet below the
folder in ``spark.checkpoint.dir``, which driver and executors share.  Where it is
unset, a folder is made here if Spark runs in one process (tests); on a cluster that
is an error.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RELEASE_S = 0.5
_LOCAL: list[str] = []
_OPEN: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="pulsegrid-"))
        base = _LOCAL[0]
    return base.rstrip("/") + "/pulsegrid"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> str:
    """Write df to the shared folder and return its path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: a checkpoint with column pruning."""
    path = save(df, name)
    if _OPEN:
        _OPEN[-1].append(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that keep() writes inside are removed at the end, unless survive() is called for them.

    Whatever is used later must be written by then: a plan that still reads a removed table fails.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def survive(kept: DataFrame) -> DataFrame:
    """A table of keep() that outlives the innermost passing() and belongs to the one around it."""
    _OPEN[-1].remove(kept._kept_at)
    if len(_OPEN) > 1:
        _OPEN[-2].append(kept._kept_at)
    return kept


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more.

    Their clean-up waits for the garbage collection of the driver's JVM, which an
    idle driver may put off for half an hour while disks fill.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()  # the plan that ran last is held until another runs
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(RELEASE_S)  # the cleaner works beside the driver's next steps


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def blobs(lengths, flat: bytes) -> pa.Array:
    """A binary array whose rows are consecutive pieces of flat, by their byte lengths."""
    import numpy as np

    offs = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offs[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offs), pa.py_buffer(flat)]).cast(pa.binary())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened as long as df has columns of these names (in any case)."""
    taken = {c.lower() for c in df.columns}
    while taken & {n.lower() for n in names}:
        names = tuple(f"{n}_" for n in names)
    return list(names)


def plus(df: DataFrame, **columns: str) -> T.StructType:
    """df's schema with more columns at the end."""
    schema = T.StructType(list(df.schema.fields))
    for name, kind in columns.items():
        schema = schema.add(T.StructType.fromDDL(f"`{name}` {kind}")[0])
    return schema
