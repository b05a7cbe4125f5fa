"""Shared storage, package shipping and small helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: "weakref.WeakSet" = weakref.WeakSet()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent (tests on one machine) a folder of our own is made and set once; a cluster without the setting raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
        if not path:
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir names no folder that all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="lodestrand-")
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestrand-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    sweep(spark)
    return spark.read.schema(df.schema).parquet(path), path


def detached(df: DataFrame, key: str) -> DataFrame:
    """``df``, one row a key, dealt out by something else than the key: a join on it shuffles both sides anew, so Spark can split a hot key of the other side."""
    return df.repartition(F.xxhash64(F.col(key), F.lit("detached")))


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by :func:`settle`."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows and bytes in a batch that goes to a Python worker, at most; a longer row is alone.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per context, and keep the batches of texts that go there small."""
    sc, name = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="lodestrand-pkg-"), "lodestrand_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for here, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(here, n)
                    out.write(full, os.path.join(os.path.basename(top), os.path.relpath(full, top)))
    sc.addPyFile(target)
    with contextlib.suppress(TypeError):
        _SHIPPED.add(sc)


_HELD: dict[str, dict] = {}


def held(name: str) -> dict:
    """What an operator keeps in a worker process from task to task."""
    return _HELD.setdefault(name, {})


def trim() -> None:
    """Give freed memory back to the system: workers are pooled, and wait beside stages that need the memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def light(run: Callable, name: str = "") -> Callable:
    """``run``, a function for mapInArrow, in a worker that holds no other operator's tables and keeps no freed memory when the task ends."""

    def task(batches):
        from lodestrand.llm.store import _HELD, trim

        for other, tables in _HELD.items():
            if other != name:
                tables.clear()
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
