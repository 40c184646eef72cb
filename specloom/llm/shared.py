"""Small helpers of the operators: tables in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only if a local session names none."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if base is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one evaluation, short lineage."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark a stored table for broadcast if it is counted to hold at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def process_state(name: str | None = None, key=None, make=None):
    """State that an operator keeps in a worker process between tasks; one operator's at a time.

    Asking for another operator's state, or for none, lets go of what is held.
    """
    held = sys.modules.setdefault("_llm_process_state", types.ModuleType("_llm_process_state"))
    if getattr(held, "owner", None) != (name, key):
        held.value = None
        release()  # else the new state comes on top of what the old one took
        held.value = make() if make else None
        held.owner = (name, key)
    return held.value


def release() -> None:
    """Give memory that arrays and batches no longer use back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def light(read):
    """The function of batches ``read``, giving memory back at the end of each task."""
    def run(batches):
        yield from read(batches)
        release()
    return run


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, size: int):
    """Arrow batches of jobs run meanwhile hold about ``size`` bytes at most: in the JVM and in Python, each task holds one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def aside(docs: DataFrame, uses: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs``, whose other columns than ``uses`` have names meanwhile that no operator gives; the columns of ``docs`` as a result."""
    read = {c.lower() for c in uses}
    held = {c: c if c.lower() in read else f"__aside_{i}" for i, c in enumerate(docs.columns)}
    out = work(docs.withColumnsRenamed({c: name for c, name in held.items() if c != name}))
    return out.select(*[F.col(f"`{name}`").alias(c) for c, name in held.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
