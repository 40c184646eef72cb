"""One evaluation per row for heavy derived columns.

Catalyst inlines projections and pushes filters through them, which is right for
cheap expressions and wrong for an expression that walks a whole record: it would
be evaluated once per reference, or once per array element inside a lambda.  An
always-true test on the partition id marks the column as not to be inlined; the
projection stays inside whole-stage codegen and adds no exchange.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def stage(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Add or replace columns (SQL text or Columns), each evaluated exactly once per row."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    once = F.spark_partition_id() >= 0
    made = [F.when(once, F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    return df.select(*kept, *made)


def spread(df: DataFrame) -> DataFrame:
    """Give compute-heavy row work at least one task per core.

    A table with fewer than twice as many splits as the cluster has cores is dealt out again: splits
    are byte ranges, and those of a file without a row group of their own have no rows.  A large table
    has far more splits than that and is left exactly as it was read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def shared_folder(spark: SparkSession, name: str = "stage") -> str:
    """A new folder below the one spark.checkpoint.dir names; below a temporary one only if a local session, as in tests, names none."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if base is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: evaluated once, short lineage."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
