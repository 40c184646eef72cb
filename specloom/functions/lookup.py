"""Lookup tables that every task holds, as the value of a session variable.

A table of bounded size becomes one value: an array of slots, entries filed by crc32 of a probe.  An
expression that binds the variable once finds the entries of a probe in one slot, so a
row's cost follows its own probes, the plan has one constant whatever the table's size, and no row is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, functions as F

from .stage import durable


@contextmanager
def held(df: DataFrame, column: str = "ix") -> Iterator[str]:
    """Name, in SQL text, of the value of the one-row ``df``; plans built inside the block have taken it."""
    spark, name = df.sparkSession, f"lookup_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    spark.sql(f"DECLARE VARIABLE {name} {df.schema[column].dataType.simpleString()}")
    try:
        spark.sql(f"SET VARIABLE {name} = (SELECT {column} FROM {name})")
        yield f"session.{name}"
    finally:
        spark.sql(f"DROP TEMPORARY VARIABLE {name}")
        spark.catalog.dropTempView(name)


def filed(table: str, probe: str) -> str:
    """Entries of ``ix.table`` filed under ``probe``; ``run`` is the probe of an entry."""
    return f"filter(get(ix.{table}, CAST(crc32(CAST({probe} AS BINARY)) % ix.size AS INT)), p -> p.run = {probe})"


def filing(entries: DataFrame) -> DataFrame:
    """The one-row table of ``entries`` (a column ``run`` and others), stored.  Its size must have been checked."""
    spark = entries.sparkSession
    size = 1 << max(4, entries.count().bit_length())
    slot = F.expr(f"CAST(crc32(CAST(run AS BINARY)) % {size} AS INT)")
    full = entries.groupBy(slot.alias("slot")).agg(F.array_sort(F.collect_list(F.struct(*entries.columns))).alias("entries"))
    empty = entries.limit(0).groupBy().agg(F.collect_list(F.struct(*entries.columns)).alias("none"))
    every = spark.range(size).select(F.col("id").cast("int").alias("slot")).join(full, "slot", "left")
    kind = empty.schema["none"].dataType.simpleString()
    row = every.groupBy().agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("entries", F.expr(f"CAST(array() AS {kind})")).alias("entries")))).alias("s"))
    return durable(row.select(F.struct(F.lit(size).alias("size"), F.transform("s", lambda x: x["entries"]).alias("slots")).alias("ix")))
