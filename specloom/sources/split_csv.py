"""CSV records of large files with line breaks inside quotes, read by many tasks.

A file is read in byte ranges as physical lines.  A quote opens or closes, so whether a line begins inside
quotes is the parity of all quotes before it: every range counts its own lines from an even start, and a
prefix sum over the ranges of a file tells which of them start inside quotes.  A line that begins and ends
outside quotes is a record as it stands; only the lines of records that break are brought together, by
record, and a record may begin in one range and end in another.

Defined results: doubled quotes stand for one; a carriage return before a line break is dropped; empty lines are
no records; the first record of a file is its header; a quote that is never closed makes the rest
of its file one record, as in any CSV reader.  The header itself must not hold a line break.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.stage import durable


def _numbered(batches):
    """Lines with their number in a range, the parity of quotes before them in it and in them, and for
    either way to enter the range (begun0, begun1) how many records that break have begun in it."""
    last, number, parity, begun = None, 0, 0, [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        start = batch.column("start").to_numpy()
        file = pc.dictionary_encode(batch.column("file"))
        code = file.indices.to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1]) | (code[1:] != code[:-1]), [True]]))
        quotes = pc.count_substring(batch.column("value"), '"').to_numpy()
        line, before, *breaks = (np.empty(batch.num_rows, np.int64) for _ in range(4))
        for a, b in zip(edges[:-1], edges[1:]):
            own = (file.dictionary[int(code[a])].as_py(), int(start[a]))
            if own != last:
                last, number, parity, begun = own, 0, 0, [0, 0]
            line[a:b] = np.arange(number, number + b - a)
            before[a:b] = parity + np.concatenate([[0], np.cumsum(quotes[a:b])[:-1]])
            for e in (0, 1):
                breaks[e][a:b] = begun[e] + np.cumsum((before[a:b] % 2 == e) & (quotes[a:b] % 2 == 1))
                begun[e] = int(breaks[e][b - 1])
            number, parity = number + int(b - a), int(before[b - 1] + quotes[b - 1]) % 2
        yield pa.record_batch([batch.column("file"), batch.column("start"), pa.array(line), batch.column("value"), pa.array(before % 2, pa.int32()), pa.array(quotes % 2, pa.int32()), *map(pa.array, breaks)],
                              names=["file", "start", "line", "value", "inside", "odd", "begun0", "begun1"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line, text): every record of the files, with the place where it begins; headers are records too."""
    raw = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    # Read by the ranges, the whole lines and the broken ones: numbered once.
    lines = durable(raw.mapInArrow(_numbered, "file string, start bigint, line bigint, value string, inside int, odd int, begun0 bigint, begun1 bigint"))
    # Ranges of a file: how each is entered, and the last record that broke before it.
    ranges = lines.groupBy("file", "start").agg(F.sum("odd").alias("odds"), *[F.max(f"begun{e}").alias(f"begun{e}") for e in (0, 1)])
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("entered", (F.coalesce(F.sum("odds").over(before), F.lit(0)) % 2).cast("int"))
    ranges = ranges.withColumn("begun", F.when(F.col("entered") == 0, F.col("begun0")).otherwise(F.col("begun1")))
    open_ = F.last(F.when(F.col("begun") > 0, F.struct(F.col("start").alias("at"), F.col("begun").alias("no"))), ignorenulls=True).over(before)
    ranges = ranges.select(F.col("file").alias("_f"), F.col("start").alias("_s"), "entered", open_.alias("open"))
    placed = lines.join(ranges, (F.col("file") == F.col("_f")) & (F.col("start") == F.col("_s"))).withColumn("begins", (F.col("inside") + F.col("entered")) % 2 == 0)
    whole = placed.where("begins AND odd = 0").select("file", "start", "line", "value")
    broken = placed.where("NOT begins OR odd = 1")
    number = F.when(F.col("entered") == 0, F.col("begun0")).otherwise(F.col("begun1"))
    record = F.when(number > 0, F.struct(F.col("start").alias("at"), number.alias("no"))).otherwise(F.col("open"))
    joined = (broken.withColumn("record", record).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "line", "value"))).alias("l"))
              .select("file", F.expr("l[0].start").alias("start"), F.expr("l[0].line").alias("line"), F.expr("array_join(transform(l, x -> x.value), '\n')").alias("value")))
    text = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), "\r$", "")
    return whole.union(joined).select("file", "start", "line", text.alias("text")).where("text <> ''")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header, all columns strings, and ``_file``, the name of a row's file."""
    columns = spark.read.csv(path, header=True, escape='"', encoding="UTF-8").columns
    schema = ", ".join("`" + c.replace("`", "``") + "` STRING" for c in columns)
    records = csv_records(spark, path).where("start > 0 OR line > 0")
    # A record may break, so no character that stands in one may end it.
    parsed = records.select(F.element_at(F.split("file", "/"), -1).alias("_file"), F.from_csv("text", schema, {"escape": '"', "lineSep": "\x01"}).alias("_row"))
    return parsed.select("_file", "_row.*")
