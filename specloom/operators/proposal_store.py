"""Proposals and their review states as versioned snapshots in a shared folder.

Every change writes a whole new snapshot to a folder of its own and then, last, one manifest row that
names it.  Readers follow the newest manifest row, so a write that fails half-way stays invisible and a
reader never sees a mix of two versions; older versions stay readable.  A manifest row also
names the batch it came from: a batch that a stream repeats after a restart changes nothing.

One writer at a time: a version's manifest row is never overwritten, so of two writers that started from
the same version the later one fails and may start again.

Defined results: a store that was never written has no proposals; a merge of no rows makes no
version; decisions on unknown ids are ignored; of several rows with one id in a merge the smallest counts.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .learn import review, upsert

MANIFEST = "version bigint, folder string, source string, batch bigint"


class ProposalStore:
    """``ddl`` has id, status and what else a proposal holds."""

    def __init__(self, spark: SparkSession, path: str, ddl: str):
        self.spark, self.path, self.ddl = spark, path.rstrip("/"), ddl

    def history(self) -> DataFrame:
        """One row for each version that was written in full."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/*")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], MANIFEST)

    def version(self) -> int:
        return self.history().agg(F.max("version")).first()[0] or 0

    def read(self, version: int | None = None) -> DataFrame:
        """The proposals of the newest version, or of an older one."""
        rows = self.history()
        at = rows.orderBy(F.desc("version")).first() if version is None else rows.where(F.col("version") == version).first()
        if at is None:
            if version:
                raise ValueError(f"no version {version}")
            return self.spark.createDataFrame([], self.ddl)
        return self.spark.read.schema(self.ddl).parquet(f"{self.path}/{at.folder}")

    def _write(self, df: DataFrame, source: str | None, batch: int | None) -> int:
        number = self.version() + 1
        folder = f"snapshot-{number:010d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        row = self.spark.createDataFrame([(number, folder, source, batch)], MANIFEST)
        row.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/{number:010d}")
        return number

    def _known(self, source: str | None, batch: int | None) -> bool:
        return batch is not None and not self.history().where((F.col("source") == source) & (F.col("batch") == batch)).isEmpty()

    def merge(self, new: DataFrame, source: str | None = None, batch: int | None = None) -> int:
        """Settled proposals stay, pending ones are refreshed, unseen ones added.  Gives the version now in force."""
        if self._known(source, batch) or new.isEmpty():
            return self.version()
        columns = [f.name for f in self.read().schema]
        rows = new.select(*columns)
        one = rows.groupBy("id").agg(F.min(F.struct(*columns)).alias("r")).select("r.*")
        return self._write(upsert(self.read(), one).select(*columns), source, batch)

    def decide(self, decisions: DataFrame, source: str | None = None, batch: int | None = None) -> int:
        """``decisions(id, decision)``, one a proposal: approve, reject or revoke."""
        if self._known(source, batch) or decisions.isEmpty():
            return self.version()
        return self._write(review(self.read(), decisions.select("id", "decision")), source, batch)

    def follow(self, stream: DataFrame, checkpoint: str, source: str = "stream") -> StreamingQuery:
        """Merge a stream of proposals batch by batch; a batch that is repeated after a failure is merged once."""
        return (stream.writeStream.foreachBatch(lambda df, batch: self.merge(df, source, batch) and None)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
