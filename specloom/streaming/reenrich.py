"""First arrivals whose memory holds the taxonomy in force (H1, H2 on a stream).

State is keyed by the address of a product's content without the taxonomy, and holds the fingerprint under which
the content last went through.  A repeated product is held back while the fingerprint is the same;
after a category has been approved, or withdrawn, it goes through once more.  State has a time to live, counted from
the last time the content was seen, so memory follows the distinct contents of that time and not the stream.

Late rows: a row is judged when it arrives; its event time does not matter.  Of equal contents in one batch
the row with the smallest id goes through.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.incremental import with_hash


def changed_arrivals(stream: DataFrame, live_ms: int | None = 86_400_000, mode: str = "demo") -> DataFrame:
    """Products of ``stream`` whose content is new, or known under another fingerprint.

    ``stream`` has a column ``fingerprint``, the taxonomy's when the row was read (see ``stamped``);
    null is the fingerprint of no learned category.  A query that is to end when all that is available has been
    read needs spark.sql.streaming.noDataMicroBatches.enabled to be false, as a time to live keeps it going.
    """
    keyed = with_hash(stream, mode).withColumn("fingerprint", F.coalesce("fingerprint", F.lit("")))

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = None
        for pdf in frames:
            best = pdf.sort_values("id", kind="stable").head(1)
            if first is None or best["id"].iloc[0] < first["id"].iloc[0]:
                first = best
        fingerprint = first["fingerprint"].iloc[0]
        new = not state.exists or state.get[0] != fingerprint
        state.update((fingerprint,))
        if live_ms:
            state.setTimeoutDuration(live_ms)
        if new:
            yield first

    timeout = GroupStateTimeout.ProcessingTimeTimeout if live_ms else GroupStateTimeout.NoTimeout
    return keyed.groupBy("content_hash").applyInPandasWithState(judge, keyed.schema, "fingerprint string", "append", timeout)


def stamped(products: DataFrame, fingerprint: Callable[[], DataFrame]) -> DataFrame:
    """``products`` with the fingerprint now in force, one row of ``fingerprint()`` (``incremental.taxonomy_fingerprint``)."""
    return products.withColumn("fingerprint", F.lit(fingerprint().first()["fingerprint"]))


# The function is sent by value, so that workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
