"""Claim tables: the contest of R1/R5 over long rows, and the scores built on it (K2).

``claims(id, key, val, prov, conf, <order columns>)``.  The contest is sequential: a
claim whose value differs costs the winner 0.05, so order decides.  One expression
(``fold_sql``) folds the ordered claims of a block from the state that entered it.  A
(id, key) group of ordinary size is one block that nothing enters.  A larger group is
never gathered: its claims are range-partitioned into consecutive blocks, the blocks are
stored, every block is folded in parallel from the state the block before it ended with,
and only blocks whose entering state changed are folded again until nothing changes.
Blocks are storage only; the result is that of one fold over the whole group.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import fixed
from ..functions.stage import durable
from ..functions.text import folded, q
from .reconcile import lowered

GROUP_LIMIT = 10_000
#: Claims whose log lines are joined before they are added to a block's log.
RUN = 100
RANK = "CASE prov " + " ".join(f"WHEN {q(p)} THEN {r}" for p, r in fixed.PROVENANCE_RANK.items()) + " ELSE 0 END"
_RANKS = dict(fixed.PROVENANCE_RANK)
_HELD = "STRUCT<val:STRING,rank:INT,conf:DOUBLE,prov:STRING>"


def fold_sql(claims: str, entering: str, log: bool) -> str:
    """R1 (and R5 lines) over an ordered array of structs (val, rank, conf, prov).

    ``entering`` is the winner so far, or null.  Gives held, conflicts and log.
    """
    wins = "(c.rank > acc.held.rank OR (c.rank = acc.held.rank AND c.conf > acc.held.conf))"
    differ = f"NOT ({folded('c.val')} <=> {folded('acc.held.val')})"

    def out(won, lost):
        line = f"concat('kept ', {won}.val, ' (', {won}.prov, ') over ', {lost}.val, ' (', {lost}.prov, ')')"
        logged = f"IF({differ}, concat(acc.log, array({line})), acc.log)" if log else "acc.log"
        return (f"named_struct('held', named_struct('val', {won}.val, 'rank', {won}.rank,"
                f" 'conf', IF({differ}, {lowered(won + '.conf')}, {won}.conf), 'prov', {won}.prov),"
                f" 'conflicts', acc.conflicts + IF({differ}, 1L, 0L), 'log', {logged})")
    first = f"named_struct('held', CAST(c AS {_HELD}), 'conflicts', acc.conflicts, 'log', acc.log)"
    step = f"CASE WHEN acc.held IS NULL THEN {first} WHEN {wins} THEN {out('c', 'acc.held')} ELSE {out('acc.held', 'c')} END"
    none = "CAST(array() AS ARRAY<STRING>)"
    inner = (f"aggregate(slice({claims}, run * {RUN} + 1, {RUN}), named_struct('held', all.held, 'conflicts', all.conflicts, 'log', {none}),"
             f" (acc, c) -> {step}, r -> named_struct('held', r.held, 'conflicts', r.conflicts, 'log', concat(all.log, r.log)))")
    return (f"aggregate(sequence(0, (size({claims}) - 1) div {RUN}), named_struct('held', CAST({entering} AS {_HELD}), 'conflicts', 0L, 'log', {none}),"
            f" (all, run) -> {inner})")


def _block_folds(claims: DataFrame, by: list[str], order: list[str], entering: str, log: bool) -> DataFrame:
    """Columns ``by`` and w (held, conflicts, log): every block folded from ``entering``, a column of the claims."""
    held = [] if entering == "NULL" else [F.any_value(entering).alias("_in")]
    grouped = claims.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(
        *order, "val", F.expr(RANK).alias("rank"), "conf", "prov"))).alias("c"), *held)
    bare = grouped.withColumn("c", F.expr("transform(c, x -> named_struct('val', x.val, 'rank', x.rank, 'conf', x.conf, 'prov', x.prov))"))
    return bare.select(*by, F.expr(fold_sql("c", "_in" if held else "NULL", log)).alias("w"))


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns whose nulls equal each other, as they do in grouping."""
    other = right.withColumnsRenamed({c: f"_{c}" for c in on})
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on])
    return left.join(other, same, how).drop(*[f"_{c}" for c in on])


def _oversized(claims: DataFrame, order: list[str], limit: int, total: int, log: bool) -> DataFrame:
    """id, key, blk, w of the blocks of large groups, each folded from its final entering state."""
    block = ["id", "key", "blk"]
    placed = durable(claims.repartitionByRange(max(2, math.ceil(total / limit)), "id", "key", *order)
                     .withColumn("blk", F.spark_partition_id()))
    entering = placed.select(*block).distinct().withColumn("e", F.lit(None).cast(_HELD))
    known = None  # blocks with the state they entered with and what they ended with
    w = W.partitionBy("id", "key").orderBy("blk")
    while True:
        ended = _joined(_block_folds(_joined(placed, entering, block), block, order, "e", log), entering, block)
        known = durable(ended if known is None else _joined(known, entering.select(*block), block, "left_anti").unionByName(ended))
        after = known.select(*block, "e", F.lag("w.held").over(w).alias("n"))
        entering = durable(after.where("NOT (e <=> n)").select(*block, F.col("n").alias("e")))
        if entering.isEmpty():
            return known.drop("e")


def _split(claims: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(ordinary claims, claims of oversized groups or None, their number)."""
    sizes = claims.groupBy("id", "key").agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    total = sizes.agg(F.count("*").alias("g"), F.sum("_n").alias("n")).first()
    if not total["g"]:
        return claims, None, 0
    big = sizes.select("id", "key")
    side = F.broadcast(big) if total["g"] <= 100_000 else big
    return _joined(claims, side, ["id", "key"], "left_anti"), _joined(claims, side, ["id", "key"], "left_semi"), total["n"]


def reconcile_claims(claims: DataFrame, order: list[str], limit: int = GROUP_LIMIT) -> DataFrame:
    """The surviving claim of every (id, key), its confidence and the conflicts it went through.

    ``order`` names the columns that put the claims of a group in sequence.  ``limit`` is the
    size of a block in memory; it does not change the result.
    """
    small, large, total = _split(claims, limit)
    columns = ["id", "key", "w.held.val", "w.held.prov", "w.held.conf"]
    settled = _block_folds(small, ["id", "key"], order, "NULL", False).select(*columns, "w.conflicts")
    if large is None:
        return settled
    blocks = _oversized(large, order, limit, total, False)
    hot = blocks.groupBy("id", "key").agg(F.max_by("w", "blk").alias("w"), F.sum("w.conflicts").alias("conflicts"))
    return settled.unionByName(hot.select(*columns, "conflicts"))


def conflict_log(claims: DataFrame, order: list[str], limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per conflict, ``(block, n)`` giving its order; no group's log is ever gathered."""
    small, large, total = _split(claims, limit)
    out = _block_folds(small, ["id", "key"], order, "NULL", True).select("id", "key", F.lit(0).alias("block"), F.posexplode("w.log").alias("n", "line"))
    if large is None:
        return out
    blocks = _oversized(large, order, limit, total, True)
    return out.unionByName(blocks.select("id", "key", F.col("blk").alias("block"), F.posexplode("w.log").alias("n", "line")))


def confidence(attributes: DataFrame, by: str = "id") -> DataFrame:
    """K2: provenance-weighted mean confidence; partial sums combine before the exchange."""
    w = F.expr(f"({RANK}) / 6D")
    return attributes.groupBy(by).agg((F.sum(F.col("conf") * w) / F.sum(w) * 100).alias("confidence"),
                                      F.count("*").alias("attributes"))
