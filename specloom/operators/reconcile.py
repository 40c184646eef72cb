"""Settle competing claims by evidence rank while keeping every conflict.

The contest is sequential: the incumbent loses 0.05 confidence each time a claim
with a different value challenges it, so the order of claims matters.  Inside a
record the claims of one key are few and the fold runs over the row's own array.
For claim tables the same fold runs per (id, key) -- see ``reconcile_claims`` for
how groups of any size are handled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.stage import stage
from ..functions.text import folded, let
from .records import NO_ATTRIBUTES, rebuilt, shown

VALUES_AGREE = (
    # Canonical numbers within 1 %, else raw numbers within 1 %, else text.
    "CASE WHEN h.norm IS NOT NULL AND s.norm IS NOT NULL"
    " THEN abs(h.norm - s.norm) <= greatest(abs(s.norm) * 0.01D, 1e-9D)"
    " WHEN try_cast(h.val AS DOUBLE) IS NOT NULL AND try_cast(s.val AS DOUBLE) IS NOT NULL"
    " THEN abs(try_cast(h.val AS DOUBLE) - try_cast(s.val AS DOUBLE))"
    " <= greatest(abs(try_cast(s.val AS DOUBLE)) * 0.01D, 1e-9D)"
    f" ELSE {folded('h.val')} <=> {folded('s.val')} END"
)


def lowered(conf: str) -> str:
    return f"round(greatest({conf} - 0.05D, 0.1D), 3)"


def reconcile(df: DataFrame) -> DataFrame:
    """R1-R5 on records: adds ``attributes`` (one per key, R4 order), ``conflicts`` and
    ``standard_conflicts``."""
    line = (f"concat(w.label, ': kept ', {shown('w')}, ' (', w.prov, ') over ', {shown('l')},"
            " ' (', l.prov, ')')")
    contest = let("inc", "get(filter(acc.held, h -> h.key = c.key), 0)", (
        "CASE WHEN inc IS NULL THEN named_struct('held', concat(acc.held, array(c)), 'log', acc.log) ELSE "
        + let("cw", "c.rank > inc.rank OR (c.rank = inc.rank AND c.conf > inc.conf)", let(
            "w", "IF(cw, c, inc)", let("l", "IF(cw, inc, c)", let(
                "differ", f"NOT ({folded('w.val')} <=> {folded('l.val')})",
                "named_struct('held', transform(acc.held, h -> IF(h.key = c.key,"
                f" IF(differ, {rebuilt('w', conf=lowered('w.conf'))}, w), h)),"
                f" 'log', IF(differ, concat(acc.log, array({line})), acc.log))"))))
        + " END"))
    fold = (f"aggregate(concat(extracted, inferred), named_struct('held', {NO_ATTRIBUTES},"
            f" 'log', CAST(array() AS ARRAY<STRING>)), (acc, c) -> {contest})")
    conflict = (
        "named_struct('key', s.key, 'label', s.label, 'held', " + shown("h") + ", 'held_provenance', h.prov,"
        " 'standard', " + shown("s") + ", 'summary', concat(s.label, ': kept ', " + shown("h")
        + ", ' (', h.prov, ') over ', " + shown("s") + ", ' (', s.prov, ')'))")
    evidence = ("concat(h.evidence, ' — but ', s.evidence, ' The supplier value is kept and flagged,"
                " not overwritten.')")
    checked = let("f", fold, let("std", "standards", (
        "named_struct('attributes', array_sort(transform(f.held, h -> "
        + let("s", "get(filter(std, x -> x.key = h.key), 0)",
              f"IF(s IS NULL OR {VALUES_AGREE}, h, {rebuilt('h', conf=lowered('h.conf'), evidence=evidence)})")
        + "), (a, b) -> CASE WHEN a.grp < b.grp THEN -1 WHEN a.grp > b.grp THEN 1"
          " WHEN a.conf > b.conf THEN -1 WHEN a.conf < b.conf THEN 1"
          " WHEN a.label < b.label THEN -1 WHEN a.label > b.label THEN 1 ELSE 0 END),"
          " 'log', f.log, 'std', filter(transform(std, s -> "
        + let("h", "get(filter(f.held, x -> x.key = s.key), 0)",
              f"CASE WHEN h IS NOT NULL AND NOT ({VALUES_AGREE}) THEN {conflict} END")
        + "), x -> x IS NOT NULL))")))
    df = stage(df, _rec=checked)
    return df.withColumns({
        "attributes": F.col("_rec.attributes"),
        "standard_conflicts": F.col("_rec.std"),
        "conflicts": F.expr("concat(_rec.log, transform(_rec.std, s -> s.summary))"),
    }).drop("_rec", "standards")
