"""Merge a second, bounded record set under an evidence policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions import units
from ..functions.stage import stage
from ..functions.text import folded, in_list, let, q
from .records import NO_ATTRIBUTES, rebuilt
from .rules import validate
from .score import score

METHOD = "hybrid:bounded"
_WHY = {
    "supplied": "the supplier stated this value",
    "parsed": "this was parsed from the supplied identifiers",
    "knowledge_base": "a published standard fixes this value",
    "derived": "this was calculated from other known attributes",
}
_REASONS = {
    "gap_filled": "The deterministic engine found no value for this field, so the model's proposal is"
                  " recorded as an inference.",
    "displaced_default": "The existing value was a category default carrying no supplier backing, which"
                         " an informed inference outranks.",
}
COLUMNS = ["label", "val", "num", "kind", "unit", "prov", "conf", "evidence", "grp"]


def decide(held: DataFrame, proposed: DataFrame) -> DataFrame:
    """G1: one row per (id, key) with the action taken, if any.

    Both sides carry id, key and ``COLUMNS`` and hold at most one row per (id, key).
    """
    h = held.select("id", "key", *[F.col(c).alias("h_" + c) for c in COLUMNS], F.lit(True).alias("_h"))
    p = proposed.select("id", "key", *[F.col(c).alias("p_" + c) for c in COLUMNS], F.lit(True).alias("_p"))
    differ = F.expr(f"NOT ({folded('h_val')} <=> {folded('p_val')})")
    return (h.join(p, ["id", "key"], "full_outer")
            .withColumn("action", F.when(F.col("_p").isNull(), F.lit(None).cast("string"))
                        .when(F.col("_h").isNull(), "gap_filled")
                        .when((F.col("h_prov") == "defaulted") & differ, "displaced_default")
                        .when(F.col("h_prov").isin(fixed.PROTECTED) & differ, "refused"))
            .drop("_h", "_p"))


def merged(decisions: DataFrame) -> DataFrame:
    """Surviving attributes; adopted values are re-stamped as capped inferences."""
    adopted = F.col("action").isin("gap_filled", "displaced_default")
    reason = F.when(F.col("action") == "gap_filled", "gap fill").otherwise("displaced category default")
    out = {c: F.when(adopted, F.col("p_" + c)).otherwise(F.col("h_" + c)) for c in COLUMNS}
    out["prov"] = F.when(adopted, "inferred").otherwise(F.col("h_prov"))
    out["conf"] = F.when(adopted, F.round(F.least("p_conf", F.lit(fixed.INFERRED_CAP)), 3)).otherwise(F.col("h_conf"))
    out["evidence"] = F.when(adopted, F.substring(
        F.concat(F.lit("[gate: "), reason, F.lit("] "), F.col("p_evidence")), 1, 600)).otherwise(F.col("h_evidence"))
    return decisions.select("id", "key", *[v.alias(k) for k, v in out.items()],
                            F.when(adopted, F.lit(METHOD)).alias("gate_method"))


def actions(decisions: DataFrame) -> DataFrame:
    """Every decision, refusals included, with its reason."""
    def shown(side: str) -> str:
        return units.display(f"{side}_val", f"{side}_num", f"{side}_kind", f"{side}_unit")
    why = "CASE h_prov " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in _WHY.items()) + " END"
    return decisions.where("action IS NOT NULL").select(
        "id", "key", F.col("p_label").alias("label"), "action", F.expr(shown("p")).alias("proposed"),
        F.expr(f"CASE WHEN action <> 'gap_filled' THEN {shown('h')} END").alias("kept"),
        F.expr("CASE WHEN action <> 'gap_filled' THEN h_prov END").alias("kept_provenance"),
        F.expr(f"CASE action WHEN 'gap_filled' THEN {q(_REASONS['gap_filled'])}"
               f" WHEN 'displaced_default' THEN {q(_REASONS['displaced_default'])}"
               f" ELSE concat('Refused: ', {why}, ', which outranks a model inference.') END").alias("reason"))


def action_counts(decisions: DataFrame) -> DataFrame:
    """Actions per record; partial counts combine before the exchange."""
    return (decisions.where("action IS NOT NULL").groupBy("id").agg(
        F.count_if(F.col("action") == "gap_filled").alias("gap_filled"),
        F.count_if(F.col("action") == "displaced_default").alias("displaced_defaults"),
        F.count_if(F.col("action") == "refused").alias("refused")))


def apply_to_records(records: DataFrame, proposed: str = "proposed") -> DataFrame:
    """Gate the ``proposed`` attribute array into records, then validate and score again.

    Adds ``gate``: every decision on the record (key, action) and how many of each there were.
    """
    def adopt(a: str, reason: str) -> str:
        return rebuilt(a, conf=f"round(least({a}.conf, {fixed.INFERRED_CAP}D), 3)",
                       evidence=f"left(concat('[gate: {reason}] ', {a}.evidence), 600)", prov="'inferred'",
                       rank=str(fixed.PROVENANCE_RANK["inferred"]), method=q(METHOD))
    held = let("p", "get(filter(pr, x -> x.key = a.key), 0)", (
        f"IF(p IS NOT NULL AND a.prov = 'defaulted' AND NOT ({folded('a.val')} <=> {folded('p.val')}),"
        f" {adopt('p', 'displaced category default')}, a)"))
    body = let("pr", f"coalesce({proposed}, {NO_ATTRIBUTES})", let("at", "attributes", (
        f"array_sort(concat(transform(at, a -> {held}),"
        f" transform(filter(pr, p -> NOT exists(at, a -> a.key = p.key)), p -> {adopt('p', 'gap fill')})),"
        " (a, b) -> CASE WHEN a.grp < b.grp THEN -1 WHEN a.grp > b.grp THEN 1 WHEN a.conf > b.conf THEN -1"
        " WHEN a.conf < b.conf THEN 1 WHEN a.label < b.label THEN -1 WHEN a.label > b.label THEN 1 ELSE 0 END)")))
    verdict = ("CASE WHEN NOT exists(at, a -> a.key = p.key) THEN 'gap_filled'"
               f" WHEN {folded('a0.val')} <=> {folded('p.val')} THEN NULL WHEN a0.prov = 'defaulted' THEN 'displaced_default'"
               f" WHEN a0.prov IN {in_list(fixed.PROTECTED)} THEN 'refused' END")
    decided = let("pr", f"coalesce({proposed}, {NO_ATTRIBUTES})", let("at", "attributes", let("ac", (
        "filter(transform(pr, p -> named_struct('key', p.key, 'action', "
        + let("a0", "get(filter(at, a -> a.key = p.key), 0)", verdict) + ")), d -> d.action IS NOT NULL)"),
        "named_struct('actions', ac, 'gap_filled', size(filter(ac, d -> d.action = 'gap_filled')),"
        " 'displaced_defaults', size(filter(ac, d -> d.action = 'displaced_default')),"
        " 'refused', size(filter(ac, d -> d.action = 'refused')))")))
    gated = stage(records, attributes=body, gate=decided).drop("issues", "missing", "readiness")
    return score(validate(gated, standards=False))
