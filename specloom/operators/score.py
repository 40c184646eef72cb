"""Readiness: completeness, confidence, validity and the verdict (K1-K4)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import fixed
from ..functions.stage import stage
from ..functions.text import let, q
from .rules import integrity

_NOTES = {
    "no_category": "No category could be resolved, so no attribute schema or validation rules apply."
                   " Supply a product type or a fuller description.",
    "no_schema": "The category carries no attribute schema, so there is nothing to validate and no"
                 " specification to publish. Enrich the category before releasing products under it.",
    "publish": "Record meets the publication threshold.",
    "weak": "Confidence and completeness are below the auto-publish threshold.",
    "empty": "No input supplied.",
}


def completeness_sql(filled: str, defined: str, required: str, missing: str) -> str:
    """K1: share of attributes filled, required ones weighing 70 %."""
    base = f"least({filled} / greatest({defined}, 1), 1D) * 100D"
    return (f"CASE WHEN {required} > 0 THEN 0.7D * (({required} - {missing}) / {required}) * 100D"
            f" + 0.3D * ({base}) ELSE {base} END")


def validity_sql(errors: str, warnings: str) -> str:
    """K3"""
    return f"greatest(0D, 100D - 22D * {errors} - 6D * {warnings})"


def score(df: DataFrame) -> DataFrame:
    """K1-K4 on validated records; adds ``readiness``.

    Rows flagged ``is_empty`` score zero and are blocked (N6).
    """
    counts = (
        "named_struct("
        "'filled', size(filter(attributes, a -> coalesce(a.val, '') <> '')),"
        " 'defined', coalesce(size(schema.attrs), 0), 'required', coalesce(size(schema.required), 0),"
        " 'missing', size(missing),"
        " 'errors', size(filter(issues, i -> i.severity = 'error')),"
        " 'warnings', size(filter(issues, i -> i.severity = 'warning')),"
        f" 'integrity', transform({integrity()}, i -> i.code),"
        " 'defaulted', size(filter(attributes, a -> a.prov = 'defaulted')),"
        # K2: provenance-weighted mean confidence
        " 'confidence', coalesce(100D * try_divide(aggregate(attributes, 0D, (s, a) -> s + a.conf * (a.rank / 6D)),"
        " aggregate(attributes, 0D, (s, a) -> s + a.rank / 6D)), 0D))")
    verdict = ("CASE WHEN schema IS NULL THEN 'blocked' WHEN n.defined = 0 THEN 'blocked'"
               " WHEN n.errors > 0 THEN 'blocked' WHEN size(n.integrity) > 0 THEN 'review'"
               f" WHEN ov >= {fixed.PUBLISH_THRESHOLD} AND n.missing = 0 THEN 'publish' ELSE 'review' END")
    notes = (
        "filter(array("
        f"CASE WHEN schema IS NULL THEN {q(_NOTES['no_category'])}"
        f" WHEN n.defined = 0 THEN {q(_NOTES['no_schema'])}"
        " WHEN n.errors > 0 THEN concat(n.errors, ' blocking error(s) must be resolved before publication.')"
        " WHEN size(n.integrity) > 0 THEN concat(size(n.integrity), ' data-integrity warning(s) require sign-off: ',"
        " array_join(slice(n.integrity, 1, 3), ', '), '.')"
        f" WHEN ov >= {fixed.PUBLISH_THRESHOLD} AND n.missing = 0 THEN {q(_NOTES['publish'])}"
        " WHEN n.missing > 0 THEN concat('Missing required field(s): ', array_join(missing, ', '), '.') END,"
        f" CASE WHEN schema IS NOT NULL AND n.defined > 0 AND n.errors = 0 AND size(n.integrity) = 0"
        f" AND ov < {fixed.PUBLISH_THRESHOLD} THEN {q(_NOTES['weak'])} END,"
        " CASE WHEN n.defaulted > 0 THEN concat(n.defaulted,"
        " ' value(s) are category defaults and carry no supplier backing.') END"
        "), x -> x IS NOT NULL)")
    body = let("n", counts, let(
        "cm", completeness_sql("n.filled", "n.defined", "n.required", "n.missing"), let(
            "vl", validity_sql("n.errors", "n.warnings"), let(
                "ov", "0.35D * cm + 0.30D * n.confidence + 0.35D * vl",
                "named_struct('overall', round(least(ov, 100D), 1), 'completeness', round(least(cm, 100D), 1),"
                f" 'confidence', round(least(n.confidence, 100D), 1), 'validity', round(vl, 1), 'verdict', {verdict},"
                f" 'missing_required', missing, 'notes', {notes})"))))
    empty = ("named_struct('overall', 0D, 'completeness', 0D, 'confidence', 0D, 'validity', 0D, 'verdict', 'blocked',"
             f" 'missing_required', CAST(array() AS ARRAY<STRING>), 'notes', array({q(_NOTES['empty'])}))")
    return stage(df, readiness=f"CASE WHEN is_empty THEN {empty} ELSE {body} END")
