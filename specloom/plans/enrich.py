"""The whole enrichment as one DataFrame transformation.

products -> normalise -> classify -> extract -> infer -> reconcile -> copy ->
formats -> validate -> score.  One row per product from end to end: the plan holds
one broadcast join (category schema) and no exchange, so it scales with the number
of input splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import fixed
from ..operators.classify import classify
from ..operators.content import compliance, copywrite
from ..operators.extract import extract
from ..operators.infer import infer
from ..operators.normalize import normalize
from ..operators.reconcile import reconcile
from ..operators.rules import validate
from ..operators.score import score
from ..operators.vocabulary import apply_to_records, fold_text
from .taxonomy import Taxonomy


def governed(taxonomy: Taxonomy, lov: dict) -> bool:
    """Whether any category's path has a list of values."""
    paths = {fold_text(p) for p in lov}
    return any(fold_text(" > ".join(c["path"])) in paths for c in taxonomy.categories)


def resolve(spark: SparkSession, products: DataFrame, taxonomy: Taxonomy | None = None) -> DataFrame:
    """Records with settled attributes, before copy and validation."""
    taxonomy = taxonomy or Taxonomy()
    return reconcile(infer(extract(classify(normalize(products), taxonomy), spark, taxonomy)))


def enrich(spark: SparkSession, products: DataFrame, taxonomy: Taxonomy | None = None,
           formats: bool = True, lov: dict | None = None) -> DataFrame:
    """Full records.  ``formats=False`` leaves the fitted commerce fields out.

    A list of values is applied before copy is written, when it governs any category.
    """
    taxonomy, lov = taxonomy or Taxonomy(), lov or fixed.LOV
    records = resolve(spark, products, taxonomy)
    if governed(taxonomy, lov):
        records = apply_to_records(records, spark, lov)
    records = copywrite(records)
    if formats:
        records = compliance(records)
    return score(validate(records))
