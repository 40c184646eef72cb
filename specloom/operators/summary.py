"""Batch summary, stage ledger and record assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def run_summary(records: DataFrame) -> DataFrame:
    """B1: one row of totals; every measure is a partial aggregate."""
    size = F.size("attributes")
    supplied = F.expr("size(filter(attributes, a -> a.prov IN ('supplied', 'parsed')))")
    verdict = F.col("readiness.verdict")
    return records.agg(
        F.count("*").alias("products"),
        F.count_if(verdict == "publish").alias("publish"), F.count_if(verdict == "review").alias("review"),
        F.count_if(verdict == "blocked").alias("blocked"),
        F.round(F.avg("readiness.overall"), 1).alias("avg_readiness"),
        F.round(F.sum(size) / F.greatest(F.count("*"), F.lit(1)), 1).alias("avg_attributes"),
        (F.sum(size) - F.sum(supplied)).alias("attributes_added"),
        F.sum(F.size("issues")).alias("issues"))


def stage_ledger(records: DataFrame) -> DataFrame:
    """Per record and stage, how many attributes it held and which keys it added or changed."""
    def keys(c):
        return f"array_join(transform({c}, a -> a.key), ',')"
    rows = ("array("
            "named_struct('stage', 'normalize', 'n', size(filter(array(identity.mpn, identity.sku, identity.brand,"
            " identity.manufacturer, identity.brand_country, identity.gtin), x -> x IS NOT NULL)), 'added', '', 'changed', ''),"
            "named_struct('stage', 'classify', 'n', IF(category IS NULL, 0, 1), 'added', coalesce(category.code, ''), 'changed', ''),"
            f"named_struct('stage', 'extract', 'n', size(extracted), 'added', {keys('extracted')}, 'changed', ''),"
            f"named_struct('stage', 'infer', 'n', size(inferred), 'added', {keys('inferred')}, 'changed', ''),"
            "named_struct('stage', 'reconcile', 'n', size(attributes), 'added', '',"
            " 'changed', array_join(transform(conflicts, c -> split(c, ':')[0]), ',')),"
            "named_struct('stage', 'validate', 'n', size(issues), 'added', '', 'changed', ''),"
            "named_struct('stage', 'score', 'n', 1, 'added', readiness.verdict, 'changed', ''))")
    return records.select("id", F.inline_outer(F.expr(rows)))


def assemble(products: DataFrame, attributes: DataFrame, issues: DataFrame) -> DataFrame:
    """Nested records from long tables.

    Long tables of settled attributes and issues hold a schema-bounded number of
    rows per product, so the arrays stay small.
    """
    a = attributes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(
        *[c for c in attributes.columns if c != "id"]))).alias("attributes"))
    i = issues.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(
        *[c for c in issues.columns if c != "id"]))).alias("issues"))
    return products.join(a, "id", "left").join(i, "id", "left")


def explode_attributes(records: DataFrame) -> DataFrame:
    """Settled attributes as a long table."""
    return (records.select("id", F.posexplode_outer("attributes").alias("pos", "a"))
            .where("a IS NOT NULL").select("id", "pos", "a.*"))


def explode_issues(records: DataFrame) -> DataFrame:
    return (records.select("id", F.posexplode_outer("issues").alias("pos", "i"))
            .where("i IS NOT NULL").select("id", "pos", "i.*"))
