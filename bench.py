"""Headline queries on the benchmark tables; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the data and
the cores.  ``enrich_lineitem`` runs the whole chain over one supplier record per order
line, which is the shape of the published products-per-second figures.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

NAMED = ["reconcile_claims", "record_confidence", "measure_parse", "canonical_brand", "identity", "classify", "extracted_attributes",
         "engineering_rules", "readiness", "vocabulary_coverage", "gate_actions", "page_budget", "merge_page_specs", "document_specs",
         "html_specs", "content_hash", "inferred_types", "recovery", "written_formats", "enriched_products"]


def session() -> SparkSession:
    return (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
            .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.adaptive.enabled", "true")
            .config("spark.driver.memory", "20g").config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def lineitem_products(spark: SparkSession) -> DataFrame:
    """One product record per order line, spread over the cores."""
    from specloom.plans.testbed import products
    from specloom.functions.stage import spread
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select(
        F.col("l_partkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"))
    base = products(spark, SF_DIR)
    return (spread(lines).join(base, F.col("l_partkey") == F.col("id"))
            .drop("l_partkey", "id").withColumnRenamed("line_id", "id"))


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    from specloom.catalog import load
    from specloom.plans.enrich import enrich

    queries, times = load()[0], {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in NAMED:
        start = time.perf_counter()
        run(queries[name](spark, SF_DIR))
        times[name] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    products = lineitem_products(spark)
    n = products.count()
    records = enrich(spark, products)
    run(records.select("id", "category", "attributes", "issues", "readiness", "content", "compliance"))
    times["enrich_lineitem"] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF_DIR.rstrip("/")), "products_per_second": round(n / times["enrich_lineitem"], 1),
                      "products": n}))


if __name__ == "__main__":
    main()
