"""Stored proposals and the stream that knows the taxonomy."""

import os

import pytest
from pyspark.sql import functions as F

from specloom.operators import incremental as H
from specloom.operators.proposal_store import ProposalStore
from specloom.streaming.reenrich import changed_arrivals

DDL = "id string, status string, noun string, keywords array<string>"


def rows(store, version=None):
    return {r["id"]: (r["status"], r["noun"]) for r in store.read(version).collect()}


def frame(spark, *items):
    return spark.createDataFrame([(i, "pending", n, [n]) for i, n in items], DDL)


def test_merges_decisions_and_versions(spark, tmp_path):
    store = ProposalStore(spark, str(tmp_path / "store"), DDL)
    assert rows(store) == {} and store.version() == 0 and store.merge(frame(spark)) == 0
    assert store.merge(frame(spark, ("a", "x"), ("b", "x"), ("a", "w"))) == 1
    assert store.decide(spark.createDataFrame([("b", "reject"), ("zz", "approve")], "id string, decision string")) == 2
    assert store.merge(frame(spark, ("a", "y"), ("b", "y"), ("c", "y"))) == 3
    assert rows(store) == {"a": ("pending", "y"), "b": ("rejected", "x"), "c": ("pending", "y")}
    assert rows(store, 1) == {"a": ("pending", "w"), "b": ("pending", "x")}
    with pytest.raises(ValueError):
        store.read(9)


def test_a_failed_write_is_invisible(spark, tmp_path):
    store = ProposalStore(spark, str(tmp_path / "store"), DDL)
    store.merge(frame(spark, ("a", "x")))
    broken = frame(spark, ("b", "y"), ("c", "z")).withColumn("noun", F.when(F.col("id") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("noun")))
    with pytest.raises(Exception, match="lost"):
        store.merge(broken)
    assert rows(store) == {"a": ("pending", "x")} and store.version() == 1
    # A snapshot that no manifest names is not read either.
    frame(spark, ("q", "q")).write.parquet(str(tmp_path / "store" / "snapshot-0000000002-half"))
    assert rows(store) == {"a": ("pending", "x")}
    # Two writers that started from one version: the second one's manifest row is refused.
    other = ProposalStore(spark, store.path, DDL)
    other.version = lambda: 0
    with pytest.raises(Exception, match="already exists"):
        other.merge(frame(spark, ("z", "z")))
    assert store.merge(frame(spark, ("b", "y"))) == 2 and rows(store) == {"a": ("pending", "x"), "b": ("pending", "y")}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = ProposalStore(spark, str(tmp_path / "store"), DDL)
    assert store.merge(frame(spark, ("a", "x")), "s", 0) == 1
    store.decide(spark.createDataFrame([("a", "approve")], "id string, decision string"))
    assert store.merge(frame(spark, ("a", "again"), ("new", "again")), "s", 0) == 2
    assert rows(store) == {"a": ("approved", "x")}
    assert store.merge(frame(spark, ("a", "y"), ("b", "y")), "s", 1) == 3
    assert rows(store) == {"a": ("approved", "x"), "b": ("pending", "y")}


def test_a_stream_of_proposals_survives_a_lost_checkpoint(spark, tmp_path):
    source = tmp_path / "in"
    frame(spark, ("a", "x"), ("b", "x")).coalesce(1).write.parquet(str(source / "1"))
    store = ProposalStore(spark, str(tmp_path / "store"), DDL)
    stream = lambda: spark.readStream.schema(DDL).parquet(str(source / "*"))
    store.follow(stream(), str(tmp_path / "c1")).awaitTermination()
    assert rows(store) == {"a": ("pending", "x"), "b": ("pending", "x")}
    store.decide(spark.createDataFrame([("a", "approve")], "id string, decision string"))
    store.follow(stream(), str(tmp_path / "c2")).awaitTermination()  # batch 0 once more
    assert store.version() == 2 and rows(store)["a"] == ("approved", "x")
    frame(spark, ("b", "y")).coalesce(1).write.parquet(str(source / "2"))
    store.follow(stream(), str(tmp_path / "c2")).awaitTermination()
    assert store.version() == 3 and rows(store) == {"a": ("approved", "x"), "b": ("pending", "y")}


def test_a_new_fingerprint_lets_a_product_through_again(spark, tmp_path, product):
    from conftest import PRODUCT_DDL
    prints = [H.taxonomy_fingerprint(spark.createDataFrame(c, "code string, version string")).first()[0] for c in ([], [("99000001", "1")], [("99000001", "1"), ("99000002", "1")])]
    assert len(set(prints)) == 3
    # With a time to live Spark goes on with empty batches, also after all that was available is read.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    ddl = PRODUCT_DDL + ", arrived_at timestamp, fingerprint string"

    def arrive(k, items, fingerprint):
        made = [dict(product(i, name=name), arrived_at=None, fingerprint=fingerprint) for i, name in items]
        df = spark.createDataFrame(made, ddl).withColumn("arrived_at", F.lit(f"2024-01-0{9 - k}").cast("timestamp"))  # each batch older than the one before
        df.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in" / "*"))
        query = (changed_arrivals(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
                 .outputMode("append").trigger(availableNow=True).start())
        assert query.awaitTermination(120)
        return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) if os.path.exists(tmp_path / "out") else []
    assert arrive(1, [(1, "valve"), (2, "valve"), (3, "pump")], prints[0]) == [1, 3]
    assert arrive(2, [(4, "valve"), (5, "hose")], prints[0]) == [1, 3, 5]
    assert arrive(3, [(6, "valve"), (7, "valve"), (8, "hose")], prints[1]) == [1, 3, 5, 6, 8]  # a category was approved
    assert arrive(4, [(9, "valve")], prints[1]) == [1, 3, 5, 6, 8]
    assert arrive(5, [(10, "valve"), (11, "pump")], prints[2]) == [1, 3, 5, 6, 8, 10, 11]
