"""Skip what has been enriched already (H1-H3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import q

SEP = "\x1f"
FIELDS = ["brand", "category_hint", "currency", "description", "free_text", "mpn", "name", "price", "sku",
          "source_document", "source_url"]


def _measured(text: str) -> str:
    """A text with its length in front, so that no two lists of texts are written alike; null is '-'."""
    return f"coalesce(concat(length({text}), ':', {text}), '-')"


def content_hash_sql(mode: str = "demo", fingerprint: str = "", model: str = "") -> str:
    """H1: address of a product's content; spec order and locators do not change it.

    ``model`` names the model whose answers the stored result holds, if any.
    """
    fields = ", ".join(f"coalesce(CAST({f} AS STRING), '')" for f in FIELDS)
    specs = f"array_join(array_sort(transform(coalesce(specs, array()), s -> concat({_measured('s.key')}, {_measured('s.value')}))), {q(SEP)})"
    tail = (f", {q('taxonomy:' + fingerprint)}" if fingerprint else "") + (f", {q('model:' + model)}" if model else "")
    return f"left(sha2(concat_ws({q(SEP)}, {q(mode)}, {fields}, {specs}{tail}), 256), 32)"


def with_hash(products: DataFrame, mode: str = "demo", fingerprint: str = "", model: str = "") -> DataFrame:
    return products.withColumn("content_hash", F.expr(content_hash_sql(mode, fingerprint, model)))


def taxonomy_fingerprint(learned: DataFrame) -> DataFrame:
    """H2: short digest of the learned categories in force; empty when there are none.

    ``learned(code, version)`` is configuration, one row per category.
    """
    return learned.agg(F.expr(
        "coalesce(left(sha2(nullif(array_join(array_sort(collect_list(concat(code, ':', coalesce(version, '')))), '|'), ''),"
        " 256), 8), '')").alias("fingerprint"))


def unseen(products: DataFrame, stored: DataFrame) -> DataFrame:
    """H1: products whose content has no stored result; one per distinct content.

    Duplicates collapse before the anti-join, so a hot repeated record is one row there.
    """
    first = products.groupBy("content_hash").agg(F.min("id").alias("id"))
    return first.join(stored.select("content_hash").distinct(), "content_hash", "left_anti")


def lookup(products: DataFrame, own: DataFrame, bundled: DataFrame) -> DataFrame:
    """H3: own result first, then the bundled one.

    ``own`` is keyed by ``content_hash``, ``bundled`` by ``bundled_hash`` (the address
    without the taxonomy fingerprint), both with a ``result`` column.  An address stored more
    than once counts once, with its smallest result.
    """
    o = own.groupBy("content_hash").agg(F.min("result").alias("_own"))
    b = bundled.groupBy("bundled_hash").agg(F.min("result").alias("_bundled"))
    return (products.join(o, "content_hash", "left").join(b, "bundled_hash", "left")
            .withColumn("result", F.coalesce("_own", "_bundled"))
            .withColumn("layer", F.when(F.col("_own").isNotNull(), "own").when(F.col("_bundled").isNotNull(), "bundled")
                        .otherwise("miss")).drop("_own", "_bundled"))
