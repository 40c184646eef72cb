"""Similarity of distinct strings as a join.

The sequence ratio of two strings is at most twice their common characters over both lengths, so
strings that reach a cutoff share many characters.  Each string is a set of tokens, a character with
its number of occurrence, and a prefix of it in rare-first order is enough: two strings that reach
the cutoff share a token of their prefixes.  Pairs that meet are tested by the exact number of common
characters, and only what is left, distinct pairs of distinct strings, goes to the sequence ratio.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed
from ..functions.similarity import sequence_ratio
from ..functions.text import in_list, let, q, slug

#: Characters from frequent to rare; others are rarer than all of these.
FREQUENT = " etaionsrlcdmupghbyfvkwxzjq0123456789"


def tokens_sql(s: str) -> str:
    """Characters of a string with their number of occurrence, the rarest first."""
    token = ("named_struct('k', -size(filter(slice(cs, 1, i + 1), d -> d = c)),"
             f" 'p', IF(instr({q(FREQUENT)}, c) = 0, -{len(FREQUENT) + 1}, -instr({q(FREQUENT)}, c)), 'c', c)")
    return let("cs", f"filter(split({s}, ''), c -> c <> '')", f"transform(array_sort(transform(cs, (c, i) -> {token})), t -> concat(t.c, -t.k))")


def _indexed(strings: DataFrame, by: list[str], column: str, cutoff: float) -> DataFrame:
    """One row for each token of each string's prefix."""
    # A partner has a length of at least cutoff / (2 - cutoff) of the string's and shares that many characters.
    least = f"CAST(ceil({cutoff / (2 - cutoff)}D * size(t) - 1e-9D) AS INT)"
    return (strings.select(*by, column).distinct().withColumn("t", F.expr(tokens_sql(column)))
            .select(*by, column, F.explode(F.expr(f"slice(t, 1, size(t) - {least} + 1)")).alias("token")))


def similar_pairs(probes: DataFrame, names: DataFrame, by: list[str], cutoff: float) -> DataFrame:
    """(by, probe, name, bound): pairs with equal ``by`` whose common characters leave a ratio of ``cutoff`` possible."""
    length = lambda x: F.length(x)
    common = f"size(array_intersect({tokens_sql('probe')}, {tokens_sql('name')}))"
    met = (_indexed(probes, by, "probe", cutoff).join(_indexed(names, by, "name", cutoff), [*by, "token"])
           .where(2 * F.least(length("probe"), length("name")) >= (cutoff - 1e-9) * (length("probe") + length("name")))
           .select(*by, "probe", "name").distinct())
    return met.withColumn("bound", F.expr(f"2D * {common} / (length(probe) + length(name))")).where(f"bound >= {cutoff - 1e-9}D")


def nearest_names(probes: DataFrame, names: DataFrame, by: list[str], cutoff: float) -> DataFrame:
    """V3: (by, probe, near) for each probe, ``near`` the most similar name of at least ``cutoff`` or null; of equals the last in order."""
    pairs = similar_pairs(probes, names, by, cutoff).withColumn("ratio", sequence_ratio("name", "probe")).where(f"ratio >= {cutoff}D")
    best = pairs.groupBy(*by, "probe").agg(F.max(F.struct("ratio", "name")).alias("b")).select(*by, "probe", F.col("b.name").alias("near"))
    return probes.select(*by, "probe").distinct().join(best, [*by, "probe"], "left")


def _words(s: str) -> str:
    return f"array_distinct(filter(split({s}, ' '), w -> w <> '' AND w NOT IN {in_list(fixed.KEY_STOP_WORDS)}))"


def key_scores(keys: DataFrame, names: DataFrame, threshold: float = fixed.MAP_THRESHOLD) -> DataFrame:
    """(key, code, j, s) of every attribute that a supplier key reaches with ``threshold`` or more.

    ``keys`` has slugs in a column ``key``; ``names`` has (code, j, name).  Equal names score 1; shared words give
    0.55 and up to 0.4 more for their share; otherwise 0.9 times the sequence ratio counts.
    """
    keys = keys.where("key <> ''").select("key").distinct()
    names = names.withColumn("name", F.expr(slug("name"))).where("name <> ''").distinct()
    distinct = names.select("name").distinct()
    side = lambda df, c: df.select(c, F.expr(_words(c)).alias("ws")).withColumns({"n": F.size("ws"), "w": F.explode("ws")}).drop("ws")
    by_word = (side(keys, "key").toDF("key", "n_k", "w").join(side(distinct, "name").toDF("name", "n_n", "w"), "w")
               .groupBy("key", "name", "n_k", "n_n").agg(F.count("*").alias("both"))
               .select("key", "name", F.expr("0.55D + 0.4D * (CAST(both AS DOUBLE) / (n_k + n_n - both))").alias("s")))
    near = similar_pairs(keys.withColumnRenamed("key", "probe"), distinct, [], threshold / 0.9)
    by_ratio = near.where("probe <> name").select(F.col("probe").alias("key"), "name", (sequence_ratio("probe", "name") * 0.9).alias("s"))
    equal = keys.join(distinct, F.col("key") == F.col("name")).select("key", "name", F.lit(1.0).alias("s"))
    best = by_word.union(by_ratio).union(equal).groupBy("key", "name").agg(F.max("s").alias("s")).where(f"s >= {threshold}D")
    return best.join(names, "name").groupBy("key", "code", "j").agg(F.max("s").alias("s"))


def attribute_names(spark: SparkSession, names_by_code: dict[str, list[tuple[str, ...]]]) -> DataFrame:
    """(code, j, name) of a taxonomy's attributes."""
    rows = [(code, j, n) for code, attributes in names_by_code.items() for j, names in enumerate(attributes) for n in names]
    return spark.createDataFrame(rows, "code string, j int, name string")
