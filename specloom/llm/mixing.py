"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Every source asks for a share of the budget in proportion to its weight.  A source whose share
exceeds ``max_epochs`` times its size is clamped there and the excess is dealt out again among
the rest, until no share is above its cap.  A source then takes whole repetitions of all its
documents and a last, fractional one: its documents in seeded order until the target is met,
the document at the edge with its first words only.

The seeded order is cut by block: sizes are summed by (source, first hex digits of the order
key), so only the one block of a source that holds the edge is sorted, and a source with a third
of all rows needs no larger task than any other.

Defined results: null text has size 0; null sources form one source, last in order; equal rows
are interchangeable; an empty table gives an empty mix.  Columns of the input other than the
text and source may have any name; the columns that ``mix`` adds replace columns of the same name,
``mixed_rows`` replaces none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window

from .shared import aside, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order key that name a block.
BLOCK_DIGITS = 3
#: Source tables up to this many rows are broadcast.
BROADCAST_SOURCES = 100_000
ADDED = ["size", "source_size", "target", "taken"]


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int, *columns: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def water_fill(sizes: list[int], weights: list[float], share: float, max_epochs: float) -> list[float]:
    """Targets of sources with the given sizes: weighted shares of share * total, none above max_epochs * size."""
    caps = [float(max_epochs * s) for s in sizes]
    budget, free = share * sum(sizes), set(range(len(sizes)))
    while free:
        level = (budget - sum(c for i, c in enumerate(caps) if i not in free)) / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] > caps[i]}
        if not over:
            return [level * weights[i] if i in free else caps[i] for i in range(len(sizes))]
        free -= over
    return caps


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 17,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes, repeats counted).

    ``weights`` repeat over the sources in code point order, null last.  The table of sources
    (not of documents) is settled on the driver.
    """
    spark = docs.sparkSession
    key = order_key(seed, F.col(id_col), F.col(text_col))
    base = docs.drop(*ADDED).withColumns({"size": size_of(F.col(text_col)), "__key": key,
                                          "__block": F.substring(key, 1, BLOCK_DIGITS)})
    blocks = base.groupBy(F.col(source_col).alias("__s"), "__block").agg(F.sum("size").alias("__sum"))
    blocks = stored(blocks)
    totals = sorted(((r[0], r[1]) for r in blocks.groupBy("__s").agg(F.sum("__sum")).collect()),
                    key=lambda r: (r[0] is None, r[0] or ""))
    targets = water_fill([n for _, n in totals], [float(weights[i % len(weights)]) for i in range(len(totals))], share, max_epochs)
    rows = []
    for (source, n), target in zip(totals, targets):
        goal = min(int(target + 0.5), int(max_epochs * n))
        whole, rest = divmod(goal, n) if n else (0, 0)
        rows.append((source, n, target, whole, rest))
    source_type = docs.schema[source_col].dataType
    plan = spark.createDataFrame(rows, T.StructType([
        T.StructField("__s", source_type), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
        T.StructField("__whole", T.LongType()), T.StructField("__rest", T.LongType())]))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy("__s").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = (blocks.withColumn("__before", before).join(plan.select(F.col("__s").alias("__t"), "__rest"), F.col("__s").eqNullSafe(F.col("__t")))
             .where("__before < __rest AND __before + __sum >= __rest").groupBy("__s").agg(F.min(F.struct("__block", "__before")).alias("__edge")))
    plan = (plan.join(edges.withColumnRenamed("__s", "__u"), F.col("__s").eqNullSafe(F.col("__u")), "left").drop("__u"))
    if len(rows) <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    placed = base.join(plan, F.col(source_col).eqNullSafe(F.col("__s")), "left")
    at_edge = F.coalesce(F.col("__block") == F.col("__edge.__block"), F.lit(False))
    sure = placed.where(~at_edge).withColumn("__part", F.when(F.col("__block") < F.col("__edge.__block"), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy(source_col).orderBy("__key", id_col).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__edge.__before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    edge = placed.where(at_edge).withColumn("__part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - start)))
    return (sure.unionByName(edge).withColumn("taken", (F.col("__whole") * F.col("size") + F.col("__part")).cast("long"))
            .select(*[c for c in docs.columns if c not in ADDED], *ADDED))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: one row per repetition, columns as in ``docs``, whatever their names.

    A fractional repetition holds the document's first words, joined by single blanks.
    Documents without words carry no weight and are left as they are, once.
    """
    own = dict(id_col=id_col, text_col=text_col, source_col=source_col)
    return aside(docs, [*own.values(), "n_chars"], lambda df: _repeated(df, text_col, **options, **{k: v for k, v in own.items() if k != "text_col"}))


def _repeated(docs: DataFrame, text_col: str, **options) -> DataFrame:
    mixed = mix(docs, text_col=text_col, **options)
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(1))
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    texts = F.concat(F.array_repeat(F.lit(False), whole.cast("int")), F.when(part > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    rows = mixed.select("*", F.explode(texts).alias("__short"), part.alias("__n"))
    first_words = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.col("__n").cast("int")), " ")
    text = F.when(F.col("__short"), first_words).otherwise(F.col(text_col))
    out = rows.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__short"), F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(c) for c in docs.columns])
