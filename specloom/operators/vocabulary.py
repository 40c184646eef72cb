"""Controlled vocabulary: accept, map or refuse a value (V1-V8)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed
from ..functions.similarity import suggest_each
from ..functions.stage import stage
from ..functions.text import let
from .nearby import nearest_names
from .records import rebuilt

# Beyond this many vocabulary rows the side is joined without a broadcast.
BROADCAST_ROWS = 200_000


def fold(x: str) -> str:
    """Case, spacing and separator noise removed, for matching only."""
    return f"trim(regexp_replace(lower(trim({x})), '[\\\\s_\\\\-/,.()]+', ' '))"


def lov_rows(lov: dict | None = None) -> list[tuple]:
    return [(path, a["key"], a["label"], a.get("sequence", 10_000), a["filterable"], pos, v)
            for path, attrs in (lov or fixed.LOV).items() for a in attrs
            for pos, v in enumerate(a["values"])]


def lov_df(spark: SparkSession, lov: dict | None = None) -> DataFrame:
    """V1: ``dim_lov``, one row per permitted value."""
    return spark.createDataFrame(
        lov_rows(lov), "classpath string, key string, label string, sequence int,"
                       " filterable boolean, pos int, value string")


def synonym_df(spark: SparkSession, lov: dict | None = None) -> DataFrame:
    """V1: ``dim_lov_synonym``, many spellings to one permitted value."""
    rows = [(path, a["key"], s, v) for path, attrs in (lov or fixed.LOV).items()
            for a in attrs for s, v in a["synonyms"].items()]
    return spark.createDataFrame(rows, "classpath string, key string, synonym string, canonical string")


def read_lov(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """V1: vocabularies from JSON files; a classpath's own entry wins over an alias."""
    schema = ("source string, classpaths map<string, struct<applies_to:array<string>,"
              "attributes:array<struct<key:string,label:string,sequence:int,filterable:boolean,"
              "values:array<string>,synonyms:map<string,string>>>>>")
    doc = spark.read.schema(schema).json(path, multiLine=True)
    own = doc.select(F.explode("classpaths").alias("classpath", "spec"))
    paths = own.select("classpath", "spec", F.expr(
        "explode(concat(array(named_struct('p', classpath, 'tier', 0)),"
        " transform(coalesce(spec.applies_to, array()), a -> named_struct('p', a, 'tier', 1))))").alias("e"))
    best = (paths.groupBy(F.expr(fold("e.p")).alias("folded"))
            .agg(F.min_by("spec", F.struct("e.tier", "classpath")).alias("spec"),
                 F.min_by("e.p", F.struct("e.tier", "classpath")).alias("classpath")))
    attrs = best.select("classpath", F.explode("spec.attributes").alias("a"))
    values = attrs.select("classpath", "a.key", "a.label",
                          F.coalesce("a.sequence", F.lit(10_000)).alias("sequence"),
                          F.coalesce("a.filterable", F.lit(False)).alias("filterable"),
                          F.posexplode("a.values").alias("pos", "value"))
    synonyms = attrs.select("classpath", "a.key", F.explode("a.synonyms").alias("synonym", "canonical"))
    return values, synonyms


def _side(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Broadcast a vocabulary side only after its size has been checked.

    A side derived from ``of`` by grouping or filtering is no larger than ``of``, so the
    source is counted instead (vocabularies are small tables; the count is one short job).
    """
    return F.broadcast(df) if (of if of is not None else df).count() <= BROADCAST_ROWS else df


def resolve(values: DataFrame, lov: DataFrame, synonyms: DataFrame) -> DataFrame:
    """V2: exact, then case, then synonym, then folded match.

    ``values(id, classpath, key, value, ...)``.  Adds ``approved`` (the permitted
    value), ``method`` and ``checked`` (false when no list applies).
    """
    cp = F.expr(fold("classpath"))
    v = values.withColumns({"_cp": cp, "_v": F.trim("value"), "_lv": F.lower(F.trim("value")),
                            "_fv": F.expr(fold("value"))})
    base = lov.withColumn("_cp", cp)
    small = lov.count() <= BROADCAST_ROWS and synonyms.count() <= BROADCAST_ROWS

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    # dict semantics of the lookups: a later value replaces an earlier one with the same key
    def keyed(expr: str, name: str) -> DataFrame:
        return side(base.groupBy("_cp", "key", F.expr(expr).alias(name))
                    .agg(F.max_by("value", "pos").alias(name + "_hit")))
    covered = side(base.select("_cp", "key").distinct().withColumn("_cov", F.lit(True)))
    syn = (synonyms.withColumn("_cp", cp).withColumn("_fv", F.expr(fold("synonym")))
           .join(base.select("_cp", "key", F.col("value").alias("canonical")),
                 ["_cp", "key", "canonical"], "left_semi")
           .groupBy("_cp", "key", "_fv").agg(F.max("canonical").alias("_syn_hit")))
    out = (v.join(covered, ["_cp", "key"], "left")
           .join(keyed("value", "_v"), ["_cp", "key", "_v"], "left")
           .join(keyed("lower(value)", "_lv"), ["_cp", "key", "_lv"], "left")
           .join(side(syn), ["_cp", "key", "_fv"], "left")
           .join(keyed(fold("value"), "_fv").withColumnRenamed("_fv_hit", "_fold_hit"),
                 ["_cp", "key", "_fv"], "left"))
    checked = F.col("_cov").isNotNull() & (F.coalesce("_v", F.lit("")) != "")
    return (out.withColumn("checked", checked)
            .withColumn("approved", F.when(checked, F.coalesce("_v_hit", "_lv_hit", "_syn_hit", "_fold_hit")))
            .withColumn("method", F.when(~checked, F.lit(None).cast("string"))
                        .when(F.col("_v_hit").isNotNull(), "exact").when(F.col("_lv_hit").isNotNull(), "case")
                        .when(F.col("_syn_hit").isNotNull(), "synonym")
                        .when(F.col("_fold_hit").isNotNull(), "folded"))
            .drop("_cp", "_v", "_lv", "_fv", "_cov", "_v_hit", "_lv_hit", "_syn_hit", "_fold_hit"))


def suggestions(resolved: DataFrame, lov: DataFrame) -> DataFrame:
    """V3: a near miss for each distinct refused value; offered, never applied.

    Refused and permitted values meet in an index of their characters; a value's list is never gathered.
    """
    cp = F.expr(fold("classpath")).alias("_cp")
    refused = resolved.where("checked AND approved IS NULL").select(cp, "key", F.trim("value").alias("probe")).distinct()
    permitted = lov.select(cp, "key", F.col("value").alias("name")).distinct()
    listed = refused.join(permitted.select("_cp", "key").distinct(), ["_cp", "key"], "left_semi")
    return (nearest_names(listed, permitted, ["_cp", "key"], fixed.SUGGEST_THRESHOLD)
            .select(F.col("_cp").alias("folded_classpath"), "key", F.col("probe").alias("value"), F.col("near").alias("suggestion")))


def apply(resolved: DataFrame) -> DataFrame:
    """V4: mapped values rewritten with the mapping noted in the evidence; refused kept."""
    mapped = "approved IS NOT NULL AND method <> 'exact'"
    return resolved.withColumns({
        "evidence": F.expr(f"CASE WHEN {mapped} THEN concat(evidence, ' Normalized to the approved value \\'',"
                           " approved, '\\' from \\'', trim(value), '\\' (', method, ' match in the list of values).')"
                           " ELSE evidence END"),
        "original": F.expr("trim(value)"),
        "value": F.expr(f"CASE WHEN {mapped} THEN approved ELSE value END"),
        "outcome": F.expr("CASE WHEN NOT checked THEN 'not_covered' WHEN approved IS NULL THEN 'refused'"
                          " WHEN method = 'exact' THEN 'approved' ELSE 'mapped' END"),
    })


def violations(applied: DataFrame, labels: DataFrame) -> DataFrame:
    """V4: LOV_VIOLATION warnings for refused values."""
    names = _side(labels.select("key", "label").distinct(), labels)
    return (applied.where("outcome = 'refused'").join(names, "key", "left")
            .select("id", F.lit("LOV_VIOLATION").alias("code"), F.lit("warning").alias("severity"),
                    F.col("key").alias("field"),
                    F.expr("concat('\\'', original, '\\' is not an approved value for ',"
                           " coalesce(label, key), ' in this classpath.')").alias("message")))


def ledger(applied: DataFrame) -> DataFrame:
    """V4: every rewrite, so none of them is silent."""
    return applied.where("outcome = 'mapped'").select(
        "id", "key", F.col("original").alias("from_value"), F.col("value").alias("to_value"), "method")


def sequence(lov: DataFrame) -> DataFrame:
    """V5: display order of each classpath's attributes."""
    return lov.groupBy("classpath", "key").agg(F.min("sequence").alias("sequence"))


def in_sequence(attributes: DataFrame, lov: DataFrame) -> DataFrame:
    """V5: attributes with the list's order; unlisted ones after it."""
    order = sequence(lov)
    return (attributes.join(_side(order, lov), ["classpath", "key"], "left")
            .withColumn("sequence", F.coalesce("sequence", F.lit(10_000))))


def filterable(lov: DataFrame) -> DataFrame:
    """V6: facet keys."""
    return lov.where("filterable").select("classpath", "key").distinct()


def facet_counts(applied: DataFrame, lov: DataFrame) -> DataFrame:
    """V6: products per facet value; partial counts combine before the shuffle."""
    return (applied.join(_side(filterable(lov), lov), ["classpath", "key"], "left_semi")
            .groupBy("key", "value").agg(F.count("*").alias("products")))


def coverage(applied: DataFrame, by: list[str] | None = None) -> DataFrame:
    """V7: checked, approved, mapped and refused values, per record or overall."""
    grouped = applied.groupBy(*by) if by else applied.groupBy()
    return grouped.agg(
        F.count_if("checked").alias("checked"),
        F.count_if(F.col("outcome").isin("approved", "mapped")).alias("approved"),
        F.count_if(F.col("outcome") == "mapped").alias("mapped"),
        F.count_if(F.col("outcome") == "refused").alias("refused"),
    ).withColumn("percent_in_lov", F.expr(
        "CASE WHEN checked > 0 THEN round(100D * approved / checked, 1) ELSE 0D END"))


def covered_classpaths(lov: DataFrame) -> DataFrame:
    """V8: classpaths that have a vocabulary."""
    return lov.select("classpath").distinct()



# ------------------------------------------------------------------ records


def fold_text(text: str) -> str:
    """``fold`` for configuration text."""
    return re.sub(r"[\s_\-/,.()]+", " ", text.strip().lower()).strip()


def record_side(spark: SparkSession, lov: dict | None = None) -> DataFrame:
    """Vocabularies by folded classpath, one row each, for the join with records."""
    rows = [(fold_text(path), [{"key": a["key"], "label": a["label"], "sequence": a.get("sequence", 10_000),
                                "options": list(a["values"]),
                                "synonyms": {fold_text(k): v for k, v in a["synonyms"].items()}} for a in attrs])
            for path, attrs in (lov or fixed.LOV).items()]
    return spark.createDataFrame(
        rows, "_folded string, lov array<struct<key:string,label:string,sequence:int,options:array<string>,"
              "synonyms:map<string,string>>>")


def apply_to_records(df: DataFrame, spark: SparkSession, lov: dict | None = None,
                     classpath: str = "schema.classpath") -> DataFrame:
    """V2-V5, V7 on records: values mapped, refusals kept and flagged, list order applied.

    Adds ``lov_issues``, ``lov_ledger`` and ``lov_coverage`` (null when no list applies).
    """
    table = lov or fixed.LOV
    side = record_side(spark, table)
    if sum(len(a["values"]) + len(a["synonyms"]) for attrs in table.values() for a in attrs) <= BROADCAST_ROWS:
        side = F.broadcast(side)
    df = df.join(side, F.expr(fold(classpath)) == side["_folded"], "left").drop("_folded")
    folded = fold("o")
    synonym = let("sy", f"try_element_at(s.synonyms, {folded})", "IF(array_contains(s.options, sy), sy, NULL)")

    def lastly(test: str) -> str:
        """Last permitted value that passes, as a later entry replaces an earlier one."""
        return f"get(reverse(filter(s.options, v -> {test})), 0)"

    looked_up = ("named_struct('to', coalesce(cs, sn, fd), 'how', CASE WHEN cs IS NOT NULL THEN 'case'"
                 " WHEN sn IS NOT NULL THEN 'synonym' WHEN fd IS NOT NULL THEN 'folded' END, 'from', o, 's', s)")
    found = let("o", "trim(a.val)", (
        "CASE WHEN s IS NULL OR size(s.options) = 0 OR coalesce(o, '') = '' THEN NULL"
        " WHEN array_contains(s.options, o) THEN named_struct('to', o, 'how', 'exact', 'from', o, 's', s) ELSE "
        + let("cs", lastly("lower(v) = lower(o)"), let("sn", synonym, let(
            "fd", lastly(f"{fold('v')} = {folded}"), looked_up))) + " END"))
    df = stage(df, _o=let("lv", "lov", "IF(lv IS NULL, NULL, transform(attributes, a -> "
                          + let("s", "get(filter(lv, x -> x.key = a.key), 0)", found) + "))"))
    refused = "filter(_o, x -> x IS NOT NULL AND x.to IS NULL)"
    df = df.withColumn("_near", suggest_each(F.expr(f"transform({refused}, x -> x.from)"),
                                             F.expr(f"transform({refused}, x -> x.s.options)")))
    note = ("concat(a.evidence, ' Normalized to the approved value \\'', x.to, '\\' from \\'', x.from, '\\' (',"
            " x.how, ' match in the list of values).')")
    mapped = let("x", "get(oc, i)", "IF(x.to IS NOT NULL AND x.how <> 'exact', "
                 + rebuilt("a", val="x.to", evidence=note) + ", a)")
    order = "coalesce(get(filter(lv, x -> x.key = a.key), 0).sequence, 1000000)"
    ordered = (f"transform(array_sort(transform(transform(attributes, (a, i) -> {mapped}), (a, i) -> named_struct("
               f"'o', {order}, 'g', a.grp, 'l', a.label, 'i', i, 'a', a))), t -> t.a)")
    issue = ("named_struct('code', 'LOV_VIOLATION', 'severity', 'warning', 'field', x.s.key, 'message', concat('\\'', x.from,"
             " '\\' is not an approved value for ', x.s.label, ' in this classpath.'), 'suggestion',"
             " IF(get(nm, i) IS NOT NULL, concat('Closest approved value is \\'', get(nm, i), '\\'. Confirm before"
             " applying — it was not applied automatically.'),"
             " 'Add the value to the list of values, or correct the source data.'))")
    return stage(
        df, attributes=let("oc", "_o", let("lv", "lov", f"IF(oc IS NULL, attributes, {ordered})")),
        lov_issues=let("nm", "_near", f"transform({refused}, (x, i) -> {issue})"),
        lov_ledger="transform(filter(_o, x -> x.to IS NOT NULL AND x.how <> 'exact'), x -> named_struct("
                   "'key', x.s.key, 'from_value', x.from, 'to_value', x.to, 'method', x.how))",
        lov_coverage="CASE WHEN _o IS NOT NULL THEN named_struct('checked', size(filter(_o, x -> x IS NOT NULL)),"
                     " 'approved', size(filter(_o, x -> x.to IS NOT NULL)), 'refused', size(filter(_o, x -> x IS NOT NULL AND x.to IS NULL)),"
                     " 'attributes_defined', size(lov)) END",
    ).drop("_o", "_near", "lov")
