"""Measure recovery, contradiction, detection and accuracy against known answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import q

SPARSE_KEEP = 0.3
MINUTES_PER_SKU = 10.0
COST_PER_HOUR = 35.0


def rate(numerator: Column | str, denominator: Column | str) -> Column:
    n = F.col(numerator) if isinstance(numerator, str) else numerator
    d = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.when(d > 0, F.round(100.0 * n / d, 1)).otherwise(F.lit(0.0))


def sparse_cases(truth: DataFrame, keep: float = SPARSE_KEEP) -> DataFrame:
    """M1: which facts of a case stay in the input; the rest are withheld.

    ``truth(case_id, key, ...)``; the choice follows a hash of case and key, so reruns agree.
    """
    order = W.partitionBy("case_id").orderBy(F.md5(F.concat_ws("|", F.col("case_id").cast("string"), "key")), "key")
    size = W.partitionBy("case_id")
    return (truth.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(size))
            .withColumn("withheld", F.col("_r") > F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(keep)).cast("int")))
            .drop("_r", "_n"))


def corrupt(cases: DataFrame) -> DataFrame:
    """M2: one defect per case with the issue code it must raise.

    ``cases(case_id, code, nums MAP<STRING,DOUBLE>, texts MAP<STRING,STRING>, ranged ARRAY<STRING>,
    enums ARRAY<STRING>)``.  Adds ``kind``, ``field``, ``expected``, ``new_nums`` and ``new_texts``.
    """
    n = lambda k: f"try_element_at(nums, {q(k)})"
    has = lambda k: f"{n(k)} IS NOT NULL"
    pick = lambda a: f"get({a}, CAST(pmod(xxhash64(case_id), greatest(size({a}), 1)) AS INT))"
    swap = [("bore_diameter", "outer_diameter"), ("inner_diameter", "outer_diameter")]
    ladder = [(f"{has(a)} AND {has(b)} AND {n(a)} <> {n(b)}", "transposition", q(a), "GEOMETRY_CONTRADICTION",
               f"map({q(a)}, {n(b)}, {q(b)}, {n(a)})", "map()") for a, b in swap]
    ladder += [
        (f"{has('flute_length')} AND {has('overall_length')}", "geometry", "'flute_length'", "GEOMETRY_CONTRADICTION",
         f"map('flute_length', {n('overall_length')} + 5D)", "map()"),
        (f"code = '40141600' AND {has('temp_rating_max')}", "material_conflict", "'temp_rating_max'", "MATERIAL_TEMP_CONFLICT",
         "map('temp_rating_max', 180D)", "map('body_material', 'PVC')"),
        (f"code = '40151500' AND {has('max_temp')}", "material_conflict", "'max_temp'", "MATERIAL_TEMP_CONFLICT",
         "map('max_temp', 140D)", "map('body_material', 'Polypropylene')"),
        ("code = '31161500'", "grade_conflict", "'grade'", "GRADE_MATERIAL_CONFLICT", "map()",
         "map('material', '316 Stainless Steel', 'grade', '10.9')"),
        (f"code = '40142000' AND {has('burst_pressure')}", "safety_factor", "'burst_pressure'", "SAFETY_FACTOR_LOW",
         f"map('burst_pressure', {n('working_pressure')} * 2D)", "map()"),
        ("try_element_at(texts, 'ip_rating') IS NOT NULL", "invalid_code", "'ip_rating'", "INVALID_IP_CODE", "map()",
         "map('ip_rating', 'IP7X9')"),
        ("size(ranged) > 0", "magnitude", pick("ranged"), "OUT_OF_RANGE",
         f"map({pick('ranged')}, try_element_at(nums, {pick('ranged')}) * 1000D)", "map()"),
        ("size(enums) > 0", "vocabulary", pick("enums"), "VOCABULARY_VIOLATION", "map()",
         f"map({pick('enums')}, 'Unspecified Material X')"),
    ]
    def case(i):
        return "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i] if i != 1 and i != 3 else q(r[i])}" for r in ladder) + " END"
    def merged(base, change, ddl):
        return (f"map_concat(map_filter({base}, (k, v) -> NOT map_contains_key(coalesce(CAST({change} AS {ddl}),"
                f" CAST(map() AS {ddl})), k)), coalesce(CAST({change} AS {ddl}), CAST(map() AS {ddl})))")
    typed_nums = case(4).replace("THEN map()", "THEN CAST(map() AS MAP<STRING,DOUBLE>)")
    typed_texts = case(5).replace("THEN map()", "THEN CAST(map() AS MAP<STRING,STRING>)")
    return (cases.withColumn("kind", F.expr(case(1))).withColumn("field", F.expr(case(2)))
            .withColumn("expected", F.expr(case(3)))
            .withColumn("_cn", F.expr(typed_nums)).withColumn("_ct", F.expr(typed_texts))
            .withColumn("new_nums", F.expr(merged("nums", "_cn", "MAP<STRING,DOUBLE>")))
            .withColumn("new_texts", F.expr(merged("texts", "_ct", "MAP<STRING,STRING>"))).drop("_cn", "_ct"))


def values_match(pred_text: str, pred_num: str, true_text: str, true_num: str) -> str:
    """M3: numbers within 1 %, booleans and text by trimmed lower-case equality."""
    return (f"CASE WHEN {pred_text} IS NULL OR {true_text} IS NULL THEN false"
            f" WHEN {true_num} IS NOT NULL AND {pred_num} IS NOT NULL THEN IF({true_num} = 0D,"
            f" abs({pred_num}) < 1e-9D, abs({pred_num} - {true_num}) / abs({true_num}) <= 0.01D)"
            f" ELSE lower(trim({pred_text})) = lower(trim({true_text})) END")


def compare(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """M4 basis: every withheld fact with what was recovered for it.

    ``truth(case_id, key, true_val, true_num, truth_source)``, ``predicted(case_id, key, val, num, prov)``.
    Both grow with the cases, and the size Spark takes truth to have is that of the file its facts were unfolded
    from: the join is a merge of sorted rows, which can spill, and no side is broadcast.
    """
    p = predicted.select("case_id", "key", "val", "num", "prov").hint("merge")
    return (truth.join(p, ["case_id", "key"], "left")
            .withColumn("recovered", F.col("prov").isNotNull())
            .withColumn("correct", F.expr(f"prov IS NOT NULL AND {values_match('val', 'num', 'true_val', 'true_num')}"))
            .withColumn("contradicted", F.expr("recovered AND NOT correct")))


def recovery(compared: DataFrame, by: list[str] | None = None) -> DataFrame:
    """M4/M5: recall, precision and contradiction, with and without defaults; optional grouping."""
    solid = F.col("prov") != "defaulted"
    out = (compared.groupBy(*by) if by else compared.groupBy()).agg(
        F.count("*").alias("withheld"), F.count_if("recovered").alias("recovered"),
        F.count_if("correct").alias("correct"), F.count_if("contradicted").alias("contradicted"),
        F.count_if(F.col("recovered") & solid).alias("solid_recovered"),
        F.count_if(F.col("correct") & solid).alias("solid_correct"),
        F.count_if(F.col("contradicted") & solid).alias("solid_contradicted"))
    return (out.withColumn("recall_pct", rate("recovered", "withheld"))
            .withColumn("precision_pct", rate("correct", "recovered"))
            .withColumn("contradiction_pct", rate("contradicted", "recovered"))
            .withColumn("solid_precision_pct", rate("solid_correct", "solid_recovered"))
            .withColumn("solid_contradiction_pct", rate("solid_contradicted", "solid_recovered")))


def breakdown(compared: DataFrame) -> DataFrame:
    """M5: provenance and truth-source precision in one pass over the data."""
    return (compared.groupingSets([["prov"], ["truth_source"]], "prov", "truth_source").agg(
        F.grouping("prov").alias("_g"), F.count("*").alias("withheld"), F.count_if("recovered").alias("recovered"),
        F.count_if("correct").alias("correct"), F.count_if("contradicted").alias("contradicted"))
        .where("_g = 1 OR prov IS NOT NULL")
        .select(F.expr("IF(_g = 1, 'truth_source', 'provenance')").alias("dimension"),
                F.expr("IF(_g = 1, truth_source, prov)").alias("member"), "withheld", "recovered", "correct", "contradicted")
        .withColumn("precision_pct", rate("correct", "recovered")))


def detection(cases: DataFrame, issues: DataFrame) -> DataFrame:
    """M6: per defect case, whether an expected code was raised.

    ``cases(case_id, kind, expected)`` with ``expected`` one code per row, ``issues(case_id, code)``.
    """
    raised = issues.select("case_id", F.col("code").alias("expected")).distinct()
    hit = cases.join(raised.withColumn("_hit", F.lit(True)), ["case_id", "expected"], "left")
    return hit.groupBy("case_id", "kind").agg(F.max(F.coalesce("_hit", F.lit(False))).alias("detected"))


def detection_recall(detected: DataFrame, by: list[str] | None = None) -> DataFrame:
    """M6"""
    out = (detected.groupBy(*by) if by else detected.groupBy()).agg(
        F.count("*").alias("expected"), F.count_if("detected").alias("detected"))
    return out.withColumn("recall_pct", rate("detected", "expected"))


def false_alarms(clean_issues: DataFrame) -> DataFrame:
    """M7: errors other than missing fields on defect-free cases, by code."""
    return (clean_issues.where("severity = 'error' AND code <> 'MISSING_REQUIRED'")
            .groupBy("code").agg(F.count("*").alias("alarms")))


def verdict_mix(records: DataFrame) -> DataFrame:
    """M8: verdicts per variant and the share stopped before a storefront."""
    return (records.groupBy("variant").agg(
        F.count("*").alias("cases"), F.count_if(F.col("verdict") == "publish").alias("publish"),
        F.count_if(F.col("verdict") == "review").alias("review"), F.count_if(F.col("verdict") == "blocked").alias("blocked"))
        .withColumn("stopped_pct", rate(F.col("review") + F.col("blocked"), F.col("cases"))))


def coverage_lift(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """M8: attributes out per attribute in."""
    both = inputs.select(F.lit(True).alias("given")).unionByName(outputs.select(F.lit(False).alias("given")))
    return both.agg(F.count_if("given").alias("attributes_in"), F.count_if(~F.col("given")).alias("attributes_out")).withColumn(
        "lift_multiple", F.when(F.col("attributes_in") > 0, F.round(F.col("attributes_out") / F.col("attributes_in"), 2))
        .otherwise(F.lit(0.0)))


def contradictions(compared: DataFrame) -> DataFrame:
    """M9"""
    return compared.where("contradicted").select("case_id", "key", F.col("val").alias("predicted"),
                                                 F.col("true_val").alias("truth"), "prov")


def business_projection(mix: DataFrame, catalog: int = 100_000) -> DataFrame:
    """Hours and cost saved; review counts as half assisted."""
    manual = catalog * MINUTES_PER_SKU / 60
    m = mix.agg(F.sum("cases").alias("t"), F.sum("publish").alias("p"), F.sum("review").alias("r"))
    saved = (F.col("p") + F.col("r") * 0.5) / F.greatest("t", F.lit(1)) * F.lit(manual)
    return m.select(rate("p", "t").alias("auto_publish_pct"), rate("r", "t").alias("assisted_pct"),
                    F.round(F.lit(manual), 0).alias("manual_hours"), F.round(saved, 0).alias("hours_saved"),
                    F.round(saved * COST_PER_HOUR, 0).alias("cost_saved"), F.round(saved / 1800, 1).alias("fte_years_saved"))


def triage(records: DataFrame, attributes: DataFrame, dim_attribute: DataFrame) -> DataFrame:
    """Records a second opinion could still change.

    ``records(id, code)``, ``attributes(id, key, prov)``.  Schema sizes are configuration and
    joined by code; gaps are counted, not listed.
    """
    defined = dim_attribute.groupBy("code").agg(F.count("*").alias("defined"))
    own = (attributes.join(records.select("id", "code"), "id")
           .join(dim_attribute.select("code", "key").withColumn("_in", F.lit(1)), ["code", "key"], "left")
           .groupBy("id").agg(F.sum("_in").alias("present"), F.count_if(F.col("prov") == "defaulted").alias("defaults")))
    return (records.join(defined, "code", "left").join(own, "id", "left")
            .withColumn("gaps", F.coalesce("defined", F.lit(0)) - F.coalesce("present", F.lit(0)))
            .withColumn("defaults", F.coalesce("defaults", F.lit(0)))
            .select("id", F.expr("CASE WHEN code IS NULL THEN 'unclassified' WHEN gaps > 0 THEN 'gaps'"
                                 " WHEN defaults > 0 THEN 'defaults' ELSE 'complete' END").alias("why"))
            .withColumn("needed", F.col("why").isin("gaps", "defaults")))


def forfeited(triaged: DataFrame, gate_counts: DataFrame) -> DataFrame:
    """Proof that skipping forfeits nothing -- gate acceptances on skipped records."""
    return (triaged.where("NOT needed").join(gate_counts, "id", "left")
            .agg(F.count("*").alias("skipped"),
                 F.count_if(F.coalesce(F.col("gap_filled") + F.col("displaced_defaults"), F.lit(0)) > 0).alias("forfeited")))


def loose(x: str) -> str:
    """Letters and digits only, lower case."""
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9 ]', ''))"


def field_outcomes(expected: DataFrame, ours: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """Exact, close, missing, wrong or extra for every scored cell."""
    def long(df, name):
        pairs = ", ".join(f"{q(c)}, CAST(`{c}` AS STRING)" for c in columns)
        return df.selectExpr(f"`{id_column}`", f"stack({len(columns)}, {pairs}) AS (field, {name})")
    norm = "trim(regexp_replace(coalesce({}, ''), '\\\\s+', ' '))"
    both = long(expected, "want").join(long(ours, "got"), [id_column, "field"], "full_outer")
    both = both.withColumn("want", F.expr(norm.format("want"))).withColumn("got", F.expr(norm.format("got")))
    return both.where("want <> '' OR got <> ''").withColumn("outcome", F.expr(
        "CASE WHEN want = '' THEN 'extra' WHEN want = got THEN 'exact' WHEN got = '' THEN 'missing'"
        f" WHEN {loose('want')} = {loose('got')} THEN 'close' ELSE 'wrong' END"))


def field_accuracy(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, loose accuracy, precision and recall, per record, per field or overall."""
    def n(o):
        return F.count_if(F.col("outcome") == o).alias(o)
    out = (outcomes.groupBy(*by) if by else outcomes.groupBy()).agg(*[n(o) for o in ("exact", "close", "missing", "wrong", "extra")])
    scored = F.col("exact") + F.col("close") + F.col("missing") + F.col("wrong")
    return (out.withColumn("scored", scored)
            .withColumn("accuracy_pct", rate("exact", "scored"))
            .withColumn("accuracy_loose_pct", rate(F.col("exact") + F.col("close"), F.col("scored")))
            .withColumn("precision_pct", rate(F.col("exact"), F.col("exact") + F.col("close") + F.col("wrong")))
            .withColumn("recall_pct", rate(F.col("scored") - F.col("missing"), F.col("scored"))))


def two_states(given: DataFrame, from_input: DataFrame) -> DataFrame:
    """Share of exact fields when the formatter gets true attributes, and when it does not."""
    a = given.select(F.lit("given_attributes").alias("state"), "field", "outcome")
    b = from_input.select(F.lit("from_input_row").alias("state"), "field", "outcome")
    return (a.unionByName(b).groupBy("state", "field")
            .agg(F.count_if(F.col("outcome") != "extra").alias("scored"), F.count_if(F.col("outcome") == "exact").alias("exact"))
            .withColumn("exact_pct", rate("exact", "scored")))


def attributes_from_slots(sheet: DataFrame, id_column: str, count: int = 50,
                          label: str = "ATTRIBUTE_LABEL {n}", value: str = "ATTRIBUTE_VALUE {n}",
                          unit: str = "ATTRIBUTE_UOM {n}") -> DataFrame:
    """label/value/unit triplets back to attributes."""
    rows = ", ".join(f"{i}, CAST(`{label.format(n=i)}` AS STRING), CAST(`{value.format(n=i)}` AS STRING),"
                     f" CAST(`{unit.format(n=i)}` AS STRING)" for i in range(1, count + 1))
    df = sheet.selectExpr(f"`{id_column}`", f"stack({count}, {rows}) AS (slot, label, value, unit)")
    norm = "nullif(trim(regexp_replace(coalesce({}, ''), '\\\\s+', ' ')), '')"
    return (df.select(id_column, "slot", *[F.expr(norm.format(c)).alias(c) for c in ("label", "value", "unit")])
            .where("label IS NOT NULL AND value IS NOT NULL")
            .withColumn("key", F.expr("replace(lower(label), ' ', '_')"))
            .withColumn("num", F.expr("try_cast(value AS DOUBLE)")))


def ablation(runs: dict[str, DataFrame]) -> DataFrame:
    """The same measures of several runs, one row each."""
    out = None
    for name, measured in runs.items():
        row = measured.withColumn("run", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def composition(cases: DataFrame) -> DataFrame:
    """Cases by category, variant, truth source and defect kind in one pass."""
    dims = ["category", "variant", "truth_source", "kind"]
    g = cases.groupingSets([[d] for d in dims], *dims).agg(
        *[F.grouping(d).alias("g_" + d) for d in dims], F.count("*").alias("cases"))
    which = "CASE " + " ".join(f"WHEN g_{d} = 0 THEN '{d}'" for d in dims) + " END"
    member = "CASE " + " ".join(f"WHEN g_{d} = 0 THEN {d}" for d in dims) + " END"
    return (g.select(F.expr(which).alias("dimension"), F.expr(member).alias("member"), "cases").where("member IS NOT NULL"))


def invariants(attributes: DataFrame) -> DataFrame:
    """Values that break a record invariant.

    ``attributes(evidence, conf, source_document, source_url, locator)``.
    """
    return attributes.agg(
        F.count("*").alias("checked"),
        F.count_if(F.length(F.coalesce("evidence", F.lit(""))) <= 10).alias("thin_evidence"),
        F.count_if(~F.col("conf").between(0, 1)).alias("confidence_outside"),
        F.count_if(F.col("source_document").isNotNull() & F.coalesce(F.col("source_url"), F.col("locator")).isNull())
        .alias("uncited"))
