"""Deterministic attribute extraction from spec tables and prose.

One row per product throughout: the category schema arrives by a broadcast join
on the category code, and every matcher walks the row's own arrays.  Supplier keys are
scored once for each distinct key, by a similarity join, and looked up.  Rows go through Python as
they are, since those of a scalar UDF wait in a queue that Spark writes to disk; the schema, most of
a row's bytes, is left out there and joined again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import fixed
from ..functions.lookup import filed, filing, held
from ..functions.stage import durable, stage
from ..functions.similarity import option_matcher, similarity_matrix
from ..functions.text import let, number, q, slug
from ..plans.taxonomy import BROADCAST_CATEGORIES, Taxonomy
from .nearby import attribute_names, key_scores
from .records import ATTRIBUTE_DDL, NO_ATTRIBUTES, NULL, attribute, coerce, coerce_number, exact_option

# Distinct supplier keys, and scores of theirs, up to which every task holds them.
LOOKUP_KEYS = 100_000
LOOKUP_SCORES = 500_000
_NEAREST = T.StructType([T.StructField("option", T.StringType()), T.StructField("score", T.DoubleType())])


def attach_schema(df: DataFrame, spark: SparkSession, taxonomy: Taxonomy) -> DataFrame:
    """Left join of the category schema as one ``schema`` struct column."""
    side = taxonomy.schema_df(spark)
    side = side.select(F.col("code").alias("_code"), F.struct(*side.columns).alias("schema"))
    if len(taxonomy.categories) <= BROADCAST_CATEGORIES:
        side = F.broadcast(side)
    return df.join(side, df["category.code"] == side["_code"], "left").drop("_code")


def _joined_again(taxonomy: Taxonomy) -> bool:
    """Whether joining the schema anew costs no shuffle and gives each row the one it had."""
    codes = [c["code"] for c in taxonomy.categories]
    return len(set(codes)) == len(codes) <= BROADCAST_CATEGORIES


def _key_index(df: DataFrame, taxonomy: Taxonomy) -> DataFrame | None:
    """Scores of all distinct supplier keys as a lookup table; None where there are too many keys, or they are not known yet."""
    if df.isStreaming:
        return None
    spark = df.sparkSession
    keys = durable(df.select(F.explode("specs.key").alias("key")).select(F.expr(slug("key")).alias("key")).distinct())
    if keys.limit(LOOKUP_KEYS + 1).count() > LOOKUP_KEYS:
        return None
    scores = durable(key_scores(keys, attribute_names(spark, taxonomy.names_by_code)).withColumnRenamed("key", "run"))
    return filing(scores) if scores.limit(LOOKUP_SCORES + 1).count() <= LOOKUP_SCORES else None


def map_specs(df: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Supplier keys to attributes, greedy in supplier order.

    Adds ``mapped`` (spec index, attribute index, score) and ``unmapped`` (key, value).  Distinct keys
    are scored once, as a join, and looked up; only beyond LOOKUP_KEYS of them is each row scored in Python.
    No schema is needed: reading keys from rows before theirs was joined classifies none.
    """
    index = _key_index(df, taxonomy)
    if index is None:
        udf = similarity_matrix(taxonomy.names_by_code)
        scored = udf(F.expr("transform(specs, s -> s.key)"), F.col("category.code"))
        df = df.withColumn("_sc", F.transform(scored, lambda x: F.transform(x, lambda s, j: F.struct(j.alias("j"), s.alias("s")))))
    else:
        found = let("k", slug("s.key"), f"transform(filter({filed('slots', 'k')}, p -> p.code = category.code), p -> named_struct('j', p.j, 's', p.s))")
        with held(index) as table:
            df = stage(df, _sc=let("ix", table, f"IF(category IS NULL, NULL, transform(specs, s -> {found}))"))
    hit = ("array_max(transform(get(sc, i), e -> named_struct('s',"
           " IF(array_contains(acc.taken, e.j), 0D, e.s), 'nj', -e.j)))")
    step = let("b", hit, (
        f"IF(b.s >= {fixed.MAP_THRESHOLD}D AND coalesce(sp[i].value, '') <> '', named_struct("
        "'taken', concat(acc.taken, array(-b.nj)),"
        " 'hits', concat(acc.hits, array(named_struct('i', i, 'j', -b.nj, 's', b.s)))), acc)"))
    fold = ("aggregate(IF(size(sp) > 0 AND sc IS NOT NULL, sequence(0, size(sp) - 1), array()),"
            " named_struct('taken', CAST(array() AS ARRAY<INT>),"
            " 'hits', CAST(array() AS ARRAY<STRUCT<i:INT,j:INT,s:DOUBLE>>)),"
            f" (acc, i) -> {step}, acc -> acc.hits)")
    df = stage(df, mapped=let("sp", "specs", let("sc", "_sc", fold))).drop("_sc")
    return df.withColumn("unmapped", F.expr(let(
        "used", "transform(mapped, m -> m.i)",
        "transform(filter(transform(specs, (s, i) -> named_struct('i', i, 'key', s.key, 'value', s.value)),"
        " s -> coalesce(s.value, '') <> '' AND NOT array_contains(used, s.i)),"
        " s -> named_struct('key', s.key, 'value', s.value))")))


_PROSE = "concat_ws(' \\n ', nullif(name, ''), nullif(description, ''), nullif(free_text, ''))"


def prose_candidates(df: DataFrame) -> DataFrame:
    """E8/E9 candidates: for every attribute the spec table left open, in schema order."""
    pick = ("CASE WHEN contains(lp, n.n) THEN " + let(
        "m", "regexp_extract(p, n.label_rx, 0)",
        "CASE WHEN m <> '' THEN named_struct('m', trim(m), 'c',"
        " trim(TRAILING '.' FROM trim(regexp_extract(p, n.label_rx, 1))))"
        " WHEN n.num_rx IS NOT NULL THEN " + let(
            "k", "regexp_extract(p, n.num_rx, 0)",
            "CASE WHEN k <> '' THEN named_struct('m', trim(k), 'c',"
            " trim(TRAILING '.' FROM trim(regexp_extract(p, n.num_rx, 1)))) END") + " END") + " END")
    unit = ("CASE WHEN a.owns AND regexp_extract(p, a.unit_rx, 0) <> '' THEN named_struct("
            "'m', trim(regexp_extract(p, a.unit_rx, 0)), 'c', concat(regexp_extract(p, a.unit_rx, 1),"
            " ' ', regexp_extract(p, a.unit_rx, 2))) END")
    body = let("p", _PROSE, let("lp", "lower(p)", let(
        "used", "transform(mapped, m -> m.j)",
        "transform(filter(schema.attrs, a -> NOT array_contains(used, a.j)), a -> named_struct("
        "'j', a.j, 'type', a.type,"
        f" 'labelled', filter(transform(a.names, n -> {pick}), c -> c IS NOT NULL AND c.c <> ''),"
        f" 'by_unit', {unit}))")))
    return stage(df, _cand=body)


def enum_texts(df: DataFrame, spark: SparkSession, taxonomy: Taxonomy) -> DataFrame:
    """E6 fuzzy tier for the distinct texts the exact tiers could not place."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    wanted = let("sa", "schema.attrs", (
        "filter(array_distinct(concat("
        "transform(filter(mapped, m -> sa[m.j].type = 'enum'),"
        " m -> named_struct('t', trim(specs[m.i].value), 'j', m.j)),"
        "flatten(transform(filter(_cand, e -> e.type = 'enum'),"
        " e -> transform(e.labelled, c -> named_struct('t', c.c, 'j', e.j)))))),"
        f" x -> x.t IS NOT NULL AND {exact_option('x.t', 'sa[x.j].options')} IS NULL)"))
    df = stage(df, _want=f"coalesce({wanted}, CAST(array() AS ARRAY<STRUCT<t:STRING,j:INT>>))")
    lean = _joined_again(taxonomy)
    if lean:
        df = df.drop("schema")
    df = df.withColumn("_at", F.col("category.code"))
    found = T.StructType([*df.schema, T.StructField("_got", T.ArrayType(_NEAREST))])
    df = df.mapInArrow(option_matcher(taxonomy.options_by_code, "_want", "_at", "_got"), found)
    df = stage(df, _fuzzy=(
        "map_from_arrays(transform(_want, x -> concat(x.j, '|', x.t)),"
        " IF(size(_got) = size(_want), _got,"
        " CAST(array_repeat(NULL, size(_want)) AS ARRAY<STRUCT<option:STRING,score:DOUBLE>>)))"
    )).drop("_want", "_at", "_got")
    return (attach_schema(df, spark, taxonomy) if lean else df).select(*kept, "_fuzzy")


def spec_claims(df: DataFrame) -> DataFrame:
    """Mapped spec pairs as attributes."""
    value = coerce("sv", "a", "try_element_at(fz, concat(a.j, '|', trim(sv)))")
    evidence = ("concat('Supplier field \\'', sk, '\\'', IF(coalesce(source_document, '') <> '',"
                " concat(' of ', source_document), ''), ' = \\'', sv, '\\'',"
                " IF(v.note <> '', concat('; ', v.note), ''))")
    conf = ("IF(startswith(v.note, 'value is outside'),"
            " least(round(least(0.72D + 0.27D * m.s, 0.99D), 3), 0.6D),"
            " round(least(0.72D + 0.27D * m.s, 0.99D), 3))")
    one = let("a", "sa[m.j]", let("sk", "sp[m.i].key", let("sv", "sp[m.i].value", let(
        "v", value, attribute(
            key="a.key", label="a.label", val="v.val", num="v.num", kind="v.kind", unit="v.unit",
            prov="IF(m.s > 0.95D, 'supplied', 'parsed')", conf=conf, evidence=evidence,
            method="'structured-spec-mapping'", grp="a.grp", source_url="source_url",
            locator="coalesce(nullif(sp[m.i].locator, ''), source_document)")))))
    return stage(df, from_specs=let("sa", "schema.attrs", let(
        "sp", "specs", let("fz", "_fuzzy", f"transform(mapped, m -> {one})"))))


def prose_claims(df: DataFrame) -> DataFrame:
    """Labelled text, then a bare unit, then a vocabulary term, per open attribute.

    Text a resolved attribute already explains is masked before the vocabulary
    search, so it cannot justify a second attribute.
    """
    labelled_value = coerce("c.c", "a", "try_element_at(fz, concat(a.j, '|', trim(c.c)))")
    usable = ("CASE a.type WHEN 'number' THEN v.kind IN ('int', 'float')"
              " WHEN 'enum' THEN array_contains(a.options, v.val) ELSE v.val <> '' END")
    stamp = dict(source_url="source_url", locator="source_document")

    def built(conf, method, evidence):
        return attribute(key="a.key", label="a.label", val="v.val", num="v.num", kind="v.kind",
                         unit="v.unit", prov="'parsed'", conf=conf, evidence=evidence,
                         method=method, grp="a.grp", **stamp)

    by_label = ("get(filter(transform(e.labelled, c -> " + let("v", labelled_value, (
        f"CASE WHEN {usable} THEN " + built(
            "IF(a.type = 'number', 0.82D, 0.74D)", "'text-pattern-extraction'",
            "concat('Found in product text: \"', c.m, '\"', IF(v.note <> '', concat('; ', v.note), ''))")
        + " END")) + "), r -> r IS NOT NULL), 0)")
    by_unit = "CASE WHEN e.by_unit IS NOT NULL THEN " + let(
        "v", coerce_number("e.by_unit.c", "a.unit"),
        "CASE WHEN v.kind IN ('int', 'float') THEN " + built(
            "0.79D", "'unit-anchored-extraction'",
            "concat('Unit-anchored match in product text: \"', e.by_unit.m, '\"',"
            " IF(v.note <> '', concat('; ', v.note), ''))") + " END") + " END"
    hits = ("transform(_cand, e -> " + let("a", "sa[e.j]", (
        f"named_struct('j', e.j, 'hit', coalesce({by_label}, {by_unit}))")) + ")")

    masked = ("aggregate(filter(acc.claimed, s -> contains(s, o.probe)), cc,"
              " (t, s) -> replace(t, s, regexp_replace(s, '\\\\w', '_')))")
    found = ("array_max(filter(transform(sa[e.j].opts, (o, i) -> CASE WHEN contains(cc, o.probe) THEN "
             + let("at", f"regexp_instr({masked}, o.rx)",
                   "CASE WHEN at > 0 THEN named_struct('n', length(o.probe), 'ni', -i,"
                   " 'option', o.option, 'text', substring(code_text, at, length(o.probe))) END")
             + " END), x -> x IS NOT NULL))")
    vocab = attribute(
        key="sa[e.j].key", label="sa[e.j].label", val="w.option", num="CAST(NULL AS DOUBLE)",
        kind="'text'", unit=NULL, prov="'parsed'", conf="0.8D",
        evidence="concat('Product text states \"', w.text, '\", which maps to the \"', w.option,"
                 " '\" vocabulary value.')",
        method="'vocabulary-match'", grp="sa[e.j].grp", **stamp)

    def keep(attr, text):
        return (f"named_struct('out', concat(acc.out, array({attr})),"
                f" 'claimed', IF(length(trim({text})) >= 2,"
                f" concat(acc.claimed, array(lower(trim({text})))), acc.claimed))")

    step = (f"CASE WHEN e.hit IS NOT NULL THEN {keep('e.hit', 'e.hit.val')}"
            " WHEN size(sa[e.j].opts) > 0 THEN "
            + let("w", found, f"CASE WHEN w IS NOT NULL THEN {keep(vocab, 'w.text')} ELSE acc END")
            + " ELSE acc END")
    seed = ("transform(filter(from_specs, a -> a.kind = 'text' AND length(trim(a.val)) >= 2),"
            " a -> lower(trim(a.val)))")
    df = stage(df, _hits=let("sa", "schema.attrs", let("fz", "_fuzzy", hits)))
    fold = (f"aggregate(_hits, named_struct('out', {NO_ATTRIBUTES}, 'claimed', {seed}),"
            f" (acc, e) -> {step}, acc -> acc.out)")
    code_text = ("concat_ws(' ', nullif(replace(mpn, '-', ' '), ''), nullif(replace(sku, '-', ' '), ''),"
                 f" nullif(replace({_PROSE}, '-', ' '), ''))")
    body = let("sa", "schema.attrs", let("code_text", code_text, let("cc", "lower(code_text)", fold)))
    return stage(df, from_text=(
        f"CASE WHEN schema IS NULL THEN {NO_ATTRIBUTES} ELSE coalesce({body}, {NO_ATTRIBUTES}) END"))


def extract(df: DataFrame, spark: SparkSession, taxonomy: Taxonomy | None = None) -> DataFrame:
    """E1-E13 on classified products; adds ``schema``, ``extracted``, ``unmapped``."""
    taxonomy = taxonomy or Taxonomy()
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("mapped", "unmapped")]
    df = attach_schema(map_specs(df, taxonomy), spark, taxonomy).select(*kept, "schema", "mapped", "unmapped")
    df = prose_claims(spec_claims(enum_texts(prose_candidates(df), spark, taxonomy)))
    return stage(df, extracted=f"concat(coalesce(from_specs, {NO_ATTRIBUTES}), from_text)").drop(
        "_cand", "_fuzzy", "from_specs", "from_text", "mapped", "_hits")


def unmapped_fields(df: DataFrame) -> DataFrame:
    """Supplier fields no attribute took, with how many products carried them."""
    return (df.select(F.col("category.code").alias("code"), F.explode_outer("unmapped").alias("u"))
            .where("u IS NOT NULL").groupBy("code", F.col("u.key").alias("key"))
            .agg(F.count("*").alias("products")))


__all__ = ["ATTRIBUTE_DDL", "attach_schema", "extract", "map_specs", "unmapped_fields", "number", "q"]
