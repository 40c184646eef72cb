"""Score products against the categories whose names their text holds.

Categories are configuration: one row with postings filed by word run, which every task holds as
the value of a session variable.  A product looks up the word runs of its own text, so
the cost follows the text and the plan does not grow with the number of categories; there is
no product x category join and no shuffle.  What the runs propose is confirmed by a
word-boundary test of the whole name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions.lookup import filed, held
from ..functions.stage import stage
from ..functions.text import let, number
from ..plans.taxonomy import GRAM, Taxonomy


def haystack_sql() -> str:
    """All searchable text, lower case, single spaced."""
    return ("regexp_replace(lower(concat_ws(' ', nullif(name, ''), nullif(description, ''),"
            " nullif(free_text, ''), nullif(category_hint, ''),"
            " nullif(array_join(transform(specs, s -> concat_ws(' ', s.key, s.value)), ' '), ''))),"
            " '\\\\s+', ' ')")


def classify(df: DataFrame, taxonomy: Taxonomy | None = None, mpn: str = "identity.mpn") -> DataFrame:
    """Adds ``category`` (null when nothing scored).

    C1 keyword hits, C2 part-number patterns, C3 attribute mentions, C4 hint,
    C5 brand affinity, C6 winner and confidence, C7 circumstantial cap,
    C8 alternatives, C9 reasons, C10 the assignment record.
    """
    taxonomy = taxonomy or Taxonomy()
    with held(taxonomy.index_df(df.sparkSession)) as index:
        return stage(df, category=_category(index, mpn))


def _category(index: str, mpn: str) -> str:
    # Postings of the text's own word runs, confirmed on the whole text.
    runs = "array_distinct(concat(regexp_extract_all(_h, '\\\\w+', 0), array('')))"
    hits = (f"array_sort(transform(filter(flatten(transform({runs}, r -> {filed('slots', 'r')})), p -> contains(_h, p.n) AND _h RLIKE p.rx),"
            " p -> named_struct('c', p.c, 'j', p.j, 'at', p.at, 'n', p.n, 'w', p.w)))")
    # C4: keywords anywhere in the hint, found by their first letters.
    grams = (f"array_distinct(flatten(transform(sequence(0, {GRAM}), g -> IF(length(hl) < g, CAST(array() AS ARRAY<STRING>),"
             " transform(sequence(1, length(hl) - g + 1), i -> substring(hl, i, g))))))")
    hinted = f"flatten(transform({grams}, r -> transform(filter({filed('grams', 'r')}, p -> contains(hl, p.n)), p -> p.c)))"
    hint_c = f"coalesce({let('hl', 'lower(category_hint)', hinted)}, CAST(array() AS ARRAY<INT>))"
    # C2, C5
    pattern_c = f"coalesce(transform(filter(ix.patterns, p -> trim({mpn}) RLIKE p.rx), p -> p.c), CAST(array() AS ARRAY<INT>))"
    brand_c = f"coalesce(flatten(transform(split(brand_entry.made, ','), r -> transform({filed('codes', 'r')}, p -> p.c))), CAST(array() AS ARRAY<INT>))"
    parts = (
        "named_struct("
        "'kw', filter(f.hits, h -> h.c = i AND h.j < 0),"
        " 'pat', size(filter(f.pats, p -> p = i)),"
        " 'men', let_men, 'hint', array_contains(f.hints, i), 'brand', array_contains(f.brands, i))"
    ).replace("let_men", let("m", "filter(f.hits, h -> h.c = i AND h.j >= 0)",
                             "transform(filter(m, (x, k) -> k = 0 OR get(m, k - 1).j <> x.j), x -> x.n)"))
    scored = let("c", "get(ix.cats, i)", let("x", parts, (
        "named_struct("
        "'score', aggregate(x.kw, 0D, (a, k) -> a + k.w) + 4D * x.pat + 0.6D * size(x.men)"
        " + IF(x.hint, 3D, 0D) + IF(x.brand, 1.5D, 0D),"
        " 'code', c.code, 'path', c.path, 'customer', c.customer, 'pos', i, 'by_mpn', x.pat > 0,"
        " 'named', exists(c.kw, k -> contains(lower(concat_ws(' ', nullif(name, ''),"
        " nullif(category_hint, ''))), k)),"
        " 'has_kw', size(c.kw) > 0,"
        " 'reasons', concat("
        "transform(x.kw, k -> concat('matched keyword \\'', k.n, '\\'')),"
        "array_repeat(concat('part number matches the ', element_at(c.path, -1), ' pattern'), x.pat),"
        "transform(x.men, n -> concat('input mentions \\'', n, '\\'')),"
        "IF(x.hint, array(concat('category hint \\'', category_hint, '\\' points here')), array()),"
        "IF(x.brand, array(concat(brand_entry.canonical, ' manufactures in this category')), array())))")))
    found = f"named_struct('hits', {hits}, 'pats', {pattern_c}, 'hints', {hint_c}, 'brands', {brand_c})"
    ranked = let("ix", index, let("_h", haystack_sql(), let("f", found, (
        f"array_sort(transform(array_distinct(concat(transform(f.hits, h -> h.c), f.pats, f.hints, f.brands)), i -> {scored}),"
        " (a, b) -> CASE WHEN a.score > b.score THEN -1"
        " WHEN a.score < b.score THEN 1 ELSE a.pos - b.pos END)"))))
    base = ("round(least(0.35D + 0.45D * least(t.score / 9D, 1D) + 0.20D *"
            " ((t.score - coalesce(get(_s, 1).score, 0D)) / t.score), 0.99D), 3)")
    capped = ("NOT t.by_mpn AND t.has_kw AND NOT t.named"
              " AND concat_ws(' ', nullif(name, ''), nullif(category_hint, '')) <> ''")
    cap = number(fixed.CIRCUMSTANTIAL_CAP)
    note = ("'confidence capped: no category keyword appears in the product name, so the match"
            " rests on surrounding description text'")
    record = let("t", "get(_s, 0)", let("f", f"named_struct('b', {base}, 'cap', {capped})", let(
        "conf", f"IF(f.cap, least(f.b, {cap}), f.b)",
        "named_struct('code', t.code, 'path', t.path, 'score', t.score, 'confidence', conf,"
        f" 'reasons', slice(array_distinct(concat(t.reasons, IF(f.cap, array({note}), array()))), 1, 6),"
        " 'alternatives', transform(slice(_s, 2, 3), a -> named_struct("
        "'code', a.code, 'path', a.path, 'score', round(a.score, 2),"
        " 'confidence', round(least(a.score / greatest(t.score, 1e-6D), 1D) * conf, 3))),"
        " 'customer', t.customer)")))
    return let("_s", ranked, f"CASE WHEN size(_s) > 0 THEN {record} END")


def assignment(df: DataFrame) -> DataFrame:
    """Flat assignment with path and rationale text."""
    return df.select(
        "id", F.col("category.code").alias("code"),
        F.array_join("category.path", " > ").alias("path"),
        F.col("category.confidence").alias("confidence"),
        F.expr("coalesce(nullif(array_join(category.reasons, '; '), ''),"
               " 'Matched on general product signals.')").alias("rationale"),
        F.size("category.alternatives").alias("alternatives"),
    ).where("code IS NOT NULL")


def weakly_classified(df: DataFrame, threshold: float = fixed.WEAK_CLASSIFICATION) -> DataFrame:
    """L1: products no category claims, or claims only weakly."""
    return df.where(F.col("category").isNull() | (F.col("category.confidence") < threshold))
