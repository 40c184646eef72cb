"""Normalise and identify products.

Input rows carry: id, sku, mpn, brand, name, description, category_hint, price,
currency, source_url, source_document, free_text and
specs ARRAY<STRUCT<key, value, locator>> in supplier order.  Every operator here
is a projection: no shuffle, any input size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions.stage import stage
from ..functions.text import in_list, let, q, squash
from ..plans.taxonomy import brand_row

TEXT_FIELDS = ["sku", "mpn", "brand", "name", "description", "category_hint", "free_text"]
EMPTY_FIELDS = ["sku", "mpn", "brand", "name", "description", "free_text", "category_hint"]


def clean_text(df: DataFrame) -> DataFrame:
    """Collapse whitespace in the seven text fields."""
    return df.withColumns({c: F.expr(squash(c)) for c in TEXT_FIELDS})


def empty_flag(df: DataFrame) -> DataFrame:
    """True when a row carries nothing at all to work from."""
    filled = " OR ".join(f"(`{c}` IS NOT NULL AND `{c}` <> '')" for c in EMPTY_FIELDS)
    return df.withColumn("is_empty", F.expr(
        f"NOT (coalesce({filled}, false) OR coalesce(size(specs), 0) > 0)"))


def brand_entry_sql(brand: str) -> str:
    """Dictionary entry by exact name, then leading words, then any word."""
    probe = (f"regexp_replace(regexp_replace(lower(trim({brand})), '[^a-z0-9 ]', ''),"
             f" '\\\\s+', ' ')")
    first = "get(array_sort({}, (a, b) -> a.pos - b.pos), 0)"
    leading = (f"filter(transform(sequence(1, size(w)), n ->"
               f" {brand_row("array_join(slice(w, 1, n), ' ')")}), e -> e IS NOT NULL)")
    words = f"filter(transform(w, t -> {brand_row('t')}), e -> e IS NOT NULL)"
    return let("w", f"split({probe}, ' ')",
               f"coalesce({brand_row('array_join(w, chr(32))')},"
               f" {first.format(leading)}, {first.format(words)})")


def canonical_brand(df: DataFrame, column: str = "brand") -> DataFrame:
    """Adds ``brand_entry`` and ``brand_name`` (canonical, or the raw text kept)."""
    blank = f"({column} IS NULL OR trim({column}) = '')"
    df = stage(df, brand_entry=f"CASE WHEN NOT {blank} THEN {brand_entry_sql(column)} END")
    return df.withColumn("brand_name", F.expr(
        f"CASE WHEN NOT {blank} THEN coalesce(brand_entry.canonical, trim({column})) END"))


def identity(df: DataFrame) -> DataFrame:
    """Part number, SKU, GTIN, manufacturer, country and notes.

    Needs ``clean_text`` and ``canonical_brand`` first.  Adds ``identity`` (a map) and
    ``identity_notes``.
    """
    corpus = ("concat_ws(' ', nullif(name, ''), nullif(description, ''),"
              " nullif(free_text, ''))")
    label0 = f"regexp_extract(_c, {q(fixed.MPN_LABEL_RX)}, 0)"
    label1 = f"regexp_extract(_c, {q(fixed.MPN_LABEL_RX)}, 1)"
    token = f"regexp_extract(_c, {q(fixed.MPN_TOKEN_RX)}, 0)"
    maker = (f"get(filter(specs, s -> lower(trim(s.key)) IN {in_list(fixed.MANUFACTURER_KEYS)}"
             f" AND s.value <> ''), 0).value")
    df = stage(df, _i=let("_c", corpus, (
        f"named_struct('own', nullif(trim(mpn), ''), 'l0', nullif({label0}, ''),"
        f" 'l1', {label1}, 't', nullif({token}, ''),"
        f" 'gtin', nullif(regexp_extract(_c, {q(fixed.GTIN_RX)}, 1), ''))")))
    df = stage(df, identity=(
        "map('mpn', coalesce(_i.own, CASE WHEN _i.l0 IS NOT NULL THEN"
        " trim(BOTH ' .' FROM _i.l1) END, _i.t),"
        " 'sku', nullif(trim(sku), ''), 'brand', brand_name,"
        f" 'manufacturer', {squash(maker)},"
        " 'brand_country', brand_entry.country,"
        " 'gtin', _i.gtin)"), identity_notes=(
        "filter(array("
        "CASE WHEN _i.own IS NULL AND _i.l0 IS NOT NULL"
        " THEN concat('Recovered from text: \"', trim(_i.l0), '\"')"
        " WHEN _i.own IS NULL AND _i.t IS NOT NULL"
        " THEN concat('Pattern-matched token \"', _i.t, '\" in the product text') END,"
        "CASE WHEN brand_entry IS NOT NULL AND lower(brand_name) <> lower(brand)"
        " THEN concat('Brand \\'', brand, '\\' normalized to \\'', brand_name, '\\'.') END,"
        "CASE WHEN price IS NOT NULL AND (currency IS NULL OR currency = '')"
        " THEN 'Price supplied without a currency; assumed to need confirmation.' END"
        "), n -> n IS NOT NULL)"))
    return df.drop("_i")


def normalize(df: DataFrame) -> DataFrame:
    """N1-N6 together."""
    return identity(canonical_brand(clean_text(empty_flag(df))))
