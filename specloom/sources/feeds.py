"""Supplier CSV files and distributor rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed
from ..functions.text import in_list, let, q, squash
from ..plans.taxonomy import brand_row
from .split_csv import read_csv

_EMPTY_SPECS = "CAST(array() AS ARRAY<STRUCT<key:STRING,value:STRING,locator:STRING>>)"


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# ------------------------------------------------------------- supplier CSV


def read_supplier_csv(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """Supplier CSV with a header to products.

    Ids come from the file's name and the row, so they do not change with partitioning; rows
    that repeat within a file share one.  Files are split over many tasks; where ``line_breaks`` is
    false, quoted cells are taken to hold no line break, which saves counting quotes.
    """
    if line_breaks:
        raw = read_csv(spark, path)
    else:
        raw = spark.read.csv(path, header=True, escape='"', encoding="UTF-8")
        raw = raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("_file"), "*")
    row_id = F.xxhash64("_file", *[F.col(f"`{c}`") for c in raw.columns if c != "_file"])
    return shape_supplier(raw.withColumn("_row_id", row_id).drop("_file"), "_row_id")


def shape_supplier(raw: DataFrame, id_column: str | None = None) -> DataFrame:
    """Recognised columns become fields, every other one an ordered spec pair."""
    fields, specs = {}, []
    for name in raw.columns:
        if name == id_column:
            continue
        bare = name.lstrip("﻿").strip()
        key = bare.lower().replace(" ", "_")
        if key in fixed.SUPPLIER_COLUMNS:
            fields[key] = f"nullif(trim(CAST({_ident(name)} AS STRING)), '')"
        else:
            specs.append((bare, f"trim(CAST({_ident(name)} AS STRING))"))
    price = fields.pop("price", None)
    number = f"try_cast(replace({price}, ',', '') AS DOUBLE)" if price else "CAST(NULL AS DOUBLE)"
    pairs = [f"named_struct('key', {q(k)}, 'value', {v}, 'locator', CAST(NULL AS STRING))" for k, v in specs]
    if price:
        pairs.append(f"named_struct('key', 'price_raw', 'value', CASE WHEN {number} IS NULL THEN {price} END,"
                     " 'locator', CAST(NULL AS STRING))")
    made = f"filter(array({', '.join(pairs)}), s -> coalesce(s.value, '') <> '')" if pairs else _EMPTY_SPECS
    text = [c for c in fixed.SUPPLIER_COLUMNS if c != "price"]
    return raw.select(
        (F.col(id_column) if id_column else F.monotonically_increasing_id()).alias("id"),
        *[F.expr(fields.get(c, "CAST(NULL AS STRING)")).alias(c) for c in text],
        F.expr(number).alias("price"), F.lit(None).cast("string").alias("source_document"),
        F.expr(made).alias("specs"))


# ---------------------------------------------------------- distributor rows


def is_placeholder(x: str) -> str:
    """N7/N7b: '-- text --' shapes and literal stand-ins; null and empty are not placeholders."""
    return (f"coalesce(trim({x}) <> '' AND (trim({x}) RLIKE {q(fixed.PLACEHOLDER_RX)}"
            f" OR lower(trim({x})) IN {in_list(fixed.PLACEHOLDER_LITERALS)}), false)")


def real_value(x: str) -> str:
    return let("rv", squash(x), f"IF({is_placeholder('rv')}, NULL, nullif(rv, ''))")


def vendor_name(x: str) -> str:
    """N10: 'Freud Inc (2435)' -> 'Freud Inc'."""
    return f"nullif(trim(regexp_replace({x}, {q(fixed.VENDOR_CODE_RX)}, '')), '')"


def vendor_code(x: str) -> str:
    return f"nullif(trim(regexp_extract({x}, {q(fixed.VENDOR_CODE_RX)}, 1)), '')"


def brand_in_text(x: str, longest: int = 3) -> str:
    """Longest known brand standing as whole words in a text.

    Word runs of up to ``longest`` words are looked up in the dictionary, so the cost
    follows the text and not the size of the dictionary.
    """
    longest = max(longest, max(len(p.split()) for p in fixed.BRANDS))
    words = f"filter(split(regexp_replace(lower({x}), '[^a-z0-9 ]', ' '), ' '), w -> true)"
    runs = " , ".join(f"transform(w, (t, i) -> array_join(slice(w, i + 1, {n}), ' '))" for n in range(1, longest + 1))
    entry = ("CASE WHEN br IS NOT NULL THEN named_struct('n', length(t), 'p', -br.pos, 'c', br.canonical) END")
    found = let("w", words, f"array_distinct(flatten(array({runs})))")
    best = let("g", found, (
        f"array_max(filter(transform(filter(g, t -> t <> ''), t -> {let('br', brand_row('t'), entry)}), x -> x IS NOT NULL))"))
    return f"{best}.c"


def fold_column(name: str) -> str:
    return re.sub(r"[\s_\-]+", " ", name.strip().lower())


def column_targets(columns: list[str]) -> dict[str, str | None]:
    """Column -> field.  Any other '<name> brand' column is the feed's own brand."""
    out: dict[str, str | None] = {}
    for c in columns:
        folded = fold_column(c)
        target = fixed.ROW_COLUMNS.get(folded)
        if target is None and re.fullmatch(r"[a-z0-9]+ brand", folded):
            target = "brand_feed"
        out[c] = target
    return out


def from_catalog_rows(df: DataFrame, id_column: str = "id") -> DataFrame:
    """Distributor rows to products plus a report of what was done.

    The vendor never becomes the manufacturer; losing brand columns are kept as specs.
    """
    columns = [c for c in df.columns if c != id_column]
    targets = column_targets(columns)
    values: dict[str, str] = {}
    for c in columns:  # a later column with a usable value replaces an earlier one
        t = targets[c]
        if t:
            now = real_value(f"CAST({_ident(c)} AS STRING)")
            values[t] = f"coalesce({now}, {values[t]})" if t in values else now
    def val(t):
        return values.get(t, "CAST(NULL AS STRING)")
    feed_name = next((fold_column(c).split(" ")[0] for c in columns if targets[c] == "brand_feed"), "feed")
    order = [("brand_feed", feed_name), ("brand_e1", "e1"), ("brand_dib", "dib")]
    df = df.select(
        F.col(id_column).alias("id"),
        *[F.expr(val(t)).alias("v_" + t) for t in
          ["sku", "part_number", "mpn", "description", "vendor", "manufacturer", "dept", "class", "fine",
           "brand_feed", "brand_e1", "brand_dib"]],
        F.expr("filter(array(" + (", ".join(
            f"CASE WHEN {is_placeholder(f'CAST({_ident(c)} AS STRING)')} THEN concat({q(c + ' = ')},"
            f" {squash(f'CAST({_ident(c)} AS STRING)')}) END" for c in columns if targets[c]) or "CAST(NULL AS STRING)")
            + "), x -> x IS NOT NULL)").alias("placeholders_dropped"),
        F.expr("filter(array(" + (", ".join(
            f"CASE WHEN coalesce({squash(f'CAST({_ident(c)} AS STRING)')}, '') <> '' THEN {q(c)} END"
            for c in columns if not targets[c]) or "CAST(NULL AS STRING)")
            + "), x -> x IS NOT NULL)").alias("unmapped_columns"))
    brand_columns = "coalesce(v_brand_feed, v_brand_e1, v_brand_dib)"
    disagree = ("size(array_distinct(transform(filter(array(v_brand_feed, v_brand_e1, v_brand_dib),"
                " b -> b IS NOT NULL), b -> lower(b)))) > 1")
    df = (df.withColumn("_text_brand", F.expr(f"CASE WHEN {brand_columns} IS NULL THEN {brand_in_text('v_description')} END"))
          .withColumn("vendor", F.expr(vendor_name("v_vendor")))
          .withColumn("vendor_code", F.expr(vendor_code("v_vendor")))
          .withColumn("brand", F.expr(f"coalesce({brand_columns}, _text_brand)"))
          .withColumn("brand_source", F.expr(
              "CASE WHEN v_brand_feed IS NOT NULL THEN 'brand_feed' WHEN v_brand_e1 IS NOT NULL THEN 'brand_e1'"
              " WHEN v_brand_dib IS NOT NULL THEN 'brand_dib' WHEN _text_brand IS NOT NULL THEN 'part_desc' END")))
    seen = "concat_ws('; ', " + ", ".join(
        f"CASE WHEN v_{t} IS NOT NULL THEN concat({q(n + '=')}, v_{t}) END" for t, n in order) + ")"
    taken = "CASE brand_source " + " ".join(f"WHEN '{t}' THEN {q(n)}" for t, n in order) + " END"
    notes = (
        "filter(array("
        f"CASE WHEN {disagree} THEN concat('Brand columns disagree (', {seen}, '). Took the ', {taken},"
        " ' value; the others are recorded for review.') END,"
        "CASE WHEN brand_source = 'part_desc' THEN concat('No brand column had a value; recognised \\'', brand,"
        " '\\' in the description against the approved brand list.') END,"
        "CASE WHEN v_manufacturer IS NULL AND vendor IS NOT NULL THEN concat('Manufacturer left empty: \\'', vendor,"
        " '\\' is the supplying vendor, which may or may not be the maker. It needs resolving against the approved"
        " manufacturer list before it can be published.') END,"
        "CASE WHEN brand IS NOT NULL AND v_manufacturer IS NOT NULL AND lower(brand) <> lower(v_manufacturer)"
        " THEN concat('Brand \\'', brand, '\\' and manufacturer \\'', v_manufacturer, '\\' differ. Legitimate for a"
        " house brand, but worth confirming against the approved list.') END"
        "), n -> n IS NOT NULL)")
    pair = "named_struct('key', {k}, 'value', {v}, 'locator', CAST(NULL AS STRING))"
    specs = "filter(array(" + ", ".join(
        [pair.format(k="'Manufacturer'", v="v_manufacturer"), pair.format(k="'Vendor'", v="vendor")]
        + [pair.format(k=q(n.upper() + " Brand"), v=f"CASE WHEN brand_source <> '{t}' THEN v_{t} END")
           for t, n in order]) + "), s -> s.value IS NOT NULL)"
    return df.select(
        "id", F.expr("coalesce(v_sku, v_part_number)").alias("sku"), F.col("v_mpn").alias("mpn"), "brand",
        F.col("v_description").alias("name"), F.col("v_description").alias("description"),
        F.expr("nullif(concat_ws(' > ', v_dept, v_class, v_fine), '')").alias("category_hint"),
        F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("currency"),
        F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("string").alias("source_document"),
        F.col("v_description").alias("free_text"), F.expr(specs).alias("specs"),
        "placeholders_dropped", "unmapped_columns", "brand_source", "vendor", "vendor_code",
        F.expr(notes).alias("row_notes"))


# ---------------------------------------------------------- enriched records


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Enriched-record JSON files keyed by file name; an unreadable file is a miss."""
    text = spark.read.text(path, wholetext=True).withColumn(
        "record_key", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    parsed = text.withColumn("_r", F.from_json("value", schema + ", _corrupt_record string",
                                               {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.where("_r IS NOT NULL AND _r._corrupt_record IS NULL").select("record_key", "_r.*").drop("_corrupt_record")
