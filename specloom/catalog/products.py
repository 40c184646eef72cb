"""Normalising, identifying and classifying products; distributor rows and supplier CSV shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import escape_rx
from ..functions.stage import shared_folder
from ..operators import classify as C, normalize as N
from ..plans.taxonomy import Taxonomy, brand_listing
from ..plans.testbed import PRODUCTS, SPEC_ROWS, products, view
from ..sources import feeds
from .registry import query, values

_P = f"p AS ({PRODUCTS})"
_SP = f"s AS ({SPEC_ROWS})"


def _sq(x):
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_CLEAN = f"""c AS (SELECT id, {_sq('sku')} AS sku, {_sq('mpn')} AS mpn, {_sq('brand')} AS brand, {_sq('name')} AS name,
  {_sq('description')} AS description, {_sq('category_hint')} AS category_hint, {_sq('free_text')} AS free_text, price, currency FROM p)"""


@query("clean_text", f"WITH {_P}, {_CLEAN} SELECT id, name, description, category_hint, free_text FROM c")
def clean_text(spark, sf):
    """N1"""
    return N.clean_text(products(spark, sf)).select("id", "name", "description", "category_hint", "free_text")


_BRANDS = values([(p, i, c, k, ",".join(cats)) for i, (p, (c, k, cats)) in enumerate(fixed.BRANDS.items())],
                 "probe", "pos", "canonical", "country", "made", name="b")
_PROBE = "regexp_replace(regexp_replace(lower(trim(brand)), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')"
_BRANDED = f"""t AS (SELECT c.id, b.*, row_number() OVER (PARTITION BY c.id ORDER BY CASE WHEN b.probe = {_PROBE} THEN 0
    WHEN starts_with({_PROBE}, b.probe || ' ') THEN 1 ELSE 2 END, b.pos) AS rn FROM c JOIN b ON b.probe = {_PROBE}
    OR starts_with({_PROBE}, b.probe || ' ') OR list_contains(string_split({_PROBE}, ' '), b.probe)),
br AS (SELECT c.*, t.canonical, t.country, t.made, coalesce(t.canonical, trim(c.brand)) AS brand_name
  FROM c LEFT JOIN t ON t.id = c.id AND t.rn = 1)"""


@query("canonical_brand", f"WITH {_P}, {_CLEAN}, {_BRANDS}, {_BRANDED} SELECT id, brand_name, country FROM br")
def canonical_brand(spark, sf):
    """N2"""
    return N.canonical_brand(N.clean_text(products(spark, sf))).select("id", "brand_name", F.col("brand_entry.country").alias("country"))


_CORPUS = "concat_ws(' ', nullif(name, ''), nullif(description, ''), nullif(free_text, ''))"
_LABEL = fixed.MPN_LABEL_RX.replace("'", "''")
_TOKEN = fixed.MPN_TOKEN_RX.replace("(?=[A-Z0-9\\-]*\\d)", "")
_IDENT = f"""mk AS (SELECT id, {_sq('arg_min(value, pos)')} AS maker FROM s
  WHERE lower(trim(key)) IN ('manufacturer', 'part manuf', 'mfr') AND value <> '' GROUP BY id),
i AS (SELECT br.*, mk.maker, nullif(trim(mpn), '') AS own, regexp_extract({_CORPUS}, '{_LABEL}', 0) AS l0,
  regexp_extract({_CORPUS}, '{_LABEL}', 1) AS l1, regexp_extract({_CORPUS}, '{_TOKEN}', 0) AS tk,
  regexp_extract({_CORPUS}, '{fixed.GTIN_RX}', 1) AS gt FROM br LEFT JOIN mk USING (id))"""


@query("identity", f"""WITH {_P}, {_SP}, {_CLEAN}, {_BRANDS}, {_BRANDED}, {_IDENT}
SELECT id, coalesce(own, CASE WHEN l0 <> '' THEN trim(l1, ' .') END, nullif(tk, '')) AS part_number, nullif(gt, '') AS gtin,
  maker AS manufacturer, country, concat_ws(' | ',
    CASE WHEN own IS NULL AND l0 <> '' THEN 'Recovered from text: "' || trim(l0) || '"'
      WHEN own IS NULL AND tk <> '' THEN 'Pattern-matched token "' || tk || '" in the product text' END,
    CASE WHEN canonical IS NOT NULL AND lower(brand_name) <> lower(brand) THEN 'Brand ''' || brand || ''' normalized to ''' || brand_name || '''.' END,
    CASE WHEN price IS NOT NULL AND coalesce(currency, '') = '' THEN 'Price supplied without a currency; assumed to need confirmation.' END) AS notes
FROM i""")
def identity(spark, sf):
    """N3, N4, N5"""
    df = N.normalize(products(spark, sf))
    return df.select("id", F.col("identity.mpn").alias("part_number"), F.col("identity.gtin").alias("gtin"),
                     F.col("identity.manufacturer").alias("manufacturer"), F.col("identity.brand_country").alias("country"),
                     F.array_join("identity_notes", " | ").alias("notes"))


@query("empty_records", """SELECT l_orderkey * 10 + l_linenumber AS id, count(*) AS rows,
  count(*) FILTER (WHERE l_linenumber >= 3 AND l_returnflag <> 'A') AS empty FROM {lineitem} GROUP BY 1""")
def empty_records(spark, sf):
    """N6"""
    df = view(spark, sf, """SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber < 3 THEN 'S' END AS sku,
      CASE WHEN l_returnflag = 'A' THEN 'x' ELSE '' END AS name, CAST(NULL AS STRING) AS mpn, CAST(NULL AS STRING) AS brand,
      '' AS description, CAST(NULL AS STRING) AS free_text, CAST(NULL AS STRING) AS category_hint,
      CAST(array() AS ARRAY<STRUCT<key:STRING,value:STRING,locator:STRING>>) AS specs FROM {lineitem}""", "lineitem")
    return N.empty_flag(df).groupBy("id").agg(F.count("*").alias("rows"), F.count_if("is_empty").alias("empty"))


# ---------------------------------------------------------------- classify

_tax = Taxonomy()
_CAT = values([(c["code"], i, c["path"][-1], " > ".join(c["path"])) for i, c in enumerate(_tax.categories)],
              "code", "cpos", "leaf", "path", name="cat")
_KW = values([(c["code"], i, k, "\\b" + escape_rx(k) + "\\b", 2.5 if " " in k else 1.5)
              for c in _tax.categories for i, k in enumerate(c["keywords"])], "code", "kpos", "kw", "rx", "w", name="kw")
_PAT = values([(c["code"], "(?i)^(?:" + p.replace("(?![0-9])", "") + ")") for c in _tax.categories for p in c["mpn_patterns"]],
              "code", "rx", name="pat")
_MEN = values([(c["code"], j, i, n, "\\b" + escape_rx(n) + "\\b") for c in _tax.categories for j, a in enumerate(c["attributes"])
               for i, n in enumerate([a["label"].lower(), a["key"].replace("_", " "), *[x.lower() for x in a["aliases"]]])
               if len(n) > 3], "code", "apos", "npos", "n", "rx", name="men")
_CLASS = f"""sx AS (SELECT id, string_agg(key || ' ' || value, ' ' ORDER BY pos) AS sp FROM s GROUP BY id),
h AS (SELECT i.*, coalesce(own, CASE WHEN l0 <> '' THEN trim(l1, ' .') END, nullif(tk, '')) AS pn,
  regexp_replace(lower(concat_ws(' ', nullif(name, ''), nullif(description, ''), nullif(free_text, ''), nullif(category_hint, ''), sp)), '\\s+', ' ', 'g') AS hay,
  lower(concat_ws(' ', nullif(name, ''), nullif(category_hint, ''))) AS nm FROM i LEFT JOIN sx USING (id)),
r AS (
  SELECT id, kw.code, 0 AS o1, kpos AS o2, w AS pts, 'matched keyword ''' || kw || '''' AS txt FROM h JOIN kw ON regexp_matches(hay, rx)
  UNION ALL SELECT id, pat.code, 1, 0, 4.0, 'part number matches the ' || leaf || ' pattern' FROM h JOIN pat ON regexp_matches(trim(pn), rx) JOIN cat ON cat.code = pat.code
  UNION ALL SELECT id, code, 2, apos, 0.6, 'input mentions ''' || arg_min(n, npos) || '''' FROM h JOIN men ON regexp_matches(hay, rx) GROUP BY id, code, apos
  UNION ALL SELECT id, code, 3, 0, 3.0, 'category hint ''' || any_value(category_hint) || ''' points here' FROM h JOIN kw ON contains(lower(category_hint), kw) GROUP BY id, code
  UNION ALL SELECT id, cat.code, 4, 0, 1.5, canonical || ' manufactures in this category' FROM h JOIN cat ON list_contains(string_split(made, ','), cat.code)),
sc AS (SELECT r.id, r.code, any_value(cpos) AS cpos, CAST(sum(pts) AS DOUBLE) AS score, bool_or(o1 = 1) AS by_mpn FROM r JOIN cat USING (code) GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, cpos) AS n FROM sc),
top AS (SELECT a.id, a.code, a.score, a.by_mpn, coalesce(b.score, 0) AS runner,
  EXISTS (SELECT 1 FROM kw WHERE kw.code = a.code AND contains(h.nm, kw.kw)) AS named, h.nm
  FROM rk a LEFT JOIN rk b ON b.id = a.id AND b.n = 2 JOIN h ON h.id = a.id WHERE a.n = 1),
cf AS (SELECT *, NOT by_mpn AND NOT named AND nm <> '' AS capped,
  round(least(0.35 + 0.45 * least(score / 9, 1.0) + 0.20 * ((score - runner) / score), 0.99), 3) AS base FROM top),
fin AS (SELECT *, CASE WHEN capped THEN least(base, 0.5) ELSE base END AS confidence FROM cf)"""
_CTX = f"WITH {_P}, {_SP}, {_CLEAN}, {_BRANDS}, {_BRANDED}, {_IDENT}, {_CAT}, {_KW}, {_PAT}, {_MEN}, {_CLASS}"


def _classified(spark, sf):
    return C.classify(N.normalize(products(spark, sf)))


@query("classify", _CTX + """
SELECT id, fin.code, cat.path, round(confidence, 2) AS confidence, round(score, 2) AS score FROM fin JOIN cat USING (code)""")
def classify(spark, sf):
    """C0-C7, C10"""
    return _classified(spark, sf).where("category IS NOT NULL").select(
        "id", F.col("category.code").alias("code"), F.array_join("category.path", " > ").alias("path"),
        F.round("category.confidence", 2).alias("confidence"), F.round("category.score", 2).alias("score"))


@query("classification_rationale", _CTX + """,
tx AS (SELECT r.id, r.txt, min(o1 * 1000 + o2) AS o FROM r JOIN fin ON fin.id = r.id AND fin.code = r.code GROUP BY 1, 2
  UNION ALL SELECT id, 'confidence capped: no category keyword appears in the product name, so the match rests on surrounding description text', 9000 FROM fin WHERE capped),
tn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS n FROM tx)
SELECT id, string_agg(txt, '; ' ORDER BY n) AS rationale FROM tn WHERE n <= 6 GROUP BY id""")
def classification_rationale(spark, sf):
    """C9, C10"""
    return C.assignment(_classified(spark, sf)).select("id", "rationale")


@query("classification_alternatives", _CTX + """
SELECT rk.id, rk.n - 1 AS place, rk.code, round(rk.score, 2) AS score,
  round(least(rk.score / greatest(fin.score, 1e-6), 1.0) * confidence, 2) AS confidence
FROM rk JOIN fin USING (id) WHERE rk.n BETWEEN 2 AND 4""")
def classification_alternatives(spark, sf):
    """C8"""
    df = _classified(spark, sf).select("id", F.posexplode_outer("category.alternatives").alias("p", "a"))
    return df.where("a IS NOT NULL").select("id", (F.col("p") + 1).cast("bigint").alias("place"), "a.code", "a.score",
                                            F.round("a.confidence", 2).alias("confidence"))


@query("weakly_classified", _CTX + """
SELECT p.id, fin.code FROM p LEFT JOIN fin ON fin.id = p.id WHERE fin.id IS NULL OR confidence < 0.65""")
def weakly_classified(spark, sf):
    """L1"""
    return C.weakly_classified(_classified(spark, sf)).select("id", F.col("category.code").alias("code"))


@query("taxonomy_listing", f"""WITH {_CAT}, {_KW}, {values([(c['code'], len(c['attributes']), len(c['required'])) for c in _tax.categories], 'code', 'attributes', 'required', name='n')},
t AS (SELECT p_partkey % 10 AS k, count(*) AS parts FROM {{part}} GROUP BY 1)
SELECT cat.code, cat.path, n.attributes, n.required, t.parts FROM cat JOIN n USING (code) JOIN t ON t.k = cat.cpos""")
def taxonomy_listing(spark, sf):
    """B2: the listing, with how many parts stand at each position of it."""
    parts = view(spark, sf, "SELECT p_partkey % 10 AS k, count(*) AS parts FROM {part} GROUP BY 1", "part")
    cats = Taxonomy().category_df(spark).select("code", F.col("pos").cast("bigint").alias("k"))
    return (Taxonomy().listing(spark).join(cats, "code").join(parts, "k")
            .select("code", "path", "attributes", "required", "parts"))


@query("brand_listing", f"""WITH {values([(c,) for c in sorted({v[0] for v in fixed.BRANDS.values()})], 'brand', name='b')},
u AS (SELECT upper(brand) AS brand FROM b UNION SELECT upper(p_brand) FROM {{part}}) SELECT brand FROM u""")
def distinct_brands(spark, sf):
    """B2"""
    parts = view(spark, sf, "SELECT upper(p_brand) AS brand FROM {part}", "part")
    return brand_listing(spark).select(F.upper("brand").alias("brand")).union(parts).distinct()


@query("learned_categories", f"""WITH {_CAT}, x AS (SELECT DISTINCT '99' || lpad(CAST(p_size AS STRING), 6, '0') AS code, p_type AS leaf FROM {{part}}
  UNION ALL SELECT code, 'shadow' FROM cat), k AS (SELECT code, min(leaf) AS leaf FROM x WHERE code NOT IN (SELECT code FROM cat) GROUP BY code)
SELECT code, leaf, false AS learned FROM cat UNION ALL SELECT code, leaf, true FROM k""")
def learned_categories(spark, sf):
    """Curated categories win over learned ones with the same code."""
    learned = view(spark, sf, "SELECT '99' || lpad(CAST(p_size AS STRING), 6, '0') AS code, min(p_type) AS leaf FROM {part} GROUP BY 1", "part")
    curated = Taxonomy().category_df(spark).select("code", "leaf")
    shadow = curated.select("code", F.lit("shadow").alias("leaf"))
    extra = learned.unionByName(shadow).join(curated.select("code"), "code", "left_anti")
    return curated.withColumn("learned", F.lit(False)).unionByName(extra.withColumn("learned", F.lit(True)))


# --------------------------------------------------------- distributor rows

_ROWS = """
SELECT p_partkey AS id, 'MP-' || CAST(p_partkey AS STRING) AS Mfg_Part_Num,
  CASE p_partkey % 4 WHEN 0 THEN 'SKF bearing  ' || p_name WHEN 1 THEN 'Parker Hannifin hose' WHEN 2 THEN '-' ELSE 'xParker ' || p_name END AS Part_Desc,
  CASE p_partkey % 5 WHEN 0 THEN '-- Unbranded --' WHEN 1 THEN 'Acme' WHEN 2 THEN 'n/a' ELSE NULL END AS E1_Brand,
  CASE WHEN p_partkey % 6 = 1 THEN 'House' ELSE '-- No Feed Brand --' END AS Feed_Brand,
  CASE WHEN p_partkey % 7 = 1 THEN 'ACME' WHEN p_partkey % 7 = 2 THEN 'Other' ELSE '-' END AS DIB_Brand,
  CASE WHEN p_partkey % 3 = 0 THEN 'Freud Inc (2435)' WHEN p_partkey % 3 = 1 THEN 'Boise Cascade' END AS Part_Manuf,
  CASE WHEN p_partkey % 4 = 1 THEN 'Acme' END AS Manufacturer_Name,
  'S' || CAST(p_size AS STRING) AS SKU, 'Hardware' AS Dept, p_type AS Class, CASE WHEN p_size % 2 = 0 THEN 'none' ELSE 'Fine' END AS Fine,
  CASE WHEN p_size % 3 = 0 THEN 'x' ELSE '' END AS Warehouse FROM {part}"""


def _real(x):
    return (f"CASE WHEN regexp_matches({_sq(x)}, '{fixed.PLACEHOLDER_RX}') OR lower({_sq(x)}) IN"
            " ('-', '--', 'commodity - unbranded', 'n/a', 'none', 'unbranded') THEN NULL ELSE nullif(" + _sq(x) + ", '') END")


_RCTX = f"""WITH {_BRANDS}, raw AS ({_ROWS}), v AS (SELECT id, {_real('Mfg_Part_Num')} AS mpn, {_real('Part_Desc')} AS d, {_real('E1_Brand')} AS e1,
  {_real('Feed_Brand')} AS fb, {_real('DIB_Brand')} AS db, {_real('Part_Manuf')} AS vend, {_real('Manufacturer_Name')} AS maker, {_real('SKU')} AS sku,
  {_real('Dept')} AS dept, {_real('Class')} AS cls, {_real('Fine')} AS fine, raw.* EXCLUDE (id, SKU, Dept, Class, Fine) FROM raw),
tb AS (SELECT v.id, arg_max(b.canonical, length(b.probe) * 1000 - b.pos) AS found FROM v JOIN b
  ON contains(' ' || regexp_replace(lower(v.d), '[^a-z0-9 ]', ' ', 'g') || ' ', ' ' || b.probe || ' ') GROUP BY v.id),
w AS (SELECT v.*, coalesce(fb, e1, db, found) AS brand, CASE WHEN fb IS NOT NULL THEN 'brand_feed' WHEN e1 IS NOT NULL THEN 'brand_e1'
    WHEN db IS NOT NULL THEN 'brand_dib' WHEN found IS NOT NULL THEN 'part_desc' END AS brand_source,
  nullif(trim(regexp_replace(vend, '\\s*\\(([^()]{{2,10}})\\)\\s*$', '')), '') AS vendor,
  nullif(regexp_extract(vend, '\\s*\\(([^()]{{2,10}})\\)\\s*$', 1), '') AS vendor_code FROM v LEFT JOIN tb USING (id))"""


def _rows(spark, sf):
    return feeds.from_catalog_rows(view(spark, sf, _ROWS, "part"))


@query("catalog_rows", _RCTX + """
SELECT id, sku, mpn, brand, d AS name, nullif(concat_ws(' > ', dept, cls, fine), '') AS hint, brand_source,
  concat_ws(' | ', 'Manufacturer=' || maker, 'Vendor=' || vendor, CASE WHEN brand_source <> 'brand_feed' THEN 'FEED Brand=' || fb END,
    CASE WHEN brand_source <> 'brand_e1' THEN 'E1 Brand=' || e1 END, CASE WHEN brand_source <> 'brand_dib' THEN 'DIB Brand=' || db END) AS specs FROM w""")
def catalog_rows(spark, sf):
    """S2, N7, N8, N9"""
    return _rows(spark, sf).select("id", "sku", "mpn", "brand", "name", F.col("category_hint").alias("hint"), "brand_source",
                                   F.expr("array_join(transform(specs, s -> concat(s.key, '=', s.value)), ' | ')").alias("specs"))


@query("row_report", _RCTX + f"""
SELECT id, vendor, vendor_code, CASE WHEN Warehouse <> '' THEN 'Warehouse' ELSE '' END AS unmapped, concat_ws(' | ', {', '.join(
    f"CASE WHEN {_real(c)} IS NULL AND {_sq(c)} <> '' THEN '{c} = ' || {_sq(c)} END" for c in
    ['Mfg_Part_Num', 'Part_Desc', 'E1_Brand', 'Feed_Brand', 'DIB_Brand', 'Part_Manuf', 'Manufacturer_Name'])},
  CASE WHEN fine IS NULL THEN 'Fine = none' END) AS placeholders FROM w""")
def row_report(spark, sf):
    """N7b, N10, S14"""
    return _rows(spark, sf).select("id", "vendor", "vendor_code", F.array_join("unmapped_columns", ",").alias("unmapped"),
                                   F.array_join("placeholders_dropped", " | ").alias("placeholders"))


@query("row_notes", _RCTX + """
SELECT id, concat_ws(' | ',
  CASE WHEN len(list_distinct(list_filter([lower(fb), lower(e1), lower(db)], lambda x: x IS NOT NULL))) > 1 THEN 'Brand columns disagree (' ||
    concat_ws('; ', 'feed=' || fb, 'e1=' || e1, 'dib=' || db) || '). Took the ' || replace(brand_source, 'brand_', '') || ' value; the others are recorded for review.' END,
  CASE WHEN brand_source = 'part_desc' THEN 'No brand column had a value; recognised ''' || brand || ''' in the description against the approved brand list.' END,
  CASE WHEN maker IS NULL AND vendor IS NOT NULL THEN 'Manufacturer left empty: ''' || vendor || ''' is the supplying vendor, which may or may not be the maker. It needs resolving against the approved manufacturer list before it can be published.' END,
  CASE WHEN brand IS NOT NULL AND maker IS NOT NULL AND lower(brand) <> lower(maker) THEN 'Brand ''' || brand || ''' and manufacturer ''' || maker || ''' differ. Legitimate for a house brand, but worth confirming against the approved list.' END) AS notes FROM w""")
def row_notes(spark, sf):
    """N8, N11"""
    return _rows(spark, sf).select("id", F.array_join("row_notes", " | ").alias("notes"))


@query("supplier_csv", """
SELECT p_partkey AS id, nullif(p_name, '') AS name, p_brand AS brand, CASE WHEN p_size % 9 = 0 THEN NULL
    WHEN p_size % 4 = 1 THEN NULL ELSE CAST(1000 + p_size AS DOUBLE) END AS price,
  concat_ws(' | ', CASE WHEN p_size % 5 <> 0 THEN 'Size (mm)=' || CAST(p_size AS STRING) END, 'Finish=' || p_type,
    CASE WHEN p_size % 9 <> 0 AND p_size % 4 = 1 THEN 'price_raw=call' END) AS specs FROM {part}""")
def supplier_csv(spark, sf):
    """The shaping applied to every row read from a supplier file."""
    raw = view(spark, sf, """SELECT p_partkey AS row_id, p_name AS Name, ' ' || p_brand || ' ' AS `Brand `, CASE WHEN p_size % 9 = 0 THEN ''
      WHEN p_size % 4 = 1 THEN 'call' ELSE '1,0' || lpad(CAST(p_size AS STRING), 2, '0') END AS Price,
      CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS STRING) ELSE '' END AS `Size (mm)`, p_type AS Finish FROM {part}""", "part")
    return feeds.shape_supplier(raw, "row_id").select("id", "name", "brand", "price", F.expr(
        "array_join(transform(specs, s -> concat(s.key, '=', s.value)), ' | ')").alias("specs"))


@query("supplier_file", """
SELECT l_orderkey * 10 + l_linenumber AS sku, 'Item ' || CAST(l_partkey AS STRING) || CASE WHEN l_linenumber % 3 = 0 THEN chr(10) || 'second "line", more' ELSE '' END AS name, CAST(1000 + l_quantity AS DOUBLE) AS price,
  concat_ws(' | ', 'Size (mm)=' || CAST(CAST(l_quantity AS BIGINT) AS STRING), CASE WHEN l_linenumber % 2 = 0 THEN 'Notes=a' || chr(10) || chr(10) || 'b ""c""' END) AS specs FROM {lineitem}""")
def supplier_file(spark, sf):
    """A supplier's CSV file of all order lines, quoted line breaks included, written and read back in byte ranges."""
    rows = view(spark, sf, """SELECT l_orderkey * 10 + l_linenumber AS SKU, 'Item ' || CAST(l_partkey AS STRING) || CASE WHEN l_linenumber % 3 = 0 THEN char(10) || 'second "line", more' ELSE '' END AS Name,
      '1,0' || lpad(CAST(CAST(l_quantity AS BIGINT) AS STRING), 2, '0') || '.00' AS Price, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS `Size (mm)`,
      CASE WHEN l_linenumber % 2 = 0 THEN 'a' || char(10) || char(10) || 'b ""c""' ELSE '' END AS Notes FROM {lineitem}""", "lineitem")
    path = shared_folder(spark, "feed")
    rows.write.csv(path, header=True, quoteAll=True, escape='"')
    return feeds.read_supplier_csv(spark, path).select(F.col("sku").cast("bigint").alias("sku"), "name", "price", F.expr(
        "array_join(transform(specs, s -> concat(s.key, '=', s.value)), ' | ')").alias("specs"))
