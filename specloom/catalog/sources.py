"""Documents, pages, source policy and page merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import policy as P
from ..plans.testbed import table, view
from ..sources import documents as D, web
from .registry import query, values

# ------------------------------------------------------- document testbed
# one document per part, two pages: labelled lines or gutter columns, then a second page
_DOC = r"""
SELECT p_partkey AS doc, 1 AS page, CASE p_partkey % 3
  WHEN 0 THEN 'DATASHEET 12\nDeep groove SKF ball bearing\nBore Diameter ........ ' || CAST(p_size AS STRING) || ' mm\nPart No: AB-' || CAST(p_partkey AS STRING) || '\nMass: 0.' || CAST(p_size AS STRING) || ' kg\nNote. this is prose'
  WHEN 1 THEN 'Technical Data\nRolling element table for ' || p_name || '\nPARAMETER            VALUE     UNIT\nBore Diameter        ' || lpad(CAST(p_size AS STRING), 4, ' ') || '      mm\nOuter Diameter       ' || lpad(CAST(p_size + 20 AS STRING), 4, ' ') || '      mm\nLimiting Speed       9000      rpm\nseals fitted   as usual\nCage: steel'
  ELSE '   \n' || upper(p_name) || '\nModel: QX' || CAST(p_size AS STRING) || '99' END AS text
FROM {part}
UNION ALL
SELECT p_partkey, 2, CASE p_partkey % 3 WHEN 0 THEN 'Bore Diameter: 99 mm\nSeal Type: 2RS' WHEN 1 THEN 'made by timken and parker hannifin today' ELSE '' END FROM {part}"""
_SPARK_DOC = _DOC.replace("\\n", "\\n")
_DUCK_DOC = _DOC.replace("\\n", "' || chr(10) || '")
_LN = f"pg AS ({_DUCK_DOC}), ln AS (SELECT doc, page, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM pg)"


def _dc(x):
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _ok(key="key", value="value", limit=120, document=True):
    t = [f"length({key}) BETWEEN 2 AND 48", f"length({value}) BETWEEN 1 AND {limit}", f"NOT regexp_matches({key}, '[.?!]$')",
         f"len(string_split({key}, ' ')) <= 6", f"length(regexp_replace({key}, '[^A-Za-z]', '', 'g')) >= 2"]
    if document:
        t += [f"NOT (length({key}) <= 3 AND regexp_matches({value}, '^\\p{{Ll}}'))", f"length(regexp_replace({value}, '[^.…]', '', 'g')) < 4"]
    return " AND ".join(t)


_DOT, _COL = fixed.DOT_LEADER_RX, fixed.COLON_RX
_LP = f"""lp0 AS (SELECT doc, page, line, CASE WHEN regexp_matches(text, '{_DOT}') THEN {_dc(f"regexp_extract(text, '{_DOT}', 1)")} ELSE {_dc(f"regexp_extract(text, '{_COL}', 1)")} END AS key,
  CASE WHEN regexp_matches(text, '{_DOT}') THEN {_dc(f"regexp_extract(text, '{_DOT}', 2)")} ELSE {_dc(f"regexp_extract(text, '{_COL}', 2)")} END AS value
  FROM ln WHERE regexp_matches(text, '{_DOT}') OR regexp_matches(text, '{_COL}')), lp AS (SELECT * FROM lp0 WHERE {_ok()})"""
_HK = ", ".join(f"'{h}'" for h in fixed.KEY_HEADERS)
_HV = ", ".join(f"'{h}'" for h in fixed.VALUE_HEADERS)
_UN = ", ".join("'" + u.replace("'", "''") + "'" for u in fixed.UNITS)
_CP = f"""gc AS (SELECT doc, page, line, text, regexp_extract_all(text, '\\S+(?: \\S+)*') AS c FROM ln),
g1 AS (SELECT *, length(regexp_extract(text, '^\\s*', 0)) AS s0, c[1] AS k0, c[2] AS v0 FROM gc WHERE len(c) >= 2),
g2 AS (SELECT *, s0 + length(k0) + length(regexp_extract(substr(text, s0 + length(k0) + 1), '^\\s*', 0)) AS st FROM g1),
g3 AS (SELECT doc, page, line, st, st + length(v0) AS en, {_dc('k0')} AS key, {_dc(f"CASE WHEN len(c) = 3 AND (lower(trim(c[3], '.')) IN ({_UN}) OR rtrim(lower(trim(c[3], '.')), 's') IN ({_UN})) THEN v0 || ' ' || c[3] ELSE v0 END")} AS value
  FROM g2 WHERE NOT (lower({_dc('k0')}) IN ({_HK}) AND lower({_dc('v0')}) IN ({_HV}))),
cd AS (SELECT * FROM g3 WHERE {_ok()}),
an AS (SELECT doc, page, 0 AS edge, st AS a FROM cd UNION SELECT doc, page, 1, en FROM cd),
sz AS (SELECT an.doc, an.page, edge, a, count(*) AS n FROM an JOIN cd ON cd.doc = an.doc AND cd.page = an.page AND abs(CASE WHEN edge = 0 THEN st ELSE en END - a) <= 2 GROUP BY 1, 2, 3, 4),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY n DESC, edge, a) AS r FROM sz WHERE n >= 3) z WHERE r = 1),
cp AS (SELECT cd.doc, cd.page, line, key, value FROM cd JOIN bs ON cd.doc = bs.doc AND cd.page = bs.page AND abs(CASE WHEN edge = 0 THEN st ELSE en END - a) <= 2)"""


def _pages(spark, sf):
    return view(spark, sf, _SPARK_DOC, "part", heavy=True)


@query("line_pairs", f"WITH {_LN}, {_LP} SELECT doc, page, line, key, value FROM lp")
def line_pairs(spark, sf):
    """S3, S5b"""
    return D.line_pairs(_pages(spark, sf)).withColumn("line", F.col("line").cast("bigint"))


@query("column_pairs", f"WITH {_LN}, {_CP} SELECT doc, page, line, key, value FROM cp")
def column_pairs(spark, sf):
    """S4"""
    return D.column_pairs(_pages(spark, sf)).withColumn("line", F.col("line").cast("bigint"))


_CELLS = """
SELECT p_partkey AS doc, 1 AS page, p_size % 3 AS tbl, r.r AS row, c.c AS col, CASE
  WHEN r.r = 0 AND p_size % 2 = 0 THEN CASE c.c WHEN 0 THEN 'No' WHEN 1 THEN 'Parameter' WHEN 2 THEN 'Value' ELSE 'Remark' END
  WHEN r.r = 3 THEN '' WHEN c.c = 0 THEN CASE WHEN p_size % 2 = 0 THEN CAST(r.r AS STRING) ELSE '' END
  WHEN c.c = 1 THEN CASE r.r WHEN 0 THEN 'Finish' WHEN 1 THEN 'Bore  size' ELSE 'Width' END
  WHEN c.c = 2 THEN CAST(p_size + r.r AS STRING) || ' mm' ELSE 'typical' END AS text
FROM {part} {cross}"""
_DUCK_CELLS = _CELLS.replace("{cross}", ", (VALUES (0), (1), (2), (3)) r(r), (VALUES (0), (1), (2), (3)) c(c)")
_GP = f"""ce AS ({_DUCK_CELLS}), cl AS (SELECT doc, page, tbl, row, col, {_dc('text')} AS text FROM ce),
lv AS (SELECT * FROM cl WHERE (doc, tbl, row) IN (SELECT (doc, tbl, row) FROM cl WHERE text <> '')),
fr AS (SELECT doc, tbl, min(row) AS f FROM lv GROUP BY 1, 2),
sh AS (SELECT lv.doc, lv.tbl, any_value(f) AS f, min(col) FILTER (WHERE row = f AND lower(text) IN ({_HK})) AS k0, min(col) FILTER (WHERE row = f AND lower(text) IN ({_HV})) AS v0,
  list_sort(list(DISTINCT col) FILTER (WHERE text <> '')) AS used FROM lv JOIN fr ON fr.doc = lv.doc AND fr.tbl = lv.tbl GROUP BY 1, 2),
kc AS (SELECT *, CASE WHEN k0 IS NOT NULL AND v0 IS NOT NULL THEN k0 ELSE used[1] END AS kcol, CASE WHEN k0 IS NOT NULL AND v0 IS NOT NULL THEN v0 ELSE used[2] END AS vcol, k0 IS NOT NULL AND v0 IS NOT NULL AS named FROM sh),
gp0 AS (SELECT k.doc, k.tbl, k.row AS line, k.text AS key, v.text AS value FROM lv k JOIN kc ON kc.doc = k.doc AND kc.tbl = k.tbl AND k.col = kcol
  JOIN lv v ON v.doc = k.doc AND v.tbl = k.tbl AND v.row = k.row AND v.col = vcol WHERE NOT (named AND k.row = f)), gp AS (SELECT * FROM gp0 WHERE {_ok()})"""


def _cells(spark, sf):
    return view(spark, sf, _CELLS.replace("{cross}", "LATERAL VIEW explode(array(0, 1, 2, 3)) r AS r LATERAL VIEW explode(array(0, 1, 2, 3)) c AS c"), "part", heavy=True)


@query("grid_pairs", f"WITH {_GP} SELECT doc, tbl, line, key, value FROM gp")
def grid_pairs(spark, sf):
    """S5"""
    return D.grid_pairs(_cells(spark, sf)).select("doc", F.col("tbl"), F.col("line"), "key", "value")


_PS = f"""{_LN}, {_LP}, {_CP}, {_GP},
ps AS (SELECT doc, 1 AS page, 0 AS tier, (tbl, line) AS seq, key, value, 'table:lines' AS strategy FROM gp
  UNION ALL SELECT doc, page, 2, (0, line), key, value, 'text:columns' FROM cp WHERE (doc, page) NOT IN (SELECT (doc, page) FROM lp GROUP BY doc, page HAVING count(*) >= 3)
    AND NOT (page = 1 AND doc IN (SELECT doc FROM gp))
  UNION ALL SELECT doc, page, 3, (0, line), key, value, 'text:line-pairs' FROM lp),
ds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, key ORDER BY page, tier, seq) AS r FROM ps) z WHERE r = 1)"""


def _specs(spark, sf):
    return D.document_specs(_pages(spark, sf), _cells(spark, sf))


@query("document_specs", f"WITH {_PS} SELECT doc, key, value, 'page ' || CAST(page AS STRING) AS locator, strategy FROM ds")
def document_specs(spark, sf):
    """S6"""
    return _specs(spark, sf)


_BR = values([(p, i, c) for i, (p, (c, _, _)) in enumerate(fixed.BRANDS.items())], "probe", "pos", "canonical", name="b")
_BP = " OR ".join(f"contains(lower(t), '{w}')" for w in fixed.HEADING_BOILERPLATE)


@query("document_identity", f"""WITH {_BR}, {_LN},
bb AS (SELECT doc, arg_max(canonical, length(probe) * 1000 - pos) AS brand FROM pg JOIN b ON regexp_matches(lower(text), '\\b' || probe || '\\b') GROUP BY doc),
mm AS (SELECT doc, arg_min(trim(regexp_extract(text, '{fixed.DOC_MPN_RX}', 1), ' .'), page) AS mpn FROM pg WHERE regexp_extract(text, '{fixed.DOC_MPN_RX}', 1) <> '' GROUP BY doc),
hh AS (SELECT doc, arg_min(t, page * 1000 + line) AS name FROM (SELECT doc, page, line, {_dc('text')} AS t FROM ln) z WHERE length(t) BETWEEN 8 AND 90
  AND NOT regexp_full_match(t, '[A-Z0-9\\-/. ]+') AND NOT ({_BP}) AND len(string_split(t, ' ')) >= 2 GROUP BY doc)
SELECT p_partkey AS doc, brand, mpn, name FROM {{part}} LEFT JOIN bb ON bb.doc = p_partkey LEFT JOIN mm ON mm.doc = p_partkey LEFT JOIN hh ON hh.doc = p_partkey""")
def document_identity(spark, sf):
    """S7"""
    return D.document_identity(_pages(spark, sf))


@query("document_report", f"""WITH {_PS}, t AS (SELECT doc, count(*) AS pages, sum(length(text)) + count(*) - 1 AS text_chars, bool_or(trim(text, ' ' || chr(10)) <> '') AS has FROM pg GROUP BY doc),
q AS (SELECT doc, count(*) AS spec_pairs, list_aggregate(list_sort(list(DISTINCT strategy)), 'string_agg', ',') AS strategies FROM ds GROUP BY doc)
SELECT doc, pages, CAST(text_chars AS BIGINT) AS text_chars, coalesce(spec_pairs, 0) AS spec_pairs, coalesce(strategies, '') AS strategies, CASE WHEN spec_pairs IS NULL AND NOT has THEN
  'No text layer found. This is likely a scanned PDF; OCR would be required to read it.' WHEN spec_pairs IS NULL THEN
  'No spec table detected — the full text was passed through for pattern extraction instead.' ELSE '' END AS note FROM t LEFT JOIN q USING (doc)""")
def document_report(spark, sf):
    """S13"""
    return D.ingest_report(_pages(spark, sf), _cells(spark, sf))


# ------------------------------------------------------------------- pages

_HTML = """SELECT p_partkey AS page_id, 'https://shop.example/' || CAST(p_partkey AS STRING) AS url,
  '<html><head><title>t</title>' || CASE p_partkey % 4
    WHEN 0 THEN '<script type="application/ld+json">{"@type":"Product","name":"' || p_name || '","sku":"K' || CAST(p_size AS STRING) || '","brand":{"name":"SKF"},"offers":{"price":"' || CAST(p_size AS STRING) || '.5","priceCurrency":"EUR"},"weight":{"value":"' || CAST(p_size AS STRING) || '","unitText":"kg"},"additionalProperty":[{"name":"Bore","value":"25 mm"}]}</script>'
    WHEN 1 THEN '<script type="application/ld+json">{"@graph":[{"@type":"WebPage","name":"no"},{"@type":["Product","Thing"],"name":"' || p_name || '","brand":"FAG","offers":[{"price":"7"}],"color":"Blue"}]}</script>'
    WHEN 2 THEN '<meta property="og:title" content="Open ' || p_name || '"><meta content="About it" name="description">' ELSE '' END
  || '</head><body><header><h1>Shop front</h1></header><nav><h2>Menu</h2><li>Menu: hidden item</li></nav><h1>Big <b>' || p_name || '</b></h1><table><tr><th>Width</th><td> ' || CAST(p_size AS STRING) || ' &quot; </td></tr><tr><td>only</td></tr><tr><td>12</td><td>x</td></tr></table>'
  || '<dl><dt>Finish</dt><dd>' || p_type || '</dd><dt>Width</dt><dd>dup</dd></dl><ul><li>Grade: A' || CAST(p_size AS STRING) || '</li><li>no pair here</li></ul><footer>foot</footer></body></html>' AS html
FROM {part}"""


def _html(spark, sf):
    return view(spark, sf, _HTML, "part", heavy=True)


@query("json_ld_products", """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 4 < 2 THEN p_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN 'K' || CAST(p_size AS STRING) END AS sku,
  CASE p_partkey % 4 WHEN 0 THEN 'SKF' WHEN 1 THEN 'FAG' END AS brand, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) + 0.5 WHEN 1 THEN 7.0 END AS price,
  CASE WHEN p_partkey % 4 = 0 THEN 'EUR' END AS currency, CASE p_partkey % 4 WHEN 0 THEN 'Bore=25 mm|Weight=' || CAST(p_size AS STRING) || ' kg' WHEN 1 THEN 'Color=Blue' END AS specs FROM {part}""")
def json_ld_products(spark, sf):
    """S8"""
    return web.json_ld(_html(spark, sf)).select("page_id", "ld.name", "ld.sku", "ld.brand", "ld.price", "ld.currency",
                                                F.expr("array_join(transform(ld.specs, s -> concat(s.key, '=', s.value)), '|')").alias("specs"))


@query("json_ld_fields", """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 4 < 2 THEN p_name END AS name, CASE p_partkey % 4 WHEN 0 THEN 'SKF' WHEN 1 THEN 'FAG' END AS brand,
  CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) + 0.5 WHEN 1 THEN 7.0 END AS price,
  CASE p_partkey % 4 WHEN 0 THEN 'Bore=25 mm|Weight=' || CAST(p_size AS STRING) || ' kg' WHEN 1 THEN 'Color=Blue' END AS specs FROM {part}""")
def json_ld_fields(spark, sf):
    """S8"""
    return json_ld_products(spark, sf).select("page_id", "name", "brand", "price", "specs")


@query("html_specs", """SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN 'Bore=25 mm|Weight=' || CAST(p_size AS STRING) || ' kg|' WHEN 1 THEN 'Color=Blue|' ELSE '' END ||
  'Width=' || CAST(p_size AS STRING) || ' "|Finish=' || p_type || '|Menu=hidden item|Grade=A' || CAST(p_size AS STRING) AS specs FROM {part}""")
def html_specs(spark, sf):
    """S9, S11"""
    return web.html_specs(web.json_ld(_html(spark, sf))).select("page_id", F.expr(
        "array_join(transform(spec_pairs, p -> concat(p.key, '=', p.value)), '|')").alias("specs"))


@query("page_text", """SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN 'Open ' || p_name ELSE 'Big ' || p_name END AS name,
  CASE WHEN p_partkey % 4 = 2 THEN 'About it' END AS description, 't Big ' || p_name || ' Width ' || CAST(p_size AS STRING) || ' " only 12 x Finish ' || p_type ||
  ' Width dup Grade: A' || CAST(p_size AS STRING) || ' no pair here' AS text FROM {part}""")
def page_text(spark, sf):
    """S10"""
    return web.page_text(web.json_ld(_html(spark, sf))).select("page_id", F.col("page_name").alias("name"),
                                                              F.col("page_description").alias("description"), F.col("page_text").alias("text"))


_SHOWN = "html"
for _tag in fixed.SKIPPED_TAGS:
    _SHOWN = f"regexp_replace({_SHOWN}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'g')"


@query("page_reports", f"""SELECT page_id, CAST(0 AS INT) AS tables, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract({_SHOWN}, '(?is)<h[12]\\b[^>]*>(.*?)</h[12]>', 1), '(?s)<[^>]*>', '', 'g'), '&amp;', '&', 'g'), '\\s+', ' ', 'g')) AS heading FROM {{pages}}""")
def page_reports(spark, sf):
    """S10, S13 over the given web pages."""
    pages = table(spark, sf, "pages")
    report = web.page_report(pages).select("page_id", "tables")
    named = web.page_text(pages).select("page_id", F.coalesce("page_name", F.lit("")).alias("heading"))
    return report.join(named, "page_id")


@query("page_products")
def page_products(spark, sf):
    """S8, S9, S10 over the given web pages."""
    return web.to_products(table(spark, sf, "pages")).select("id", "name", "source_url", F.size("specs").alias("specs"), F.length("free_text").alias("chars"))


@query("page_usefulness", """SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS useful,
  CASE p_size % 4 WHEN 1 THEN 'wrong address' WHEN 2 THEN 'nothing' ELSE '' END AS cause FROM {part}""")
def page_usefulness(spark, sf):
    """D5"""
    df = view(spark, sf, """SELECT p_partkey AS id, CASE p_size % 4 WHEN 1 THEN '404 - Page Not Found' WHEN 3 THEN p_name END AS name, CAST(NULL AS STRING) AS description,
      CAST(NULL AS STRING) AS brand, CASE WHEN p_size % 4 = 2 THEN 'loading' END AS free_text, IF(p_size % 4 = 0, array(named_struct('key', 'a', 'value', 'b')), array()) AS specs FROM {part}""", "part")
    return P.usefulness(df).select("id", "useful", F.expr("CASE WHEN useful THEN '' WHEN why_not LIKE '%address is wrong rather%' THEN 'wrong address' ELSE 'nothing' END").alias("cause"))


# ------------------------------------------------------------------ policy

_URLS = """SELECT page_id AS id, CASE page_id % 9 WHEN 0 THEN 'https://www.amazon.co.uk/dp/' || CAST(page_id AS STRING) WHEN 1 THEN 'http://shop.grainger.com/x' WHEN 2 THEN 'https://new.abb.com/p'
   WHEN 3 THEN 'https://www.skf.com/a?b=1' WHEN 4 THEN 'ftp://skf.com/x' WHEN 5 THEN 'https://en.wikipedia.org/wiki/B' ELSE url END AS url,
  CASE page_id % 4 WHEN 0 THEN 'SKF' WHEN 1 THEN 'abb' WHEN 2 THEN 'Acme' END AS brand FROM {pages}"""
_BL = values(fixed.BLOCKED_SOURCES, "domain", "kind", "anytld", name="bl")
_MF = values([(d, b, m) for d, (b, m) in {d: (b, m) for b, m, ds, _ in fixed.MANUFACTURERS for d in ds}.items()], "domain", "owner", "maker", name="mf")
_KN = ", ".join(f"'{b.lower()}'" for b, *_ in fixed.MANUFACTURERS)
_HOST = f"""u AS ({_URLS}), h AS (SELECT *, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host FROM u),
hp AS (SELECT *, string_split(host, '.') AS p FROM h), hl AS (SELECT *, CASE WHEN len(p) >= 3 AND length(p[-1]) = 2 AND p[-2] IN ('co', 'com', 'net', 'org', 'gov', 'ac') THEN p[-3] WHEN len(p) >= 2 THEN p[-2] ELSE '' END AS label FROM hp),
bd AS (SELECT hl.id, arg_max(domain, length(domain)) AS dom, arg_max(kind, length(domain)) AS kind FROM hl JOIN bl ON host = domain OR ends_with(host, '.' || domain) GROUP BY hl.id),
bn AS (SELECT hl.id, any_value(kind) AS kind FROM hl JOIN bl ON anytld AND label = split_part(domain, '.', 1) GROUP BY hl.id),
ow AS (SELECT hl.id, arg_max(domain, length(domain)) AS site, arg_max(owner, length(domain)) AS owner, arg_max(maker, length(domain)) AS maker FROM hl JOIN mf ON host = domain OR ends_with(host, '.' || domain) GROUP BY hl.id),
al AS (SELECT hl.*, bd.dom, coalesce(bd.kind, bn.kind) AS bkind, coalesce(bd.dom, CASE WHEN bn.kind IS NOT NULL THEN host END) AS bmatch, site, owner, maker
  FROM hl LEFT JOIN bd ON bd.id = hl.id LEFT JOIN bn ON bn.id = hl.id LEFT JOIN ow ON ow.id = hl.id)"""


@query("host_parts", f"WITH {_HOST} SELECT id, host, label, len(p) AS suffixes FROM hl")
def host_parts(spark, sf):
    """D1"""
    return P.host_parts(view(spark, sf, _URLS, "pages")).select("id", "host", "label", F.size("suffixes").cast("bigint").alias("suffixes"))


@query("blocked_sources", f"WITH {_BL}, {_MF}, {_HOST} SELECT id, bkind AS kind, bmatch AS matched FROM al WHERE bkind IS NOT NULL")
def blocked_sources(spark, sf):
    """D2"""
    return P.blocked(P.host_parts(view(spark, sf, _URLS, "pages"))).where("blocked_kind IS NOT NULL").select(
        "id", F.col("blocked_kind").alias("kind"), F.col("blocked_match").alias("matched"))


@query("source_verdicts", f"""WITH {_BL}, {_MF}, {_HOST}, s AS (SELECT *, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN bkind IS NOT NULL THEN 'blocked'
   WHEN site IS NOT NULL AND coalesce(brand, '') <> '' AND lower(brand) IN ({_KN}) AND lower(owner) <> lower(brand) THEN 'wrong' WHEN site IS NOT NULL THEN 'maker' ELSE 'unknown' END AS st FROM al)
SELECT id, st = 'maker' AS allowed, CASE st WHEN 'blocked' THEN bkind WHEN 'wrong' THEN 'manufacturer' WHEN 'maker' THEN 'manufacturer' WHEN 'unknown' THEN 'unknown' ELSE '' END AS kind,
 CASE st WHEN 'scheme' THEN 'Only http(s) sources are fetched; got ''' || scheme || '''.' WHEN 'blocked' THEN bmatch || ' is a ' || bkind || '. The content standard requires manufacturer-provided sources, so ' || bkind || 's are excluded.'
 WHEN 'wrong' THEN site || ' is the official site of ' || owner || ', not of ''' || brand || '''. A manufacturer page for the wrong manufacturer is not evidence about this part.'
 WHEN 'maker' THEN site || ' is the approved domain for ' || owner || ' (' || maker || ').' ELSE host || ' is not a known manufacturer domain. It cannot be cited as a manufacturer-provided source, so it was not fetched.' END AS reason FROM s""")
def source_verdicts(spark, sf):
    """D3"""
    return P.check(view(spark, sf, _URLS, "pages")).select("id", "allowed", "kind", "reason")


_BRANDED = """SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'skf' WHEN 1 THEN 'Whirlpool' WHEN 2 THEN '3M' WHEN 3 THEN p_brand WHEN 4 THEN 'Milwaukee' END AS brand,
  CASE WHEN p_partkey % 5 <> 0 THEN 'M-' || CAST(p_partkey AS STRING) END AS mpn FROM {part}"""
_TP = values([(b.lower(), i, t) for b, _, _, ts in fixed.MANUFACTURERS for i, t in enumerate(ts)], "bk", "pos", "t", name="tp")


@query("candidate_urls", f"WITH {_TP}, x AS ({_BRANDED}) SELECT id, pos AS rank, replace(t, '{{mpn}}', mpn) AS url FROM x JOIN tp ON bk = lower(brand) WHERE mpn IS NOT NULL")
def candidate_urls(spark, sf):
    """D4"""
    return P.candidate_urls(view(spark, sf, _BRANDED, "part"), spark).select("id", "rank", "url")


@query("candidate_outcomes", f"WITH x AS ({_BRANDED}) SELECT id, CASE WHEN brand IS NULL THEN 'no_brand' WHEN lower(brand) NOT IN ({_KN}) THEN 'brand_unknown' WHEN mpn IS NULL THEN 'no_part_number' WHEN brand = '3M' THEN 'no_template' ELSE 'candidates' END AS outcome FROM x")
def candidate_outcomes(spark, sf):
    """D4"""
    return P.candidate_notes(view(spark, sf, _BRANDED, "part"))


_LEDGER = """SELECT l_partkey AS product_id, l_orderkey * 10 + l_linenumber AS rank, 'u' || CAST(l_suppkey AS STRING) AS url, max(l_linenumber) % 3 <> 0 AS allowed, 'policy' AS reason FROM {lineitem} GROUP BY 1, 2, 3"""
_BG = f"g AS ({_LEDGER}), rn AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN allowed THEN 0 ELSE 1 END, rank, url) AS n FROM g), bg AS (SELECT *, allowed AND n <= 3 AS accepted FROM rn)"


def _ledger(spark, sf):
    return P.page_budget(view(spark, sf, _LEDGER, "lineitem"))


@query("page_budget", f"WITH {_BG} SELECT product_id, rank, url, accepted, CASE WHEN allowed AND NOT accepted THEN 'Within policy, but the per-product page budget of 3 was already spent on higher-ranked sources.' ELSE reason END AS reason FROM bg")
def page_budget(spark, sf):
    """D6"""
    return _ledger(spark, sf).select("product_id", "rank", "url", "accepted", F.col("ledger_reason").alias("reason"))


@query("discovery_summary", f"WITH {_BG} SELECT product_id, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE NOT accepted) AS refused, bool_or(accepted) AS found FROM bg GROUP BY 1")
def discovery_summary(spark, sf):
    """D9"""
    return P.discovery_summary(_ledger(spark, sf))


_HARVEST = """SELECT l_partkey AS product_id, l_orderkey * 10 + l_linenumber AS rank, 'k' || CAST(l_linenumber AS STRING) AS key, min(l_returnflag || CAST(l_suppkey AS STRING)) AS value,
  'https://x/' || CAST(l_orderkey AS STRING) AS url, CASE WHEN l_orderkey % 3 = 0 THEN 'n' || CAST(l_orderkey AS STRING) END AS name FROM {lineitem} GROUP BY 1, 2, 3, 5, 6"""


def _harvest(spark, sf):
    df = view(spark, sf, _HARVEST, "lineitem")
    return df.select("product_id", "rank", "url", "name", F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("free_text"),
                     F.expr("array(named_struct('key', key, 'value', value))").alias("specs"))


@query("merge_page_specs", f"WITH h AS ({_HARVEST}) SELECT product_id, key, arg_min(value, rank) AS value, arg_min(url, rank) AS source_url FROM h GROUP BY 1, 2")
def merge_page_specs(spark, sf):
    """D7"""
    return P.merge_pages(_harvest(spark, sf))[1]


@query("merge_page_fields", f"WITH h AS ({_HARVEST}) SELECT product_id, arg_min(name, rank) FILTER (WHERE name IS NOT NULL) AS name, arg_min(url, rank) AS source_url FROM h GROUP BY 1")
def merge_page_fields(spark, sf):
    """D7"""
    return P.merge_pages(_harvest(spark, sf))[0].select("product_id", "name", "source_url")


@query("caller_wins", f"""WITH h AS ({_HARVEST}), m AS (SELECT product_id, key, arg_min(value, rank) AS value, arg_min(url, rank) AS source_url FROM h GROUP BY 1, 2),
b AS (SELECT p_partkey AS product_id, 'k' || CAST(p_size % 9 AS STRING) AS key, 'mine' AS value FROM {{part}})
SELECT coalesce(m.product_id, b.product_id) AS product_id, coalesce(m.key, b.key) AS key, coalesce(b.value, m.value) AS value, CASE WHEN b.value IS NULL THEN source_url END AS source_url
FROM m FULL JOIN b ON m.product_id = b.product_id AND m.key = b.key""")
def caller_wins(spark, sf):
    """D8"""
    base = view(spark, sf, "SELECT p_partkey AS product_id, concat('k', p_size % 9) AS key, 'mine' AS value FROM {part}", "part")
    return P.caller_wins(P.merge_pages(_harvest(spark, sf))[1], base)
