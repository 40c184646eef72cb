"""Records with settled attributes: inference, validation, scoring, copy, exports, gate, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import style
from ..functions.text import q
from ..operators import content as T, export as X, extract as E, gate as G, infer as I, rules as Q, summary as B
from ..operators.classify import classify
from ..operators.normalize import normalize
from ..operators.records import NO_ATTRIBUTES, NULL, attribute
from ..operators.score import score
from ..plans.enrich import enrich, resolve
from ..plans.taxonomy import Taxonomy
from ..plans.testbed import products, view
from .registry import query, values

MOTOR = "26101100"
_tax = Taxonomy()
_motor = next(c for c in _tax.categories if c["code"] == MOTOR)

# --------------------------------------------------------------- record bed
# (position, key, label, value, number, kind, unit, provenance, confidence, group); a null value: absent
_S = "CAST(p_size AS STRING)"
_BED = [
    ("power_rating", "Power Rating", f"{_S} || '.0'", "CAST(p_size AS DOUBLE)", "'float'", "'kW'",
     "CASE p_size % 3 WHEN 0 THEN 'supplied' WHEN 1 THEN 'parsed' ELSE 'defaulted' END",
     "CAST(CAST(0.4 + (p_size % 6) / 10.0 AS DECIMAL(10,3)) AS DOUBLE)", "Performance"),
    ("voltage", "Rated Voltage", "CASE WHEN p_size % 4 <> 0 THEN '460.0' END", "CASE WHEN p_size % 4 <> 0 THEN CAST(460 AS DOUBLE) END",
     "'float'", "'V'", "'parsed'", "CAST(0.79 AS DOUBLE)", "Electrical"),
    ("phase", "Phase", "CASE WHEN p_size % 5 = 0 THEN 'Dual' ELSE 'Three Phase' END", "CAST(NULL AS DOUBLE)", "'text'",
     "CAST(NULL AS STRING)", "'knowledge_base'", "CAST(0.8 AS DOUBLE)", "Electrical"),
    ("speed", "Rated Speed", "CASE WHEN p_size % 7 = 0 THEN 'fast' WHEN p_size % 7 = 1 THEN '1450.0' ELSE '1750.0' END",
     "CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN CAST(1450 AS DOUBLE) ELSE CAST(1750 AS DOUBLE) END",
     "CASE WHEN p_size % 7 = 0 THEN 'text' ELSE 'float' END", "'rpm'", "'derived'", "CAST(0.74 AS DOUBLE)", "Performance"),
    ("full_load_current", "Full Load Current", f"CAST(p_size * 100 AS STRING) || '.0'", "CAST(p_size * 100 AS DOUBLE)", "'float'", "'A'",
     "'inferred'", "CAST(0.6 AS DOUBLE)", "Electrical"),
    ("frame_size", "Frame Size", "CASE WHEN p_size % 5 <> 0 THEN '184T' END", "CAST(NULL AS DOUBLE)", "'text'", "CAST(NULL AS STRING)",
     "'supplied'", "CAST(0.99 AS DOUBLE)", "Mechanical"),
]
_HEAD = """p_partkey AS id, 'SKU-' || CAST(p_partkey AS STRING) AS sku, CASE WHEN p_partkey % 9 <> 0 THEN 'WEG' END AS brand,
  'W22-' || CAST(p_size AS STRING) AS mpn, p_name AS description"""
_LONG = " UNION ALL ".join(
    f"SELECT {_HEAD}, p_size, {i} AS pos, '{k}' AS key, '{lb}' AS label, {v} AS val, {n} AS num, {kd} AS kind, {u} AS unit, {pr} AS prov,"
    f" {cf} AS conf, '{g}' AS grp FROM {{part}}" for i, (k, lb, v, n, kd, u, pr, cf, g) in enumerate(_BED))
_A = f"a AS (SELECT * FROM ({_LONG}) t WHERE val IS NOT NULL)"
_R = f"r AS (SELECT {_HEAD}, p_size FROM {{part}})"


def _bed(spark, sf, settled: bool = True):
    made = ", ".join(attribute(key=q(k), label=q(lb), val=v, num=n, kind=kd, unit=u, prov=pr, conf=cf,
                               evidence=f"concat('Supplier field ', {q(k)})", method="'bed'", grp=q(g), source_url="CAST('https://x.example' AS STRING)")
                     for k, lb, v, n, kd, u, pr, cf, g in _BED)
    order = ("array_sort(filter(array(" + made + "), a -> a.val IS NOT NULL), (a, b) -> CASE WHEN a.grp < b.grp THEN -1 WHEN a.grp > b.grp THEN 1"
             " WHEN a.conf > b.conf THEN -1 WHEN a.conf < b.conf THEN 1 WHEN a.label < b.label THEN -1 ELSE 1 END)")
    df = view(spark, sf, f"""SELECT {_HEAD}, {order} AS attributes, named_struct('code', '{MOTOR}', 'path', array({', '.join(q(x) for x in _motor['path'])})) AS category,
        CAST(NULL AS STRING) AS name, CAST(NULL AS STRING) AS free_text, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS STRING) AS currency,
        CAST(NULL AS STRING) AS source_url, CAST(NULL AS STRING) AS source_document, CAST(NULL AS STRING) AS category_hint, false AS is_empty FROM {{part}}""", "part", heavy=True)
    df = df.withColumn("identity", F.expr("map('mpn', mpn, 'sku', sku, 'brand', brand, 'manufacturer', CAST(NULL AS STRING),"
                                  " 'brand_country', CAST(NULL AS STRING), 'gtin', CAST(NULL AS STRING))"))
    return E.attach_schema(df, spark, _tax)


_NUMSHOW = "CASE WHEN kind = 'float' THEN printf('%g', num) ELSE val END || CASE WHEN unit IS NOT NULL THEN ' ' || unit ELSE '' END"
_W = f"w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY grp, conf DESC, label) AS n, {_NUMSHOW} AS shown FROM a)"


@query("attribute_order", f"WITH {_A}, {_W} SELECT id, n, key, val FROM w")
def attribute_order(spark, sf):
    """R4"""
    return B.explode_attributes(_bed(spark, sf)).select("id", (F.col("pos") + 1).cast("bigint").alias("n"), "key", "val")


# --------------------------------------------------------------- validation

_RANGE = values([(a["key"], a["range"][0] * 1.0, a["range"][1] * 1.0) for a in _motor["attributes"] if a["range"]], "key", "lo", "hi", name="rg")
_EXPECT = "(pw * 1000 / (CASE WHEN contains(ph, 'Three') OR ph = '' THEN 1.732 ELSE 1.0 END * vo * 0.85 * 0.92))"
_ISSUES = f"""pv AS (SELECT id, max(num) FILTER (WHERE key = 'power_rating') AS pw, max(num) FILTER (WHERE key = 'voltage') AS vo,
   max(num) FILTER (WHERE key = 'full_load_current') AS am, max(num) FILTER (WHERE key = 'speed') AS sp, coalesce(max(val) FILTER (WHERE key = 'phase'), '') AS ph FROM a GROUP BY id),
rq AS (SELECT r.id, k.key FROM r, (VALUES {', '.join(f"('{k}')" for k in _motor['required'])}) k(key)
   WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = r.id AND a.key = k.key) AND NOT (k.key = 'mpn') AND NOT (k.key = 'brand' AND r.brand IS NOT NULL)),
iss AS (
  SELECT id, 'TYPE_MISMATCH' AS code, 'error' AS severity, key AS field FROM a WHERE key IN (SELECT key FROM rg) AND kind = 'text'
  UNION ALL SELECT id, 'OUT_OF_RANGE', 'error', a.key FROM a JOIN rg USING (key) WHERE kind <> 'text' AND NOT (num BETWEEN lo AND hi)
  UNION ALL SELECT id, 'VOCABULARY_VIOLATION', 'warning', key FROM a WHERE key = 'phase' AND val NOT IN ('Single Phase', 'Three Phase')
  UNION ALL SELECT id, 'MISSING_REQUIRED', 'error', key FROM rq
  UNION ALL SELECT id, 'ELECTRICAL_INCONSISTENCY', 'warning', 'full_load_current' FROM pv WHERE vo > 0 AND {_EXPECT} > 0 AND NOT (am / {_EXPECT} BETWEEN 0.6 AND 1.7)
  UNION ALL SELECT id, 'SPEED_NOT_STANDARD', 'info', 'speed' FROM pv WHERE sp IS NOT NULL AND NOT (sp BETWEEN 0.93 * 3000 AND 1.001 * 3000 OR sp BETWEEN 0.93 * 1500 AND 1.001 * 1500
     OR sp BETWEEN 0.93 * 1000 AND 1.001 * 1000 OR sp BETWEEN 0.93 * 750 AND 1.001 * 750 OR sp BETWEEN 0.93 * 600 AND 1.001 * 600 OR sp BETWEEN 0.93 * 500 AND 1.001 * 500)
  UNION ALL SELECT id, 'LOW_CONFIDENCE', 'warning', NULL FROM a WHERE conf < 0.5 GROUP BY id)"""
_VCTX = f"WITH {_A}, {_R}, {_RANGE}, {_ISSUES}"


def _validated(spark, sf):
    return Q.validate(_bed(spark, sf), content=False, standards=False)


@query("schema_checks", _VCTX + " SELECT * FROM iss")
def schema_checks(spark, sf):
    """Q1-Q5, Q7, Q14, Q15, Q25"""
    return B.explode_issues(_validated(spark, sf)).select("id", "code", "severity", "field")


@query("range_messages", f"""WITH {_A}, {_RANGE} SELECT id, key AS field, label || ' is ' || val || ' ' || unit || ', outside the plausible range ' || printf('%g', lo) || '–' || printf('%g', hi)
  || ' for this category.' AS message, CASE WHEN num / 25.4 BETWEEN lo AND hi OR num * 25.4 BETWEEN lo AND hi THEN 'The magnitude suggests inches were read as millimetres.'
  WHEN num / 1000 BETWEEN lo AND hi OR num * 1000 BETWEEN lo AND hi THEN 'The magnitude suggests a kilo- prefix was dropped.'
  WHEN num / 0.7457 BETWEEN lo AND hi OR num * 0.7457 BETWEEN lo AND hi THEN 'The magnitude suggests horsepower was read as kilowatts.' ELSE 'Check the source value and its unit.' END AS suggestion
  FROM a JOIN rg USING (key) WHERE kind <> 'text' AND NOT (num BETWEEN lo AND hi)""")
def range_messages(spark, sf):
    """Q2"""
    return B.explode_issues(_validated(spark, sf)).where("code = 'OUT_OF_RANGE'").select("id", "field", "message", "suggestion")


@query("weak_attribute_notice", f"""WITH {_A}, {_W}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS m, count(*) OVER (PARTITION BY id) AS t FROM w WHERE conf < 0.5)
SELECT id, any_value(t) || ' attribute(s) rest on category defaults rather than supplier data: ' || string_agg(label, ', ' ORDER BY m) FILTER (WHERE m <= 6) || '.' AS message FROM k GROUP BY id""")
def weak_attribute_notice(spark, sf):
    """Q5"""
    return B.explode_issues(_validated(spark, sf)).where("code = 'LOW_CONFIDENCE'").select("id", "message")


_READY = f""", ct AS (SELECT r.id, (SELECT count(*) FROM a WHERE a.id = r.id) AS filled, (SELECT count(*) FROM rq WHERE rq.id = r.id) AS missing,
  (SELECT count(*) FROM iss WHERE iss.id = r.id AND severity = 'error') AS er, (SELECT count(*) FROM iss WHERE iss.id = r.id AND severity = 'warning') AS wa,
  (SELECT count(*) FROM iss WHERE iss.id = r.id AND severity <> 'error' AND code IN ({', '.join(f"'{c}'" for c in fixed.INTEGRITY_CODES)})) AS it,
  (SELECT sum(conf * rk / 6.0) / sum(rk / 6.0) * 100 FROM (SELECT *, CASE prov WHEN 'supplied' THEN 6 WHEN 'parsed' THEN 5 WHEN 'knowledge_base' THEN 4
     WHEN 'derived' THEN 3 WHEN 'inferred' THEN 2 ELSE 1 END AS rk FROM a) z WHERE z.id = r.id) AS cf FROM r),
k AS (SELECT *, 0.7 * ((6 - missing) / 6.0) * 100 + 0.3 * least(filled / {len(_motor['attributes'])}.0, 1) * 100 AS cm, greatest(0, 100 - 22 * er - 6 * wa) AS vl FROM ct),
rd AS (SELECT id, CAST(round(0.35 * cm + 0.30 * cf + 0.35 * vl, 1) AS DOUBLE) AS overall, CAST(round(cm, 1) AS DOUBLE) AS completeness, CAST(round(cf, 1) AS DOUBLE) AS confidence,
  CAST(vl AS DOUBLE) AS validity, CASE WHEN er > 0 THEN 'blocked' WHEN it > 0 THEN 'review' WHEN 0.35 * cm + 0.30 * cf + 0.35 * vl >= 78 AND missing = 0 THEN 'publish' ELSE 'review' END AS verdict FROM k)"""


@query("readiness", _VCTX + _READY + " SELECT * FROM rd")
def readiness(spark, sf):
    """K1-K4, Q26"""
    return score(_validated(spark, sf)).select("id", *[f"readiness.{c}" for c in ("overall", "completeness", "confidence", "validity", "verdict")])


@query("run_summary", _VCTX + _READY + """ SELECT count(*) AS products, count(*) FILTER (WHERE verdict = 'publish') AS publish, count(*) FILTER (WHERE verdict = 'review') AS review,
  count(*) FILTER (WHERE verdict = 'blocked') AS blocked, CAST(round(avg(overall), 1) AS DOUBLE) AS avg_readiness, CAST(round((SELECT count(*) FROM a) / count(*), 1) AS DOUBLE) AS avg_attributes,
  (SELECT count(*) FROM a WHERE prov NOT IN ('supplied', 'parsed')) AS attributes_added, (SELECT count(*) FROM iss) AS issues FROM rd""")
def run_summary(spark, sf):
    """B1"""
    return B.run_summary(score(_validated(spark, sf)))


@query("assemble_records", f"""WITH {_A}, {_W}, {_R}, {_RANGE}, {_ISSUES}
SELECT r.id, coalesce((SELECT string_agg(key || '=' || val, ',' ORDER BY n) FROM w WHERE w.id = r.id), '') AS attributes,
  (SELECT count(*) FROM iss WHERE iss.id = r.id) AS issues FROM r""")
def assemble_records(spark, sf):
    """B5"""
    base = _validated(spark, sf)
    long = B.explode_attributes(base).select("id", "pos", "key", "val")
    issues = B.explode_issues(base).select("id", "pos", "code")
    return B.assemble(view(spark, sf, "SELECT p_partkey AS id FROM {part}", "part"), long, issues).select(
        "id", F.expr("coalesce(array_join(transform(attributes, a -> concat(a.key, '=', a.val)), ','), '')").alias("attributes"),
        F.expr("CAST(coalesce(size(issues), 0) AS BIGINT)").alias("issues"))


# ------------------------------------------------------------- rules by name

_RX = """SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 10 AS k, l_quantity AS qn, CAST(l_linenumber AS DOUBLE) AS ln, l_suppkey % 4 AS m FROM {lineitem}"""
_N = {"bore_diameter": "qn", "outer_diameter": "qn + ln - 3", "static_load_rating": "ln", "dynamic_load_rating": "CAST(4 AS DOUBLE)",
      "max_speed": "qn * 1000", "temp_rating_max": "qn * 7", "pressure_rating": "qn * 100", "tensile_strength": "qn * 40",
      "inlet_size": "CAST(2 AS DOUBLE)", "outlet_size": "ln / 2", "max_temp": "qn * 3", "flute_length": "qn", "overall_length": "qn + ln - 4",
      "burst_pressure": "qn * ln", "working_pressure": "qn * 2", "inner_diameter": "qn"}
_T = {"seal_type": "CASE WHEN m = 0 THEN '2RS (Rubber Sealed)' ELSE 'Open' END",
      "body_material": "CASE m WHEN 0 THEN 'PVC' WHEN 1 THEN 'Brass' WHEN 2 THEN 'Polypropylene' ELSE 'Cast Iron' END",
      "seat_material": "CASE WHEN m = 1 THEN 'PTFE' ELSE 'Metal' END", "material": "CASE WHEN m < 2 THEN '316 Stainless Steel' ELSE 'Alloy Steel' END",
      "grade": "CASE m WHEN 0 THEN '8.8' WHEN 1 THEN 'A2-70' WHEN 2 THEN '10.9' ELSE 'custom' END",
      "ip_rating": "CASE m WHEN 0 THEN 'IP67' WHEN 1 THEN 'IP6X' WHEN 2 THEN 'IP68K9' ELSE '' END"}
_CODES = [c["code"] for c in _tax.categories]
_XR = ("x AS (SELECT id, m, CASE k " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END AS cat, "
       + ", ".join(f"{e} AS {k}" for k, e in _N.items()) + ", " + ", ".join(f"{e} AS {k}" for k, e in _T.items()) + f" FROM ({_RX}) t)")


def _py(x):
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS STRING) || '.0' ELSE CAST({x} AS STRING) END)"


def _g(x):
    return f"printf('%g', {x})"


_RULES = [
    ("31171500", "GEOMETRY_CONTRADICTION", "'error'", "bore_diameter >= outer_diameter",
     f"'Bore diameter (' || {_py('bore_diameter')} || ' mm) is not smaller than outer diameter (' || {_py('outer_diameter')} || ' mm).'"),
    ("31171500", "LOAD_RATING_SUSPECT", "'warning'", "bore_diameter < 50 AND static_load_rating > dynamic_load_rating",
     f"'Static rating (' || {_py('static_load_rating')} || ' kN) exceeds dynamic rating (4.0 kN) on a ' || {_py('bore_diameter')} || ' mm bore bearing, which is atypical for this size class.'"),
    ("31171500", "SPEED_SEAL_CONFLICT", "'warning'", "max_speed > 20000 AND contains(seal_type, '2RS')",
     f"'Contact seals (2RS) limit speed well below the stated ' || {_g('max_speed')} || ' rpm.'"),
    ("40141600", "MATERIAL_TEMP_CONFLICT", "'error'", "temp_rating_max > 60 AND body_material = 'PVC'",
     f"'A PVC body cannot be rated to ' || {_g('temp_rating_max')} || ' C; PVC softens above about 60 C.'"),
    ("40141600", "SEAT_TEMP_CONFLICT", "'warning'", "temp_rating_max > 230 AND seat_material = 'PTFE'",
     f"'PTFE seats degrade above ~230 C but the valve is rated to ' || {_g('temp_rating_max')} || ' C.'"),
    ("40141600", "MATERIAL_PRESSURE_CONFLICT", "'warning'", "pressure_rating > 3000 AND body_material = 'Brass'",
     f"{_g('pressure_rating')} || ' psi is beyond the usual envelope for a brass body.'"),
    ("31161500", "GRADE_MATERIAL_CONFLICT", "'error'", "contains(material, 'Stainless') AND NOT starts_with(upper(grade), 'A')",
     "'Property class ''' || grade || ''' is a carbon-steel designation but the material is ' || material || '.'"),
    ("31161500", "STRENGTH_MISMATCH", "'error'", "abs(tensile_strength - CASE grade WHEN '8.8' THEN 800 WHEN 'A2-70' THEN 700 WHEN '10.9' THEN 1000 END) / CASE grade WHEN '8.8' THEN 800 WHEN 'A2-70' THEN 700 WHEN '10.9' THEN 1000 END > 0.12",
     f"'Property class ' || grade || ' requires about ' || CASE grade WHEN '8.8' THEN '800' WHEN 'A2-70' THEN '700' ELSE '1000' END || ' MPa minimum tensile strength, but ' || {_g('tensile_strength')} || ' MPa is stated.'"),
    ("40151500", "PORT_SIZE_SUSPECT", "'info'", "outlet_size > inlet_size", f"'Outlet (' || {_py('outlet_size')} || '\") is larger than inlet (2.0\"), which is unusual.'"),
    ("40151500", "MATERIAL_TEMP_CONFLICT", "'error'", "max_temp > 90 AND body_material = 'Polypropylene'", f"'Polypropylene wetted parts are not rated to ' || {_g('max_temp')} || ' C.'"),
    ("27112700", "GEOMETRY_CONTRADICTION", "'error'", "flute_length >= overall_length",
     f"'Flute length (' || {_py('flute_length')} || ' mm) is not shorter than overall length (' || {_py('overall_length')} || ' mm).'"),
    ("40142000", "PRESSURE_CONTRADICTION", "'error'", "burst_pressure < working_pressure",
     f"'Burst pressure (' || {_g('burst_pressure')} || ' bar) is below working pressure (' || {_g('working_pressure')} || ' bar).'"),
    ("40142000", "SAFETY_FACTOR_LOW", "CASE WHEN burst_pressure / working_pressure < 3 THEN 'error' ELSE 'warning' END",
     "burst_pressure >= working_pressure AND burst_pressure < working_pressure * 4",
     "'Safety factor is ' || printf('%.1f', burst_pressure / working_pressure) || ':1; SAE J517 requires at least 4:1 for hydraulic hose.'"),
    ("40142000", "GEOMETRY_CONTRADICTION", "'error'", "inner_diameter >= outer_diameter",
     f"'Inner diameter (' || {_py('inner_diameter')} || ' mm) is not smaller than outer diameter (' || {_py('outer_diameter')} || ' mm).'"),
] + [(c, "INVALID_IP_CODE", "'warning'", "ip_rating = 'IP68K9'", "'''IP68K9'' is not a valid IEC 60529 ingress protection code.'")
     for c in ("26101100", "39121000", "41111700")]


@query("engineering_rules", f"WITH {_XR} " + " UNION ALL ".join(
    f"SELECT id, '{code}' AS code, {sev} AS severity, {msg} AS message FROM x WHERE cat = '{cat}' AND {cond}" for cat, code, sev, cond, msg in _RULES))
def engineering_rules(spark, sf):
    """Q7-Q13, Q16-Q23"""
    pairs = lambda d: ", ".join(f"{q(k)}, {e}" for k, e in d.items())
    checks = "CASE k " + " ".join(
        f"WHEN {i} THEN array({', '.join(q(r) for r in c['cross_checks'])})" if c["cross_checks"] else f"WHEN {i} THEN CAST(array() AS ARRAY<STRING>)"
        for i, c in enumerate(_tax.categories)) + " END"
    df = view(spark, sf, f"SELECT id, map({pairs(_N)}) AS nums, map({pairs(_T)}) AS texts, {checks} AS checks FROM ({_RX}) t", "lineitem")
    grades = "array(" + ", ".join(f"named_struct('name', {q(g)}, 'num', {float(v)}D)" for g, v in fixed.GRADES.items()) + ")"
    names = [n for n in Q.REGISTRY if not n.startswith("motor_")]
    found = df.select("id", F.explode_outer(F.expr(Q.cross_rules(names, Q.Values("nums", "texts", grades), "checks"))).alias("i"))
    return found.where("i IS NOT NULL").select("id", "i.code", "i.severity", "i.message")


@query("copy_checks", """
WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity AS BIGINT) AS qn, l_linenumber AS ln, l_suppkey % 3 AS m FROM {lineitem}),
c AS (SELECT *, 155 + ln AS tl FROM x)
SELECT id, 'TITLE_TOO_LONG' AS code, 'Title is ' || tl || ' characters; most marketplaces truncate at 150.' AS message FROM c WHERE ln > 3
UNION ALL SELECT id, 'META_TOO_LONG', 'Meta description exceeds 160 characters and will be cut off in search results.' FROM c WHERE ln > 5
UNION ALL SELECT id, 'UNSUPPORTED_CLAIM', 'Copy contains unverifiable marketing claims: ' || CASE m WHEN 0 THEN 'world class' ELSE 'premium quality, unbeatable' END || '.' FROM c WHERE m < 2
UNION ALL SELECT id, 'UNVERIFIED_FIGURE', 'The description cites figures not present in the attribute set: ' || list_aggregate(list_sort([CAST(qn + 100 AS STRING), CAST(qn + 200 AS STRING), CAST(qn + 300 AS STRING)]), 'string_agg', ', ') || '.' FROM c WHERE ln % 2 = 0""")
def copy_checks(spark, sf):
    """Q6"""
    made = attribute(key="'power'", label="'Power'", val="concat(qn, '.0')", num="CAST(qn AS DOUBLE)", kind="'float'", unit="'kW'", prov="'supplied'",
                     conf="0.9D", evidence="'stated'", method="'m'", grp="'g'")
    other = attribute(key="'range'", label="'Range'", val="'10-30 VDC'", num="CAST(NULL AS DOUBLE)", kind="'text'", unit=NULL, prov="'supplied'",
                      conf="0.9D", evidence="'stated'", method="'m'", grp="'g'")
    df = view(spark, sf, f"""SELECT id, array({made}, {other}) AS attributes, named_struct(
        'title', repeat('t', IF(ln > 3, 155 + ln, 20)), 'meta_description', repeat('m', IF(ln > 5, 161, 10)),
        'short_description', CASE m WHEN 0 THEN 'A World Class part' WHEN 1 THEN 'unbeatable, premium quality' ELSE 'plain' END,
        'long_description', concat('Rated ', qn, ' kW at 10 or 30 VDC, pack of 2', IF(ln % 2 = 0, concat(', ', qn + 100, ' and ', qn + 200, ' or ', qn + 300), concat(', ', qn + 100)), '.')) AS content
        FROM (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity AS BIGINT) AS qn, l_linenumber AS ln, l_suppkey % 3 AS m FROM {{lineitem}}) t""", "lineitem")
    found = df.select("id", F.explode_outer(F.expr(Q.content_issues())).alias("i"))
    return found.where("i IS NOT NULL").select("id", "i.code", "i.message")


# ------------------------------------------------------------------- content

_TR = f"""t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY conf DESC, n) AS o FROM w WHERE prov <> 'defaulted')"""
_CTXT = f"WITH {_A}, {_W}, {_R}, {_TR}"


@query("storefront_copy", _CTXT + f""",
hl AS (SELECT id, string_agg(shown, ', ' ORDER BY o) AS hd FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS h FROM t
   WHERE key IN ('power_rating', 'voltage', 'speed', 'frame_size')) z WHERE h <= 2 GROUP BY id),
cl AS (SELECT id, string_agg(lower(label) || ' ' || shown, '; ' ORDER BY o) AS cl FROM t WHERE o <= 5 GROUP BY id),
x AS (SELECT r.*, coalesce(brand || ' ', '') || mpn AS lead, hd, cl FROM r LEFT JOIN hl USING (id) LEFT JOIN cl USING (id))
SELECT id, left(lead || ' Electric Motor' || coalesce(' — ' || hd, ''), 150) AS title,
  left(upper(left(lead, 1)) || substr(lead, 2) || ' electric motor' || coalesce(' with ' || cl, '') || '.', 300) AS short_description FROM x""")
def storefront_copy(spark, sf):
    """T1, T2"""
    return T.copywrite(_bed(spark, sf)).select("id", "content.title", "content.short_description")


@query("long_description", _CTXT + """,
g AS (SELECT id, grp, min(o) AS g0 FROM t GROUP BY 1, 2), g4 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY g0) AS gn FROM g),
it AS (SELECT t.*, row_number() OVER (PARTITION BY id, grp ORDER BY o) AS i FROM t),
gt AS (SELECT id, grp, string_agg(lower(label) || ' ' || shown, ', ' ORDER BY i) AS tx FROM it WHERE i <= 5 GROUP BY 1, 2),
pg AS (SELECT id, string_agg(grp || ': ' || tx || '.', ' ' ORDER BY gn) AS body FROM g4 JOIN gt USING (id, grp) WHERE gn <= 4 GROUP BY id)
SELECT id, left(concat_ws(' ', 'The ' || coalesce(brand || ' ', '') || mpn || ' is a electric motor intended for industrial service where consistent, documented performance matters.',
  body, trim(description)), 1800) AS long_description FROM r LEFT JOIN pg USING (id)""")
def long_description(spark, sf):
    """T2"""
    return T.copywrite(_bed(spark, sf)).select("id", "content.long_description")


@query("bullets_and_keywords", _CTXT + """,
b AS (SELECT id, string_agg(label || ' ' || shown, ' | ' ORDER BY o) AS bl FROM t WHERE o <= 6 GROUP BY id),
kw AS (SELECT id, 1 AS p, mpn AS w FROM r UNION ALL SELECT id, 2, trim(coalesce(brand, '') || ' ' || mpn) FROM r UNION ALL SELECT id, 3, brand || ' electric motor' FROM r WHERE brand IS NOT NULL
  UNION ALL SELECT id, 4, 'electric motor' FROM r UNION ALL SELECT id, 4 + o, lower(shown || ' electric motor') FROM t WHERE o <= 4),
kd AS (SELECT id, lower(w) AS l, min(p) AS p, arg_min(w, p) AS w FROM kw GROUP BY 1, 2),
ks AS (SELECT id, string_agg(w, ' | ' ORDER BY p) AS keywords FROM kd GROUP BY id)
SELECT r.id, concat_ws(' | ', bl, 'Genuine ' || brand || ' part, MPN ' || mpn) AS bullets, keywords,
  concat_ws(' | ', mpn, replace(mpn, '-', ''), replace(mpn, '-', ' '), brand || ' ' || mpn, 'electric motor') AS search_terms FROM r LEFT JOIN b USING (id) JOIN ks USING (id)""")
def bullets_and_keywords(spark, sf):
    """T3"""
    return T.copywrite(_bed(spark, sf)).select(
        "id", F.array_join("content.bullets", " | ").alias("bullets"), F.array_join("content.keywords", " | ").alias("keywords"),
        F.array_join("content.search_terms", " | ").alias("search_terms"))


@query("repair_lists", """SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN lang || source WHEN 1 THEN 'ok|' || lang ELSE lang END AS items,
  lang AS single FROM {documents}""")
def repair_lists(spark, sf):
    """T4"""
    df = view(spark, sf, """SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN split(concat(lang, source), '') WHEN 1 THEN array('ok', '<parameter name="x">', lang)
        ELSE array(lang, '</b>') END AS items, lang FROM {documents}""", "documents")
    return df.select("id", F.array_join(F.expr(T.repair_list("items")), "|").alias("items"), F.expr(f"get({T.repair_text('lang')}, 0)").alias("single"))


_TITLE_UPPER = ", ".join(f"'{u}'" for u in fixed.ALWAYS_UPPER)
_UOM = values(style.uom_rows(), "s", "m", "a", name="uom")


@query("title_case", f"""WITH {_UOM}, x AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || ' (rubber ' || lower(p_type) || ') npt inches 3/4 psi; pH mixed-Case' AS t FROM {{part}}),
ws AS (SELECT id, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS i FROM x),
st AS (SELECT *, trim(w, '.,;:()[]') AS s FROM ws)
SELECT id, string_agg(CASE WHEN lower(s) IN ({_TITLE_UPPER}) THEN replace(w, s, upper(s)) WHEN uom.a IS NOT NULL THEN replace(w, s2, uom.a)
  WHEN regexp_matches(s2, '[0-9\\p{{Lu}}]') THEN w ELSE upper(left(w, 1)) || lower(substr(w, 2)) END, ' ' ORDER BY i) AS title,
  upper(any_value(replace(t, 'pH', 'pH'))) AS upper
FROM (SELECT st.*, st.s AS s2, x.t FROM st JOIN x USING (id)) z LEFT JOIN uom ON uom.s = lower(z.s2) GROUP BY id""".replace("lower(s) IN", "lower(s2) IN").replace("replace(w, s, upper(s))", "replace(w, s2, upper(s2))"))
def title_case(spark, sf):
    """T10"""
    df = view(spark, sf, """SELECT p_partkey AS id, p_name || ' ' || p_brand || ' (rubber ' || lower(p_type) || ') npt inches 3/4 psi; pH mixed-Case' AS t FROM {part}""", "part")
    return df.select("id", F.expr(style.title_case("t")).alias("title"), F.expr(style.upper_case("concat(t, '®')")).alias("upper"))


@query("label_rules", """SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'Wash Cycles' WHEN 1 THEN 'Mounting' WHEN 2 THEN 'Hoses' ELSE 'Material' END AS shown,
  CASE p_size % 4 WHEN 0 THEN 'Wash Cycle' WHEN 1 THEN 'Mounting' WHEN 2 THEN 'Hose' ELSE 'Material' END AS singular,
  CASE WHEN p_size % 4 = 3 THEN false WHEN p_size % 3 = 0 THEN false ELSE true END AS wanted FROM {part}""")
def label_rules(spark, sf):
    """T11"""
    df = view(spark, sf, """SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'Number of Wash Cycles' WHEN 1 THEN 'Mounting Type' WHEN 2 THEN 'Hoses' ELSE 'Material' END AS label,
      CASE WHEN p_size % 3 = 0 THEN 'volts' WHEN p_size % 3 = 1 THEN 'dba' END AS unit, 'k' AS key FROM {part}""", "part")
    df = df.withColumn("shown", F.expr(style.display_label("label")))
    return df.select("id", "shown", F.expr(style.label_singular("shown")).alias("singular"), F.expr(style.wants_label("key", "label", "unit")).alias("wanted"))


def _rendered(spark, sf):
    return T.compliance(_bed(spark, sf))


@query("written_formats")
def written_formats(spark, sf):
    """T12, T13, T14, T15, T16, T17"""
    df = _rendered(spark, sf).select("id", F.explode_outer("fields").alias("f"))
    return df.select("id", F.col("f.id").alias("format"), "f.text", "f.length", "f.compliant", F.array_join("f.dropped", ",").alias("dropped"),
                     F.array_join("f.notes", " ").alias("notes"))


@query("product_title", _CTXT + """ SELECT id, trim(coalesce(brand || ' ', '') || mpn || ' Electric Motor') AS text, CAST(length(trim(coalesce(brand || ' ', '') || mpn || ' Electric Motor')) AS INT) AS length, true AS compliant FROM r""")
def product_title(spark, sf):
    """T12, T14, T17"""
    df = _rendered(spark, sf).select("id", F.expr("get(filter(fields, f -> f.id = 'product_title'), 0)").alias("f"))
    return df.select("id", "f.text", "f.length", "f.compliant")


@query("compliance_rollup")
def compliance_rollup(spark, sf):
    """T18"""
    df = _rendered(spark, sf).select("id", "compliance.compliant", F.array_join("compliance.breaches", ", ").alias("breaches"))
    return df.groupBy("compliant", "breaches").agg(F.count("*").alias("records"))


# ----------------------------------------------------------------- inference

_INFER_KEYS = f"""k AS (SELECT p_partkey AS id, p_partkey % 10 AS c, p_size FROM {{part}}),
d AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{key}', '{v}')" for i, c in enumerate([[x for x in _tax.categories if x['code'] == code][0] for code in
      ['31171500', '31161500', '40141600', '26101100', '40151500', '39121000', '27112700', '41111700', '40142000', '31161500']]) for key, v in c['defaults'].items())}) t(c, key, val))"""


def _given(spark, sf):
    """Classified products carrying only a few hand-built extracted attributes."""
    def attr(key, val, num, kind, unit):
        return attribute(key=q(key), label=q(key.title()), val=val, num=num, kind=kind, unit=unit, prov="'supplied'", conf="0.99D",
                         evidence="'Supplier field'", method="'m'", grp="'General'")
    null = "CAST(NULL AS DOUBLE)"
    size = "CAST(regexp_extract(coalesce(mpn, name), '([0-9]+)', 1) AS DOUBLE)"
    df = classify(normalize(products(spark, sf)))
    df = E.attach_schema(df, spark, _tax)
    return df.withColumn("extracted", F.expr(
        f"CASE id % 10 WHEN 0 THEN IF(id % 3 = 0, array({attr('bore_diameter', q('30.0'), '30D', q('float'), q('mm'))}), {NO_ATTRIBUTES})"
        f" WHEN 1 THEN array({attr('grade', 'regexp_extract(mpn, ' + q('-(.*)$') + ', 1)', null, q('text'), NULL)})"
        f" WHEN 3 THEN array({attr('power_rating', q('2.0'), '2D', q('float'), q('kW'))}, {attr('voltage', q('460.0'), '460D', q('float'), q('V'))},"
        f" {attr('phase', 'IF(id % 3 = 0, ' + q('Single Phase') + ', ' + q('Three Phase') + ')', null, q('text'), NULL)})"
        f" WHEN 8 THEN array({attr('working_pressure', f'concat(CAST({size} AS BIGINT), ' + q('.0') + ')', size, q('float'), q('bar'))}) ELSE {NO_ATTRIBUTES} END"))


_SERIES = values([(s, k, float(v)) for s, row in fixed.SERIES.items() for k, v in zip(fixed.SERIES_KEYS, row)], "sname", "key", "num", name="sr")
_SNAME = "CASE p_size % 4 WHEN 0 THEN '6205' WHEN 1 THEN '6203' WHEN 2 THEN '6305' ELSE '6202' END"


@query("series_lookup", f"""WITH {_SERIES}, k AS (SELECT p_partkey AS id, {_SNAME} AS sname FROM {{part}} WHERE p_partkey % 10 = 0)
SELECT id, key, num, CASE WHEN key = 'bore_diameter' AND id % 3 = 0 THEN 'check' ELSE 'fill' END AS role FROM k JOIN sr USING (sname)""")
def series_lookup(spark, sf):
    """I1, I2"""
    df = I.from_series(_given(spark, sf)).where("category.code = '31171500'")
    fill = df.select("id", F.explode_outer("_series").alias("a"), F.lit("fill").alias("role"))
    check = df.select("id", F.explode_outer("standards").alias("a"), F.lit("check").alias("role"))
    return fill.unionByName(check).where("a IS NOT NULL").select("id", "a.key", "a.num", "role")


def _inferred(spark, sf):
    return I.infer(_given(spark, sf)).select("id", F.explode_outer("inferred").alias("a")).where("a IS NOT NULL").select("id", "a.*")


@query("grade_strength", """SELECT p_partkey AS id, CAST(CASE p_size % 3 WHEN 0 THEN 800 WHEN 1 THEN 1000 ELSE 700 END AS DOUBLE) AS num, 'ISO 898-1 specifies ' ||
  CASE p_size % 3 WHEN 0 THEN '800' WHEN 1 THEN '1000' ELSE '700' END || ' MPa minimum tensile strength for property class ' || CASE p_size % 3 WHEN 0 THEN '8.8' WHEN 1 THEN '10.9' ELSE 'A2-70' END || '.' AS evidence
  FROM {part} WHERE p_partkey % 10 = 1""")
def grade_strength(spark, sf):
    """I3"""
    return _inferred(spark, sf).where("method = 'standards-derivation'").select("id", "num", "evidence")


@query("arithmetic_derivations", """SELECT p_partkey AS id, 'full_load_current' AS key, round(2 * 1000 / (CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 1.732 END * 460 * 0.85 * 0.92), 3)::DOUBLE AS num, CAST(0.66 AS DOUBLE) AS conf FROM {part} WHERE p_partkey % 10 = 3
  UNION ALL SELECT p_partkey, 'burst_pressure', CAST(p_size * 4 AS DOUBLE), CAST(0.72 AS DOUBLE) FROM {part} WHERE p_partkey % 10 = 8""")
def arithmetic_derivations(spark, sf):
    """I4"""
    return _inferred(spark, sf).where("method = 'engineering-derivation'").select("id", "key", "num", "conf")


@query("category_defaults", f"WITH {_INFER_KEYS} SELECT id, key, val FROM k JOIN d USING (c)")
def category_defaults(spark, sf):
    """I5, I7"""
    return _inferred(spark, sf).where("prov = 'defaulted'").select("id", "key", "val")


@query("external_proposals", f"""WITH x AS (SELECT l_partkey AS id, CASE l_linenumber % 4 WHEN 0 THEN 'speed' WHEN 1 THEN 'phase' WHEN 2 THEN 'colour' ELSE 'frequency' END AS key,
   max(l_linenumber % 4) AS b, max(CAST(CAST(0.3 + l_linenumber / 10.0 AS DECIMAL(4,2)) AS DOUBLE)) AS cf FROM {{lineitem}} GROUP BY 1, 2)
SELECT id, key, CASE b WHEN 0 THEN 'knowledge_base' WHEN 1 THEN 'inferred' ELSE 'defaulted' END AS provenance,
  round(greatest(0.0, least(CASE b WHEN 0 THEN cf WHEN 1 THEN least(cf, 0.85) ELSE least(cf, 0.55) END, 1.0)), 3)::DOUBLE AS confidence FROM x
WHERE key <> 'colour' AND NOT (key = 'phase' AND id % 2 = 0)""")
def external_proposals(spark, sf):
    """I6"""
    p = view(spark, sf, """SELECT l_partkey AS id, CASE l_linenumber % 4 WHEN 0 THEN 'speed' WHEN 1 THEN 'phase' WHEN 2 THEN 'colour' ELSE 'frequency' END AS key,
      'v' AS value, CASE max(l_linenumber % 4) WHEN 0 THEN 'standard' WHEN 1 THEN 'engineering_inference' ELSE 'typical_value' END AS basis,
      max(CAST(CAST(0.3 + l_linenumber / 10.0 AS DECIMAL(4,2)) AS DOUBLE)) AS confidence, CAST(NULL AS STRING) AS evidence FROM {lineitem} GROUP BY 1, 2""", "lineitem")
    held = view(spark, sf, "SELECT p_partkey AS id, 'phase' AS key FROM {part} WHERE p_partkey % 2 = 0", "part")
    classified = view(spark, sf, f"SELECT p_partkey AS id, '{MOTOR}' AS code FROM {{part}}", "part")
    return I.accept_proposals(p, held, _tax.attribute_df(spark), classified).select("id", "key", "provenance", "confidence")


# ---------------------------------------------------------------------- gate

_GATE = """h AS (SELECT p_partkey AS id, 'k' || CAST(g.k AS STRING) AS key, 'K' AS label, CAST((p_partkey + g.k) % 3 AS STRING) AS val,
    CASE (p_partkey + g.k) % 6 WHEN 0 THEN 'supplied' WHEN 1 THEN 'parsed' WHEN 2 THEN 'knowledge_base' WHEN 3 THEN 'derived' ELSE 'defaulted' END AS prov
  FROM {part}, (VALUES (0), (1), (2), (3)) g(k)),
pr AS (SELECT p_partkey AS id, 'k' || CAST(g.k AS STRING) AS key, 'K' AS label, CAST(p_size % 3 AS STRING) AS val,
    CAST(CAST(0.4 + g.k / 10.0 AS DECIMAL(4,2)) AS DOUBLE) AS conf FROM {part}, (VALUES (2), (3), (4), (5)) g(k)),
j AS (SELECT coalesce(h.id, pr.id) AS id, coalesce(h.key, pr.key) AS key, h.val AS hv, h.prov AS hp, pr.val AS pv, pr.conf AS pc, CASE WHEN pr.id IS NULL THEN NULL
  WHEN h.id IS NULL THEN 'gap_filled' WHEN h.prov = 'defaulted' AND h.val <> pr.val THEN 'displaced_default' WHEN h.prov <> 'defaulted' AND h.val <> pr.val THEN 'refused' END AS action
  FROM h FULL JOIN pr ON h.id = pr.id AND h.key = pr.key)"""


def _decisions(spark, sf):
    def side(ks, val, prov, conf):
        return view(spark, sf, f"""SELECT id, concat('k', k) AS key, 'K' AS label, CAST({val} AS STRING) AS val, CAST(NULL AS DOUBLE) AS num, 'text' AS kind, CAST(NULL AS STRING) AS unit,
          {prov} AS prov, {conf} AS conf, 'seen' AS evidence, 'g' AS grp FROM (SELECT p_partkey AS id, p_size, explode(array({ks})) AS k FROM {{part}}) t""", "part")
    held = side("0, 1, 2, 3", "(id + k) % 3", "CASE (id + k) % 6 WHEN 0 THEN 'supplied' WHEN 1 THEN 'parsed' WHEN 2 THEN 'knowledge_base' WHEN 3 THEN 'derived' ELSE 'defaulted' END", "0.9D")
    proposed = side("2, 3, 4, 5", "p_size % 3", "'inferred'", "CAST(CAST(0.4 + k / 10.0 AS DECIMAL(4,2)) AS DOUBLE)")
    return G.decide(held, proposed)


@query("gate_actions", f"""WITH {_GATE} SELECT id, key, action, pv AS proposed, CASE WHEN action <> 'gap_filled' THEN hv END AS kept, CASE action
  WHEN 'gap_filled' THEN 'The deterministic engine found no value for this field, so the model''s proposal is recorded as an inference.'
  WHEN 'displaced_default' THEN 'The existing value was a category default carrying no supplier backing, which an informed inference outranks.'
  ELSE 'Refused: ' || CASE hp WHEN 'supplied' THEN 'the supplier stated this value' WHEN 'parsed' THEN 'this was parsed from the supplied identifiers'
    WHEN 'knowledge_base' THEN 'a published standard fixes this value' ELSE 'this was calculated from other known attributes' END || ', which outranks a model inference.' END AS reason
  FROM j WHERE action IS NOT NULL""")
def gate_actions(spark, sf):
    """G1, G3"""
    return G.actions(_decisions(spark, sf)).select("id", "key", "action", "proposed", "kept", "reason")


@query("gate_merge", f"""WITH {_GATE} SELECT id, key, CASE WHEN action IN ('gap_filled', 'displaced_default') THEN pv ELSE hv END AS val,
  CASE WHEN action IN ('gap_filled', 'displaced_default') THEN 'inferred' ELSE hp END AS prov, CAST(CASE WHEN action IN ('gap_filled', 'displaced_default') THEN least(pc, 0.6) ELSE 0.9 END AS DOUBLE) AS conf,
  CASE action WHEN 'gap_filled' THEN '[gate: gap fill] seen' WHEN 'displaced_default' THEN '[gate: displaced category default] seen' ELSE 'seen' END AS evidence FROM j""")
def gate_merge(spark, sf):
    """G1, G2"""
    return G.merged(_decisions(spark, sf)).select("id", "key", "val", "prov", "conf", "evidence")


@query("gate_counts", f"""WITH {_GATE} SELECT id, count(*) FILTER (WHERE action = 'gap_filled') AS gap_filled, count(*) FILTER (WHERE action = 'displaced_default') AS displaced_defaults,
  count(*) FILTER (WHERE action = 'refused') AS refused FROM j WHERE action IS NOT NULL GROUP BY id""")
def gate_counts(spark, sf):
    """G3"""
    return G.action_counts(_decisions(spark, sf))


@query("gated_records")
def gated_records(spark, sf):
    """G4"""
    proposal = attribute(key="'frequency'", label="'Frequency'", val="'50'", num="50D", kind="'int'", unit="'Hz'", prov="'knowledge_base'", conf="0.9D",
                         evidence="'proposed'", method="'x'", grp="'Electrical'")
    df = T.copywrite(_bed(spark, sf)).withColumn("proposed", F.expr(f"array({proposal})"))
    return G.apply_to_records(df).select("id", F.size("attributes").alias("attributes"), "readiness.overall", "readiness.verdict")


# -------------------------------------------------------------------- export

def _full(spark, sf):
    return score(Q.validate(T.compliance(T.copywrite(_bed(spark, sf))), standards=False))


_SHEET = ["phase", "voltage", "full_load_current", "frame_size", "power_rating", "speed"]


@query("export_sheet", f"""WITH {_A}, {_R}, p AS (SELECT id, {', '.join(f"max(val || coalesce(' ' || unit, '')) FILTER (WHERE key = '{k}') AS {k}, max(prov) FILTER (WHERE key = '{k}') AS {k}_p" for k in _SHEET)} FROM a GROUP BY id)
SELECT sku, mpn, coalesce(brand, '') AS brand, '{MOTOR}' AS category_code, '{' > '.join(_motor['path'])}' AS category_path, {', '.join(f"coalesce({k}, '') AS {k}, coalesce({k}_p, '') AS {k}_provenance" for k in _SHEET)} FROM r LEFT JOIN p USING (id)""")
def export_sheet(spark, sf):
    """X1, X2, X3"""
    rows = X.to_rows(_full(spark, sf), "catalog_csv")
    return rows.select("sku", "mpn", "brand", "category_code", "category_path", *[c for k in _SHEET for c in (
        F.col(k), F.col(f"`{k}.provenance`").alias(f"{k}_provenance"))])


@query("export_columns", f"WITH {_A}, {_W}, f AS (SELECT key, min(id * 100 + n) AS f FROM w GROUP BY key) SELECT key, row_number() OVER (ORDER BY f) AS position FROM f")
def export_columns(spark, sf):
    """Attribute columns of the batch in first-seen order."""
    keys = X.dynamic_keys(_bed(spark, sf), set())
    return spark.createDataFrame([(k, i + 1) for i, k in enumerate(keys)], "key string, position bigint")


@query("audit_sheet", f"""WITH {_A}, {_R}, p AS (SELECT id, {', '.join(f"max(val || coalesce(' ' || unit, '')) FILTER (WHERE key = '{k}') AS {k}, max(prov) FILTER (WHERE key = '{k}') AS {k}__provenance, max(conf) FILTER (WHERE key = '{k}') AS {k}__c" for k in _SHEET)} FROM a GROUP BY id)
SELECT sku, mpn, coalesce(brand, '') AS brand, {', '.join(f"coalesce({k}, '') AS {k}, coalesce({k}__provenance, '') AS {k}__provenance, coalesce(CAST({k}__c AS STRING), '') AS {k}__confidence, CASE WHEN {k} IS NULL THEN '' ELSE 'https://x.example' END AS {k}__source" for k in _SHEET)} FROM r LEFT JOIN p USING (id)""")
def audit_sheet(spark, sf):
    """X6"""
    rows = X.audit_rows(_full(spark, sf))
    return rows.select("sku", "mpn", "brand", *[k + s for k in _SHEET for s in ("", "__provenance", "__confidence", "__source")])


@query("slot_block", f"""WITH {_A}, {_W} SELECT r.id, {', '.join(f"coalesce(max(label) FILTER (WHERE n = {i}), '') AS label_{i}, coalesce(max(CASE WHEN kind = 'float' THEN CAST(CAST(num AS BIGINT) AS STRING) ELSE val END) FILTER (WHERE n = {i}), '') AS value_{i}, coalesce(max(unit) FILTER (WHERE n = {i}), '') AS unit_{i}" for i in (1, 2, 7))}
FROM (SELECT p_partkey AS id FROM {{part}}) r LEFT JOIN w USING (id) GROUP BY r.id""")
def slot_block(spark, sf):
    """X4"""
    spec = {"fields": [{"target": "sku", "from": "input.sku"}, {"slots": {"source": "attributes", "count": 7, "columns": [
        {"target": "label_{n}", "from": "label"}, {"target": "value_{n}", "from": "value"}, {"target": "unit_{n}", "from": "unit"}]}}]}
    rows = X.to_rows(_full(spark, sf), spec)
    return rows.select(F.expr("CAST(substring(sku, 5) AS BIGINT)").alias("id"), *[f"{c}_{i}" for i in (1, 2, 7) for c in ("label", "value", "unit")])


@query("nested_documents", f"""WITH {_A}, {_R} SELECT r.id, 'Product' AS kind, mpn, brand, (SELECT count(*) FROM a WHERE a.id = r.id) AS properties,
  (SELECT max(num) FROM a WHERE a.id = r.id AND key = 'power_rating') AS power FROM r""")
def nested_documents(spark, sf):
    """X5"""
    docs = X.to_documents(_full(spark, sf), "schema_org")
    j = "from_json(document, 'struct<`@type`:string,mpn:string,brand:string,additionalProperty:array<struct<propertyID:string,value:string>>>')"
    return docs.withColumn("j", F.expr(j)).select(
        "id", F.col("j.@type").alias("kind"), "j.mpn", "j.brand", F.size("j.additionalProperty").cast("bigint").alias("properties"),
        F.expr("CAST(get(filter(j.additionalProperty, p -> p.propertyID = 'power_rating'), 0).value AS DOUBLE)").alias("power"))


@query("delivery_sheet")
def delivery_sheet(spark, sf):
    """X7"""
    return X.to_rows(_full(spark, sf), "delivery")


# ----------------------------------------------------------- the whole chain

@query("enriched_products")
def enriched_products(spark, sf):
    """Everything from raw products to verdicts."""
    df = enrich(spark, products(spark, sf))
    return df.select("id", F.col("category.code").alias("code"), F.size("attributes").alias("attributes"), F.size("issues").alias("issues"),
                     "readiness.overall", "readiness.verdict", "compliance.compliant", "content.title")


def _extracted(spark, sf):
    df = E.extract(classify(normalize(products(spark, sf))), spark, _tax)
    return df


@query("extracted_attributes")
def extracted_attributes(spark, sf):
    """E1, E2, E4-E8, E11-E13"""
    df = _extracted(spark, sf).select("id", F.explode_outer("extracted").alias("a")).where("a IS NOT NULL")
    return df.select("id", "a.key", "a.val", "a.unit", "a.norm", "a.prov", "a.conf", "a.method", "a.evidence", "a.locator")


def _long_extracted(spark, sf):
    return _extracted(spark, sf).select("id", F.explode_outer("extracted").alias("a")).where("a IS NOT NULL").select("id", "a.*")


@query("mapped_measures", """SELECT p_partkey AS id, 'burst_pressure' AS key, CAST(p_size * 20 AS DOUBLE) AS num, 'bar' AS unit, CAST(0.99 AS DOUBLE) AS conf,
  'Supplier field ''Burst Pressure''' || CASE WHEN p_partkey % 5 = 0 THEN ' of sheet.pdf' ELSE '' END || ' = ''' || CAST(p_size * 20 AS STRING) || ' bar''' AS evidence FROM {part} WHERE p_partkey % 10 = 8
UNION ALL SELECT p_partkey, 'outer_diameter', CASE p_size % 4 WHEN 0 THEN 52.0 WHEN 1 THEN 40.0 WHEN 2 THEN 62.0 ELSE 35.0 END, 'mm', 0.99,
  'Supplier field ''Outer Diameter''' || CASE WHEN p_partkey % 5 = 0 THEN ' of sheet.pdf' ELSE '' END || ' = ''' || CASE p_size % 4 WHEN 0 THEN '52 mm' WHEN 1 THEN '40 mm' WHEN 2 THEN '2.441 in' ELSE '35 mm' END || '''' ||
  CASE WHEN p_size % 4 = 2 THEN '; converted 2.441 in to mm' ELSE '' END FROM {part} WHERE p_partkey % 10 = 0""")
def mapped_measures(spark, sf):
    """E2, E4, E7, E12, E13"""
    return _long_extracted(spark, sf).where("key IN ('burst_pressure', 'outer_diameter') AND method = 'structured-spec-mapping'").select("id", "key", "num", "unit", "conf", "evidence")


@query("mapped_flags", """SELECT p_partkey AS id, 'self_priming' AS key, CASE p_size % 2 WHEN 0 THEN 'True' ELSE 'False' END AS val FROM {part} WHERE p_partkey % 10 = 4
UNION ALL SELECT p_partkey, 'grade', CASE p_size % 3 WHEN 0 THEN '8.8' WHEN 1 THEN '10.9' ELSE 'A2-70' END FROM {part} WHERE p_partkey % 10 = 1""")
def mapped_flags(spark, sf):
    """E5, E6"""
    return _long_extracted(spark, sf).where("key IN ('self_priming', 'grade')").select("id", "key", "val")


@query("labelled_prose", """SELECT p_partkey AS id, 'inner_diameter' AS key, '12.7' AS val, CAST(0.82 AS DOUBLE) AS conf, 'Found in product text: "Inner diameter: 12.7 mm"' AS evidence FROM {part} WHERE p_partkey % 10 = 8
UNION ALL SELECT p_partkey, 'voltage', '460.0', 0.82, 'Found in product text: "Rated voltage: 460 V"' FROM {part} WHERE p_partkey % 10 = 3
UNION ALL SELECT p_partkey, 'max_head', CAST(p_size AS STRING) || '.0', 0.82, 'Found in product text: "Max head: ' || CAST(p_size AS STRING) || ' m"' FROM {part} WHERE p_partkey % 10 = 4""")
def labelled_prose(spark, sf):
    """E8"""
    return _long_extracted(spark, sf).where("method = 'text-pattern-extraction' AND key IN ('inner_diameter', 'voltage', 'max_head')").select(
        "id", "key", "val", "conf", "evidence")


@query("unit_anchored_prose", """SELECT p_partkey AS id, 'power_rating' AS key, round(CAST(p_size AS DOUBLE) * 0.7457 * pow(10, greatest(3 - CAST(floor(log10(p_size * 0.7457)) AS INT), 0)))
   / pow(10, greatest(3 - CAST(floor(log10(p_size * 0.7457)) AS INT), 0)) AS num, CAST(0.79 AS DOUBLE) AS conf FROM {part} WHERE p_partkey % 10 = 3
UNION ALL SELECT p_partkey, 'speed', 1750.0, 0.79 FROM {part} WHERE p_partkey % 10 = 3""")
def unit_anchored_prose(spark, sf):
    """E9, E9b"""
    return _long_extracted(spark, sf).where("method = 'unit-anchored-extraction' AND key IN ('power_rating', 'speed')").select("id", "key", "num", "conf")


@query("vocabulary_in_prose", """SELECT p_partkey AS id, 'seat_material' AS key, 'PTFE' AS val FROM {part} WHERE p_partkey % 10 = 2
UNION ALL SELECT p_partkey, 'connection_type', 'NPT Threaded' FROM {part} WHERE p_partkey % 10 = 2
UNION ALL SELECT p_partkey, 'enclosure', 'TEFC' FROM {part} WHERE p_partkey % 10 = 3
UNION ALL SELECT p_partkey, 'seal_type', '2RS (Rubber Sealed)' FROM {part} WHERE p_partkey % 10 = 0
UNION ALL SELECT p_partkey, 'coating', 'TiAlN' FROM {part} WHERE p_partkey % 10 = 6""")
def vocabulary_in_prose(spark, sf):
    """E10"""
    return _long_extracted(spark, sf).where("method = 'vocabulary-match' AND key IN ('seat_material', 'connection_type', 'enclosure', 'seal_type', 'coating')").select("id", "key", "val")


@query("unmapped_fields")
def unmapped_fields(spark, sf):
    """E3"""
    return E.unmapped_fields(_extracted(spark, sf))


@query("standard_contradictions", f"""WITH k AS (SELECT p_partkey AS id, p_size % 4 AS m, p_size FROM {{part}} WHERE p_partkey % 10 = 0)
SELECT id, 'bore_diameter' AS key, '30 mm' AS held, CASE m WHEN 0 THEN '25 mm' WHEN 1 THEN '17 mm' WHEN 2 THEN '25 mm' ELSE '15 mm' END AS standard FROM k WHERE p_size % 5 = 0
UNION ALL SELECT id, 'width', '15 mm', CASE m WHEN 1 THEN '12 mm' WHEN 2 THEN '17 mm' ELSE '11 mm' END FROM k WHERE m <> 0""")
def standard_contradictions(spark, sf):
    """R2, R3, Q24"""
    df = resolve(spark, products(spark, sf)).select("id", F.explode_outer("standard_conflicts").alias("c")).where("c IS NOT NULL")
    return df.select("id", "c.key", "c.held", "c.standard")


@query("stage_ledger")
def stage_ledger(spark, sf):
    """B4"""
    return B.stage_ledger(enrich(spark, products(spark, sf), formats=False))


@query("open_keys")
def open_keys(spark, sf):
    """Keys an external proposer would be asked for."""
    return I.gaps(resolve(spark, products(spark, sf)).where("schema IS NOT NULL")).select("id", F.array_join("open_keys", ",").alias("keys"))


