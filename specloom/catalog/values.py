"""Claims, units and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed
from ..functions import style, units
from ..operators import claims as C, reconcile as R
from ..plans.testbed import CLAIM_RANK, CLAIMS, MEASURES, view
from .registry import query, values

ORDER = ["o1", "o2", "o3", "o4", "o5"]
_U = values([(s, d, f, o) for s, (d, f, o) in fixed.UNITS.items()], "s", "d", "f", "o", name="u")
_CANON = values(list(fixed.CANONICAL_UNIT.items()), "d", "c", name="cn")

_FOLD = f"""
WITH c AS ({CLAIMS}), g AS (
  SELECT id, key, list({{'val': val, 'rank': {CLAIM_RANK}, 'conf': conf, 'prov': prov, 'n': CAST(0 AS BIGINT)}}
    ORDER BY o1, o2, o3, o4, o5) AS l FROM c GROUP BY id, key),
w AS (SELECT id, key, list_reduce(l, lambda a, x:
  CASE WHEN x.rank > a.rank OR (x.rank = a.rank AND x.conf > a.conf)
    THEN {{'val': x.val, 'rank': x.rank, 'conf': CASE WHEN x.val <> a.val THEN round(greatest(x.conf - 0.05, 0.1), 3) ELSE x.conf END,
           'prov': x.prov, 'n': a.n + CASE WHEN x.val <> a.val THEN 1 ELSE 0 END}}
    ELSE {{'val': a.val, 'rank': a.rank, 'conf': CASE WHEN x.val <> a.val THEN round(greatest(a.conf - 0.05, 0.1), 3) ELSE a.conf END,
           'prov': a.prov, 'n': a.n + CASE WHEN x.val <> a.val THEN 1 ELSE 0 END}} END) AS w FROM g)
"""


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, CLAIMS, "lineitem")


@query("reconcile_claims", _FOLD + "SELECT id, key, w.val AS val, w.prov AS prov, w.conf AS conf, w.n AS conflicts FROM w")
def reconcile_claims(spark, sf):
    """R1"""
    return C.reconcile_claims(_claims(spark, sf), ORDER)


_LOG = _FOLD[:_FOLD.index("w AS (")] + """
w AS (SELECT id, key, list_reduce(list_transform(l, lambda x: {'val': x.val, 'rank': x.rank, 'conf': x.conf, 'prov': x.prov, 'log': CAST([] AS VARCHAR[])}), lambda a, x:
  CASE WHEN x.rank > a.rank OR (x.rank = a.rank AND x.conf > a.conf)
    THEN {'val': x.val, 'rank': x.rank, 'conf': CASE WHEN x.val <> a.val THEN round(greatest(x.conf - 0.05, 0.1), 3) ELSE x.conf END, 'prov': x.prov,
      'log': CASE WHEN x.val <> a.val THEN list_append(a.log, 'kept ' || x.val || ' (' || x.prov || ') over ' || a.val || ' (' || a.prov || ')') ELSE a.log END}
    ELSE {'val': a.val, 'rank': a.rank, 'conf': CASE WHEN x.val <> a.val THEN round(greatest(a.conf - 0.05, 0.1), 3) ELSE a.conf END, 'prov': a.prov,
      'log': CASE WHEN x.val <> a.val THEN list_append(a.log, 'kept ' || a.val || ' (' || a.prov || ') over ' || x.val || ' (' || x.prov || ')') ELSE a.log END} END) AS w FROM g)
SELECT id, key, unnest(w.log) AS line, CAST(generate_subscripts(w.log, 1) - 1 AS INT) AS n FROM w"""


@query("conflict_log", _LOG)
def conflict_log(spark, sf):
    """R5"""
    return C.conflict_log(_claims(spark, sf), ORDER).select("id", "key", "n", "line")


@query("record_confidence", _FOLD + f""", a AS (SELECT id, w.prov AS prov, w.conf AS conf FROM w)
SELECT id, round(sum(conf * ({CLAIM_RANK}) / 6.0) / sum(({CLAIM_RANK}) / 6.0) * 100, 2) AS confidence,
  count(*) AS attributes FROM a GROUP BY id""")
def record_confidence(spark, sf):
    """K2"""
    settled = C.reconcile_claims(_claims(spark, sf), ORDER)
    return C.confidence(settled).withColumn("confidence", F.round("confidence", 2))


_PARSED = f"""
WITH {_U}, {_CANON}, m AS ({MEASURES}), t AS (SELECT id, trim(txt) AS txt FROM m),
r AS (SELECT *, regexp_extract(txt, '(?i)(?:(\\d+)\\s*[-\\s])?(\\d+)\\s*/\\s*(\\d+)\\s*(in|inch|inches|")?', ['w','n','d']) AS fr,
  regexp_extract(txt, '([-+]?\\d+(?:[.,]\\d+)?)\\s*(°?[a-zA-Z³/"]+(?:/[a-zA-Z0-9³]+)?|")?', ['num','unit']) AS q FROM t),
p AS (SELECT id, txt, CASE WHEN contains(txt, '/') AND TRY_CAST(fr.d AS DOUBLE) <> 0
    THEN round(coalesce(TRY_CAST(fr.w AS DOUBLE), 0) + TRY_CAST(fr.n AS DOUBLE) / TRY_CAST(fr.d AS DOUBLE), 5)
    ELSE TRY_CAST(replace(q.num, ',', '.') AS DOUBLE) END AS num,
  CASE WHEN contains(txt, '/') AND TRY_CAST(fr.d AS DOUBLE) <> 0 THEN 'in'
    WHEN q.num <> '' THEN CASE WHEN EXISTS (SELECT 1 FROM u WHERE u.s = lower(q.unit)) THEN q.unit ELSE 'mm' END END AS unit FROM r)
"""


@query("measure_parse", _PARSED + """
SELECT id, num, unit, u.d AS dimension, round((num + u.o) * u.f, 6) AS norm, cn.c AS norm_unit
FROM p LEFT JOIN u ON u.s = lower(unit) LEFT JOIN cn ON cn.d = u.d""")
def measure_parse(spark, sf):
    """U1, U2, U4, U5"""
    df = view(spark, sf, MEASURES, "lineitem").select("id", units.parse_measure("txt", "'mm'").alias("m"))
    df = df.select("id", F.col("m.num").alias("num"), F.col("m.unit").alias("unit"))
    return df.select("id", "num", "unit", units.unit_dimension("unit").alias("dimension"),
                     units.normalize_unit("num", "unit").alias("n")).select(
        "id", "num", "unit", "dimension", F.col("n.value").alias("norm"), F.col("n.unit").alias("norm_unit"))


@query("unit_convert", f"""
WITH {_U}, x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS v,
  CASE l_linenumber % 5 WHEN 0 THEN 'in' WHEN 1 THEN 'HP' WHEN 2 THEN 'psi' WHEN 3 THEN '°F' ELSE 'gpm' END AS a,
  CASE l_linenumber % 5 WHEN 0 THEN 'mm' WHEN 1 THEN 'kW' WHEN 2 THEN 'bar' WHEN 3 THEN 'C' ELSE 'rpm' END AS b FROM {{lineitem}}),
c AS (SELECT id, CASE WHEN s.d = t.d THEN (v + s.o) * s.f / t.f - t.o END AS c FROM x
  LEFT JOIN u s ON s.s = lower(a) LEFT JOIN u t ON t.s = lower(b))
SELECT id, round(c, 4) AS converted,
  CASE WHEN c IS NULL THEN NULL WHEN c = 0 THEN 0 ELSE
    round(c * pow(10, greatest(3 - CAST(floor(log10(abs(c))) AS INT), 0))) / pow(10, greatest(3 - CAST(floor(log10(abs(c))) AS INT), 0)) END AS tidied
FROM c""")
def unit_convert(spark, sf):
    """U3, U6"""
    df = view(spark, sf, """SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS v,
      CASE l_linenumber % 5 WHEN 0 THEN 'in' WHEN 1 THEN 'HP' WHEN 2 THEN 'psi' WHEN 3 THEN '°F' ELSE 'gpm' END AS a,
      CASE l_linenumber % 5 WHEN 0 THEN 'mm' WHEN 1 THEN 'kW' WHEN 2 THEN 'bar' WHEN 3 THEN 'C' ELSE 'rpm' END AS b
      FROM {lineitem}""", "lineitem").withColumn("c", units.convert_unit("v", "a", "b"))
    return df.select("id", F.round("c", 4).alias("converted"), units.tidy_value("c").alias("tidied"))


_SPELLINGS = values([(d, len(units.spellings(d)), units.spellings(d)[0]) for d in fixed.CANONICAL_UNIT], "d", "n", "longest", name="sp")


@query("display_value", """
SELECT l_orderkey * 10 + l_linenumber AS id, count(*) AS rows,
  min(printf('%g', floor(l_extendedprice * 100 + 0.5) / 1000)) || ' kW' AS shown FROM {lineitem} GROUP BY 1""")
def display_value(spark, sf):
    """U7"""
    df = view(spark, sf, """SELECT l_orderkey * 10 + l_linenumber AS id,
        floor(l_extendedprice * 100 + 0.5) / 1000 AS v FROM {lineitem}""", "lineitem")
    df = df.withColumn("s", units.show_value("CAST(NULL AS STRING)", "v", "'float'", "CAST(NULL AS STRING)"))
    return df.groupBy("id").agg(F.count("*").alias("rows"), F.concat(F.min("s"), F.lit(" kW")).alias("shown"))


@query("values_agree", """
WITH x AS (SELECT l_orderkey AS id, l_linenumber AS line, l_suppkey AS s, l_quantity AS a, l_quantity + l_discount * 5 AS b FROM {lineitem})
SELECT count(*) AS pairs, count(*) FILTER (WHERE abs(a - b) <= greatest(abs(b) * 0.01, 1e-9)) AS agree,
  count(*) FILTER (WHERE CAST(CAST(a AS BIGINT) AS STRING) = CAST(CAST(floor(b) AS BIGINT) AS STRING)) AS same_text FROM x""")
def values_agree(spark, sf):
    """R3"""
    df = view(spark, sf, """SELECT named_struct('norm', l_quantity, 'val', CAST(CAST(l_quantity AS BIGINT) AS STRING)) AS h,
        named_struct('norm', l_quantity + l_discount * 5, 'val', CAST(CAST(floor(l_quantity + l_discount * 5) AS BIGINT) AS STRING)) AS s,
        l_quantity AS a, l_quantity + l_discount * 5 AS b FROM {lineitem}""", "lineitem")
    return df.agg(F.count("*").alias("pairs"), F.count_if(F.expr(R.VALUES_AGREE)).alias("agree"),
                  F.count_if(F.expr("h.val = s.val")).alias("same_text"))


_UOM = values(style.uom_rows(), "s", "m", "a", name="uom")
_FRACTION = """CASE WHEN abs(abs(v) * 64 - round(abs(v) * 64)) > 1e-9 THEN NULL ELSE
  CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN CAST(round(abs(v) * 64) AS BIGINT) % 64 = 0
    THEN CAST(CAST(round(abs(v) * 64) AS BIGINT) // 64 AS STRING)
    ELSE CASE WHEN CAST(round(abs(v) * 64) AS BIGINT) // 64 > 0 THEN CAST(CAST(round(abs(v) * 64) AS BIGINT) // 64 AS STRING) || '-' ELSE '' END
      || CAST(CAST(round(abs(v) * 64) AS BIGINT) % 64 // gcd(CAST(round(abs(v) * 64) AS BIGINT) % 64, 64) AS STRING)
      || '/' || CAST(64 // gcd(CAST(round(abs(v) * 64) AS BIGINT) % 64, 64) AS STRING) END END"""
_TRIM = ("CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS STRING)"
         " ELSE regexp_replace(regexp_replace(printf('%.6f', v), '0+$', ''), '\\.$', '') END")
_STYLED = """
SELECT l_orderkey * 10 + l_linenumber AS id, (l_quantity - 25) * (l_linenumber * 2 + l_suppkey % 3) / 64 AS v,
  CASE l_linenumber % 6 WHEN 0 THEN 'inches' WHEN 1 THEN 'IN.' WHEN 2 THEN 'Volts' WHEN 3 THEN 'furlongs' WHEN 4 THEN '"' ELSE 'lbs/sq in' END AS unit
FROM {lineitem}"""


@query("house_style_measure", f"""
WITH {_UOM}, x AS ({_STYLED}), f AS (SELECT x.*, {_FRACTION} AS fr, {_TRIM} AS tr, uom.m, uom.a FROM x LEFT JOIN uom ON uom.s = lower(trim(unit)))
SELECT id, count(*) AS rows, min(a) AS abbreviation, min(fr) AS fraction,
  min(CASE WHEN a IS NULL THEN NULL ELSE coalesce(CASE WHEN a = 'in' THEN fr END, tr) || ' ' || a END) AS written,
  min(CASE WHEN a IS NULL THEN NULL ELSE coalesce(CASE WHEN a = 'in' THEN fr END, tr) || upper(a) END) AS compact,
  min(coalesce(CASE WHEN a = 'in' THEN fr END, tr)) AS bare FROM f GROUP BY id""")
def house_style_measure(spark, sf):
    """T5, T6, T8, T9"""
    df = view(spark, sf, _STYLED, "lineitem").withColumn("val", F.lit(None).cast("string"))
    df = df.withColumns({
        "a": F.expr(f"{style.approved_unit('unit')}.abbr"), "f": F.expr(style.to_fraction("v")),
        "w": F.expr(style.measurement("val", "v", "unit", False)), "c": F.expr(style.measurement("val", "v", "unit", True)),
        "b": F.expr(style.value_only("CAST(v AS STRING)", "v", "unit"))})
    return df.groupBy("id").agg(F.count("*").alias("rows"), F.min("a").alias("abbreviation"), F.min("f").alias("fraction"),
                                F.min("w").alias("written"), F.min("c").alias("compact"), F.min("b").alias("bare"))


@query("fraction_to_decimal", """
SELECT l_orderkey * 10 + l_linenumber AS id, count(*) AS rows, min(CASE WHEN l_linenumber % 3 = 2 THEN NULL ELSE
  CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_linenumber AS DOUBLE) ELSE 0 END + CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) / 8 END) AS number
FROM {lineitem} GROUP BY 1""")
def fraction_to_decimal(spark, sf):
    """T7"""
    df = view(spark, sf, """SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 3
      WHEN 0 THEN CAST(l_linenumber AS STRING) || '-' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || '/8'
      WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' / 8' ELSE 'M' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || '/8' END AS t
      FROM {lineitem}""", "lineitem")
    return df.groupBy("id").agg(F.count("*").alias("rows"), F.min(F.expr(style.from_fraction("t"))).alias("number"))
