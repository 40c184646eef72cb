"""Catalogue-shaped views over the given tables.

Each view is SQL text that both Spark and an ANSI engine accept, so a query and its
oracle start from the same rows.  Every view reads whole tables; one product, claim
or page comes out for each source row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.stage import spread
from ..functions.text import q

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, *names: str, heavy: bool = False) -> DataFrame:
    """Run testbed SQL with its tables bound as DataFrames (no temp views).

    ``heavy`` deals the tables' own rows out to every core before the SQL makes text of them.
    """
    text = sql.replace("{", "{{").replace("}", "}}")
    for n in names:
        text = text.replace("{{" + n + "}}", "{" + n + "}")
    read = (lambda n: spread(table(spark, sf_dir, n))) if heavy else (lambda n: table(spark, sf_dir, n))
    return spark.sql(text, **{n: read(n) for n in names})


def bound(sql: str, *names: str) -> str:
    """The same SQL with table placeholders filled for an engine that has views."""
    for n in names:
        sql = sql.replace("{" + n + "}", n)
    return sql


# ------------------------------------------------------------------- claims
# six (flag, status) pairs -> six provenance classes
CLAIMS = """
SELECT l_partkey AS id, 'unit_price' AS key,
  l_orderkey AS o1, l_linenumber AS o2, l_suppkey AS o3, l_quantity AS o4, l_extendedprice AS o5,
  CAST(CAST(floor(l_extendedprice / l_quantity / 100) AS BIGINT) AS STRING) AS val,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'supplied'
       WHEN l_returnflag = 'A' THEN 'parsed'
       WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'knowledge_base'
       WHEN l_returnflag = 'N' THEN 'derived'
       WHEN l_linestatus = 'F' THEN 'inferred' ELSE 'defaulted' END AS prov,
  CAST(round(0.5 + l_linenumber / 20.0, 3) AS DOUBLE) AS conf
FROM {lineitem}"""
CLAIM_RANK = ("CASE prov WHEN 'supplied' THEN 6 WHEN 'parsed' THEN 5 WHEN 'knowledge_base' THEN 4"
              " WHEN 'derived' THEN 3 WHEN 'inferred' THEN 2 ELSE 1 END")

# ----------------------------------------------------------------- products
_K = "(p_partkey % 10)"
_S = "CAST(p_size AS STRING)"
_SERIES = "CASE p_size % 4 WHEN 0 THEN '6205' WHEN 1 THEN '6203' WHEN 2 THEN '6305' ELSE '6202' END"
_GRADE = "CASE p_size % 3 WHEN 0 THEN '8.8' WHEN 1 THEN '10.9' ELSE 'A2-70' END"
_BRANDS = ["SKF Group", "wurth", "swagelok", "WEG", "Grundfos", "Danfoss", "Kennametal", "ifm electronic", "gates", None]


def _by_k(values: list[str | None]) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v)
    return f"CASE {_K} {whens} END"


PRODUCTS = f"""
SELECT p_partkey AS id, 'SKU-' || CAST(p_partkey AS STRING) AS sku,
  {_by_k([_SERIES + " || '-2RS'", "'M10x' || " + _S + " || '-' || " + _GRADE, None, "'W22-' || " + _S,
          "'PX' || " + _S, None, "'EM-' || " + _S, "'IFS' || " + _S, "'H' || " + _S, None])} AS mpn,
  {_by_k([q(b) if b else "CASE WHEN p_partkey % 20 = 9 THEN p_brand END" for b in _BRANDS])} AS brand,
  {_by_k(["'Deep groove  ball bearing ' || " + _SERIES, "'Hex bolt M10'",
          "'Ball valve 1/2 inch'", "'Three phase induction motor ' || " + _S + " || ' HP'",
          "'Centrifugal pump'", "'Variable frequency drive'", "'End mill ' || " + _S + " || ' mm'",
          "'Pressure sensor'", "'Hydraulic hose'", "p_name"])} AS name,
  {_by_k(["'Replaces the older ' || " + _SERIES + " || ' in this housing.'",
          "'Zinc plated steel fastener, part no: FX-' || CAST(p_partkey AS STRING)",
          "'PTFE seat, NPT threaded, working pressure ' || CAST(p_size * 100 AS STRING) || ' psi'",
          "'Rated voltage: 460 V, 1750 rpm, TEFC enclosure, frame 184T'",
          "'Max head: ' || " + _S + " || ' m; flow rate ' || CAST(p_size * 10 AS STRING) || ' L/min'",
          "'Rated for  ' || " + _S + " || ' kW, Modbus RTU. model VFD-' || " + _S,
          "'Solid carbide, TiAlN coating, 4 flutes'", "'Output signal: 4-20 mA, supply voltage: 24 VDC'",
          "'Inner diameter: 12.7 mm, 2-wire braid'", None])} AS description,
  {_by_k([None, None, None, "'electric motor'", None, None, None, None, None, "p_type"])} AS category_hint,
  CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS price,
  CASE WHEN p_partkey % 6 = 0 THEN 'USD' END AS currency,
  CASE WHEN p_partkey % 4 = 0 THEN 'https://www.skf.com/p/' || CAST(p_partkey AS STRING) END AS source_url,
  CASE WHEN p_partkey % 5 = 0 THEN 'sheet.pdf' END AS source_document,
  CASE WHEN p_partkey % 7 = 0 THEN 'EAN: 40' || CAST(10000000 + p_partkey AS STRING) END AS free_text
FROM {{part}}"""

# ordered spec pairs: (position, key, value); a null value means the row has no such pair
SPECS: list[tuple[str, str]] = [
    (_by_k(["'Bore'", "'Grade'", "'Body Material'", "'Efficiency'", "'Inlet Size'", "'Input Voltage'", "'Overall Length'",
            "'Ingress Protection'", "'Burst Pressure'", "'Bore Size'"]),
     _by_k(["CASE WHEN p_size % 5 = 0 THEN '30 mm' ELSE CASE p_size % 4 WHEN 0 THEN '25 mm' WHEN 1 THEN '17 mm'"
            " WHEN 2 THEN '25 mm' ELSE '15 mm' END END",
            _GRADE, "CASE p_size % 3 WHEN 0 THEN 'PVC' WHEN 1 THEN 'brass' ELSE 'SS316' END", "'IE3'",
            "'2 in'", "'400 VAC'", _S + " || ' mm'", "CASE p_size % 2 WHEN 0 THEN 'IP67' ELSE 'IP68K9' END",
            "CAST(p_size * 20 AS STRING) || ' bar'", "CAST(20 + p_size AS STRING) || ' mm'"])),
    (_by_k(["'Outer Diameter'", "'Tensile Strength'", "'Max Temperature'", "'Full Load Current'", "'Outlet Size'", "'Power'",
            "'Flute Length'", "'Measuring Range'", "'Working Pressure'", "'Stroke Length'"]),
     _by_k(["CASE p_size % 4 WHEN 0 THEN '52 mm' WHEN 1 THEN '40 mm' WHEN 2 THEN '2.441 in' ELSE '35 mm' END",
            "CASE p_size % 3 WHEN 0 THEN '800 MPa' WHEN 1 THEN '900 MPa' ELSE '700 MPa' END",
            "CAST(p_size * 6 AS STRING) || ' C'", "CAST(p_size * 3 AS STRING) || ' A'", "'1-1/2 in'", _S + " || ' kW'",
            "'20 mm'", "'0-16 bar'", "CAST(p_size * 6 AS STRING) || ' bar'", "CAST(p_size * 10 AS STRING) || ' mm'"])),
    (_by_k(["'Width'", "'Material'", None, None, "'Self Priming'", "'Protection'", "'Number of Flutes'", None, "'Material'",
            "'Finish'"]),
     _by_k(["'15 mm'", "CASE p_size % 2 WHEN 0 THEN '316 Stainless Steel' ELSE 'Alloy Steel' END", None, None,
            "CASE p_size % 2 WHEN 0 THEN 'yes' ELSE 'no' END", "'IP21'", "'4'", None, "'PTFE'", "p_type"])),
    ("'Manufacturer'", "CASE WHEN p_partkey % 8 = 0 THEN p_brand || '  Works' END"),
]

SPEC_ROWS = " UNION ALL ".join(
    f"SELECT p_partkey AS id, {i} AS pos, {k} AS key, {v} AS value FROM {{part}}" for i, (k, v) in enumerate(SPECS))
SPEC_ROWS = f"SELECT id, pos, key, value FROM ({SPEC_ROWS}) t WHERE value IS NOT NULL AND key IS NOT NULL"


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with their spec pairs nested in supplier order, dealt out to every core."""
    pairs = ", ".join(f"named_struct('key', {k}, 'value', {v}, 'locator', CAST(NULL AS STRING))" for k, v in SPECS)
    sql = PRODUCTS.replace("FROM {part}", (
        f", filter(array({pairs}), s -> s.key IS NOT NULL AND s.value IS NOT NULL) AS specs FROM {{part}}"))
    return view(spark, sf_dir, sql, "part", heavy=True)


# ------------------------------------------------------------ measure texts
MEASURES = """
SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 7
  WHEN 0 THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' mm'
  WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) || '/8 inch'
  WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) || '-1/4"'
  WHEN 3 THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) || '.5 HP'
  WHEN 4 THEN '1,' || CAST(CAST(l_quantity AS BIGINT) + 100 AS STRING) || ' rpm'
  WHEN 5 THEN 'about ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' furlongs'
  ELSE CASE WHEN l_returnflag = 'A' THEN 'no number' ELSE '-' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || '.25 °F' END END AS txt
FROM {lineitem}"""
