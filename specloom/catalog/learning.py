"""Vocabulary, schema learning, incremental runs and measurement."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import fixed
from ..functions.stage import shared_folder
from ..functions.text import q
from ..operators import incremental as H, learn as L, measure as M, vocabulary as V
from ..operators.proposal_store import ProposalStore
from ..plans.taxonomy import Taxonomy
from ..plans.testbed import view
from .registry import ORACLES, query, values

# -------------------------------------------------------------- vocabulary

_PATH = next(iter(fixed.LOV))
_LOV = values([r for r in V.lov_rows()], "classpath", "key", "label", "seq", "filterable", "pos", "value", name="lov")
_SYN = values([(a["key"], s, v) for a in fixed.LOV[_PATH] for s, v in a["synonyms"].items()], "key", "synonym", "canonical", name="syn")
_RAW = ["Coupling", "coupling", "CPLG", "Push Fit", "push/fit", "Stainless Steal", "SS", "C-PVC", "Class 150", "Cast Steel", "npt", "3000#", "Unobtanium", ""]
_VALS = f"""SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS s, CASE WHEN l_suppkey % 11 = 0 THEN 'Other > Path' ELSE '{_PATH.upper()}' END AS classpath,
  CASE l_linenumber % 5 WHEN 0 THEN 'fitting_type' WHEN 1 THEN 'material' WHEN 2 THEN 'connection_type' WHEN 3 THEN 'pressure_class' ELSE 'weight' END AS key,
  CASE CAST(l_quantity AS BIGINT) % {len(_RAW)} {' '.join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_RAW))} END AS value FROM {{lineitem}}"""


def _fold(x):
    return f"trim(regexp_replace(lower(trim({x})), '[\\s_\\-/,.()]+', ' ', 'g'))"


_RES = f"""v AS ({_VALS}), rs AS (SELECT v.*, EXISTS (SELECT 1 FROM lov WHERE {_fold('lov.classpath')} = {_fold('v.classpath')} AND lov.key = v.key) AND trim(v.value) <> '' AS checked FROM v),
dv AS (SELECT DISTINCT key, value FROM rs WHERE checked),
ap AS (SELECT dv.key, dv.value, (SELECT max(lov.value) FROM lov WHERE lov.key = dv.key AND lov.value = trim(dv.value)) AS e,
  (SELECT max(lov.value) FROM lov WHERE lov.key = dv.key AND lower(lov.value) = lower(trim(dv.value))) AS c,
  (SELECT max(canonical) FROM syn WHERE syn.key = dv.key AND {_fold('syn.synonym')} = {_fold('dv.value')}) AS s,
  (SELECT max(lov.value) FROM lov WHERE lov.key = dv.key AND {_fold('lov.value')} = {_fold('dv.value')}) AS f FROM dv),
rv AS (SELECT rs.*, CASE WHEN checked THEN coalesce(e, c, ap.s, f) END AS approved, CASE WHEN NOT checked THEN NULL WHEN e IS NOT NULL THEN 'exact' WHEN c IS NOT NULL THEN 'case'
  WHEN ap.s IS NOT NULL THEN 'synonym' WHEN f IS NOT NULL THEN 'folded' END AS method FROM rs LEFT JOIN ap ON rs.checked AND ap.key = rs.key AND ap.value = rs.value),
oc AS (SELECT *, CASE WHEN NOT checked THEN 'not_covered' WHEN approved IS NULL THEN 'refused' WHEN method = 'exact' THEN 'approved' ELSE 'mapped' END AS outcome FROM rv)"""
_VC = f"WITH {_LOV}, {_SYN}, {_RES}"


def _resolved(spark, sf):
    return V.resolve(view(spark, sf, _VALS, "lineitem").withColumn("evidence", F.lit("seen.")), V.lov_df(spark), V.synonym_df(spark))


@query("vocabulary_resolve", _VC + " SELECT key, value, classpath, approved, method, checked, count(*) AS rows FROM rv GROUP BY ALL")
def vocabulary_resolve(spark, sf):
    """V1, V2"""
    return _resolved(spark, sf).groupBy("key", "value", "classpath", "approved", "method", "checked").agg(F.count("*").alias("rows"))


@query("vocabulary_files", _VC + " SELECT key, value, classpath, approved, method, checked, count(*) AS rows FROM rv GROUP BY ALL")
def vocabulary_files(spark, sf):
    """V1, V2: values resolved by lists that are read from JSON files."""
    lists = {"source": "files", "classpaths": {path: {"applies_to": [], "attributes": attrs} for path, attrs in fixed.LOV.items()}}
    path = shared_folder(spark, "lists")
    spark.createDataFrame([(json.dumps(lists),)], "value string").coalesce(1).write.text(path)
    rows = V.resolve(view(spark, sf, _VALS, "lineitem"), *V.read_lov(spark, path))
    return rows.groupBy("key", "value", "classpath", "approved", "method", "checked").agg(F.count("*").alias("rows"))


@query("vocabulary_suggestions")
def vocabulary_suggestions(spark, sf):
    """V3"""
    return V.suggestions(_resolved(spark, sf), V.lov_df(spark))


@query("vocabulary_apply", _VC + """ SELECT key, outcome, CASE WHEN outcome = 'mapped' THEN approved ELSE value END AS value, CASE WHEN outcome = 'mapped' THEN
  'seen. Normalized to the approved value ''' || approved || ''' from ''' || trim(value) || ''' (' || method || ' match in the list of values).' ELSE 'seen.' END AS evidence, count(*) AS rows FROM oc GROUP BY ALL""")
def vocabulary_apply(spark, sf):
    """V4"""
    return V.apply(_resolved(spark, sf)).groupBy("key", "outcome", "value", "evidence").agg(F.count("*").alias("rows"))


@query("vocabulary_violations", _VC + """ SELECT id, 'LOV_VIOLATION' AS code, 'warning' AS severity, key AS field, '''' || trim(value) || ''' is not an approved value for ' ||
  (SELECT any_value(label) FROM lov WHERE lov.key = oc.key) || ' in this classpath.' AS message FROM oc WHERE outcome = 'refused'""")
def vocabulary_violations(spark, sf):
    """V4"""
    return V.violations(V.apply(_resolved(spark, sf)), V.lov_df(spark))


@query("vocabulary_ledger", _VC + " SELECT key, trim(value) AS from_value, approved AS to_value, method, count(*) AS rows FROM oc WHERE outcome = 'mapped' GROUP BY ALL")
def vocabulary_ledger(spark, sf):
    """V4"""
    return V.ledger(V.apply(_resolved(spark, sf))).groupBy("key", "from_value", "to_value", "method").agg(F.count("*").alias("rows"))


_OWN_PATH = f"IF(classpath = 'Other > Path', classpath, {q(_PATH)})"


@query("vocabulary_sequence", f"WITH {_LOV}, v AS ({_VALS}) SELECT key, CAST(coalesce((SELECT min(seq) FROM lov WHERE lov.key = v.key AND v.classpath <> 'Other > Path'), 10000) AS BIGINT) AS sequence, count(*) AS rows FROM v GROUP BY 1, 2")
def vocabulary_sequence(spark, sf):
    """V5"""
    v = view(spark, sf, _VALS, "lineitem").withColumn("classpath", F.expr(_OWN_PATH))
    return V.in_sequence(v, V.lov_df(spark)).groupBy("key", F.col("sequence").cast("bigint").alias("sequence")).agg(F.count("*").alias("rows"))


@query("facet_counts", _VC + " SELECT key, CASE WHEN outcome = 'mapped' THEN approved ELSE value END AS value, count(*) AS products FROM oc WHERE classpath <> 'Other > Path' AND key IN (SELECT key FROM lov WHERE filterable) GROUP BY 1, 2")
def facet_counts(spark, sf):
    """V6"""
    applied = V.apply(_resolved(spark, sf)).withColumn("classpath", F.expr(_OWN_PATH))
    return V.facet_counts(applied, V.lov_df(spark))


@query("vocabulary_coverage", _VC + """ SELECT s, count(*) FILTER (WHERE checked) AS checked, count(*) FILTER (WHERE outcome IN ('approved', 'mapped')) AS approved, count(*) FILTER (WHERE outcome = 'mapped') AS mapped,
  count(*) FILTER (WHERE outcome = 'refused') AS refused, CASE WHEN count(*) FILTER (WHERE checked) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (WHERE outcome IN ('approved', 'mapped')) / count(*) FILTER (WHERE checked), 1) ELSE 0 END AS percent_in_lov FROM oc GROUP BY s""")
def vocabulary_coverage(spark, sf):
    """V7"""
    return V.coverage(V.apply(_resolved(spark, sf)), ["s"])


@query("covered_classpaths", f"WITH {_LOV}, v AS ({_VALS}) SELECT classpath, {_fold('classpath')} IN (SELECT {_fold('lov.classpath')} FROM lov) AS covered, count(*) AS rows FROM v GROUP BY 1, 2")
def covered_classpaths(spark, sf):
    """V8"""
    v = view(spark, sf, _VALS, "lineitem").withColumn("_f", F.expr(V.fold("classpath")))
    have = V.covered_classpaths(V.lov_df(spark)).select(F.expr(V.fold("classpath")).alias("_f"), F.lit(True).alias("_c"))
    return v.join(have, "_f", "left").groupBy("classpath", F.coalesce("_c", F.lit(False)).alias("covered")).agg(F.count("*").alias("rows"))


# ----------------------------------------------------------- schema learning
# products no category claims, from the part table, clustered by their type
_LP = """SELECT p_partkey AS id, 'S' || CAST(p_partkey AS STRING) AS sku, CAST(NULL AS STRING) AS mpn, CASE p_partkey % 3 WHEN 0 THEN 'Round pneumatic cylinder ' WHEN 1 THEN 'Linear guide rail ' ELSE 'Cable gland ' END || p_name AS name,
  lower(p_type) AS category_hint, p_size, p_partkey % 3 AS c FROM {part}"""
_LF = [("Bore Size", "CASE c WHEN 0 THEN CAST(p_size AS STRING) || ' mm' END"), ("Stroke", "CASE c WHEN 0 THEN CAST(p_size AS STRING) || ' in' END"),
       ("Cushioning", "CASE c WHEN 0 THEN CASE p_size % 3 WHEN 0 THEN 'Air' WHEN 1 THEN 'Rubber' ELSE 'None fitted' END WHEN 1 THEN NULL END"),
       ("Rail Width", "CASE c WHEN 1 THEN CAST(p_size AS STRING) || CASE WHEN p_size % 2 = 0 THEN ' cm' ELSE ' mm' END END"),
       ("Coated", "CASE c WHEN 1 THEN CASE p_size % 2 WHEN 0 THEN 'yes' ELSE 'No' END END"), ("Thread", "CASE c WHEN 2 THEN 'M' || CAST(p_size AS STRING) || 'x1.5' END"),
       ("IP Class", "CASE c WHEN 2 THEN CASE WHEN p_size % 4 = 0 THEN '' ELSE 'IP' || CAST(60 + p_size % 9 AS STRING) END END"), ("Vendor", "'V'"), ("E1_Brand", "'X'")]


def _learn_products(spark, sf):
    pairs = ", ".join(f"named_struct('key', {q(k)}, 'value', {v}, 'locator', CAST(NULL AS STRING))" for k, v in _LF)
    return view(spark, sf, f"SELECT id, sku, mpn, name, category_hint, filter(array({pairs}), s -> s.value IS NOT NULL) AS specs, c FROM ({_LP}) t", "part")


_LV = "lv AS (" + " UNION ALL ".join(
    f"SELECT id, c AS cluster, '{k.lower().replace(' ', '_')}' AS key, '{k}' AS label, {v} AS value FROM ({_LP}) t" for k, v in _LF[:-2]) + "), fv AS (SELECT * FROM lv WHERE coalesce(value, '') <> '')"


_SIG = f"""SELECT id, CASE c WHEN 0 THEN 'bore_size,cushioning,stroke' WHEN 1 THEN 'coated,rail_width' ELSE 'ip_class,thread' END AS fields, CASE c WHEN 0 THEN 'round pneumatic cylinder' WHEN 1 THEN 'linear guide rail' ELSE 'cable gland' END || replace(' ' || regexp_extract(name, '([a-z]+ [a-z]+)$', 1), ' new ', ' ') || CASE WHEN category_hint = 'standard' THEN '' ELSE ' ' || category_hint END AS words FROM x"""


@query("signatures", f"WITH x AS ({_LP}) {_SIG}")
def signatures(spark, sf):
    """L2"""
    return L.signatures(_learn_products(spark, sf)).select("id", F.array_join("fields", ",").alias("fields"), F.array_join("words", " ").alias("words"))


_CL = f"""x AS ({_LP}), p AS (SELECT g.id, x.c, string_split(g.fields, ',') AS f, list_sort(list_distinct(string_split(g.words, ' '))) AS w FROM ({_SIG}) g JOIN x USING (id)),
s AS (SELECT f, w, min(id) AS first, row_number() OVER (ORDER BY count(*) DESC, min(id)) AS i FROM p GROUP BY f, w),
sh AS (SELECT a.i, b.i AS j, len(list_intersect(a.f, b.f)) AS ff, len(list_intersect(a.w, b.w)) AS ww, len(a.f) + len(b.f) AS nf, len(a.w) + len(b.w) AS nw FROM s a JOIN s b ON b.i < a.i),
k AS (SELECT i, j, CASE WHEN nf - ff >= 2 THEN 0.7::DOUBLE * (ff::DOUBLE / (nf - ff)) + 0.3::DOUBLE * (ww::DOUBLE / (nw - ww)) ELSE ww::DOUBLE / (nw - ww) END AS score FROM sh),
n AS (SELECT i, list(j) AS near FROM k WHERE score >= 0.35 GROUP BY i),
r AS (SELECT CAST(1 AS BIGINT) AS i, [CAST(1 AS BIGINT)] AS leads UNION ALL SELECT r.i + 1, CASE WHEN list_has_any(coalesce(near, []), leads) THEN leads ELSE list_append(leads, r.i + 1) END
  FROM r LEFT JOIN n ON n.i = r.i + 1 WHERE r.i < (SELECT count(*) FROM s)),
ld AS (SELECT unnest(leads) AS j FROM r WHERE i = (SELECT count(*) FROM s)),
best AS (SELECT k.i, k.j, row_number() OVER (PARTITION BY k.i ORDER BY score DESC, k.j) AS o FROM k JOIN ld ON ld.j = k.j WHERE score >= 0.35),
home AS (SELECT s.i, s.f, s.w, CASE WHEN s.i IN (SELECT j FROM ld) THEN s.i ELSE best.j END AS j FROM s LEFT JOIN best ON best.i = s.i AND o = 1),
cl AS (SELECT p.id, p.c, s.first AS cluster FROM p JOIN home ON home.f = p.f AND home.w = p.w JOIN s ON s.i = home.j)"""


@query("clusters", f"WITH RECURSIVE {_CL} SELECT cluster, count(*) AS products, count(DISTINCT c) AS kinds FROM cl GROUP BY cluster")
def clusters(spark, sf):
    """L3"""
    return L.cluster(_learn_products(spark, sf)).groupBy("cluster").agg(F.count("*").alias("products"), F.count_distinct("c").alias("kinds"))


_WORDS = f"""w0 AS (SELECT id, c, string_split(CASE c WHEN 0 THEN 'round pneumatic cylinder' WHEN 1 THEN 'linear guide rail' ELSE 'cable gland' END || replace(' ' || regexp_extract(name, '([a-z]+ [a-z]+)$', 1), ' new ', ' ') || CASE WHEN category_hint = 'standard' THEN '' ELSE ' ' || category_hint END, ' ') AS ws FROM ({_LP}) t),
wd AS (SELECT id, c, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM w0), wc AS (SELECT c, w, count(DISTINCT id) AS n, avg(i) AS p FROM wd GROUP BY 1, 2), tt AS (SELECT c, count(*) AS t FROM w0 GROUP BY 1),
tp AS (SELECT * FROM (SELECT wc.*, row_number() OVER (PARTITION BY c ORDER BY n DESC, w) AS r FROM wc) z JOIN tt USING (c) WHERE r <= 6 AND n >= greatest(1, t * 0.4)),
tk AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY r) AS k FROM tp), hd AS (SELECT c, string_agg(w, ' ' ORDER BY p, r) AS head, string_agg(upper(left(w, 1)) || substr(w, 2), ' ' ORDER BY p, r) AS noun FROM tk WHERE k <= 2 GROUP BY c),
kw AS (SELECT c, string_agg(DISTINCT w, ',' ORDER BY w) AS keywords FROM (SELECT c, w FROM tk UNION SELECT c, head FROM hd) z GROUP BY c)"""


def _named(spark, sf):
    return L.names(L.signatures(_learn_products(spark, sf)).withColumn("cluster", F.col("c").cast("bigint")))


@query("cluster_names", f"WITH {_WORDS} SELECT CAST(c AS BIGINT) AS cluster, noun, keywords, t AS total FROM hd JOIN kw USING (c) JOIN tt USING (c)")
def cluster_names(spark, sf):
    """L8"""
    return _named(spark, sf).select("cluster", "noun", F.array_join("keywords", ",").alias("keywords"), "total")


@query("learned_codes", f"""WITH {_WORDS}, s AS (SELECT c, lower(noun) || '|' || array_to_string(list_sort(string_split(keywords, ',')), '|') AS seed FROM hd JOIN kw USING (c))
SELECT CAST(c AS BIGINT) AS cluster, '99' || lpad(left(CAST(CAST('0x' || left(sha256(seed), 8) AS BIGINT) AS STRING), 6), 6, '0') AS code FROM s""")
def learned_codes(spark, sf):
    """L9"""
    return _named(spark, sf).select("cluster", F.expr(L.code_sql()).alias("code"))


@query("merge_alike", """SELECT CAST(count(*) AS BIGINT) AS products, CAST(least(3, count(*)) AS BIGINT) AS clusters FROM {part}""")
def merge_alike(spark, sf):
    """L4: clusters split only by id parity fold back into one per kind."""
    split = L.signatures(_learn_products(spark, sf)).withColumn("cluster", F.expr("CAST(c * 2 + floor(id / 3) % 2 AS BIGINT)"))
    return L.merge_alike(split).agg(F.count("*").alias("products"), F.count_distinct("cluster").alias("clusters"))


_UCONV = "CASE u WHEN 'in' THEN 25.4 WHEN 'cm' THEN 10.0 ELSE 1.0 END"


@query("inferred_types", f"""WITH {_LV}, q AS (SELECT cluster, key, trim(value) AS v, TRY_CAST(regexp_extract(trim(value), '^([0-9.]+) (mm|in|cm)$', 1) AS DOUBLE) AS num, nullif(regexp_extract(trim(value), '^([0-9.]+) (mm|in|cm)$', 2), '') AS u FROM fv),
t AS (SELECT cluster, key, count(*) AS cleaned, count(*) FILTER (WHERE lower(v) IN ('yes', 'no', 'true', 'false', 'y', 'n')) AS b, count(num) AS parsed, count(DISTINCT v) AS dv, max(length(v)) AS ml,
   min(num * {_UCONV}) AS lo, max(num * {_UCONV}) AS hi FROM q GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN b = cleaned THEN 'boolean' WHEN parsed >= greatest(2, floor(0.7 * cleaned)) THEN 'number' WHEN dv BETWEEN 2 AND 12 AND dv <= greatest(1, floor(0.6 * cleaned)) AND ml <= 40 THEN 'enum' ELSE 'text' END AS type FROM t)
SELECT CAST(cluster AS BIGINT) AS cluster, key, type, CASE WHEN type = 'number' THEN 'mm' END AS unit, CASE WHEN type = 'number' THEN round(greatest(lo - greatest(hi - lo, abs(hi) * 0.5, 1), 0), 4) END::DOUBLE AS range_low,
  CASE WHEN type = 'number' THEN round(hi + greatest(hi - lo, abs(hi) * 0.5, 1), 4) END::DOUBLE AS range_high, CASE WHEN type = 'enum' THEN (SELECT string_agg(DISTINCT v, ',' ORDER BY v) FROM q WHERE q.cluster = k.cluster AND q.key = k.key) END AS members, cleaned FROM k""")
def inferred_types(spark, sf):
    """L5"""
    c = L.signatures(_learn_products(spark, sf)).withColumn("cluster", F.col("c").cast("bigint"))
    return L.infer_types(L.field_values(c), ["cluster", "key"]).withColumn("members", F.array_join("members", ","))


@query("proposed_attributes", f"""WITH {_LV}, t AS (SELECT c AS cluster, count(*) AS total FROM ({_LP}) t GROUP BY 1),
s AS (SELECT cluster, key, any_value(label) AS label, count(*) AS n FROM fv GROUP BY 1, 2),
k AS (SELECT s.*, total, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, key) AS pos FROM s JOIN t USING (cluster) WHERE n / total >= 0.34),
d AS (SELECT cluster, key, value, row_number() OVER (PARTITION BY cluster, key ORDER BY value) AS r FROM (SELECT DISTINCT cluster, key, value FROM fv) z)
SELECT CAST(cluster AS BIGINT) AS cluster, pos, key, label, n AS observed_in, n / total >= 0.75 AS required, CASE key WHEN 'bore_size' THEN 'Dimensions' WHEN 'rail_width' THEN 'Dimensions'
  WHEN 'ip_class' THEN 'Standards' ELSE 'General' END AS grp, (SELECT string_agg(value, ',' ORDER BY r) FROM d WHERE d.cluster = k.cluster AND d.key = k.key AND r <= 5) AS samples FROM k""")
def proposed_attributes(spark, sf):
    """L6, L7"""
    c = L.signatures(_learn_products(spark, sf)).withColumn("cluster", F.col("c").cast("bigint"))
    return L.proposed_attributes(c).select("cluster", F.col("pos").cast("bigint").alias("pos"), "key", "label", "observed_in", "required", "grp", F.array_join("sample_values", ",").alias("samples"))


_PARTS = f"""pa AS ({ORACLES['proposed_attributes']}), ty AS ({ORACLES['inferred_types']}), lc AS ({ORACLES['learned_codes']}), nm AS ({ORACLES['cluster_names']}),
pt AS (SELECT c AS cluster, count(*) AS total FROM ({_LP}) t GROUP BY 1)"""


@query("proposals", f"""WITH {_PARTS}, g AS (SELECT cluster, count(*) AS fields, sum(observed_in) AS observed, string_agg(key, '|' ORDER BY key) AS keys,
  list(key ORDER BY pos) FILTER (required) AS needed FROM pa GROUP BY cluster)
SELECT left(sha256(code || '|' || keys), 12) AS id, code, noun || 's' AS name, noun, keywords, array_to_string(list_concat(['brand', 'mpn'], coalesce(needed, [])[1:4]), ',') AS required, pt.total AS sample_count,
  round(least(0.25 + 0.45 * least(pt.total / 6, 1.0) + 0.30 * observed::DOUBLE / (fields * pt.total), 0.95), 3)::DOUBLE AS confidence
FROM lc JOIN nm USING (cluster) JOIN pt USING (cluster) JOIN g USING (cluster)""")
def proposals(spark, sf):
    """L2-L11"""
    p, _ = L.propose(_learn_products(spark, sf))
    return p.select("id", "code", "name", "noun", F.array_join("keywords", ",").alias("keywords"), F.array_join("required", ",").alias("required"), "sample_count", "confidence")


@query("proposal_confidence", """SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN least(round(least(0.25 + 0.45 * least((o_custkey % 9 + 1) / 6, 1.0), 0.95), 3), 0.45)
  ELSE round(least(0.25 + 0.45 * least((o_custkey % 9 + 1) / 6, 1.0) + 0.30 * ((o_custkey % 5) * (o_custkey % 9 + 1) - o_custkey % 3) / ((o_custkey % 5) * (o_custkey % 9 + 1)), 0.95), 3) END::DOUBLE AS confidence FROM {orders}""")
def proposal_confidence(spark, sf):
    """L10"""
    df = view(spark, sf, """SELECT o_orderkey AS id, o_custkey % 9 + 1 AS total, o_custkey % 5 AS fields, (o_custkey % 5) * (o_custkey % 9 + 1) - o_custkey % 3 AS observed FROM {orders}""", "orders")
    return df.select("id", F.expr(L.confidence_sql()).alias("confidence"))


_PR = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status, 'old' AS noun FROM {orders} WHERE o_orderkey % 2 = 0"
_NW = "SELECT o_orderkey AS id, 'pending' AS status, 'new' AS noun FROM {orders} WHERE o_orderkey % 5 <> 0"


@query("proposal_upsert", f"""WITH e AS ({_PR}), n AS ({_NW}) SELECT coalesce(e.id, n.id) AS id, CASE WHEN n.id IS NULL OR coalesce(e.status, 'pending') <> 'pending' THEN e.status ELSE n.status END AS status,
  CASE WHEN n.id IS NULL OR coalesce(e.status, 'pending') <> 'pending' THEN e.noun ELSE n.noun END AS noun, e.id IS NULL AS is_new FROM e FULL JOIN n ON e.id = n.id""")
def proposal_upsert(spark, sf):
    """L12"""
    return L.upsert(view(spark, sf, _PR, "orders"), view(spark, sf, _NW, "orders"))


@query("proposal_review", f"""WITH e AS ({_PR}), d AS (SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'revoke' END AS decision FROM {{orders}} WHERE o_custkey % 4 = 0),
r AS (SELECT CASE decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'revoke' THEN CASE WHEN status = 'approved' THEN 'pending' ELSE status END ELSE status END AS status FROM e LEFT JOIN d USING (id))
SELECT status, count(*) AS proposals FROM r GROUP BY 1""")
def proposal_review(spark, sf):
    """L13"""
    d = view(spark, sf, "SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'revoke' END AS decision FROM {orders} WHERE o_custkey % 4 = 0", "orders")
    return L.by_status(L.review(view(spark, sf, _PR, "orders"), d))


_DC = "SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'revoke' END AS decision FROM {orders} WHERE o_custkey % 4 = 0"


@query("proposal_store", f"""WITH e AS ({_PR}), n AS ({_NW}), d AS ({_DC}), u AS (SELECT coalesce(e.id, n.id) AS id, CASE WHEN n.id IS NULL OR coalesce(e.status, 'pending') <> 'pending' THEN e.status ELSE n.status END AS status,
  CASE WHEN n.id IS NULL OR coalesce(e.status, 'pending') <> 'pending' THEN e.noun ELSE n.noun END AS noun FROM e FULL JOIN n ON e.id = n.id)
SELECT u.id, noun, u.status AS before, CASE decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'revoke' THEN CASE WHEN status = 'approved' THEN 'pending' ELSE status END ELSE status END AS status FROM u LEFT JOIN d USING (id)""")
def proposal_store(spark, sf):
    """Two merges, the second one repeated, and decisions, in a stored table; its last two versions."""
    store = ProposalStore(spark, shared_folder(spark, "proposals"), "id bigint, status string, noun string")
    store.merge(view(spark, sf, _PR, "orders"))
    for _ in range(2):
        merged = store.merge(view(spark, sf, _NW, "orders"), "feed", 1)
    decided = store.decide(view(spark, sf, _DC, "orders"))
    return store.read(decided).join(store.read(merged).select("id", F.col("status").alias("before")), "id").select("id", "noun", "before", "status")


_CURATED = values([(c["code"], a["key"], a["type"], a["unit"], a["group"]) for c in fixed.CATEGORIES for a in c["attributes"]], "code", "key", "type", "unit", "grp", name="cu")


@query("schema_rows", f"""WITH {_CURATED}, {_PARTS} SELECT code, key, type, unit, grp FROM cu
UNION ALL SELECT code, pa.key, type, unit, grp FROM pa JOIN ty ON ty.cluster = pa.cluster AND ty.key = pa.key JOIN lc ON lc.cluster = pa.cluster""")
def schema_rows(spark, sf):
    """Learned categories as schema rows next to the curated ones."""
    p, a = L.propose(_learn_products(spark, sf))
    cats = L.to_categories(p.withColumn("status", F.lit("approved")), a)
    return Taxonomy(learned=cats).attribute_df(spark).select("code", "key", "type", "unit", "grp")


# ------------------------------------------------------------- incremental

_EV = "SELECT event_id AS id, event_type AS name, props AS description, 'U' || CAST(user_id % 20 AS STRING) AS brand, value FROM {events}"


def _events(spark, sf):
    null = "CAST(NULL AS STRING)"
    return view(spark, sf, f"""SELECT event_id AS id, event_type AS name, props AS description, concat('U', user_id % 20) AS brand, {null} AS category_hint, {null} AS currency, {null} AS free_text, {null} AS mpn,
      CAST(NULL AS DOUBLE) AS price, {null} AS sku, {null} AS source_document, {null} AS source_url, array(named_struct('key', 'z', 'value', '1'), named_struct('key', 'a', 'value', '2')) AS specs FROM {{events}}""", "events")


_SEP = "chr(31)"
_HASH = f"left(sha256(concat_ws({_SEP}, 'demo', brand, '', '', description, '', '', name, '', '', '', '', '1:a1:2' || {_SEP} || '1:z1:1')), 32)"


@query("content_hash", f"WITH e AS ({_EV}) SELECT id, {_HASH} AS content_hash FROM e")
def content_hash(spark, sf):
    """H1"""
    return H.with_hash(_events(spark, sf)).select("id", "content_hash")


@query("unseen_products", f"WITH e AS ({_EV}), h AS (SELECT id, name, {_HASH} AS content_hash FROM e) SELECT content_hash, min(id) AS id FROM h WHERE content_hash NOT IN (SELECT content_hash FROM h WHERE name = 'view') GROUP BY 1")
def unseen_products(spark, sf):
    """H1"""
    h = H.with_hash(_events(spark, sf))
    return H.unseen(h, h.where("name = 'view'"))


@query("taxonomy_fingerprint", """SELECT left(sha256(string_agg(code || ':' || v, '|' ORDER BY code || ':' || v)), 8) AS fingerprint FROM (SELECT '99' || lpad(CAST(p_size AS STRING), 6, '0') AS code, CAST(count(*) AS STRING) AS v FROM {part} GROUP BY 1) t""")
def taxonomy_fingerprint(spark, sf):
    """H2"""
    return H.taxonomy_fingerprint(view(spark, sf, "SELECT '99' || lpad(CAST(p_size AS STRING), 6, '0') AS code, CAST(count(*) AS STRING) AS version FROM {part} GROUP BY 1", "part"))


@query("result_lookup", f"""WITH e AS ({_EV}), h AS (SELECT id, name, {_HASH} AS k FROM e), o AS (SELECT DISTINCT k FROM h WHERE name = 'view'), b AS (SELECT DISTINCT k FROM h WHERE name IN ('view', 'click'))
SELECT id, CASE WHEN k IN (SELECT k FROM o) THEN 'own' WHEN k IN (SELECT k FROM b) THEN 'bundled' ELSE 'miss' END AS layer FROM h""")
def result_lookup(spark, sf):
    """H3"""
    h = H.with_hash(_events(spark, sf)).withColumn("bundled_hash", F.col("content_hash"))
    own = h.where("name = 'view'").select("content_hash").distinct().withColumn("result", F.lit("o"))
    bundled = h.where("name IN ('view', 'click')").select("bundled_hash").distinct().withColumn("result", F.lit("b"))
    return H.lookup(h, own, bundled).select("id", "layer")


# ------------------------------------------------------------- measurement

_TRUTH = """SELECT p_partkey AS case_id, k.k AS key, CASE k.k WHEN 'size' THEN CAST(p_size AS STRING) WHEN 'type' THEN p_type WHEN 'brand' THEN p_brand ELSE p_name END AS true_val,
  CASE WHEN k.k = 'size' THEN CAST(p_size AS DOUBLE) END AS true_num, CASE WHEN p_partkey % 2 = 0 THEN 'standards' ELSE 'archetype' END AS truth_source FROM {part} {cross}"""
_DT = _TRUTH.replace("{cross}", ", (VALUES ('size'), ('type'), ('brand'), ('name')) k(k)")
_STRUTH = _TRUTH.replace("{cross}", "LATERAL VIEW explode(array('size', 'type', 'brand', 'name')) k AS k")
_PRED = """SELECT l_partkey AS case_id, CASE l_linenumber % 4 WHEN 0 THEN 'size' WHEN 1 THEN 'type' WHEN 2 THEN 'brand' ELSE 'other' END AS key, min(l_returnflag || CAST(l_linenumber AS STRING)) AS mv,
  CAST(min(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS mq FROM {lineitem} GROUP BY 1, 2"""
_PFULL = f"""SELECT x.case_id, x.key, CASE x.key WHEN 'size' THEN CAST(CAST(mq AS BIGINT) AS STRING) WHEN 'type' THEN CASE WHEN mv < 'B' THEN lower(p_type) || ' ' ELSE 'X' END ELSE p_brand END AS val,
  CASE WHEN x.key = 'size' THEN mq END AS num, CASE WHEN mv < 'A4' THEN 'defaulted' WHEN mv < 'B' THEN 'knowledge_base' ELSE 'parsed' END AS prov FROM ({_PRED}) x JOIN {{part}} ON p_partkey = x.case_id"""
_CMP = f"""t AS ({_DT}), p AS ({_PFULL}), c AS (SELECT t.*, val, num, prov, prov IS NOT NULL AS recovered, prov IS NOT NULL AND CASE WHEN true_num IS NOT NULL AND num IS NOT NULL THEN abs(num - true_num) / abs(true_num) <= 0.01
  ELSE lower(trim(val)) = lower(trim(true_val)) END AS correct FROM t LEFT JOIN p USING (case_id, key))"""


def _rate(n, d):
    return f"CASE WHEN {d} > 0 THEN round(100.0::DOUBLE * ({n}) / ({d}), 1) ELSE 0 END::DOUBLE"


def _compared(spark, sf):
    return M.compare(view(spark, sf, _STRUTH, "part"), view(spark, sf, _PFULL, "lineitem", "part"))


@query("sparse_cases", f"""WITH t AS ({_DT}) SELECT case_id, key, row_number() OVER (PARTITION BY case_id ORDER BY md5(CAST(case_id AS STRING) || '|' || key), key) > 1 AS withheld FROM t""")
def sparse_cases(spark, sf):
    """M1"""
    return M.sparse_cases(view(spark, sf, _STRUTH, "part")).select("case_id", "key", "withheld")


_CASES = """SELECT l_orderkey * 10 + l_linenumber AS case_id, l_suppkey % 6 AS k, l_quantity AS qn FROM {lineitem}"""


@query("seeded_defects", f"""WITH x AS ({_CASES}) SELECT case_id, k, CASE k WHEN 0 THEN CASE WHEN qn <> 20 THEN 'transposition' END WHEN 1 THEN 'geometry' WHEN 2 THEN 'material_conflict' WHEN 3 THEN 'grade_conflict' WHEN 4 THEN 'safety_factor' ELSE 'invalid_code' END AS kind,
  CASE k WHEN 0 THEN CASE WHEN qn <> 20 THEN 'GEOMETRY_CONTRADICTION' END WHEN 1 THEN 'GEOMETRY_CONTRADICTION' WHEN 2 THEN 'MATERIAL_TEMP_CONFLICT' WHEN 3 THEN 'GRADE_MATERIAL_CONFLICT' WHEN 4 THEN 'SAFETY_FACTOR_LOW' ELSE 'INVALID_IP_CODE' END AS expected,
  CAST(CASE k WHEN 0 THEN 20 WHEN 1 THEN qn + 5 WHEN 2 THEN 180 WHEN 4 THEN qn * 2 END AS DOUBLE) AS broken FROM x""")
def seeded_defects(spark, sf):
    """M2"""
    df = view(spark, sf, f"""SELECT case_id, k, CASE k WHEN 2 THEN '40141600' WHEN 3 THEN '31161500' WHEN 4 THEN '40142000' ELSE 'x' END AS code,
      CASE k WHEN 0 THEN map('bore_diameter', qn, 'outer_diameter', 20D) WHEN 1 THEN map('flute_length', 3D, 'overall_length', qn) WHEN 2 THEN map('temp_rating_max', qn)
        WHEN 4 THEN map('working_pressure', qn, 'burst_pressure', qn * 4) ELSE CAST(map() AS MAP<STRING,DOUBLE>) END AS nums,
      IF(k = 5, map('ip_rating', 'IP67'), CAST(map() AS MAP<STRING,STRING>)) AS texts, CAST(array() AS ARRAY<STRING>) AS ranged, CAST(array() AS ARRAY<STRING>) AS enums FROM ({_CASES}) t""", "lineitem")
    return M.corrupt(df).select("case_id", "k", "kind", "expected", F.expr(
        "CASE k WHEN 0 THEN IF(kind IS NULL, 20D, new_nums['bore_diameter']) WHEN 1 THEN new_nums['flute_length'] WHEN 2 THEN new_nums['temp_rating_max'] WHEN 4 THEN new_nums['burst_pressure'] END").alias("broken"))


@query("recovery", f"""WITH {_CMP}, a AS (SELECT count(*) AS withheld, count(*) FILTER (WHERE recovered) AS recovered, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE recovered AND NOT correct) AS contradicted,
  count(*) FILTER (WHERE recovered AND prov <> 'defaulted') AS solid_recovered, count(*) FILTER (WHERE correct AND prov <> 'defaulted') AS solid_correct, count(*) FILTER (WHERE recovered AND NOT correct AND prov <> 'defaulted') AS solid_contradicted FROM c)
SELECT *, {_rate('recovered', 'withheld')} AS recall_pct, {_rate('correct', 'recovered')} AS precision_pct, {_rate('contradicted', 'recovered')} AS contradiction_pct,
  {_rate('solid_correct', 'solid_recovered')} AS solid_precision_pct, {_rate('solid_contradicted', 'solid_recovered')} AS solid_contradiction_pct FROM a""")
def recovery(spark, sf):
    """M3, M4"""
    return M.recovery(_compared(spark, sf))


@query("recovery_breakdown", f"""WITH {_CMP}, g AS (SELECT 'provenance' AS dimension, prov AS member, recovered, correct FROM c WHERE prov IS NOT NULL UNION ALL SELECT 'truth_source', truth_source, recovered, correct FROM c),
a AS (SELECT dimension, member, count(*) AS withheld, count(*) FILTER (WHERE recovered) AS recovered, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE recovered AND NOT correct) AS contradicted FROM g GROUP BY 1, 2)
SELECT *, {_rate('correct', 'recovered')} AS precision_pct FROM a""")
def recovery_breakdown(spark, sf):
    """M5"""
    return M.breakdown(_compared(spark, sf))


@query("contradictions", f"WITH {_CMP} SELECT case_id, key, val AS predicted, true_val AS truth, prov FROM c WHERE recovered AND NOT correct")
def contradictions(spark, sf):
    """M9"""
    return M.contradictions(_compared(spark, sf))


_DET = """d AS (SELECT p_partkey AS case_id, 'kind' || CAST(p_size % 4 AS STRING) AS kind, 'C' || CAST(p_size % 5 AS STRING) AS expected FROM {part}), i AS (SELECT l_partkey AS case_id, 'C' || CAST(l_linenumber AS STRING) AS code FROM {lineitem} WHERE l_returnflag = 'R'),
h AS (SELECT case_id, kind, EXISTS (SELECT 1 FROM i WHERE i.case_id = d.case_id AND i.code = d.expected) AS detected FROM d)"""


@query("defect_detection", f"WITH {_DET} SELECT kind, count(*) AS expected, count(*) FILTER (WHERE detected) AS detected, {_rate('count(*) FILTER (WHERE detected)', 'count(*)')} AS recall_pct FROM h GROUP BY kind")
def defect_detection(spark, sf):
    """M6"""
    cases = view(spark, sf, "SELECT p_partkey AS case_id, concat('kind', p_size % 4) AS kind, concat('C', p_size % 5) AS expected FROM {part}", "part")
    issues = view(spark, sf, "SELECT l_partkey AS case_id, concat('C', l_linenumber) AS code FROM {lineitem} WHERE l_returnflag = 'R'", "lineitem")
    return M.detection_recall(M.detection(cases, issues), ["kind"])


@query("false_alarms", "SELECT 'C' || CAST(l_linenumber AS STRING) AS code, count(*) AS alarms FROM {lineitem} WHERE l_returnflag = 'R' AND l_linenumber <> 3 GROUP BY 1")
def false_alarms(spark, sf):
    """M7"""
    return M.false_alarms(view(spark, sf, """SELECT l_partkey AS case_id, IF(l_linenumber = 3, 'MISSING_REQUIRED', concat('C', l_linenumber)) AS code, IF(l_returnflag = 'R', 'error', 'warning') AS severity FROM {lineitem}""", "lineitem"))


_MIX = "SELECT CASE WHEN l_linenumber < 4 THEN 'sparse' ELSE 'defect' END AS variant, CASE l_returnflag WHEN 'A' THEN 'publish' WHEN 'N' THEN 'review' ELSE 'blocked' END AS verdict FROM {lineitem}"
_MX = f"m AS (SELECT variant, count(*) AS cases, count(*) FILTER (WHERE verdict = 'publish') AS publish, count(*) FILTER (WHERE verdict = 'review') AS review, count(*) FILTER (WHERE verdict = 'blocked') AS blocked FROM ({_MIX}) t GROUP BY 1)"


@query("verdict_mix", f"WITH {_MX} SELECT *, {_rate('review + blocked', 'cases')} AS stopped_pct FROM m")
def verdict_mix(spark, sf):
    """M8"""
    return M.verdict_mix(view(spark, sf, _MIX, "lineitem"))


@query("coverage_lift", f"WITH t AS ({_DT}), p AS ({_PFULL}) SELECT (SELECT count(*) FROM t) AS attributes_in, (SELECT count(*) FROM p) AS attributes_out, round((SELECT count(*) FROM p)::DOUBLE / (SELECT count(*) FROM t), 2) AS lift_multiple")
def coverage_lift(spark, sf):
    """M8"""
    return M.coverage_lift(view(spark, sf, _STRUTH, "part"), view(spark, sf, _PFULL, "lineitem", "part"))


@query("business_projection", f"""WITH {_MX}, s AS (SELECT sum(cases)::DOUBLE AS t, sum(publish)::DOUBLE AS p, sum(review)::DOUBLE AS r FROM m), x AS (SELECT *, (p + r * 0.5) / t * (100000 * 10.0 / 60)::DOUBLE AS saved FROM s)
SELECT round(100 * p / t, 1) AS auto_publish_pct, round(100 * r / t, 1) AS assisted_pct, 16667::DOUBLE AS manual_hours, round(saved, 0) AS hours_saved, round(saved * 35, 0) AS cost_saved, round(saved / 1800, 1) AS fte_years_saved FROM x""")
def business_projection(spark, sf):
    """M10"""
    return M.business_projection(M.verdict_mix(view(spark, sf, _MIX, "lineitem")))


_TRI = """r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN '46181500' END AS code, p_size FROM {part}),
k AS (SELECT r.id, k.k AS key, CASE WHEN r.p_size % 3 = 0 AND k.k = 'color' THEN 'defaulted' ELSE 'parsed' END AS prov FROM r, (VALUES ('ppe_type'), ('size'), ('material'), ('standard'), ('protection_level'), ('color'), ('reusable')) k(k) WHERE NOT (p_size % 2 = 0 AND k.k = 'size')),
w AS (SELECT r.id, CASE WHEN code IS NULL THEN 'unclassified' WHEN 7 - (SELECT count(*) FROM k WHERE k.id = r.id) > 0 THEN 'gaps' WHEN (SELECT count(*) FROM k WHERE k.id = r.id AND prov = 'defaulted') > 0 THEN 'defaults' ELSE 'complete' END AS why FROM r)"""


def _triaged(spark, sf):
    records = view(spark, sf, "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN '46181500' END AS code, p_size FROM {part}", "part")
    attrs = (records.withColumn("key", F.explode(F.array(*[F.lit(k) for k in ("ppe_type", "size", "material", "standard", "protection_level", "color", "reusable")])))
             .where("NOT (p_size % 2 = 0 AND key = 'size')").withColumn("prov", F.expr("IF(p_size % 3 = 0 AND key = 'color', 'defaulted', 'parsed')")))
    return M.triage(records.select("id", "code"), attrs.select("id", "key", "prov"), Taxonomy().attribute_df(spark))


@query("triage", f"WITH {_TRI} SELECT id, why, why IN ('gaps', 'defaults') AS needed FROM w")
def triage(spark, sf):
    """M11"""
    return _triaged(spark, sf)


@query("triage_forfeits", f"WITH {_TRI} SELECT count(*) FILTER (WHERE why NOT IN ('gaps', 'defaults')) AS skipped, count(*) FILTER (WHERE why NOT IN ('gaps', 'defaults') AND id % 10 = 3) AS forfeited FROM w")
def triage_forfeits(spark, sf):
    """M11"""
    counts = view(spark, sf, "SELECT p_partkey AS id, CAST(IF(p_partkey % 10 = 3, 1, 0) AS BIGINT) AS gap_filled, 0L AS displaced_defaults, 1L AS refused FROM {part}", "part")
    return M.forfeited(_triaged(spark, sf), counts)


_WANT = "SELECT p_partkey AS id, p_name AS title, p_brand AS maker, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS kind FROM {part}"
_GOT = "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || '!' WHEN 2 THEN '' ELSE 'other' END AS title, ' ' || p_brand AS maker, p_type AS kind FROM {part}"
_OUT = """o AS (SELECT w.id, f.f AS field, trim(CASE f.f WHEN 'title' THEN w.title WHEN 'maker' THEN w.maker ELSE w.kind END) AS a, trim(CASE f.f WHEN 'title' THEN g.title WHEN 'maker' THEN g.maker ELSE g.kind END) AS b
  FROM w JOIN g USING (id), (VALUES ('title'), ('maker'), ('kind')) f(f)),
oc AS (SELECT id, field, CASE WHEN a = '' THEN 'extra' WHEN a = b THEN 'exact' WHEN b = '' THEN 'missing' WHEN regexp_replace(lower(a), '[^a-z0-9 ]', '', 'g') = regexp_replace(lower(b), '[^a-z0-9 ]', '', 'g') THEN 'close' ELSE 'wrong' END AS outcome FROM o WHERE a <> '' OR b <> '')"""
_FC = f"w AS ({_WANT}), g AS ({_GOT}), {_OUT}"


def _outcomes(spark, sf):
    return M.field_outcomes(view(spark, sf, _WANT, "part"), view(spark, sf, _GOT, "part"), "id", ["title", "maker", "kind"])


@query("field_outcomes", f"WITH {_FC} SELECT * FROM oc")
def field_outcomes(spark, sf):
    """M12"""
    return _outcomes(spark, sf).select("id", "field", "outcome")


@query("field_accuracy", f"""WITH {_FC}, a AS (SELECT field, {', '.join(f"count(*) FILTER (WHERE outcome = '{x}') AS {x}" for x in ('exact', 'close', 'missing', 'wrong', 'extra'))} FROM oc GROUP BY field), s AS (SELECT *, exact + close + missing + wrong AS scored FROM a)
SELECT *, {_rate('exact', 'scored')} AS accuracy_pct, {_rate('exact + close', 'scored')} AS accuracy_loose_pct, {_rate('exact', 'exact + close + wrong')} AS precision_pct, {_rate('scored - missing', 'scored')} AS recall_pct FROM s""")
def field_accuracy(spark, sf):
    """M12"""
    return M.field_accuracy(_outcomes(spark, sf), ["field"])


@query("two_states", f"""WITH {_FC}, u AS (SELECT 'given_attributes' AS state, field, CASE WHEN outcome = 'extra' THEN 'extra' ELSE 'exact' END AS outcome FROM oc UNION ALL SELECT 'from_input_row', field, outcome FROM oc),
a AS (SELECT state, field, count(*) FILTER (WHERE outcome <> 'extra') AS scored, count(*) FILTER (WHERE outcome = 'exact') AS exact FROM u GROUP BY 1, 2) SELECT *, {_rate('exact', 'scored')} AS exact_pct FROM a""")
def two_states(spark, sf):
    """M13"""
    o = _outcomes(spark, sf)
    return M.two_states(o.withColumn("outcome", F.expr("IF(outcome = 'extra', 'extra', 'exact')")), o)


@query("slot_attributes", """SELECT p_partkey AS id, 1 AS slot, 'Bore Size' AS label, CAST(p_size AS STRING) AS value, 'mm' AS unit, 'bore_size' AS key, CAST(p_size AS DOUBLE) AS num FROM {part}
UNION ALL SELECT p_partkey, 3, 'Finish', p_type, NULL, 'finish', NULL FROM {part} WHERE p_size % 2 = 0""")
def slot_attributes(spark, sf):
    """M14"""
    df = view(spark, sf, """SELECT p_partkey AS id, ' Bore  Size' AS `ATTRIBUTE_LABEL 1`, CAST(p_size AS STRING) AS `ATTRIBUTE_VALUE 1`, 'mm' AS `ATTRIBUTE_UOM 1`, 'Empty' AS `ATTRIBUTE_LABEL 2`, '' AS `ATTRIBUTE_VALUE 2`, '' AS `ATTRIBUTE_UOM 2`,
      'Finish' AS `ATTRIBUTE_LABEL 3`, IF(p_size % 2 = 0, p_type, '  ') AS `ATTRIBUTE_VALUE 3`, '' AS `ATTRIBUTE_UOM 3` FROM {part}""", "part")
    return M.attributes_from_slots(df, "id", 3)


@query("ablation", f"""WITH {_CMP}, a AS (SELECT 'all' AS run, recovered, correct FROM c UNION ALL SELECT 'standards', recovered, correct FROM c WHERE truth_source = 'standards')
SELECT run, count(*) AS withheld, count(*) FILTER (WHERE recovered) AS recovered, {_rate('count(*) FILTER (WHERE recovered)', 'count(*)')} AS recall_pct FROM a GROUP BY run""")
def ablation(spark, sf):
    """M15"""
    c = _compared(spark, sf)
    return M.ablation({"all": M.recovery(c), "standards": M.recovery(c.where("truth_source = 'standards'"))}).select("run", "withheld", "recovered", "recall_pct")


_CO = "SELECT p_type AS category, CASE WHEN p_size % 2 = 0 THEN 'sparse' ELSE 'defect' END AS variant, CASE WHEN p_size < 20 THEN 'standards' ELSE 'archetype' END AS truth_source, CASE WHEN p_size % 2 = 1 THEN 'kind' || CAST(p_size % 3 AS STRING) END AS kind FROM {part}"


@query("composition", f"WITH x AS ({_CO}) " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS member, count(*) AS cases FROM x WHERE {d} IS NOT NULL GROUP BY 2" for d in ("category", "variant", "truth_source", "kind")))
def composition(spark, sf):
    """M16"""
    return M.composition(view(spark, sf, _CO, "part"))


@query("invariants", """SELECT count(*) AS checked, count(*) FILTER (WHERE length(CAST(l_extendedprice AS STRING)) >= 0 AND l_linenumber = 1) AS thin_evidence, count(*) FILTER (WHERE l_quantity > 40) AS confidence_outside,
  count(*) FILTER (WHERE l_suppkey % 3 = 0 AND l_linenumber % 2 = 0) AS uncited FROM {lineitem}""")
def invariants(spark, sf):
    """M17"""
    return M.invariants(view(spark, sf, """SELECT IF(l_linenumber = 1, 'too short', 'evidence long enough') AS evidence, l_quantity / 40 AS conf, IF(l_suppkey % 3 = 0, 'd', NULL) AS source_document,
      IF(l_linenumber % 2 = 0, NULL, 'u') AS source_url, CAST(NULL AS STRING) AS locator FROM {lineitem}""", "lineitem"))


