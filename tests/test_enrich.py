"""End-to-end behaviour of single products."""
import pytest
from pyspark.sql import functions as F

from specloom.plans.enrich import enrich

ATTRS = "transform(attributes, a -> named_struct('key', a.key, 'val', a.val, 'num', a.num, 'unit', a.unit, 'prov', a.prov, 'conf', a.conf, 'evidence', a.evidence, 'locator', a.locator))"


@pytest.fixture(scope="module")
def records(spark, product, product_df):
    bearing = dict(brand="SKF", name="Deep groove ball bearing")
    p = product
    rows = [
        p(1, mpn="6205", specs={"Bore": "30 mm", "Outer Diameter": "52 mm", "Width": "15 mm"}, **bearing),
        p(2, mpn="6205", specs={"Bore": "25 mm", "Outer Diameter": "52 mm", "Width": "15 mm"}, **bearing),
        p(3, sku="BRG-6205-2RS", mpn="6205-2RS", brand="skf", name="Deep groove ball bearing"),
        p(4, mpn="6205", specs={"Bore": "25.0 mm", "Outer Diameter": "52 mm", "Width": "15 mm"}, **bearing),
        p(5, mpn="6205", specs={"Bore": "0.9843 in", "Outer Diameter": "52 mm", "Width": "15 mm"}, **bearing),
        p(6, mpn="6305", description="Replaces the older 6205 in this housing.",
          specs={"Bore": "25 mm", "Outer Diameter": "62 mm", "Width": "17 mm"}, **bearing),
        p(7, mpn="HOUSE-CODE-9", brand="SKF", name="Deep groove ball bearing 6205"),
        p(8, mpn="HOUSE-CODE-9", brand="SKF", name="Deep groove ball bearing 6205",
          specs={"Bore": "30 mm", "Outer Diameter": "52 mm", "Width": "15 mm"}),
        p(9, name="5 HP motor three phase 460 volts 1750 RPM TEFC frame 184T", brand="WEG", mpn="W22"),
        p(10, name="Ball valve", mpn="BV1", brand="Swagelok",
          specs={"Body Material": "PVC", "Max Temperature": "180 C", "Nominal Size": "1/2 inch", "Pressure Rating": "150 psi"}),
        p(11, mpn="6204", specs={"Bore": "47 mm", "Outer Diameter": "20 mm", "Width": "14 mm"}, **bearing),
        p(12, name="Hydraulic hose", brand="Gates", mpn="H1", description="Inner diameter: 12.7 mm, working pressure 350 bar"),
        p(13, name="Hydraulic hose", brand="Gates", mpn="H2", source_document="sheet.pdf",
          specs={"Inner Diameter": "12.7 mm", "Working Pressure": "350 bar", "Burst Pressure": "700 bar"}),
        p(14, name="Hex bolt", brand="Wurth", mpn="M10x50-10.9",
          specs={"Grade": "10.9", "Material": "316 Stainless Steel", "Thread Size": "M10", "Length": "50 mm"}),
        p(15, name="Pressure sensor", brand="ifm electronic", mpn="PN1", specs={"Ingress Protection": "IP68K9"}),
        p(16, name="Mystery item"), p(17),
    ]
    df = enrich(spark, product_df(rows))
    out = df.select("id", F.expr(ATTRS).alias("attributes"), "issues", "readiness", "category", "content", "identity",
                    "conflicts", "fields").collect()
    return {r["id"]: r for r in out}


def attr(r, key):
    return next((a for a in r["attributes"] if a["key"] == key), None)


def codes(r):
    return {i["code"] for i in r["issues"]}


def test_standard_contradicts_but_does_not_overrule(records):
    r = records[1]
    flag = next(i for i in r["issues"] if i["code"] == "STANDARD_CONTRADICTION")
    assert "30 mm" in flag["message"] and "25 mm" in flag["message"]
    assert r["readiness"]["verdict"] != "publish"
    bore = attr(r, "bore_diameter")
    assert bore["num"] == 30.0 and bore["conf"] == 0.94 and "25 mm" in bore["evidence"]


def test_agreement_and_sparse_case_publish(records):
    for i in (2, 3, 6):
        assert "STANDARD_CONTRADICTION" not in codes(records[i])
        assert records[i]["readiness"]["verdict"] == "publish"
    assert attr(records[2], "bore_diameter")["conf"] == 0.99
    assert attr(records[3], "bore_diameter")["num"] == 25
    assert attr(records[3], "seal_type")["val"] == "2RS (Rubber Sealed)"


def test_rounding_and_units_are_no_contradiction(records):
    for i in (4, 5):
        assert "STANDARD_CONTRADICTION" not in codes(records[i])


def test_series_in_prose_fills_but_never_accuses(records):
    assert attr(records[7], "bore_diameter")["num"] == 25
    assert "STANDARD_CONTRADICTION" not in codes(records[8])


def test_motor_prose(records):
    r = records[9]
    assert attr(r, "power_rating")["val"] == "3.729" and attr(r, "power_rating")["unit"] == "kW"
    assert attr(r, "voltage")["num"] == 460 and attr(r, "speed")["num"] == 1750
    assert attr(r, "phase")["val"] == "Three Phase" and attr(r, "frame_size")["val"] == "184T"
    assert attr(r, "full_load_current")["prov"] == "derived"
    assert "MISSING_REQUIRED" not in codes(r)


def test_engineering_rules(records):
    assert "MATERIAL_TEMP_CONFLICT" in codes(records[10]) and records[10]["readiness"]["verdict"] == "blocked"
    assert attr(records[10], "nominal_size")["num"] == 0.5
    assert "GEOMETRY_CONTRADICTION" in codes(records[11])
    assert "GRADE_MATERIAL_CONFLICT" in codes(records[14])
    assert "INVALID_IP_CODE" in codes(records[15])
    low = next(i for i in records[13]["issues"] if i["code"] == "SAFETY_FACTOR_LOW")
    assert low["severity"] == "error" and "2.0:1" in low["message"]


def test_prose_only_hose(records):
    r = records[12]
    assert attr(r, "inner_diameter")["num"] == 12.7
    burst = attr(r, "burst_pressure")
    assert burst["num"] == 1400 and burst["prov"] == "derived"


def test_document_values_carry_a_locator(records):
    assert attr(records[13], "inner_diameter")["locator"] == "sheet.pdf"


def test_unidentifiable_and_empty(records):
    assert records[16]["category"] is None and records[16]["readiness"]["verdict"] == "blocked"
    assert records[17]["readiness"]["overall"] == 0 and records[17]["readiness"]["notes"] == ["No input supplied."]
    assert all(not f["compliant"] for f in records[16]["fields"] if f["id"] in ("invoice_desc", "product_title"))


def test_every_attribute_has_evidence(records):
    for r in records.values():
        for a in r["attributes"]:
            assert len(a["evidence"]) > 10 and 0 <= a["conf"] <= 1


def test_issues_are_ordered_by_severity(records):
    rank = {"error": 0, "warning": 1, "info": 2}
    for r in records.values():
        seen = [rank[i["severity"]] for i in r["issues"]]
        assert seen == sorted(seen)


def test_copy_leaves_defaults_out(records):
    r = records[3]
    assert r["content"]["title"].startswith("SKF 6205-2RS Ball Bearing")
    assert "Chrome Steel" not in r["content"]["long_description"]


def test_whole_plan_has_no_exchange(spark, product, product_df):
    plan = enrich(spark, product_df([product(1, name="x")]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert "hashpartitioning" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_list_of_values_governs_records(spark, product, product_df):
    from specloom import fixed
    from specloom.plans.taxonomy import Taxonomy
    text = lambda k, label: {"key": k, "label": label, "type": "text", "unit": None, "group": "General", "values": [], "range": None, "aliases": []}
    pipe = {"code": "99000001", "noun": "Pipe Fitting", "path": next(iter(fixed.LOV)).split(" > "), "keywords": ["pipe fitting"], "mpn_patterns": [],
            "required": [], "cross_checks": [], "defaults": {}, "learned": True,
            "attributes": [text("material", "Material Construction"), text("fitting_type", "Fitting Type"), text("weight", "Weight")]}
    rows = [product(1, name="Pipe fitting", specs={"Weight": "3 lb", "Material Construction": "BRS", "Fitting Type": "CPLG"}),
            product(2, name="Pipe fitting", specs={"Material Construction": "Stainless Steal"})]
    df = enrich(spark, product_df(rows), Taxonomy(learned=[pipe]), formats=False)
    r = {x["id"]: x for x in df.select("id", F.expr(ATTRS).alias("attributes"), "issues", "readiness", "lov_ledger", "lov_coverage").collect()}
    assert [(a["key"], a["val"]) for a in r[1]["attributes"]] == [("fitting_type", "Coupling"), ("material", "Brass"), ("weight", "3 lb")]
    assert {x["method"] for x in r[1]["lov_ledger"]} == {"synonym"} and r[1]["lov_coverage"]["approved"] == 2
    bad = next(i for i in r[2]["issues"] if i["code"] == "LOV_VIOLATION")
    assert "Stainless Steel" in bad["suggestion"] and attr(r[2], "material")["val"] == "Stainless Steal"
    assert r[2]["readiness"]["verdict"] == "review"
