"""Written formats against the labelled rows."""
import pytest
from pyspark.sql import functions as F

from specloom.operators import content as T
from specloom.operators.records import NULL, attribute
from specloom.functions.text import number, q


def attr(key, label, value, unit=None, prov="supplied"):
    num = isinstance(value, (int, float))
    return attribute(key=q(key), label=q(label), val=q(str(value)), num=number(value) if num else "CAST(NULL AS DOUBLE)",
                     kind=q(("float" if isinstance(value, float) else "int") if num else "text"), unit=q(unit) if unit else NULL,
                     prov=q(prov), conf="0.99D", evidence="'supplied in the labelled row'", method="'fixture'", grp="'General'")


ROW1 = [attr("feature", "Feature", "CleanBoost™"), attr("series", "Series", "Professional Series"),
        attr("wash_cycles", "Number of Wash Cycles", 5), attr("voltage", "Voltage Rating", 120, "V"), attr("current", "Amperage Rating", 15, "A"),
        attr("mounting", "Mounting Type", "Leg"), attr("size", "Size", "24 in W x 24-1/4 in D"),
        attr("depth_with_door_open", "Depth With Door Open", "50-1/4", "in"),
        attr("minimum_height", "Minimum Height", "8-1/2 in Upper Rack, 11-1/4 in Lower Rack"),
        attr("maximum_height", "Maximum Height", "10-3/8 in Upper Rack, 13-1/4 in Lower Rack"), attr("sound_level", "Sound Level", 47, "dBA"),
        attr("material", "Material", "Stainless Steel"),
        attr("additional_information", "Additional Information", "240 kW-hr Annual Energy, 1 to 12 hr Delay Start Hours")]
ROW2 = [attr("feature", "Feature", "Washing 3rd Rack, Water Repellent Silverware Basket"), attr("series", "Series", "Eco Series"),
        attr("voltage", "Voltage Rating", 120, "V"), attr("current", "Amperage Rating", 10, "A"), attr("mounting", "Mounting Type", "Built-in"),
        attr("size", "Size", "33-7/16 in H x 23-7/8 in W x 22-5/8 in D"), attr("depth_with_door_open", "Depth With Door Open", "50-3/16", "in"),
        attr("minimum_height", "Minimum Height", "33-7/16", "in"), attr("sound_level", "Sound Level", 41, "dBA"),
        attr("material", "Material", "Stainless Steel"), attr("color", "Color", "Stainless Steel")]
EXPECTED = {
    1: {"invoice_desc": "DISHWASHER LEG 5 SST 120V 15A 50-1/4IN",
        "mobile_desc": "Rheem Manufacturing FRIGIDAIRE, Dishwasher, Professional Series, PDSH4816AF",
        "product_title": "FRIGIDAIRE® Professional Series PDSH4816AF Dishwasher With CleanBoost™, Leg Mounting, 5-Wash Cycle, Stainless Steel",
        "retail_desc": "Professional Series Dishwasher, Leg Mounting, 5-Wash Cycle, Stainless Steel",
        "with_clause": "With CleanBoost™", "product_name": "Dishwasher",
        "long_description": "FRIGIDAIRE® Dishwasher With CleanBoost™, Professional Series, 5 Wash Cycles, 120 V, 15 A, Leg Mounting,"
                            " 24 in W x 24-1/4 in D, 50-1/4 in Depth With Door Open, 8-1/2 in Upper Rack, 11-1/4 in Lower Rack Minimum Height,"
                            " 10-3/8 in Upper Rack, 13-1/4 in Lower Rack Maximum Height, 47 dBA Sound Level, Stainless Steel,"
                            " Additional Information: 240 kW-hr Annual Energy, 1 to 12 hr Delay Start Hours"},
    2: {"invoice_desc": "DISHWASHER BLTLN SST SST 120V 10A 41DBA",
        "mobile_desc": "Whirlpool, Dishwasher, Eco Series, WDTS7024RZ, Built-in Mounting",
        "product_title": "Whirlpool® Eco Series WDTS7024RZ Dishwasher, Built-in Mounting, Stainless Steel, Stainless Steel",
        "retail_desc": "Eco Series Dishwasher, Built-in Mounting, Stainless Steel, Stainless Steel",
        "with_clause": "With Washing 3rd Rack, Water Repellent Silverware Basket", "product_name": "Dishwasher"},
}


@pytest.fixture(scope="module")
def written(spark):
    rows = {1: ("FRIGIDAIRE®", "Rheem Manufacturing", "PDSH4816AF", "Dishwasher", ROW1),
            2: ("Whirlpool®", "Whirlpool Corporation", "WDTS7024RZ", "Dishwasher", ROW2),
            3: ("Acme", "", "X1", "Gauge", [attr("span", "Span", 12, "furlongs")]),
            4: ("B", "", "M", "Commercial Grade Heavy Duty Stainless Steel Built-In Dishwashing Appliance", []),
            5: ("Acme", "", "X1", "Valve", [])}
    sql = " UNION ALL ".join(
        f"SELECT {i} AS id, {q(b)} AS brand, {q(mpn)} AS mpn, map('brand', {q(b)}, 'mpn', {q(mpn)}, 'manufacturer', {q(m)}) AS identity,"
        f" named_struct('noun', {q(t)}, 'leaf', {q(t)}) AS schema, " + (f"array({', '.join(a)})" if a else "filter(array("
        + attr("x", "X", "y") + "), a -> false)") + " AS attributes" for i, (b, m, mpn, t, a) in rows.items())
    df = T.compliance(spark.sql(sql)).select("id", F.explode("fields").alias("f")).select("id", "f.*")
    return {(r["id"], r["f.id"] if "f.id" in r else r[1]): r for r in df.toDF(
        "id", "format", "label", "text", "length", "min_length", "max_length", "compliant", "dropped", "notes").collect()}


@pytest.mark.parametrize("row,fmt", [(r, f) for r, fs in EXPECTED.items() for f in fs])
def test_labelled_rows_are_reproduced(written, row, fmt):
    assert written[(row, fmt)]["text"] == EXPECTED[row][fmt]


def test_unapproved_unit_never_reaches_copy(written):
    r = written[(3, "long_description")]
    assert "12" not in r["text"] and not r["compliant"] and any("furlongs" in n for n in r["notes"])


def test_overflow_is_reported_and_clipped_on_a_word(written):
    r = written[(4, "invoice_desc")]
    assert not r["compliant"] and not r["text"].endswith("DISHWASHIN") and any("exceed" in n for n in r["notes"])


def test_below_minimum_is_reported_not_padded(written):
    r = written[(5, "mobile_desc")]
    assert not r["compliant"] and "Acme" in r["text"] and r["length"] < 60


def test_fitting_is_not_a_breach(written):
    r = written[(1, "invoice_desc")]
    assert r["compliant"] and r["dropped"]
