"""Units, house style and the claim contest."""
import pytest
from pyspark.sql import functions as F

from specloom.functions import style, units
from specloom.functions.text import general, python_float
from specloom.operators import claims as C


def one(spark, sql, **cols):
    names = ", ".join(f"{v} AS {k}" for k, v in cols.items()) or "1 AS x"
    return spark.sql(f"SELECT {names}").select(F.expr(sql).alias("r")).first()["r"]


@pytest.mark.parametrize("text,num,unit", [
    ("25 mm", 25.0, "mm"), ("1/2 inch", 0.5, "in"), ('3-1/4"', 3.25, "in"), ("1,750 rpm", 1.75, "rpm"), ("5 furlongs", 5.0, "mm"),
    ("-3.5", -3.5, "mm"), ("3/0 in", 3.0, "mm"), ("12 L/min", 12.0, "L/min")])
def test_measure(spark, text, num, unit):
    r = one(spark, units.measure("t", "'mm'"), t=f"'{text}'")
    assert (r["num"], r["unit"]) == (num, unit)


def test_no_number_is_null(spark):
    assert one(spark, units.measure("t", "'mm'"), t="'none here'") is None


def test_convert(spark):
    assert one(spark, units.convert("32D", "'F'", "'C'")) == 0
    assert one(spark, units.convert("1D", "'in'", "'mm'")) == 25.4
    assert one(spark, units.convert("1D", "'in'", "'kW'")) is None
    assert one(spark, units.tidy(units.convert("5D", "'HP'", "'kW'"))) == 3.729


@pytest.mark.parametrize("value", [0.5, 1.25, 3728.4917, 0.0001234, 1e6, 1234567.0, 99999.95, 7544.445, 12.0, 0.1, 1e-05])
def test_general_matches_percent_g(spark, value):
    assert one(spark, general("v"), v=f"{value!r}D") == f"{value:g}"


@pytest.mark.parametrize("value", [25.0, 3.728, 0.05, 16000.0, 12345678.0])
def test_python_float(spark, value):
    assert one(spark, python_float("v"), v=f"{value!r}D") == repr(value)


@pytest.mark.parametrize("value,text", [(0.5, "1/2"), (50.25, "50-1/4"), (0.015625, "1/64"), (0.984375, "63/64"), (3.0, "3"),
                                        (-1.5, "-1-1/2"), (0.3, None), (0.51, None)])
def test_fraction(spark, value, text):
    assert one(spark, style.to_fraction("v"), v=f"CAST({value} AS DOUBLE)") == text


def test_house_style(spark):
    m = lambda v, u, c=False: one(spark, style.measurement("t", "v", "u", c), t="CAST(NULL AS STRING)", v=f"CAST({v} AS DOUBLE)", u=u)
    assert m(24, "'inch'") == "24 in" and m(50.25, "'in'") == "50-1/4 in" and m(0.3, "'in'") == "0.3 in"
    assert m(50.25, "'in'", True) == "50-1/4IN" and m(24, "'furlongs'") is None
    assert one(spark, style.value_only("'50-1/4'", "CAST(NULL AS DOUBLE)", "'in'")) == "50-1/4"
    assert one(spark, style.title_case("'PDSH4816AF dishwasher 1/2 npt'")) == "PDSH4816AF Dishwasher 1/2 NPT"
    assert one(spark, style.title_case("'2RS (Rubber Sealed) seal type'")) == "2RS (Rubber Sealed) Seal Type"
    assert one(spark, style.upper_case("'FRIGIDAIRE®'")) == "FRIGIDAIRE"


# ------------------------------------------------------------ claim contest


def model(claims):
    """The contest, one claim after another."""
    ranks = C._RANKS
    held, conflicts = None, 0
    for val, prov, conf in claims:
        if held is None:
            held = (val, prov, conf)
            continue
        win = (ranks[prov], conf) > (ranks[held[1]], held[2])
        kept, lost = ((val, prov, conf), held) if win else (held, (val, prov, conf))
        if (kept[0] or "\0").strip().lower() != (lost[0] or "\0").strip().lower():
            conflicts += 1
            kept = (kept[0], kept[1], round(max(kept[2] - 0.05, 0.1) + 1e-12, 3))
        held = kept
    return (*held, conflicts)


def claim_rows(n, groups, seed):
    import random
    rng = random.Random(seed)
    provs = list(C._RANKS)
    return [(g, "k", i, rng.choice(["A", "b", "B ", "C", "\tb\n", " c", None]), rng.choice(provs), rng.choice([0.3, 0.45, 0.6, 0.75, 0.9, 0.6125]))
            for g in range(groups) for i in range(n)]


@pytest.mark.parametrize("limit", [10_000, 100, 40])
def test_contest_is_exact_for_any_group_size(spark, limit):
    """With a small limit every group takes the block-wise route."""
    rows = claim_rows(150, 4, 7) + [(9, "k", i, "same", "supplied", 0.9) for i in range(200)] + [(10, "k", 0, "x", "parsed", 0.5)]
    df = spark.createDataFrame(rows, "id bigint, key string, seq bigint, val string, prov string, conf double").repartition(4)
    got = {r["id"]: (r["val"], r["prov"], r["conf"], r["conflicts"]) for r in C.reconcile_claims(df, ["seq"], limit=limit).collect()}
    lines = {r["id"]: r["count"] for r in C.conflict_log(df, ["seq"], limit=limit).groupBy("id").count().collect()}
    for g in {r[0] for r in rows}:
        want = model([(v, p, c) for i, _, _, v, p, c in sorted(x for x in rows if x[0] == g)])
        assert got[g] == want and lines.get(g, 0) == want[3]


@pytest.mark.parametrize("limit", [10_000, 40])
def test_groups_of_null_id_or_key_are_kept_at_any_size(spark, limit):
    names = [(1, None), (None, "k"), (None, None), (1, "k")]
    rows = [(*names[g], i, v, p, c) for g, _, i, v, p, c in claim_rows(150, 4, 11)]
    df = spark.createDataFrame(rows, "id bigint, key string, seq bigint, val string, prov string, conf double").repartition(4)
    got = {(r["id"], r["key"]): (r["val"], r["prov"], r["conf"], r["conflicts"]) for r in C.reconcile_claims(df, ["seq"], limit=limit).collect()}
    lines = {(r["id"], r["key"]): r["count"] for r in C.conflict_log(df, ["seq"], limit=limit).groupBy("id", "key").count().collect()}
    for g in names:
        want = model([(v, p, c) for i, k, _, v, p, c in sorted((x for x in rows if x[:2] == g), key=lambda x: x[2])])
        assert got[g] == want and lines.get(g, 0) == want[3]
