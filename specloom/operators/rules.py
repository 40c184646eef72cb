"""Validation: schema checks, engineering rules, copy checks (Q1-Q26).

Rules read a record through ``Values`` and return an issue struct or null.  They
are registered by name, and run only for categories whose schema lists the name;
``register_rule`` is the extension point for new ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .. import fixed
from ..functions.stage import stage
from ..functions.text import general, in_list, let, python_float, q, strings

ISSUE_DDL = "code:string,severity:string,field:string,message:string,suggestion:string"
NO_ISSUES = f"CAST(array() AS ARRAY<STRUCT<{ISSUE_DDL}>>)"


class Values:
    """SQL operands for the numbers and texts of a record, read from two map columns."""

    def __init__(self, nums: str = "_nums", texts: str = "_texts", grades: str = "schema.grades"):
        self.nums, self.texts, self.grades = nums, texts, grades

    def num(self, key: str) -> str:
        return f"try_element_at({self.nums}, {q(key)})"

    def text(self, key: str) -> str:
        return f"coalesce(try_element_at({self.texts}, {q(key)}), '')"

    def shows(self, key: str) -> str:
        """Number printed with its decimal point."""
        return python_float(self.num(key))

    def brief(self, key: str) -> str:
        """Number in six significant digits."""
        return general(self.num(key))

    def grade_strength(self) -> str:
        return f"get(filter({self.grades}, g -> g.name = {self.text('grade')}), 0).num"


def issue(code: str, severity: str, field: str | None, message: str, suggestion: str | None = None) -> str:
    """Issue struct; ``message`` is SQL, the rest are plain strings."""
    return (f"named_struct('code', {q(code)}, 'severity', {severity if severity.startswith('IF(') else q(severity)},"
            f" 'field', {q(field)}, 'message', {message}, 'suggestion', "
            + (suggestion if suggestion and suggestion.startswith("IF(") else q(suggestion)) + ")")


Rule = Callable[[Values], str]
REGISTRY: dict[str, Rule] = {}


def register_rule(name: str) -> Callable[[Rule], Rule]:
    """Q7: add a rule under ``name``; categories opt in by listing it."""
    def add(fn: Rule) -> Rule:
        REGISTRY[name] = fn
        return fn
    return add


def _when(condition: str, then: str) -> str:
    return f"CASE WHEN {condition} THEN {then} END"


@register_rule("bore_lt_od")
def bore_below_outer(v: Values) -> str:
    """Q8"""
    return _when(f"{v.num('bore_diameter')} >= {v.num('outer_diameter')}", issue(
        "GEOMETRY_CONTRADICTION", "error", "bore_diameter",
        f"concat('Bore diameter (', {v.shows('bore_diameter')}, ' mm) is not smaller than outer diameter (',"
        f" {v.shows('outer_diameter')}, ' mm).')",
        "The two values are most likely transposed in the source data."))


@register_rule("static_vs_dynamic")
def static_within_dynamic(v: Values) -> str:
    """Q9"""
    return _when(f"{v.num('bore_diameter')} < 50 AND {v.num('static_load_rating')} > {v.num('dynamic_load_rating')}", issue(
        "LOAD_RATING_SUSPECT", "warning", "static_load_rating",
        f"concat('Static rating (', {v.shows('static_load_rating')}, ' kN) exceeds dynamic rating (',"
        f" {v.shows('dynamic_load_rating')}, ' kN) on a ', {v.shows('bore_diameter')},"
        " ' mm bore bearing, which is atypical for this size class.')",
        "Verify that C and C0 have not been swapped."))


@register_rule("sealed_speed")
def sealed_speed(v: Values) -> str:
    """Q10"""
    return _when(f"{v.num('max_speed')} > 20000 AND contains(upper({v.text('seal_type')}), '2RS')", issue(
        "SPEED_SEAL_CONFLICT", "warning", "max_speed",
        f"concat('Contact seals (2RS) limit speed well below the stated ', {v.brief('max_speed')}, ' rpm.')",
        "The figure likely belongs to the open or shielded variant."))


@register_rule("pvc_temp")
def pvc_temperature(v: Values) -> str:
    """Q11"""
    return _when(f"{v.num('temp_rating_max')} > 60 AND contains(upper({v.text('body_material')}), 'PVC')", issue(
        "MATERIAL_TEMP_CONFLICT", "error", "temp_rating_max",
        f"concat('A PVC body cannot be rated to ', {v.brief('temp_rating_max')}, ' C; PVC softens above about 60 C.')",
        "Either the body material or the temperature rating is wrong."))


@register_rule("ptfe_temp")
def ptfe_temperature(v: Values) -> str:
    """Q12"""
    return _when(f"{v.num('temp_rating_max')} > 230 AND contains(upper({v.text('seat_material')}), 'PTFE')", issue(
        "SEAT_TEMP_CONFLICT", "warning", "seat_material",
        f"concat('PTFE seats degrade above ~230 C but the valve is rated to ', {v.brief('temp_rating_max')}, ' C.')",
        "A metal-seated variant is implied; confirm the seat material."))


@register_rule("brass_pressure")
def brass_pressure(v: Values) -> str:
    """Q13"""
    return _when(f"{v.num('pressure_rating')} > 3000 AND contains(upper({v.text('body_material')}), 'BRASS')", issue(
        "MATERIAL_PRESSURE_CONFLICT", "warning", "pressure_rating",
        f"concat({v.brief('pressure_rating')}, ' psi is beyond the usual envelope for a brass body.')",
        "Confirm the rating, or the body may in fact be stainless."))


@register_rule("motor_power_current")
def motor_current(v: Values) -> str:
    """Q14"""
    power, volts, amps, phase = v.num("power_rating"), v.num("voltage"), v.num("full_load_current"), v.text("phase")
    expected = (f"try_divide({power} * 1000D, IF(contains({phase}, 'Three') OR {phase} = '', 1.732D, 1D)"
                f" * {volts} * 0.85D * 0.92D)")
    return let("ex", f"CASE WHEN {volts} > 0 THEN {expected} END", _when(
        f"ex > 0 AND {amps} IS NOT NULL AND NOT ({amps} / ex BETWEEN 0.6D AND 1.7D)", issue(
            "ELECTRICAL_INCONSISTENCY", "warning", "full_load_current",
            f"concat({v.brief('full_load_current')}, ' A does not fit ', {v.brief('power_rating')}, ' kW at ',"
            f" {v.brief('voltage')}, ' V; roughly ', format_string('%.1f', ex), ' A would be expected.')",
            "Check whether the current is per-phase or the power is in horsepower.")))


@register_rule("motor_pole_speed")
def motor_speed(v: Values) -> str:
    """Q15"""
    speed, freq = v.num("speed"), v.num("frequency")
    return let("fr", f"coalesce(nullif({freq}, 0D), 50D)", _when(
        f"{speed} IS NOT NULL AND NOT exists(array(2D, 4D, 6D, 8D, 10D, 12D), p ->"
        f" {speed} >= 0.93D * 120D * fr / p AND {speed} <= 1.001D * 120D * fr / p)", issue(
            "SPEED_NOT_STANDARD", "info", "speed",
            f"concat({v.brief('speed')}, ' rpm matches no standard pole count at ', {general('fr')},"
            " ' Hz (expected near ', array_join(transform(array(2D, 4D, 6D, 8D),"
            " p -> format_string('%.0f', 120D * fr / p)), ', '), ').')",
            "Normal for inverter-duty or servo motors; verify otherwise.")))


@register_rule("stainless_grade")
def stainless_grade(v: Values) -> str:
    """Q16"""
    return _when(f"contains(upper({v.text('material')}), 'STAINLESS') AND {v.text('grade')} <> ''"
                 f" AND NOT startswith(upper({v.text('grade')}), 'A')", issue(
        "GRADE_MATERIAL_CONFLICT", "error", "grade",
        f"concat('Property class \\'', {v.text('grade')}, '\\' is a carbon-steel designation but the material is ',"
        f" {v.text('material')}, '.')",
        "Stainless fasteners use A2-70 or A4-80 per ISO 3506."))


@register_rule("grade_tensile")
def grade_tensile(v: Values) -> str:
    """Q17"""
    tensile = v.num("tensile_strength")
    return let("st", v.grade_strength(), _when(f"abs({tensile} - st) / st > 0.12D", issue(
        "STRENGTH_MISMATCH", "error", "tensile_strength",
        f"concat('Property class ', {v.text('grade')}, ' requires about ', CAST(CAST(st AS BIGINT) AS STRING),"
        f" ' MPa minimum tensile strength, but ', {v.brief('tensile_strength')}, ' MPa is stated.')",
        "ISO 898-1 fixes this relationship; one of the two values is wrong.")))


@register_rule("ip_plausible")
def ip_code(v: Values) -> str:
    """Q18"""
    return let("ip", f"trim({v.text('ip_rating')})", _when(
        "ip <> '' AND NOT upper(ip) RLIKE '^IP\\\\s?[0-6X][0-9XK]$'", issue(
            "INVALID_IP_CODE", "warning", "ip_rating",
            "concat('\\'', ip, '\\' is not a valid IEC 60529 ingress protection code.')",
            "Expected the form IP54, IP67, IP69K.")))


@register_rule("pump_ports")
def pump_ports(v: Values) -> str:
    """Q19"""
    return _when(f"{v.num('outlet_size')} > {v.num('inlet_size')}", issue(
        "PORT_SIZE_SUSPECT", "info", "outlet_size",
        f"concat('Outlet (', {v.shows('outlet_size')}, '\") is larger than inlet (', {v.shows('inlet_size')},"
        " '\"), which is unusual.')",
        "Centrifugal pumps normally have the larger port on the suction side."))


@register_rule("pp_temp")
def polypropylene_temperature(v: Values) -> str:
    """Q20"""
    return _when(f"{v.num('max_temp')} > 90 AND contains(upper({v.text('body_material')}), 'POLYPROPYLENE')", issue(
        "MATERIAL_TEMP_CONFLICT", "error", "max_temp",
        f"concat('Polypropylene wetted parts are not rated to ', {v.brief('max_temp')}, ' C.')",
        "Above 90 C requires PVDF or stainless steel."))


@register_rule("flute_vs_overall")
def flute_below_overall(v: Values) -> str:
    """Q21"""
    return _when(f"{v.num('flute_length')} >= {v.num('overall_length')}", issue(
        "GEOMETRY_CONTRADICTION", "error", "flute_length",
        f"concat('Flute length (', {v.shows('flute_length')}, ' mm) is not shorter than overall length (',"
        f" {v.shows('overall_length')}, ' mm).')",
        "A cutting tool needs shank beyond the flutes; check both values."))


@register_rule("burst_vs_working")
def burst_margin(v: Values) -> str:
    """Q22"""
    burst, working = v.num("burst_pressure"), v.num("working_pressure")
    low = issue("PRESSURE_CONTRADICTION", "error", "burst_pressure",
                f"concat('Burst pressure (', {v.brief('burst_pressure')}, ' bar) is below working pressure (',"
                f" {v.brief('working_pressure')}, ' bar).')",
                "The values are transposed; burst must always exceed working pressure.")
    severe = f"{burst} / {working} < 3"
    thin = issue("SAFETY_FACTOR_LOW", f"IF({severe}, 'error', 'warning')", "burst_pressure",
                 f"concat('Safety factor is ', format_string('%.1f', {burst} / {working}),"
                 " ':1; SAE J517 requires at least 4:1 for hydraulic hose.')",
                 f"IF({severe}, 'Do not list this for hydraulic service until the rating is confirmed.',"
                 " 'Confirm the burst rating against the manufacturer datasheet.')")
    return f"CASE WHEN {burst} < {working} THEN {low} WHEN {burst} < {working} * 4 THEN {thin} END"


@register_rule("hose_id_od")
def hose_bore_below_outer(v: Values) -> str:
    """Q23"""
    return _when(f"{v.num('inner_diameter')} >= {v.num('outer_diameter')}", issue(
        "GEOMETRY_CONTRADICTION", "error", "inner_diameter",
        f"concat('Inner diameter (', {v.shows('inner_diameter')}, ' mm) is not smaller than outer diameter (',"
        f" {v.shows('outer_diameter')}, ' mm).')",
        "Check whether the two columns are swapped in the source."))


# ------------------------------------------------------------ generic checks


def _range_issues() -> str:
    """Q1-Q3 for every attribute the schema defines, in attribute order."""
    mismatch = issue("TYPE_MISMATCH", "error", None,
                     "concat(a.label, ' should be numeric but holds \\'', coalesce(a.val, 'None'), '\\'.')",
                     "Extract the numeric portion and record the unit separately.")
    hint = "IF(" + "true, CASE " + " ".join(
        f"WHEN a.num / {f}D BETWEEN s.lo AND s.hi OR a.num * {f}D BETWEEN s.lo AND s.hi"
        f" THEN 'The magnitude suggests {why}.'"
        for f, why in ((25.4, "inches were read as millimetres"), (1000.0, "a kilo- prefix was dropped"),
                       (0.7457, "horsepower was read as kilowatts"))
    ) + " ELSE 'Check the source value and its unit.' END, NULL)"
    outside = issue("OUT_OF_RANGE", "error", None,
                    "concat(a.label, ' is ', a.val, IF(coalesce(a.unit, '') <> '', concat(' ', a.unit), ''),"
                    f" ', outside the plausible range ', {general('s.lo')}, '–', {general('s.hi')}, ' for this category.')",
                    hint)
    vocab = issue("VOCABULARY_VIOLATION", "warning", None,
                  "concat('\\'', a.val, '\\' is not in the controlled vocabulary for ', a.label, '.')",
                  "IF(true, concat('Expected one of: ', array_join(s.options, ', '), '.'), NULL)")
    body = ("CASE WHEN s IS NULL THEN NULL"
            f" WHEN s.type = 'number' AND a.kind NOT IN ('int', 'float') THEN {mismatch}"
            f" WHEN s.type = 'number' AND s.lo IS NOT NULL AND NOT (a.num BETWEEN s.lo AND s.hi) THEN {outside}"
            f" WHEN s.type = 'enum' AND size(s.options) > 0 AND NOT array_contains(s.options, a.val) THEN {vocab} END")
    body = body.replace("'field', CAST(NULL AS STRING)", "'field', a.key")
    return ("filter(transform(attributes, a -> "
            + let("s", "get(filter(sa, x -> x.key = a.key), 0)", body) + "), x -> x IS NOT NULL)")


def _missing() -> str:
    """Q4: required keys neither among the attributes nor in the identity."""
    return ("filter(schema.required, k -> NOT array_contains(present, k)"
            " AND NOT (CASE k WHEN 'brand' THEN coalesce(identity.brand, '') <> ''"
            " WHEN 'mpn' THEN coalesce(identity.mpn, '') <> '' WHEN 'sku' THEN coalesce(identity.sku, '') <> ''"
            " WHEN 'gtin' THEN coalesce(identity.gtin, '') <> ''"
            " WHEN 'manufacturer' THEN coalesce(identity.manufacturer, '') <> '' ELSE false END))")


def _required_issues() -> str:
    made = issue("MISSING_REQUIRED", "error", None,
                 "concat(coalesce(get(filter(sa, x -> x.key = k), 0).label, initcap(replace(k, '_', ' '))),"
                 " ' is required for ', schema.leaf, ' but could not be resolved.')",
                 "Request this field from the supplier or source it from the datasheet.")
    return "transform(missing, k -> " + made.replace("'field', CAST(NULL AS STRING)", "'field', k") + ")"


def _confidence_issue() -> str:
    """Q5: one warning naming the first six weak attributes."""
    made = issue("LOW_CONFIDENCE", "warning", None,
                 "concat(size(wk), ' attribute(s) rest on category defaults rather than supplier data: ',"
                 " array_join(transform(slice(wk, 1, 6), a -> a.label), ', '), '.')",
                 "Confirm these against the manufacturer datasheet before publishing.")
    return let("wk", "filter(attributes, a -> a.conf < 0.5D)", f"CASE WHEN size(wk) > 0 THEN {made} END")


def content_issues(content: str = "content") -> str:
    """Q6: lengths, banned phrases and figures no attribute backs."""
    title = issue("TITLE_TOO_LONG", "warning", "title",
                  f"concat('Title is ', length({content}.title), ' characters; most marketplaces truncate at 150.')",
                  "Trim to the brand, part number and two defining specs.")
    meta = issue("META_TOO_LONG", "warning", "meta_description",
                 "'Meta description exceeds 160 characters and will be cut off in search results.'")
    banned = issue("UNSUPPORTED_CLAIM", "warning", "content",
                   "concat('Copy contains unverifiable marketing claims: ', array_join(hits, ', '), '.')",
                   "Replace with a measurable specification.")
    figures = issue("UNVERIFIED_FIGURE", "warning", "long_description",
                    "concat('The description cites figures not present in the attribute set: ',"
                    " array_join(slice(array_sort(orphans), 1, 5), ', '), '.')",
                    "Remove them or promote them to attributes with evidence.")
    rx = q(r"\d+(?:\.\d+)?")
    known = ("flatten(transform(attributes, a -> IF(a.kind IN ('int', 'float'), array("
             + general("a.num") + f"), transform(regexp_extract_all(coalesce(a.val, ''), {rx}, 0),"
             + " t -> " + let("td", "CAST(t AS DOUBLE)", general("td")) + "))))")
    stated = f"array_distinct(regexp_extract_all(coalesce({content}.long_description, ''), {q(chr(92) + 'b' + r'\d+(?:\.\d+)?' + chr(92) + 'b')}, 0))"
    orphan = let("kn", known, f"filter({stated}, t -> CAST(t AS DOUBLE) > 3 AND NOT array_contains(kn, "
                 + let("td", "CAST(t AS DOUBLE)", general("td")) + "))")
    return ("filter(array("
            f"CASE WHEN length({content}.title) > 150 THEN {title} END,"
            f"CASE WHEN length({content}.meta_description) > 160 THEN {meta} END,"
            + let("blob", f"lower(concat_ws(' ', {content}.title, {content}.short_description, {content}.long_description))",
                  let("hits", f"filter({strings(fixed.BANNED_PHRASES)}, b -> contains(blob, b))",
                      f"CASE WHEN size(hits) > 0 THEN {banned} END")) + ","
            + let("orphans", orphan, f"CASE WHEN size(orphans) > 2 THEN {figures} END")
            + "), x -> x IS NOT NULL)")


def standard_issues() -> str:
    """Q24"""
    made = issue("STANDARD_CONTRADICTION", "warning", None,
                 "concat(c.label, ' is given as ', c.held, ' but the part number\\'s standard fixes it at ', c.standard, '.')",
                 "Confirm the part number against the dimension. One of the two is wrong, and the supplier"
                 " value has been kept unchanged.")
    return ("transform(standard_conflicts, c -> "
            + made.replace("'field', CAST(NULL AS STRING)", "'field', c.key") + ")")


def cross_rules(names: list[str] | None = None, values: Values | None = None,
                listed: str = "schema.checks") -> str:
    """Q7-Q23: issues of every registered rule the category lists."""
    values = values or Values()
    parts = [f"CASE WHEN array_contains({listed}, {q(n)}) THEN {fn(values)} END"
             for n, fn in REGISTRY.items() if names is None or n in names]
    return f"filter(array({', '.join(parts)}), x -> x IS NOT NULL)"


def value_maps(df: DataFrame) -> DataFrame:
    """Numbers and texts of a record by key, for the rules."""
    return stage(
        df,
        _nums="map_from_entries(transform(filter(attributes, a -> a.kind IN ('int', 'float')), a -> struct(a.key, a.num)))",
        _texts="map_from_entries(transform(filter(attributes, a -> a.val IS NOT NULL), a -> struct(a.key, a.val)))")


def validate(df: DataFrame, content: bool = True, standards: bool = True) -> DataFrame:
    """Q1-Q25: adds ``missing`` and ``issues`` ordered by severity (stable)."""
    df = value_maps(df)
    df = stage(df, missing="CASE WHEN schema IS NULL THEN CAST(array() AS ARRAY<STRING>) ELSE " + let(
        "present", "transform(filter(attributes, a -> coalesce(a.val, '') <> ''), a -> a.key)", _missing()) + " END")
    parts = {
        "_q1": f"CASE WHEN schema IS NULL THEN {NO_ISSUES} ELSE {let('sa', 'schema.attrs', _range_issues())} END",
        "_q2": f"CASE WHEN schema IS NULL THEN {NO_ISSUES} ELSE {let('sa', 'schema.attrs', _required_issues())} END",
        "_q3": f"CASE WHEN schema IS NULL THEN {NO_ISSUES} ELSE {cross_rules()} END",
        "_q4": standard_issues() if standards else NO_ISSUES,
        "_q5": f"filter(array({_confidence_issue()}), x -> x IS NOT NULL)",
        "_q6": content_issues() if content else NO_ISSUES,
    }
    df = stage(df, **parts)
    if "lov_issues" in df.columns:
        parts["lov_issues"] = ""
    return stage(df, issues=by_severity(
        f"concat({', '.join(f'coalesce({p}, {NO_ISSUES})' for p in parts)})")).drop(*[p for p in parts if p != "lov_issues"], "_nums", "_texts")


def by_severity(issues: str) -> str:
    """Q25: stable order error, warning, info."""
    ranks = "CASE i.severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
    return (f"transform(array_sort(transform({issues}, (i, n) -> named_struct('r', {ranks}, 'n', n, 'i', i))),"
            " x -> x.i)")


def integrity(issues: str = "issues") -> str:
    """Q26: issues that question the data itself, short of errors."""
    return f"filter({issues}, i -> i.code IN {in_list(fixed.INTEGRITY_CODES)} AND i.severity <> 'error')"
