"""Shape of an attribute inside a record, and the expressions that build one."""

from __future__ import annotations

from .. import fixed
from ..functions import units
from ..functions.text import let, python_float, q

ATTRIBUTE_DDL = (
    "key:string,label:string,val:string,num:double,kind:string,unit:string,"
    "norm:double,norm_unit:string,prov:string,rank:int,conf:double,evidence:string,"
    "method:string,grp:string,source_url:string,locator:string"
)
NO_ATTRIBUTES = f"CAST(array() AS ARRAY<STRUCT<{ATTRIBUTE_DDL}>>)"
NULL = "CAST(NULL AS STRING)"

RANKS = "map(" + ", ".join(f"{q(p)}, {r}" for p, r in fixed.PROVENANCE_RANK.items()) + ")"


def attribute(*, key: str, label: str, val: str, num: str, kind: str, unit: str, prov: str,
              conf: str, evidence: str, method: str, grp: str, source_url: str = NULL,
              locator: str = NULL) -> str:
    """Attribute struct with its canonical value filled in (all operands are SQL)."""
    return let(
        "an", f"CASE WHEN {kind} IN ('int', 'float') AND {unit} IS NOT NULL AND {unit} <> ''"
              f" THEN {units.normalize(num, unit)} END",
        f"named_struct('key', {key}, 'label', {label}, 'val', {val}, 'num', {num},"
        f" 'kind', {kind}, 'unit', {unit}, 'norm', an.value, 'norm_unit', an.unit,"
        f" 'prov', {prov}, 'rank', {RANKS}[{prov}], 'conf', {conf}, 'evidence', {evidence},"
        f" 'method', {method}, 'grp', {grp}, 'source_url', {source_url},"
        f" 'locator', {locator})")


def rebuilt(a: str, **changes: str) -> str:
    """Attribute struct ``a`` with some fields replaced."""
    return "named_struct(" + ", ".join(
        f"'{f}', {changes.get(f, f'{a}.{f}')}" for f in (x.split(":")[0] for x in ATTRIBUTE_DDL.split(","))) + ")"


def shown(a: str) -> str:
    """Value and unit of an attribute as written in evidence text."""
    return units.display(f"{a}.val", f"{a}.num", f"{a}.kind", f"{a}.unit")


def same_text(a: str, b: str) -> str:
    return f"(lower(trim({a}.val)) <=> lower(trim({b}.val)))"


def coerced(val: str, num: str, kind: str, unit: str, note: str) -> str:
    return (f"named_struct('val', {val}, 'num', {num}, 'kind', {kind}, 'unit', {unit},"
            f" 'note', {note})")


def coerce_number(value: str, unit: str) -> str:
    """Number in the schema's unit, or text with the reason it is not one."""
    none = "CAST(NULL AS DOUBLE)"
    dims = (f"concat('rejected: \\'', pq.unit, '\\' measures ',"
            f" coalesce({units.dimension('pq.unit')}, 'None'), ', not ',"
            f" coalesce({units.dimension(unit)}, 'None'))")
    plain = coerced(python_float("pq.num"), "pq.num", "'float'", f"coalesce(pq.unit, {unit})", "''")
    converted = let("tv", units.tidy("cv"), coerced(
        f"CASE WHEN tv = floor(tv) THEN CAST(CAST(tv AS BIGINT) AS STRING) ELSE {python_float('tv')} END",
        "tv", "IF(tv = floor(tv), 'int', 'float')", unit,
        f"concat('converted ', {units.display(NULL, 'pq.num', chr(39) + 'float' + chr(39), 'pq.unit')},"
        f" ' to ', {unit})"))
    return let("pq", units.measure(value, unit), (
        f"CASE WHEN pq IS NULL THEN "
        + coerced(value, none, "'text'", NULL, "'kept as text; no numeric value found'")
        + f" WHEN pq.unit IS NOT NULL AND {unit} IS NOT NULL AND lower(pq.unit) <> lower({unit}) THEN "
        + let("cv", units.convert("pq.num", "pq.unit", unit), (
            f"CASE WHEN cv IS NOT NULL THEN {converted}"
            f" WHEN NOT ({units.dimension('pq.unit')} <=> {units.dimension(unit)}) THEN "
            + coerced(value, none, "'text'", NULL, dims) + f" ELSE {plain} END"))
        + f" ELSE {plain} END"))


def coerce_boolean(value: str) -> str:
    """E5: yes/no word lists; any other non-empty text counts as true."""
    from ..functions.text import in_list
    return coerced(
        f"CASE WHEN lower(trim({value})) IN {in_list(fixed.TRUE_WORDS)} THEN 'True'"
        f" WHEN lower(trim({value})) IN {in_list(fixed.FALSE_WORDS)} THEN 'False'"
        f" WHEN {value} <> '' THEN 'True' ELSE 'False' END",
        "CAST(NULL AS DOUBLE)", "'bool'", NULL, "''")


def exact_option(text: str, options: str) -> str:
    """E6 tiers one and two: member equal to the text, or to it before '('."""
    short = "trim(split(o, '\\\\(')[0])"
    return (f"get(filter({options}, o -> lower(o) = lower({text})"
            f" OR ({short} <> '' AND lower({short}) = lower({text}))), 0)")


def coerce_enum(value: str, options: str, fuzzy: str) -> str:
    """Vocabulary member, or the text with an outside-vocabulary note."""
    none = "CAST(NULL AS DOUBLE)"
    return let("et", f"trim({value})", let("eo", exact_option("et", options), let("ef", fuzzy, (
        "CASE WHEN eo IS NOT NULL THEN "
        + coerced("eo", none, "'text'", NULL,
                  "CASE WHEN lower(eo) = lower(et) THEN '' ELSE"
                  " concat('expanded \\'', et, '\\' to the full \\'', eo, '\\' value') END")
        + f" WHEN ef.option IS NOT NULL AND ef.score >= {fixed.ENUM_THRESHOLD}D THEN "
        + coerced("ef.option", none, "'text'", NULL,
                  "CASE WHEN ef.score > 0.95D THEN '' ELSE"
                  " concat('mapped \\'', et, '\\' onto the \\'', ef.option, '\\' enum value') END")
        + " ELSE " + coerced("et", none, "'text'", NULL,
                             "'value is outside the controlled vocabulary'") + " END"))))


def coerce(value: str, a: str, fuzzy: str) -> str:
    """E4-E6 by the attribute's declared type."""
    return (f"CASE {a}.type WHEN 'number' THEN {coerce_number(value, a + '.unit')}"
            f" WHEN 'boolean' THEN {coerce_boolean(value)}"
            f" WHEN 'enum' THEN {coerce_enum(value, a + '.options', fuzzy)}"
            f" ELSE {coerced('trim(' + value + ')', 'CAST(NULL AS DOUBLE)', chr(39) + 'text' + chr(39), NULL, chr(39) * 2)} END")
