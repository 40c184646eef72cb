"""House style: how a value may be written (T5-T11).  SQL text in, SQL text out."""

from __future__ import annotations

from .. import fixed
from .text import in_list, let, lookup, lookup_one, q


def uom_rows() -> list[tuple[str, str, str]]:
    """T5: spelling, measurement, approved abbreviation; first registration wins."""
    table: dict[str, tuple[str, str]] = {}
    for measurement, abbreviation, accepts in fixed.UOM:
        for spelling in [abbreviation, *accepts]:
            table.setdefault(" ".join(spelling.strip().lower().split()), (measurement, abbreviation))
    return [(s, m, a) for s, (m, a) in table.items()]


_UOM = {s: (m, a) for s, m, a in uom_rows()}


def approved_unit(unit: str) -> str:
    """T5: struct(m, abbr) of the approved unit, or null."""
    return lookup(_UOM, {"m": "STRING", "abbr": "STRING"}, f"regexp_replace(lower(trim({unit})), '\\\\s+', ' ')")


def abbreviated(text: str) -> str:
    return f"coalesce({lookup_one(fixed.ABBREVIATIONS, f'lower({text})')}, {text})"


def to_fraction(value: str) -> str:
    """Trade fraction when the value lies exactly on a 64th, else null."""
    divisor = ("CASE " + " ".join(f"WHEN fr % {d} = 0 THEN {d}" for d in (32, 16, 8, 4, 2)) + " ELSE 1 END")
    return let("fv", f"abs({value})", let("fn", "CAST(round(fv * 64D) AS BIGINT)", (
        "CASE WHEN fv IS NULL OR abs(fv * 64D - fn) > 1e-9D THEN NULL ELSE concat("
        f"IF({value} < 0, '-', ''), "
        + let("fw", "fn div 64", let("fr", "fn % 64", let("fd", divisor, (
            "CASE WHEN fr = 0 THEN CAST(fw AS STRING) ELSE concat("
            "IF(fw > 0, concat(fw, '-'), ''), CAST(fr div fd AS STRING), '/', CAST(64 div fd AS STRING)) END"))))
        + ") END")))


def from_fraction(text: str) -> str:
    """T7: '50-1/4' as a number; null when the text is not a fraction."""
    def part(n):
        return f"try_cast(nullif(regexp_extract({text}, {q(fixed.FRACTION_ONLY_RX)}, {n}), '') AS DOUBLE)"
    return f"coalesce({part(1)}, 0D) + try_divide({part(2)}, {part(3)})"


def trimmed_number(value: str) -> str:
    """Whole numbers bare, others with up to six decimals and no trailing zeros."""
    return (f"CASE WHEN {value} = floor({value}) THEN CAST(CAST({value} AS DECIMAL(30,0)) AS STRING)"
            f" ELSE regexp_replace(regexp_replace(format_string('%.6f', {value}), '0+$', ''), '\\\\.$', '') END")


def as_number(text: str, num: str) -> str:
    """Number behind a value: its own number, else a fraction, else plain digits."""
    return f"coalesce({num}, {from_fraction(text)}, try_cast(replace(trim({text}), ',', '') AS DOUBLE))"


def measurement(val: str, num: str, unit: str, compact: bool) -> str:
    """Number, space, approved unit; null when the unit is not approved."""
    tail = "upper(ru.abbr)" if compact else "concat(' ', ru.abbr)"
    return let("ru", approved_unit(unit), let("mv", as_number(val, num), (
        f"CASE WHEN ru IS NULL THEN NULL WHEN mv IS NULL THEN concat(trim({val}), ' ', ru.abbr)"
        f" ELSE concat(coalesce(CASE WHEN ru.abbr = 'in' THEN {to_fraction('mv')} END,"
        f" {trimmed_number('mv')}), {tail}) END")))


def value_only(val: str, num: str, unit: str) -> str:
    """The number as written, its unit left to a column of its own; never refuses."""
    return let("ru", approved_unit(unit), let("mv", as_number(val, num), (
        f"CASE WHEN {val} IS NULL THEN '' WHEN mv IS NULL THEN trim({val})"
        f" ELSE coalesce(CASE WHEN ru.abbr = 'in' THEN {to_fraction('mv')} END, {trimmed_number('mv')}) END")))


def title_case(text: str) -> str:
    """Capitalise lower-case words; leave acronyms, units, codes and cased words alone."""
    word = let("st", "trim(BOTH '.,;:()[]' FROM w)", let("au", approved_unit("st"), (
        f"CASE WHEN lower(st) IN {in_list(fixed.ALWAYS_UPPER)} THEN replace(w, st, upper(st))"
        " WHEN au IS NOT NULL THEN replace(w, st, au.abbr)"
        " WHEN st RLIKE '[0-9\\\\p{Lu}]' THEN w"
        " ELSE concat(upper(substring(w, 1, 1)), lower(substring(w, 2))) END")))
    return (f"array_join(transform(filter(split({text}, '\\\\s+'), w -> w <> ''), w -> {word}), ' ')")


def upper_case(text: str) -> str:
    return f"upper(regexp_replace({text}, '[®™©]', ''))"


def cased(text: str, case: str) -> str:
    return {"upper": upper_case, "title": title_case}.get(case, lambda t: t)(text)


def singular(word: str) -> str:
    """Last plural ending removed."""
    return (f"CASE WHEN {word} LIKE '%ies' THEN concat(left({word}, length({word}) - 3), 'y')"
            f" WHEN {word} RLIKE '(sses|shes|ches|xes|zes)$' THEN left({word}, length({word}) - 2)"
            f" WHEN {word} LIKE '%s' AND {word} NOT LIKE '%ss' THEN left({word}, length({word}) - 1)"
            f" ELSE {word} END")


def label_singular(label: str) -> str:
    return let("lw", f"filter(split({label}, '\\\\s+'), w -> w <> '')", (
        f"CASE WHEN size(lw) = 0 THEN {label} ELSE array_join(concat(slice(lw, 1, size(lw) - 1),"
        f" array({let('lz', 'element_at(lw, -1)', singular('lz'))})), ' ') END"))


def display_label(label: str) -> str:
    """Counting prefix and type suffix belong to the spec table, not the sentence."""
    out = f"trim({label})"
    for prefix in fixed.LABEL_PREFIXES_TO_DROP:
        out = let("dl", out, f"IF(startswith(lower(dl), {q(prefix.lower())}), substring(dl, {len(prefix) + 1}), dl)")
    for suffix in fixed.LABEL_SUFFIXES_TO_DROP:
        out = let("dl", out, f"IF(endswith(lower(dl), {q(suffix.lower())}), left(dl, length(dl) - {len(suffix)}), dl)")
    return f"trim({out})"


def wants_label(key: str, label: str, unit: str) -> str:
    """Whether the label adds anything the value has not said already."""
    terminal = in_list(fixed.TERMINAL_ATTRIBUTES)
    return let("wl", f"lower(trim(coalesce({label}, '')))", let("wu", approved_unit(unit), (
        f"wl <> '' AND lower({key}) NOT IN {terminal} AND wl NOT IN {terminal}"
        f" AND coalesce(wu.abbr NOT IN {in_list(fixed.SELF_DESCRIBING_UNITS)}, true)"
        " AND coalesce(lower(trim(wu.m)) <> wl, true)")))
