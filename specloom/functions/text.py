"""Text helpers: each returns Spark SQL expression text built from SQL operands.

Operators compose these snippets and hand the result to ``F.expr``; everything
stays a built-in JVM expression.
"""

from __future__ import annotations

from collections.abc import Iterable


def q(value: str | None) -> str:
    """SQL string literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: Iterable[str]) -> str:
    values = list(values)
    if not values:
        return "CAST(array() AS ARRAY<STRING>)"
    return "array(" + ", ".join(q(v) for v in values) + ")"


def in_list(values: Iterable[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def number(value: float | int | None) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else f"{float(value)!r}D"


def let(name: str, value: str, body: str) -> str:
    """Bind ``value`` once and use it in ``body`` (a one-element transform)."""
    return f"transform(array({value}), {name} -> {body})[0]"


def squash(x: str) -> str:
    """Whitespace collapsed and trimmed; null stays null."""
    return f"trim(regexp_replace({x}, '\\\\s+', ' '))"


def folded(x: str) -> str:
    """Lower case without white space of any kind at the ends; the form in which values are compared."""
    return f"lower(regexp_replace({x}, '(?U)^\\\\s+|\\\\s+$', ''))"


def blank_to_null(x: str) -> str:
    return f"nullif({x}, '')"


def slug(x: str) -> str:
    """Lower-case words of letters and digits, one space between."""
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' '))"


def key_slug(x: str) -> str:
    """Lower-case words joined by underscores."""
    return f"replace({slug(x)}, ' ', '_')"


def array_literal(values: Iterable[str], cast: str = "STRING") -> str:
    """A long constant array as one folded expression instead of one node per value."""
    body = f"split({q(chr(31).join(values))}, {q(chr(31))})"
    return body if cast == "STRING" else f"CAST({body} AS ARRAY<{cast}>)"


def lookup(table: dict[str, tuple], fields: dict[str, str], key: str) -> str:
    """Row of a constant table as a struct, or null: one scan of a folded key array.

    Every array folds to a literal at planning time, so a lookup costs a few string
    comparisons per row and the plan stays small.
    """
    columns = {n: array_literal((str(row[i]) for row in table.values()), t)
               for i, (n, t) in enumerate(fields.items())}
    made = ", ".join(f"'{n}', get({c}, CAST(ix - 1 AS INT))" for n, c in columns.items())
    return let("ix", f"array_position({array_literal(table)}, {key})",
               f"CASE WHEN ix > 0 THEN named_struct({made}) END")


def lookup_one(table: dict[str, str], key: str) -> str:
    """Single value of a constant table, or null."""
    return f"try_element_at(map_from_arrays({array_literal(table)}, {array_literal(table.values())}), {key})"


def title_words(x: str) -> str:
    return f"initcap({x})"


def escape_rx(text: str) -> str:
    """A regex that matches ``text`` literally (Java and RE2 alike)."""
    return "".join(c if c.isalnum() or c in " _" or ord(c) > 127 else "\\" + c for c in text)


def group(x: str, rx: str, n: int = 1) -> str:
    """Regex group, null when the pattern does not match."""
    return f"nullif(regexp_extract({x}, {q(rx)}, {n}), '')"


def python_float(d: str) -> str:
    """A double printed the way a float is shown in evidence text: 25.0, 3.728."""
    return (
        f"CASE WHEN {d} IS NULL THEN NULL"
        f" WHEN {d} = floor({d}) AND abs({d}) < 1e16"
        f" THEN concat(CAST(CAST({d} AS DECIMAL(20,0)) AS STRING), '.0')"
        f" WHEN abs({d}) >= 1e-3 AND abs({d}) < 1e7 THEN CAST({d} AS STRING)"
        f" ELSE regexp_replace(CAST(CAST({d} AS DECIMAL(38,16)) AS STRING), '0+$', '') END"
    )


def general(d: str) -> str:
    """``%g``: six significant digits, trailing zeros removed."""
    plain = " ".join(
        f"WHEN {e} THEN regexp_replace(replace(format_number({d}, {5 - e}), ',', ''), '\\\\.?0+$', '')"
        if e < 5 else f"WHEN {e} THEN replace(format_number({d}, 0), ',', '')"
        for e in range(-4, 6)
    )
    exponent = f"CAST(floor(log10(abs({d}))) AS INT)"
    tiny_or_huge = f"abs({d}) >= 999999.5D OR abs({d}) < 1e-4D"
    scientific = (f"concat(regexp_replace(split(format_string('%.5e', {d}), 'e')[0], '\\\\.?0+$', ''),"
                  f" 'e', split(format_string('%.5e', {d}), 'e')[1])")
    return (
        f"CASE WHEN {d} IS NULL THEN NULL"
        f" WHEN {d} = floor({d}) AND abs({d}) < 1e6 THEN CAST(CAST({d} AS BIGINT) AS STRING)"
        f" WHEN abs({d}) >= 1e-3 AND abs({d}) < 1e6 AND length(CAST(abs({d}) AS STRING)) <= 7"
        f" THEN CAST({d} AS STRING)"
        f" WHEN {tiny_or_huge} THEN {scientific} ELSE CASE {exponent} {plain} END END"
    )
