"""Written content: storefront copy (T1-T4) and the fitted formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions import style
from ..functions.stage import stage
from ..functions.text import in_list, let, q, squash
from .records import shown

_CLOSING = " intended for industrial service where consistent, documented performance matters."


def _unique(words: str) -> str:
    """First-seen words, compared without case, blanks dropped."""
    return let("uw", f"filter({words}, w -> w IS NOT NULL AND w <> '')", let(
        "ul", "transform(uw, w -> lower(w))",
        "filter(uw, (w, i) -> array_position(ul, lower(w)) = i + 1)"))


def copywrite(df: DataFrame) -> DataFrame:
    """Title, descriptions, bullets, keywords and search terms from backed values.

    Adds ``content``.
    """
    trusted = ("transform(array_sort(transform(filter(attributes, a -> a.prov <> 'defaulted'"
               " AND coalesce(a.val, '') <> ''), (a, i) -> named_struct('o', -a.conf, 'i', i, 'a', a))),"
               " t -> named_struct('key', t.a.key, 'grp', t.a.grp, 'label', t.a.label, 'shown', "
               + shown("t.a") + "))")
    lead = "trim(concat_ws(' ', nullif(brand_, ''), nullif(mpn_, '')))"
    headline = ("array_join(transform(slice(filter(tr, t -> array_contains(schema.required, t.key)"
                " AND t.key NOT IN ('brand', 'mpn')), 1, 2), t -> t.shown), ', ')")
    title = let("hd", headline, (
        f"left(concat(trim(concat({lead}, ' ', noun)), IF(hd <> '', concat(' — ', hd), '')), 150)"))
    clause = "array_join(transform(slice(tr, 1, 5), t -> concat(lower(t.label), ' ', t.shown)), '; ')"
    short = let("cl", clause, let("s0", (
        "trim(concat(IF(brand_ <> '', concat(brand_, ' '), ''), IF(mpn_ <> '', concat(mpn_, ' '), ''),"
        " lower(noun), IF(cl <> '', concat(' with ', cl), ''), '.'))"),
        "left(concat(upper(left(s0, 1)), substring(s0, 2)), 300)"))
    groups = ("transform(slice(array_distinct(transform(tr, t -> t.grp)), 1, 4), g -> concat(g, ': ',"
              " array_join(transform(slice(filter(tr, t -> t.grp = g), 1, 5),"
              " t -> concat(lower(t.label), ' ', t.shown)), ', '), '.'))")
    long = ("left(array_join(concat(array(concat('The ', IF(" + lead + " <> '', " + lead + ", noun), ' is a ',"
            f" lower(noun), {q(_CLOSING)})), {groups},"
            " IF(coalesce(description, '') <> '', array(trim(description)), array())), ' '), 1800)")
    bullets = ("concat(transform(slice(tr, 1, 6), t -> concat(t.label, ' ', t.shown)),"
               " IF(brand_ <> '', array(concat('Genuine ', brand_, ' part',"
               " IF(mpn_ <> '', concat(', MPN ', mpn_), ''))), array()))")
    keywords = _unique(
        "concat(IF(mpn_ <> '', array(mpn_, trim(concat(brand_, ' ', mpn_))), array()),"
        " IF(brand_ <> '', array(trim(concat(brand_, ' ', lower(noun)))), array()), array(lower(noun)),"
        " transform(slice(tr, 1, 4), t -> lower(trim(concat(t.shown, ' ', lower(noun))))))")
    terms = _unique(
        "concat(IF(mpn_ <> '', array(mpn_, replace(mpn_, '-', ''), replace(mpn_, '-', ' ')), array()),"
        " IF(brand_ <> '' AND mpn_ <> '', array(concat(brand_, ' ', mpn_)), array()), array(lower(noun)))")
    body = let("tr", trusted, let(
        "brand_", "coalesce(nullif(identity.brand, ''), brand, '')", let(
            "mpn_", "coalesce(nullif(identity.mpn, ''), mpn, '')", let(
                "noun", "coalesce(nullif(schema.noun, ''), 'Industrial Product')", let(
                    "ti", title, let("sh", short,
                        f"named_struct('title', ti, 'short_description', sh, 'long_description', {long},"
                        f" 'bullets', {bullets}, 'meta_description', left(coalesce(nullif(sh, ''), ti), 158),"
                        f" 'keywords', slice({keywords}, 1, 12), 'search_terms', {terms})"))))))
    return stage(df, content=body)


def repair_list(column: str) -> str:
    """T4: letters rejoined into the word they came from, leaked markup dropped."""
    return (f"CASE WHEN size({column}) > 2 AND forall({column}, i -> length(i) = 1)"
            f" THEN filter(array(trim(array_join({column}, ''))), i -> i <> '')"
            f" ELSE filter({column}, i -> NOT contains(i, '<parameter') AND NOT contains(i, '</')) END")


def repair_text(column: str) -> str:
    """T4: a bare string where a list belongs becomes a one-element list."""
    return f"IF(trim({column}) <> '', array({column}), CAST(array() AS ARRAY<STRING>))"


# ------------------------------------------------------------------ formats

_PIECE = ("STRUCT<ord:INT,key:STRING,label:STRING,text:STRING,priority:INT,required:BOOLEAN,"
          "tail:BOOLEAN,space:BOOLEAN,bare:STRING,refusal:STRING,n:INT>")


def _variant(spec: dict) -> tuple[bool, bool, str]:
    return bool(spec.get("compact")), bool(spec.get("abbreviate")), spec.get("label_style", "space")


def render_attribute(a: str, compact: bool, abbreviate: bool, label_style: str) -> str:
    """struct(t, b, r): labelled text, bare text, refusal of one attribute."""
    plain = style.abbreviated(f"trim({a}.val)") if abbreviate else f"trim({a}.val)"
    number = f"{a}.kind IN ('int', 'float')"
    written = (f"CASE WHEN coalesce({a}.unit, '') <> '' THEN {style.measurement(a + '.val', a + '.num', a + '.unit', compact)}"
               f" WHEN {number} THEN {style.trimmed_number(a + '.num')} ELSE {plain} END")
    refusal = (f"CASE WHEN wr IS NULL THEN concat({a}.label, ': unit \\'', {a}.unit, '\\' is not in the"
               " approved UOM list, so the value was left out of the copy rather than written in a"
               " non-standard form.') END")
    text = "wr"
    if not compact:
        styled = (f"WHEN {number} THEN concat(wr, '-', {style.label_singular('lb')}) "
                  if label_style == "hyphen_singular" else "")
        text = ("CASE WHEN wr IS NULL THEN NULL WHEN " + style.wants_label(f"{a}.key", f"{a}.label", f"{a}.unit")
                + " THEN " + let("lb", style.display_label(f"{a}.label"), (
                    f"CASE WHEN lower({a}.key) IN {in_list(fixed.PREFIX_LABEL_ATTRIBUTES)}"
                    f" THEN concat(lb, ': ', wr) {styled}ELSE concat(wr, ' ', lb) END")) + " ELSE wr END")
    return (f"CASE WHEN coalesce({a}.val, '') = '' THEN NULL ELSE "
            + let("wr", written, f"named_struct('t', {text}, 'b', wr, 'r', {refusal})") + " END")


def _views(variants: list[tuple[bool, bool, str]]) -> str:
    """Every attribute written once per variant the formats ask for."""
    made = ", ".join(f"'c{i}', {render_attribute('a', *v)}" for i, v in enumerate(variants))
    return f"transform(attributes, a -> named_struct('key', a.key, 'label', a.label, 'prov', a.prov, {made}))"


def _piece(key: str, label: str, text: str, bare: str, refusal: str, token: dict) -> str:
    if token.get("single"):
        text = f"IF(contains({text}, ','), NULL, {text})"
    if token.get("prefix"):
        text = f"IF({text} <> '', concat({q(token['prefix'] + ' ')}, {text}), {text})"
    flags = {k: str(bool(token.get(k))).lower() for k in ("required", "tail", "space")}
    return (f"named_struct('ord', 0, 'key', {key}, 'label', {label}, 'text', nullif({text}, ''),"
            f" 'priority', {token['priority']}, 'required', {flags['required']}, 'tail', {flags['tail']},"
            f" 'space', {flags['space']}, 'bare', {bare}, 'refusal', {refusal}, 'n', 0)")


def pieces(spec: dict, variant: int) -> str:
    """Tokens of a format that resolved to text, in token order.

    Reads ``vis`` (attribute views the format may use), ``brand_``, ``maker_``, ``mpn_``
    and ``type_``.
    """
    named = [t["source"][5:] for t in spec["tokens"]
             if t["source"].startswith("attr:") and t["source"] != "attr:*"]
    parts = []
    for token in spec["tokens"]:
        source = token["source"]
        if source.startswith("attr:"):
            chosen = (f"filter(vis, x -> x.key NOT IN {in_list(named)})" if source == "attr:*" and named
                      else "vis" if source == "attr:*" else f"filter(vis, x -> x.key = {q(source[5:])})")
            c = f"a.c{variant}"
            one = _piece("a.key", "a.label", f"{c}.{'t' if token.get('with_label') else 'b'}", f"{c}.b", f"{c}.r", token)
            parts.append(f"transform({chosen}, a -> {one})")
        else:
            value = {"brand": "brand_", "manufacturer": "maker_", "mpn": "mpn_", "item_type": "type_"}[source]
            if token.get("strip"):
                value = f"trim(regexp_replace({value}, '[®™©]', ''))"
            if spec.get("abbreviate"):
                value = style.abbreviated(value)
            label = source.replace("_", " ").title()
            parts.append("array(" + let("fx", f"trim({value})", _piece(
                q(source), q(label), "fx", "fx", "CAST(NULL AS STRING)", token)) + ")")
    return f"concat({', '.join(parts)})"


def _drop_repeats(ps: str) -> str:
    """An identity name is said once; two specifications may share a value."""
    identity = "p.key IN ('brand', 'manufacturer', 'mpn', 'item_type')"
    ordered = (f"array_sort(transform({ps}, p -> named_struct('nr', NOT p.required, 'pr', p.priority,"
               " 'o', p.ord, 'sig', regexp_replace(trim(lower(p.bare)), '\\\\s+', ' '),"
               f" 'idn', {identity}, 'p', p)))")
    repeated = ("exists(acc, e -> (e.sig = t.sig AND (t.idn OR e.idn)) OR (t.idn AND e.idn"
                " AND (contains(e.sig, t.sig) OR contains(t.sig, e.sig))))")
    kept = (f"aggregate({ordered}, CAST(array() AS ARRAY<STRUCT<sig:STRING,idn:BOOLEAN,p:{_PIECE}>>),"
            f" (acc, t) -> IF({repeated}, acc, concat(acc, array(named_struct('sig', t.sig, 'idn', t.idn, 'p', t.p)))))")
    return f"array_sort(transform({kept}, k -> k.p))"


def _assemble(ps: str, spec: dict) -> str:
    """Head joined by the separator, tail appended after it."""
    sep, tail_sep = q(spec["separator"]), q(spec.get("tail_separator", spec["separator"]))
    return let("so", f"array_sort({ps})", let(
        "hd", f"array_join(transform(filter(so, p -> NOT p.tail), (p, i) -> IF(i = 0, p.text,"
              f" concat(IF(p.space, ' ', {sep}), p.text))), '')", let(
            "tl", f"array_join(transform(filter(so, p -> p.tail), p -> p.text), {tail_sep})",
            squash(f"concat(hd, IF(hd <> '' AND tl <> '', {tail_sep}, ''), tl)"))))


def _written(ps: str, spec: dict) -> str:
    return style.cased(_assemble(ps, spec), spec["case"])


def _clip(text: str, limit: int) -> str:
    """Cut on a word boundary, never inside a word."""
    return (f"CASE WHEN length({text}) <= {limit} THEN {text}"
            f" WHEN contains(left({text}, {limit}), ' ') AND NOT substring({text}, {limit + 1}, 1) RLIKE '\\\\s'"
            f" THEN trim(regexp_extract(left({text}, {limit}), '(?s)^(.*) [^ ]*$', 1))"
            f" ELSE trim(left({text}, {limit})) END")


def _visible(spec: dict) -> str:
    excluded, skipped = spec.get("exclude_provenance", []), spec.get("exclude_keys", [])
    tests = ([f"a.prov NOT IN {in_list(excluded)}"] if excluded else []) + (
        [f"lower(a.key) NOT IN {in_list(skipped)}"] if skipped else [])
    return f"filter(_v, a -> {' AND '.join(tests)})" if tests else "_v"


def _numbered(raw: str, spec: dict) -> str:
    """Pieces with text, numbered in order, each with its length as it will be written."""
    written = style.cased(squash("p.text"), spec["case"])
    return (f"transform(filter({raw}, p -> p.text IS NOT NULL), (p, i) -> named_struct('ord', i, 'key', p.key,"
            " 'label', p.label, 'text', p.text, 'priority', p.priority, 'required', p.required,"
            f" 'tail', p.tail, 'space', p.space, 'bare', p.bare, 'refusal', p.refusal, 'n', length({written})))")


def _fit(ps: str, spec: dict) -> str:
    """Grow from the required tokens by priority; whole tokens are dropped, never characters.

    Casing and joining work word by word, so the length of a line is the sum of its
    pieces and separators; the line itself is only written once, at the end.
    """
    lo, hi = spec.get("min"), spec.get("max")
    sep, tail_sep = len(spec["separator"]), len(spec.get("tail_separator", spec["separator"]))

    def grown(z, p):
        """Running length facts after adding piece ``p`` to facts ``z``."""
        gap = f"IF({p}.space, 1, {sep})"
        first = f"(NOT {p}.tail AND {p}.ord < {z}.first)"
        return (f"named_struct('n', {z}.n + {p}.n, 'gaps', {z}.gaps + IF({p}.tail, 0, {gap}),"
                f" 'first', IF({first}, {p}.ord, {z}.first), 'lead', IF({first}, {gap}, {z}.lead),"
                f" 'tails', {z}.tails + IF({p}.tail, 1, 0), 'all', {z}.all + 1)")

    def size(z):
        heads = f"({z}.all - {z}.tails)"
        return (f"({z}.n + {z}.gaps - {z}.lead + greatest({z}.tails - 1, 0) * {tail_sep}"
                f" + IF({heads} > 0 AND {z}.tails > 0, {tail_sep}, 0))")
    nothing = "named_struct('n', 0, 'gaps', 0, 'first', 1000000, 'lead', 0, 'tails', 0, 'all', 0)"
    enough = f"{size('acc.z')} >= {lo}" if lo else "false"
    over = f"{size('nz')} > {hi}" if hi else "false"
    step = ("CASE WHEN acc.done THEN acc"
            f" WHEN {enough} THEN named_struct('kept', acc.kept, 'dropped', acc.dropped, 'done', true, 'z', acc.z) ELSE "
            + let("nz", grown("acc.z", "t.p"), (
                f"IF({over}, named_struct('kept', acc.kept, 'dropped', concat(acc.dropped, array(t.p.label)), 'done', false, 'z', acc.z),"
                " named_struct('kept', concat(acc.kept, array(t.p)), 'dropped', acc.dropped, 'done', false, 'z', nz))")) + " END")
    return (f"aggregate(array_sort(transform(filter({ps}, p -> NOT p.required), p -> named_struct("
            f"'pr', p.priority, 'o', p.ord, 'p', p))), named_struct('kept', filter({ps}, p -> p.required),"
            " 'dropped', CAST(array() AS ARRAY<STRING>), 'done', false, 'z',"
            f" aggregate(filter({ps}, p -> p.required), {nothing}, (z, p) -> {grown('z', 'p')})), (acc, t) -> {step})")


def _verdict(spec: dict, raw: str, ps: str, ft: str, full: str) -> str:
    """Text, length window, compliance and notes of one format."""
    lo, hi = spec.get("min"), spec.get("max")
    required = [t["source"] for t in spec["tokens"] if t.get("required")]
    too_long = f"length({full}) > {hi}" if hi else "false"
    text = f"IF({too_long}, {_clip(full, hi)}, {full})" if hi else full
    too_short = f"length(tx) < {lo}" if lo else "false"
    empty = f"tx = '' AND NOT exists({ps}, p -> p.required)" if required else "false"
    notes = ["rf"]
    if hi:
        notes.append(f"IF({too_long}, array({q(f'Required tokens alone exceed the {hi}-character limit; the field was clipped and needs a human-authored short form.')}), array())")
    if lo:
        notes.append(f"IF({too_short}, array(concat('Field is ', length(tx), ' characters, below the {lo}-character"
                     " minimum. No further backed values were available to extend it.')), array())")
    if required:
        notes.append(f"IF({empty}, array({q('Field is empty: none of its required inputs (' + ', '.join(required) + ') could be resolved, so there is nothing to write.')}), array())")
    notes.append(f"IF(size({ft}.dropped) > 0, array(concat('Dropped to fit the {hi}-character limit: ',"
                 f" array_join({ft}.dropped, ', '), '.')), array())")
    return let("rf", f"filter(transform({raw}, p -> p.refusal), r -> r IS NOT NULL)", let(
        "tx", text,
        f"named_struct('id', {q(spec['id'])}, 'label', {q(spec['label'])}, 'text', tx, 'length', length(tx),"
        f" 'min_length', CAST({lo or 'NULL'} AS INT), 'max_length', CAST({hi or 'NULL'} AS INT),"
        f" 'compliant', NOT ({too_long}) AND NOT ({too_short}) AND NOT ({empty}) AND size(rf) = 0,"
        f" 'dropped', {ft}.dropped, 'notes', concat({', '.join(notes)}))"))


def compliance(df: DataFrame, formats: list[dict] | None = None) -> DataFrame:
    """Every format rendered; adds ``fields`` and ``compliance``.

    Formats advance together, one step per stage, which keeps each expression shallow.
    """
    formats = formats or fixed.FORMATS
    leaf = style.singular("schema.leaf")
    ids = [s["id"] for s in formats]
    df = stage(df, brand_="coalesce(nullif(identity.brand, ''), brand, '')",
               maker_="coalesce(identity.manufacturer, '')",
               mpn_="coalesce(nullif(identity.mpn, ''), mpn, '')",
               type_=f"coalesce(nullif(schema.noun, ''), {leaf}, '')")
    variants = list(dict.fromkeys(_variant(s) for s in formats))
    df = stage(df, _v=_views(variants))
    df = stage(df, **{f"_r_{s['id']}": let("vis", _visible(s), pieces(s, variants.index(_variant(s)))) for s in formats})
    df = stage(df, **{f"_p_{s['id']}": _drop_repeats(_numbered(f"_r_{s['id']}", s)) for s in formats})
    df = stage(df, **{f"_t_{s['id']}": _fit(f"_p_{s['id']}", s) for s in formats})
    df = stage(df, **{f"_u_{s['id']}": _written(f"_t_{s['id']}.kept", s) for s in formats})
    df = stage(df, fields="array(" + ", ".join(
        _verdict(s, f"_r_{s['id']}", f"_p_{s['id']}", f"_t_{s['id']}", f"_u_{s['id']}") for s in formats) + ")")
    df = df.drop("_v", "brand_", "maker_", "mpn_", "type_", *[f"_{x}_{i}" for x in "rptu" for i in ids])
    listed = " AND coalesce(size(lov_issues), 0) <= 0" if "lov_issues" in df.columns else ""
    return df.withColumn("compliance", F.expr(
        f"named_struct('compliant', forall(fields, f -> f.compliant){listed},"
        " 'breaches', transform(filter(fields, f -> NOT f.compliant), f -> f.label))"))
