"""Product data in HTML pages (S8-S11).  Input: ``pages(page_id, url, html)``, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions.stage import stage
from ..functions.text import let, q
from .documents import looks_like_spec

_NODE = ("name:string,sku:string,mpn:string,description:string,brand:string,offers:string,additionalProperty:string,"
         + ",".join(p for p in [f"{p}:string" for p, _ in fixed.SCHEMA_MEASURES]) + ",`@type`:string")
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&deg;", "°"), ("&amp;", "&")]


def text_of(x: str) -> str:
    """Readable text of an HTML fragment: tags out, common entities decoded, spaces collapsed."""
    out = f"regexp_replace({x}, '(?s)<[^>]*>', '')"
    for entity, char in _ENTITIES:
        out = f"replace({out}, {q(entity)}, {q(char)})"
    return f"trim(regexp_replace(replace({out}, '\\u00A0', ' '), '\\\\s+', ' '))"


def _json_text(x: str) -> str:
    return f"nullif(trim(regexp_replace(replace({x}, '\\u00A0', ' '), '\\\\s+', ' ')), '')"


def json_ld(pages: DataFrame) -> DataFrame:
    """Schema.org Product nodes -- bare object, list or @graph -- first node wins per field.

    Adds ``ld`` (name, sku, mpn, description, brand, price, currency, specs).
    """
    script = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
    node = f"STRUCT<{_NODE}>"
    parsed = ("flatten(transform(regexp_extract_all(html, " + q(script) + ", 1), j -> "
              + let("g", "get_json_object(j, " + q("$['@graph']") + ")",
                    f"coalesce(from_json(coalesce(g, j), 'ARRAY<{node}>'), array())") + "))")
    product = "lower(n.`@type`) = 'product' OR (startswith(n.`@type`, '[') AND lower(n.`@type`) LIKE '%\"product\"%')"
    nodes = f"filter({parsed}, n -> n IS NOT NULL AND coalesce({product}, false))"
    def first(sql):
        return f"get(filter(transform(nd, n -> {sql}), x -> x IS NOT NULL), 0)"
    brand = "CASE WHEN startswith(n.brand, '{') THEN get_json_object(n.brand, '$.name') ELSE n.brand END"
    def offer(field):
        return (f"CASE WHEN startswith(n.offers, '[') THEN get_json_object(n.offers, '$[0].{field}')"
                f" ELSE get_json_object(n.offers, '$.{field}') END")
    extra = ("transform(coalesce(from_json(n.additionalProperty, 'ARRAY<STRUCT<name:STRING,value:STRING>>'), array()),"
             f" p -> named_struct('key', {_json_text('p.name')}, 'value', {_json_text('p.value')}))")
    def measure(prop, label):
        obj = (f"CASE WHEN startswith(n.`{prop}`, '{{') THEN CASE WHEN coalesce(get_json_object(n.`{prop}`, '$.value'), '') <> ''"
               f" THEN concat_ws(' ', get_json_object(n.`{prop}`, '$.value'), nullif(coalesce(nullif(get_json_object(n.`{prop}`,"
               f" '$.unitText'), ''), get_json_object(n.`{prop}`, '$.unitCode')), '')) END ELSE n.`{prop}` END")
        return f"named_struct('key', {q(label)}, 'value', {_json_text(obj)})"
    measures = "array(" + ", ".join(measure(p, lb) for p, lb in fixed.SCHEMA_MEASURES) + ")"
    specs = first(let("sp", "filter(concat(" + extra + ", " + measures + "), s -> s.key IS NOT NULL AND s.value IS NOT NULL)",
                      "CASE WHEN size(sp) > 0 THEN sp END"))
    body = let("nd", nodes, (
        f"CASE WHEN size(nd) > 0 THEN named_struct('name', {first(_json_text('n.name'))}, 'sku', {first(_json_text('n.sku'))},"
        f" 'mpn', {first(_json_text('n.mpn'))}, 'description', {first(_json_text('n.description'))},"
        f" 'brand', {first(_json_text(brand))}, 'price', {first('try_cast(' + offer('price') + ' AS DOUBLE)')},"
        f" 'currency', {first(_json_text(offer('priceCurrency')))}, 'specs', {specs}) END"))
    return stage(pages, ld=body)


def table_pairs(html: str = "html") -> str:
    """First two cells of every table row."""
    rows = f"regexp_extract_all({html}, '(?is)<tr\\\\b[^>]*>(.*?)</tr>', 1)"
    return (f"transform(filter(transform({rows}, r -> regexp_extract_all(r, '(?is)<t[hd]\\\\b[^>]*>(.*?)</t[hd]>', 1)),"
            f" c -> size(c) >= 2), c -> named_struct('key', {text_of('get(c, 0)')}, 'value', {text_of('get(c, 1)')}, 'how', 'html:table'))")


def definition_pairs(html: str = "html") -> str:
    """Terms zipped with definitions of every definition list."""
    lists = f"regexp_extract_all({html}, '(?is)<dl\\\\b[^>]*>(.*?)</dl>', 1)"
    def parts(tag):
        return f"regexp_extract_all(d, '(?is)<{tag}\\\\b[^>]*>(.*?)</{tag}>', 1)"
    return ("flatten(transform(" + lists + ", d -> " + let("t", parts("dt"), let("v", parts("dd"),
            "transform(slice(t, 1, least(size(t), size(v))), (k, i) -> named_struct('key', " + text_of("k")
            + ", 'value', " + text_of("get(v, i)") + ", 'how', 'html:deflist'))")) + "))")


def bullet_pairs(html: str = "html") -> str:
    """S9: 'Label: value' list items."""
    items = f"regexp_extract_all({html}, '(?is)<li\\\\b[^>]*>(.*?)</li>', 1)"
    rx = q(fixed.LIST_PAIR_RX)
    return (f"transform(filter(transform({items}, i -> {text_of('i')}), t -> t RLIKE {rx}), t -> named_struct("
            f"'key', trim(regexp_extract(t, {rx}, 1)), 'value', trim(regexp_extract(t, {rx}, 2)), 'how', 'html:list'))")


def html_specs(pages: DataFrame) -> DataFrame:
    """Spec pairs of a page, JSON-LD first, then tables, definition lists, bullets."""
    shaped = looks_like_spec("p.key", "p.value", fixed.MAX_WEB_VALUE_CHARS, document=False)
    ld = ("transform(coalesce(ld.specs, array()), s -> named_struct('key', s.key, 'value', s.value, 'how', 'json-ld:Product'))"
          if "ld" in pages.columns else "CAST(array() AS ARRAY<STRUCT<key:STRING,value:STRING,how:STRING>>)")
    read = f"filter(concat({table_pairs()}, {definition_pairs()}, {bullet_pairs()}), p -> {shaped})"
    body = let("al", f"concat({ld}, {read})", let("ks", "transform(al, p -> p.key)",
               "filter(al, (p, i) -> array_position(ks, p.key) = i + 1)"))
    return stage(pages, spec_pairs=body)


def _meta(names: list[str]) -> str:
    found = []
    for n in names:
        key = rf"(?:property|name|itemprop)\s*=\s*[\"']{n}[\"']"
        content = r"content\s*=\s*[\"']([^\"']*)[\"']"
        found.append(f"nullif(regexp_extract(html, {q(rf'(?is)<meta\b[^>]*{key}[^>]*{content}')}, 1), '')")
        found.append(f"nullif(regexp_extract(html, {q(rf'(?is)<meta\b[^>]*{content}[^>]*{key}')}, 1), '')")
    return f"coalesce({', '.join(found)})"


def page_text(pages: DataFrame) -> DataFrame:
    """Name, description and readable text of a page.

    The heading is read after scripts, navigation, headers and the like are gone.  The text is whole, whatever its length.
    """
    shown = "html"
    for tag in fixed.SKIPPED_TAGS:
        shown = f"regexp_replace({shown}, '(?is)<{tag}\\\\b[^>]*>.*?</{tag}>', ' ')"
    pages = stage(pages, _shown=f"regexp_replace({shown}, '(?s)<!--.*?-->', ' ')")
    body = "regexp_replace(_shown, '(?s)<[^>]*>', ' ')"
    ld = "ld" in pages.columns
    heading = f"nullif({text_of(f'regexp_extract(_shown, {q(r'(?is)<h[12]\b[^>]*>(.*?)</h[12]>')}, 1)')}, '')"
    name = f"coalesce({'ld.name, ' if ld else ''}{_meta(['og:title', 'twitter:title'])}, {heading})"
    description = f"coalesce({'ld.description, ' if ld else ''}{_meta(['og:description', 'description'])})"
    return stage(pages, page_name=name, page_description=description,
                 page_text=f"nullif({text_of(body)}, '')").drop("_shown")


def to_products(pages: DataFrame) -> DataFrame:
    """S8-S10 together: one product per page, every spec citing the page."""
    df = page_text(html_specs(json_ld(pages)))
    null = F.lit(None).cast("string")
    return df.select(
        F.col("page_id").alias("id"), F.col("ld.sku").alias("sku"), F.col("ld.mpn").alias("mpn"),
        F.expr(f"coalesce(ld.brand, {_meta(['product:brand', 'brand'])})").alias("brand"),
        F.col("page_name").alias("name"), F.col("page_description").alias("description"), null.alias("category_hint"),
        F.col("ld.price").alias("price"), F.col("ld.currency").alias("currency"), F.col("url").alias("source_url"),
        F.col("url").alias("source_document"), F.col("page_text").alias("free_text"),
        F.expr("transform(spec_pairs, p -> named_struct('key', p.key, 'value', p.value, 'locator', url))").alias("specs"))


def page_report(pages: DataFrame) -> DataFrame:
    """Pairs, tables, characters and strategies of every page."""
    df = page_text(html_specs(json_ld(pages)))
    tables = "size(regexp_extract_all(html, '(?is)<table\\\\b', 0))"
    return df.select("page_id", F.size("spec_pairs").alias("spec_pairs"), F.expr(tables).alias("tables"),
                     F.expr("coalesce(length(page_text), 0)").alias("text_chars"),
                     F.expr("array_join(array_distinct(transform(spec_pairs, p -> p.how)), ',')").alias("strategies"),
                     F.expr("CASE WHEN size(spec_pairs) = 0 THEN 'No spec table found on the page; the readable text was"
                            " passed through for pattern extraction instead.' ELSE '' END").alias("note"))
