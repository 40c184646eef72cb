"""Render records into customer schemas described as data."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import style
from ..functions.text import q
from ..plans.taxonomy import CUSTOMER_NAMES

_INPUT = ["sku", "mpn", "brand", "name", "description", "category_hint", "price", "currency",
          "source_url", "source_document", "free_text"]
_ATTRIBUTE_FIELDS = {"provenance": "prov", "confidence": "conf", "value": "val", "unit": "unit", "label": "label",
                     "key": "key", "source_url": "source_url", "source_locator": "locator", "evidence": "evidence",
                     "method": "method", "group": "grp", "normalized_value": "norm", "normalized_unit": "norm_unit"}

# Built-in output profiles
_ATTR_BLOCK = [("", "attr:{key}"), (".provenance", "attr:{key}.provenance"),
               (".confidence", "attr:{key}.confidence"), (".source_url", "attr:{key}.source_url")]
_BASE = [("sku", "input.sku"), ("mpn", "identity.mpn"), ("brand", "identity.brand"),
         ("category_code", "category.code"), ("category_path", "category.path"), ("title", "content.title"),
         ("short_description", "content.short_description"), ("long_description", "content.long_description"),
         ("bullets", "content.bullets"), ("keywords", "content.keywords"), ("readiness", "readiness.overall"),
         ("verdict", "readiness.verdict"), ("errors", "issues.errors"), ("warnings", "issues.warnings")]
_DELIVERY_MAPPED = {
    "Ref URL 1": "input.source_url", "Dept": "category.customer.dept", "Class": "category.customer.class",
    "Fine": "category.customer.fine", "Mfg_Part_Num": "identity.mpn", "Part_Desc": "input.description",
    "E1_Brand": "attr:_e1_brand", "Feed_Brand": "attr:_feed_brand", "DIB_Brand": "attr:_dib_brand",
    "Part_Manuf": "attr:_part_manuf", "MANUFACTURER_NAME": "identity.manufacturer", "BRAND_NAME": "identity.brand",
    "MANUFACTURER_PART_NUMBER": "identity.mpn", "Classpath": "category.classpath", "MOBILE_DESC": "field:mobile_desc",
    "INVOICE_DESC": "field:invoice_desc", "SHORT_DESC": "field:product_title", "LONG_DESC1": "field:long_description",
    "RETAIL_DESC": "field:retail_desc", "MARKETING_DESCRIPTION": "content.long_description", "With": "field:with_clause",
    "Product Name": "field:product_name", "UNSPSC": "category.code", "List Price": "input.price",
    "Country Of Origin": "identity.brand_country",
}
_DELIVERY_HEAD = ["MFR URL", "Ref URL 1", "Ref URL 2", "Ref URL 3", "Ref URL 4", "Ref URL 5", "PART_NUMBER", "Dept",
                  "Class", "Fine", "SKU - MY_PART_NUMBER", "Mfg_Part_Num", "Part_Desc", "E1_Brand", "Feed_Brand",
                  "DIB_Brand", "Part_Manuf", "MANUFACTURER_NAME", "BRAND_NAME", "TRADE_NAME",
                  "MANUFACTURER_PART_NUMBER", "ALTERNATE_PART_NUMBER", "Classpath", "MOBILE_DESC", "INVOICE_DESC",
                  "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC", "MARKETING_DESCRIPTION"]
_DELIVERY_MIDDLE = ["With", "Standard/Approvals", "Prop 65", "Application", "Includes", "Product Name"]
_DELIVERY_TAIL = ["UPC", "EAN", "GTIN", "UNSPSC", "Warranty", "List Price", "Selling Qty", "Selling UOM",
                  "Standard Packaging Information", "LENGTH", "LENGTH_UOM", "HEIGHT", "HEIGHT_UOM", "WIDTH",
                  "WIDTH_UOM", "WEIGHT", "WEIGHT_UOM", "VOLUME", "VOLUME_UOM", "Product Image", "Alternate Image 1",
                  "Alternate Image 2", "Alternate Image 3", "Alternate Image 4", "SDS", "SDS_1",
                  "Warranty Information", "Catalog", "Specification Sheet", "Instruction/Installation Manual",
                  "Service Manual", "Owners/User Manual", "Line Drawing", "MTR", "RoHS", "Full Engineering Drawing",
                  "Energy Star Guide", "Technical Bulletin", "Submittal", "Compatibility Chart", "Size Chart",
                  "Product Label/Insert", "Video Link", "Video Link 1", "Country Of Origin", "Discontinued",
                  "Actual Image (Yes/No)"]


def _delivery_fields(feed_brand: str = "Feed_Brand") -> list[dict]:
    def one(name):
        target = feed_brand if name == "Feed_Brand" else name
        source = _DELIVERY_MAPPED.get(name)
        return {"target": target, "from": source} if source else {"target": target, "const": ""}
    return ([one(n) for n in _DELIVERY_HEAD]
            + [{"slots": {"source": "content.bullets", "count": 20, "target": "ITEM_FEATURES_{n}"}}]
            + [one(n) for n in _DELIVERY_MIDDLE]
            + [{"slots": {"source": "attributes", "count": 50, "columns": [
                {"target": "ATTRIBUTE_LABEL {n}", "from": "label"},
                {"target": "ATTRIBUTE_VALUE {n}", "from": "value"},
                {"target": "ATTRIBUTE_UOM {n}", "from": "unit"}]}}]
            + [one(n) for n in _DELIVERY_TAIL])


PROFILES: dict[str, dict] = {
    "catalog_csv": {"id": "catalog_csv", "format": "csv",
                    "fields": [{"target": t, "from": s} for t, s in _BASE],
                    "attributes": {"columns": [{"suffix": s, "from": f} for s, f in _ATTR_BLOCK]}},
    "schema_org": {"id": "schema_org", "format": "jsonld", "fields": [
        {"target": "@context", "const": "https://schema.org"}, {"target": "@type", "const": "Product"},
        {"target": "sku", "from": "input.sku"}, {"target": "mpn", "from": "identity.mpn"},
        {"target": "brand", "from": "identity.brand"}, {"target": "name", "from": "content.title"},
        {"target": "description", "from": "content.short_description"}, {"target": "category", "from": "category.path"}],
        "attributes": {"target": "additionalProperty", "item": {
            "@type": {"const": "PropertyValue"}, "propertyID": "attr:{key}.key", "name": "attr:{key}.label",
            "value": "attr:{key}.value", "unitText": "attr:{key}.unit", "url": "attr:{key}.source_url"}}},
    "delivery": {"id": "delivery", "format": "csv", "fields": _delivery_fields()},
}


class ProfileError(ValueError):
    """Unknown profile or a path the record does not have."""


def profile(ref: str | dict) -> dict:
    """A profile by id, from a JSON file, or given as a dict."""
    if isinstance(ref, dict):
        return ref
    if ref in PROFILES:
        return PROFILES[ref]
    if ref.endswith(".json"):
        with open(ref, encoding="utf-8") as handle:
            return json.load(handle)
    raise ProfileError(f"Unknown export profile '{ref}'. Available: {', '.join(sorted(PROFILES))}")


def with_unit(a: str) -> str:
    return f"IF({a} IS NULL, NULL, concat({a}.val, IF(coalesce({a}.unit, '') <> '', concat(' ', {a}.unit), '')))"


def path_sql(path: str) -> str:
    """SQL of one profile path over an enriched record."""
    if path.startswith("attr:"):
        key, _, part = path[5:].partition(".")
        a = f"get(filter(attributes, a -> a.key = {q(key)}), 0)"
        if not part:
            return with_unit(a)
        if part not in _ATTRIBUTE_FIELDS:
            return "CAST(NULL AS STRING)"
        return f"{a}.{_ATTRIBUTE_FIELDS[part]}"
    if path.startswith("field:"):
        name, _, part = path[6:].partition(".")
        return f"get(filter(fields, f -> f.id = {q(name)}), 0).{part or 'text'}"
    special = {
        "category.path": "array_join(category.path, ' > ')", "category.classpath": "coalesce(nullif(category.customer.classpath, ''), array_join(category.path, '>'))",
        "issues.errors": "size(filter(issues, i -> i.severity = 'error'))",
        "issues.warnings": "size(filter(issues, i -> i.severity = 'warning'))",
        "content.bullets": "array_join(content.bullets, ' | ')",
        "content.keywords": "array_join(content.keywords, ', ')",
    }
    if path in special:
        return special[path]
    if path.startswith("category.customer."):
        name = path.removeprefix("category.customer.")
        return f"category.customer.{name}" if name in CUSTOMER_NAMES else "CAST(NULL AS STRING)"
    head, _, rest = path.partition(".")
    if head == "input" and rest in _INPUT:
        return rest
    if head == "identity" and rest:
        return f"identity[{q(rest)}]"
    if head in ("category", "content", "readiness", "compliance") and rest:
        return f"{head}.{rest}"
    raise ProfileError(f"Unknown path '{path}'")


def _named_keys(spec: dict) -> set[str]:
    return {f["from"][5:].partition(".")[0] for f in spec.get("fields", []) if f.get("from", "").startswith("attr:")}


def _slots(slots: dict) -> list[Column]:
    """A numbered block, always padded to its full width."""
    columns = slots.get("columns") or [{"target": slots["target"], "from": "."}]
    pick = {"label": "a.label", "value": "a.value", "unit": "a.unit", "source_url": "a.source_url",
            "provenance": "a.provenance", ".": "a"}
    made = []
    for n in range(1, int(slots["count"]) + 1):
        for c in columns:
            cell = pick[c["from"]].replace("a.", f"get(_slots_attributes, {n - 1}).") if c["from"] != "." else \
                f"get(content.bullets, {n - 1})"
            made.append(F.expr(f"coalesce({cell}, '')").alias(c["target"].format(n=n)))
    return made


def dynamic_keys(records: DataFrame, skip: set[str], order: str = "id") -> list[str]:
    """Attribute keys of the batch in first-seen order.

    Each becomes a column, so the keys (attribute names of category schemas), not rows, reach
    the driver.
    """
    seen = (records.select(F.col(order).alias("_o"), F.posexplode_outer("attributes").alias("_p", "_a"))
            .where("_a IS NOT NULL").groupBy(F.col("_a.key").alias("key"))
            .agg(F.min(F.struct("_o", "_p")).alias("first")).orderBy("first").collect())
    return [r["key"] for r in seen if r["key"] not in skip]


def _with_customer(records: DataFrame) -> DataFrame:
    """Records from before categories carried the customer's names get empty ones."""
    kind = records.schema["category"].dataType if "category" in records.columns else None
    if not isinstance(kind, T.StructType) or "customer" in kind.names:
        return records
    none = F.struct(*[F.lit(None).cast("string").alias(n) for n in CUSTOMER_NAMES])
    return records.withColumn("category", F.when(F.col("category").isNotNull(), F.col("category").withField("customer", none)))


def to_rows(records: DataFrame, ref: str | dict, keys: list[str] | None = None, order: str = "id") -> DataFrame:
    """A flat sheet as strings, one row per record; a pure projection once keys are known."""
    spec = profile(ref)
    columns = spec.get("attributes", {}).get("columns", [])
    if columns and keys is None:
        keys = dynamic_keys(records, _named_keys(spec), order)
    shaped = records = _with_customer(records)
    if any("slots" in f and f["slots"]["source"] == "attributes" for f in spec["fields"]):
        shaped = records.withColumn("_slots_attributes", F.expr(
            "transform(attributes, a -> named_struct('label', a.label, 'value', "
            + style.value_only("a.val", "a.num", "a.unit")
            + ", 'unit', coalesce(a.unit, ''), 'source_url', coalesce(a.source_url, ''), 'provenance', a.prov))"))
    out: list[Column] = []
    for f in spec["fields"]:
        if "slots" in f:
            out += _slots(f["slots"])
        elif "from" in f:
            out.append(F.expr(f"coalesce(CAST({path_sql(f['from'])} AS STRING), '')").alias(f["target"]))
        else:
            out.append(F.lit(str(f.get("const", ""))).alias(f["target"]))
    for key in keys or []:
        for c in columns:
            sql = path_sql(c["from"].format(key=key))
            out.append(F.expr(f"coalesce(CAST({sql} AS STRING), '')").alias(key + c.get("suffix", "")))
    return shaped.select(*out)


def to_documents(records: DataFrame, ref: str | dict) -> DataFrame:
    """Nested documents as JSON text; nulls are left out."""
    spec, records = profile(ref), _with_customer(records)
    parts = []
    for f in spec["fields"]:
        value = q(f["const"]) if "const" in f else path_sql(f["from"])
        parts.append(f"{q(f['target'])}, {value}")
    block = spec.get("attributes") or {}
    if block.get("item"):
        skip = _named_keys(spec)
        def source(s):
            if isinstance(s, dict):
                return q(s["const"])
            part = s.partition(".")[2]
            if part == "value":
                return ("CASE WHEN a.kind IN ('int', 'float') THEN parse_json(a.val)"
                        " WHEN a.kind = 'bool' THEN parse_json(lower(a.val)) ELSE CAST(a.val AS VARIANT) END")
            return f"a.{_ATTRIBUTE_FIELDS[part]}" if part else with_unit("a")
        item = ", ".join(f"{q(t)}, {source(s)}" for t, s in block["item"].items())
        shown = "attributes" if not skip else (
            "filter(attributes, a -> a.key NOT IN (" + ", ".join(q(k) for k in sorted(skip)) + "))")
        parts.append(f"{q(block['target'])}, CASE WHEN size({shown}) > 0 THEN"
                     f" transform({shown}, a -> named_struct({item})) END")
    return records.select("id", F.expr(f"to_json(named_struct({', '.join(parts)}))").alias("document"))


def audit_rows(records: DataFrame, keys: list[str] | None = None, order: str = "id") -> DataFrame:
    """Flat catalogue with value, provenance, confidence and source of every attribute."""
    keys = dynamic_keys(records, set(), order) if keys is None else keys
    records = _with_customer(records)
    out = [F.expr(f"coalesce(CAST({path_sql(s)} AS STRING), '')").alias(t) for t, s in _BASE]
    out[1] = F.expr("coalesce(nullif(identity.mpn, ''), mpn, '')").alias("mpn")
    out[2] = F.expr("coalesce(nullif(identity.brand, ''), brand, '')").alias("brand")
    for k in keys:
        a = f"get(filter(attributes, a -> a.key = {q(k)}), 0)"
        for suffix, sql in (("", with_unit(a)), ("__provenance", f"{a}.prov"), ("__confidence", f"{a}.conf"),
                            ("__source", f"nullif(concat_ws(' · ', nullif({a}.source_url, ''), nullif({a}.locator, '')), '')")):
            out.append(F.expr(f"coalesce(CAST({sql} AS STRING), '')").alias(k + suffix))
    return records.select(*out)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_documents(documents: DataFrame, path: str) -> None:
    documents.select("document").write.mode("overwrite").text(path)

