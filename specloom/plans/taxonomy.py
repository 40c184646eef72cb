"""Category dimension: curated schemas plus approved learned ones (B2, B3, V8-like lookups).

A taxonomy is a few hundred rows of configuration at most.  It is turned into
(a) a one-row index that texts are probed against, (b) a small DataFrame for a size-checked
broadcast join, and (c) the name/option lists the similarity UDFs need.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed
from ..functions.text import escape_rx, lookup, number
from ..functions import units

SCHEMA_DDL = """
code string, leaf string, noun string, path array<string>, required array<string>,
checks array<string>, classpath string,
attrs array<struct<j:int,key:string,label:string,type:string,unit:string,grp:string,
  options:array<string>,lo:double,hi:double,owns:boolean,unit_rx:string,
  names:array<struct<n:string,label_rx:string,num_rx:string>>,
  opts:array<struct<option:string,probe:string,rx:string>>>>,
series array<struct<name:string,rx:string,
  vals:array<struct<key:string,val:string,num:double,kind:string>>>>,
grades array<struct<name:string,key:string,num:double>>,
defaults array<struct<key:string,val:string,num:double,kind:string>>
"""

# Beyond this many categories the schema side is joined without a broadcast.
BROADCAST_CATEGORIES = 5_000


def typed(value) -> dict:
    """A configured value with the text and kind it has in a record."""
    if isinstance(value, bool):
        return {"val": str(value), "num": None, "kind": "bool"}
    if isinstance(value, (int, float)):
        return {"val": str(value), "num": float(value),
                "kind": "float" if isinstance(value, float) else "int"}
    return {"val": value, "num": None, "kind": "text"}


# The customer's names for a shelf that a category may carry
CUSTOMER_NAMES = ["dept", "class", "fine", "classpath"]


#: The classification index: postings by word run, by first letters and by code; categories; part-number patterns.
INDEX_DDL = """
ix struct<size:int,
  slots:array<array<struct<run:string,c:int,j:int,at:int,n:string,rx:string,w:double>>>,
  grams:array<array<struct<run:string,c:int,n:string>>>,
  codes:array<array<struct<run:string,c:int>>>,
  cats:array<struct<code:string,path:array<string>,customer:struct<dept:string,class:string,fine:string,classpath:string>,kw:array<string>>>,
  patterns:array<struct<c:int,rx:string>>>
"""
#: Letters by which a keyword is found inside words.
GRAM = 3
_RUN = re.compile(r"\w+", re.ASCII)


def _dim(unit):
    entry = fixed.UNITS.get((unit or "").strip().lower())
    return entry[0] if entry else None


@dataclass
class Taxonomy:
    curated: list[dict] = field(default_factory=lambda: fixed.CATEGORIES)
    learned: list[dict] = field(default_factory=list)

    @cached_property
    def categories(self) -> list[dict]:
        """Curated first; a learned category never redefines a curated code."""
        known = {c["code"] for c in self.curated}
        return [*self.curated, *[c for c in self.learned if c["code"] not in known]]

    # ---------------------------------------------------------------- names
    @staticmethod
    def names(attribute: dict) -> list[str]:
        return [attribute["key"].replace("_", " "), attribute["label"], *attribute["aliases"]]

    @property
    def names_by_code(self) -> dict[str, list[tuple[str, ...]]]:
        return {c["code"]: [tuple(self.names(a)) for a in c["attributes"]]
                for c in self.categories}

    @property
    def options_by_code(self) -> dict[str, list[tuple[str, ...]]]:
        return {c["code"]: [tuple(a["values"]) for a in c["attributes"]]
                for c in self.categories}

    # ---------------------------------------------------------------- index
    def scoring_index(self) -> tuple:
        """What classification needs, as one row to be probed with a text's words (``INDEX_DDL``).

        Postings are filed by crc32 in ``slots``: a keyword or attribute name under the rarest of
        its word runs, a category under its code; keywords are filed again by their first
        letters in ``grams``, for search inside words.
        """
        names, cats, patterns = [], [], []
        for c, category in enumerate(self.categories):
            own = category.get("customer") or {}
            cats.append((category["code"], category["path"], tuple(own.get(n) for n in CUSTOMER_NAMES), category["keywords"]))
            patterns += [(c, "(?i)^(?:" + p + ")") for p in category["mpn_patterns"]]
            names += [(c, -1, i, k, 2.5 if " " in k else 1.5) for i, k in enumerate(category["keywords"])]
            for j, a in enumerate(category["attributes"]):
                mentions = [a["label"].lower(), a["key"].replace("_", " "), *[x.lower() for x in a["aliases"]]]
                names += [(c, j, i, n, 0.0) for i, n in enumerate(mentions) if len(n) > 3]
        runs = [_RUN.findall(n) for _, _, _, n, _ in names]
        often = Counter(r for found in runs for r in set(found))
        size = 1 << max(4, len(names) + len(cats)).bit_length()
        slots, grams = [[] for _ in range(size)], [[] for _ in range(size)]
        file = lambda table, probe, row: table[zlib.crc32(probe.encode()) % size].append((probe, *row))
        for (c, j, i, n, w), found in zip(names, runs):
            file(slots, min(found, key=lambda r: (often[r], r), default=""), (c, j, i, n, rf"\b{escape_rx(n)}\b", w))
            if j < 0:
                file(grams, n[:GRAM], (c, n))
        codes = [[] for _ in range(size)]
        for c, row in enumerate(cats):
            file(codes, row[0], (c,))
        return size, slots, grams, codes, cats, patterns

    def index_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.scoring_index(),)], INDEX_DDL, verifySchema=False)

    # ----------------------------------------------------------- schema rows
    def schema_rows(self) -> list[dict]:
        rows = []
        for c in self.categories:
            dims = [_dim(a["unit"]) for a in c["attributes"]]
            attrs = []
            for j, a in enumerate(c["attributes"]):
                names = []
                for n in [a["label"], a["key"].replace("_", " "), *a["aliases"]]:
                    if len(n) < 2:
                        continue
                    rx = escape_rx(n)
                    number_first = len(n) >= 4 or n.strip().lower() in fixed.UNITS
                    names.append({
                        "n": n.lower(),
                        "label_rx": rf"(?i)\b{rx}\b[ \t]*[:=\-]?[ \t]*([^,;\n|]{{1,40}})",
                        "num_rx": (rf"(?i)({fixed.PROSE_NUMBER}[ \t]*{rx})\b"
                                   if number_first else None)})
                opts = []
                if a["type"] == "enum":
                    for option in a["values"]:
                        for probe in dict.fromkeys([option, option.split("(")[0].strip()]):
                            if len(probe) >= 2:
                                opts.append({"option": option, "probe": probe.lower(),
                                             "rx": rf"(?i)\b{escape_rx(probe)}\b"})
                owns = dims[j] is not None and dims.count(dims[j]) == 1
                tokens = "|".join(escape_rx(t) for t in units.spellings(dims[j])) if owns else None
                lo, hi = a["range"] or (None, None)
                attrs.append({
                    "j": j, "key": a["key"], "label": a["label"], "type": a["type"],
                    "unit": a["unit"], "grp": a["group"], "options": list(a["values"]),
                    "lo": None if lo is None else float(lo),
                    "hi": None if hi is None else float(hi),
                    "owns": owns and a["type"] == "number",
                    "unit_rx": rf"(?i)({fixed.PROSE_NUMBER})\s*({tokens})\b" if owns else None,
                    "names": names, "opts": opts})
            series, grades = [], []
            if c["code"] == "31171500" or c.get("series"):
                table = c.get("series") or fixed.SERIES
                for name in sorted(table, key=len, reverse=True):
                    series.append({"name": name, "rx": rf"\b{escape_rx(name)}\b",
                                   "vals": [{"key": k, **typed(v)}
                                            for k, v in zip(fixed.SERIES_KEYS, table[name])]})
            if c["code"] == "31161500":
                grades = [{"name": g, "key": "tensile_strength", "num": float(v)}
                          for g, v in fixed.GRADES.items()]
            rows.append({
                "code": c["code"], "leaf": c["path"][-1], "noun": c["noun"],
                "path": c["path"], "required": c["required"], "checks": c["cross_checks"],
                "classpath": " > ".join(c["path"]), "attrs": attrs, "series": series,
                "grades": grades,
                "defaults": [{"key": k, **typed(v)} for k, v in c["defaults"].items()]})
        return rows

    def schema_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.schema_rows(), SCHEMA_DDL)

    def schema_side(self, spark: SparkSession) -> DataFrame:
        """Schema rows for the join on ``code``; broadcast only while known to be small."""
        df = self.schema_df(spark)
        return F.broadcast(df) if len(self.categories) <= BROADCAST_CATEGORIES else df

    # ------------------------------------------------------- flat dimensions
    def attribute_rows(self) -> list[tuple]:
        return [(c["code"], j, a["key"], a["label"], a["type"], a["unit"], a["group"],
                 None if not a["range"] else float(a["range"][0]),
                 None if not a["range"] else float(a["range"][1]),
                 _dim(a["unit"]))
                for c in self.categories for j, a in enumerate(c["attributes"])]

    def attribute_df(self, spark: SparkSession) -> DataFrame:
        """``dim_attribute``: one row per category and attribute."""
        return spark.createDataFrame(
            self.attribute_rows(),
            "code string, pos int, key string, label string, type string, unit string,"
            " grp string, lo double, hi double, dimension string")

    def category_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(c["code"], " > ".join(c["path"]), c["path"][-1], c["noun"], i,
              bool(c.get("learned", False))) for i, c in enumerate(self.categories)],
            "code string, path string, leaf string, noun string, pos int, learned boolean")

    def required_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(c["code"], i, k) for c in self.categories for i, k in enumerate(c["required"])],
            "code string, pos int, key string")

    def listing(self, spark: SparkSession) -> DataFrame:
        """B2: categories with attribute, required and rule counts."""
        return spark.createDataFrame(
            [(c["code"], " > ".join(c["path"]), len(c["attributes"]), len(c["required"]),
              len(c["cross_checks"])) for c in self.categories],
            "code string, path string, attributes int, required int, rules int")


def brand_listing(spark: SparkSession) -> DataFrame:
    """B2: distinct canonical brand names in order."""
    names = sorted({v[0] for v in fixed.BRANDS.values()})
    return spark.createDataFrame([(n,) for n in names], "brand string")


_BRANDS = {p: (i, c, k, ",".join(made)) for i, (p, (c, k, made)) in enumerate(fixed.BRANDS.items())}


def brand_row(probe: str) -> str:
    """Brand entry of a folded name, or null; ``made`` lists category codes."""
    return lookup(_BRANDS, {"pos": "INT", "canonical": "STRING", "country": "STRING", "made": "STRING"}, probe)


__all__ = ["Taxonomy", "brand_listing", "brand_row", "typed", "number"]
