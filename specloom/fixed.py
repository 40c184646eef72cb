"""Units, vocabularies, word lists, limits and reference tables.

Everything here is data.  Operators read these tables; none of them hard-codes a
value of its own, so replacing a table never means editing an operator.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Canonical unit per physical dimension
CANONICAL_UNIT = {
    "length": "mm", "pressure": "bar", "power": "kW", "flow": "L/min",
    "temperature": "C", "force": "kN", "current": "A", "voltage": "V",
    "speed": "rpm", "frequency": "Hz", "angle": "deg", "time": "ms", "mass": "kg",
}

# Spelling -> (dimension, factor to canonical, offset before scaling)
UNITS = {
    "mm": ("length", 1.0, 0.0), "millimeter": ("length", 1.0, 0.0),
    "millimetre": ("length", 1.0, 0.0), "cm": ("length", 10.0, 0.0),
    "m": ("length", 1000.0, 0.0), "meter": ("length", 1000.0, 0.0),
    "in": ("length", 25.4, 0.0), "inch": ("length", 25.4, 0.0),
    "inches": ("length", 25.4, 0.0), '"': ("length", 25.4, 0.0),
    "ft": ("length", 304.8, 0.0), "foot": ("length", 304.8, 0.0),
    "feet": ("length", 304.8, 0.0),
    "bar": ("pressure", 1.0, 0.0), "mbar": ("pressure", 0.001, 0.0),
    "psi": ("pressure", 0.0689476, 0.0), "kpa": ("pressure", 0.01, 0.0),
    "mpa": ("pressure", 10.0, 0.0), "pa": ("pressure", 1e-5, 0.0),
    "atm": ("pressure", 1.01325, 0.0),
    "kw": ("power", 1.0, 0.0), "w": ("power", 0.001, 0.0),
    "watt": ("power", 0.001, 0.0), "watts": ("power", 0.001, 0.0),
    "mw": ("power", 1000.0, 0.0), "hp": ("power", 0.7457, 0.0),
    "horsepower": ("power", 0.7457, 0.0),
    "l/min": ("flow", 1.0, 0.0), "lpm": ("flow", 1.0, 0.0),
    "l/s": ("flow", 60.0, 0.0), "l/h": ("flow", 1 / 60, 0.0),
    "m3/h": ("flow", 16.6667, 0.0), "m³/h": ("flow", 16.6667, 0.0),
    "gpm": ("flow", 3.78541, 0.0), "cfm": ("flow", 28.3168, 0.0),
    "c": ("temperature", 1.0, 0.0), "°c": ("temperature", 1.0, 0.0),
    "degc": ("temperature", 1.0, 0.0), "celsius": ("temperature", 1.0, 0.0),
    "f": ("temperature", 5 / 9, -32.0), "°f": ("temperature", 5 / 9, -32.0),
    "degf": ("temperature", 5 / 9, -32.0), "fahrenheit": ("temperature", 5 / 9, -32.0),
    "k": ("temperature", 1.0, -273.15),
    "kn": ("force", 1.0, 0.0), "n": ("force", 0.001, 0.0),
    "lbf": ("force", 0.00444822, 0.0), "kgf": ("force", 0.00980665, 0.0),
    "a": ("current", 1.0, 0.0), "amp": ("current", 1.0, 0.0),
    "amps": ("current", 1.0, 0.0), "ma": ("current", 0.001, 0.0),
    "v": ("voltage", 1.0, 0.0), "volt": ("voltage", 1.0, 0.0),
    "volts": ("voltage", 1.0, 0.0), "kv": ("voltage", 1000.0, 0.0),
    "rpm": ("speed", 1.0, 0.0), "min-1": ("speed", 1.0, 0.0),
    "hz": ("frequency", 1.0, 0.0), "khz": ("frequency", 1000.0, 0.0),
    "deg": ("angle", 1.0, 0.0), "°": ("angle", 1.0, 0.0),
    "ms": ("time", 1.0, 0.0), "s": ("time", 1000.0, 0.0), "us": ("time", 0.001, 0.0),
    "kg": ("mass", 1.0, 0.0), "g": ("mass", 0.001, 0.0),
    "lb": ("mass", 0.453592, 0.0), "lbs": ("mass", 0.453592, 0.0),
}

# Patterns for quantities, fractions, part numbers
NUMBER_UNIT_RX = r'([-+]?\d+(?:[.,]\d+)?)\s*(°?[a-zA-Z³/"]+(?:/[a-zA-Z0-9³]+)?|")?'
FRACTION_RX = r'(?i)(?:(\d+)\s*[-\s])?(\d+)\s*/\s*(\d+)\s*(in|inch|inches|")?'
FRACTION_ONLY_RX = r'^\s*(?:(\d+)\s*[-\s]\s*)?(\d+)\s*/\s*(\d+)\s*$'
PROSE_NUMBER = r'[-+]?\d+(?:\.\d+)?'
QUANTITY_ONLY_RX = (r'^\s*[-+]?\d+(?:[.,]\d+)?\s*'
                    r'(?:°|[A-Za-z]{1,12}(?:/[A-Za-z0-9]{1,6})?|%|")?\s*$')
MPN_LABEL_RX = (r'(?i)\b(?:p/?n|part(?:\s*(?:no|number))?|mpn|model)\b\s*[:#=]?\s*'
                r'([A-Z0-9][A-Z0-9\-/.]{2,24})')
MPN_TOKEN_RX = r'\b(?=[A-Z0-9\-]*\d)[A-Z]{0,4}\d{3,5}[A-Z0-9\-]{0,8}\b'
GTIN_RX = r'(?i)\b(?:gtin|ean|upc)\b\s*[:#=]?\s*(\d{8,14})'
DOC_MPN_RX = (r'(?i)\b(?:part\s*(?:no\.?|number)|p/?n|mpn|model(?:\s*no\.?)?|'
              r'order(?:ing)?\s*code|cat(?:alog(?:ue)?)?\s*(?:no\.?|number))\b'
              r'\s*[:#=]?\s*([A-Z0-9][A-Z0-9\-/.]{2,24})')

# Trust order of provenance classes, severity order
PROVENANCE_RANK = {"supplied": 6, "parsed": 5, "knowledge_base": 4,
                   "derived": 3, "inferred": 2, "defaulted": 1}
PROTECTED = ["supplied", "parsed", "knowledge_base", "derived"]
SEVERITY_RANK = {"error": 0, "warning": 1, "info": 2}

# Issue codes that never auto-publish
INTEGRITY_CODES = [
    "VOCABULARY_VIOLATION", "LOV_VIOLATION", "INVALID_IP_CODE", "SAFETY_FACTOR_LOW",
    "MATERIAL_TEMP_CONFLICT", "SEAT_TEMP_CONFLICT", "MATERIAL_PRESSURE_CONFLICT",
    "ELECTRICAL_INCONSISTENCY", "LOAD_RATING_SUSPECT", "SPEED_SEAL_CONFLICT",
    "PORT_SIZE_SUSPECT", "STRENGTH_MISMATCH", "GRADE_MATERIAL_CONFLICT",
    "GEOMETRY_CONTRADICTION", "STANDARD_CONTRADICTION", "PRESSURE_CONTRADICTION",
    "UNVERIFIED_FIGURE", "UNSUPPORTED_CLAIM", "TYPE_MISMATCH", "OUT_OF_RANGE",
]
BANNED_PHRASES = ["best in class", "world class", "premium quality", "cutting edge",
                  "state of the art", "unbeatable", "revolutionary"]

# Numeric thresholds
MAP_THRESHOLD = 0.62
ENUM_THRESHOLD = 0.5
SUGGEST_THRESHOLD = 0.86
PUBLISH_THRESHOLD = 78
CIRCUMSTANTIAL_CAP = 0.5
INFERRED_CAP = 0.6
WEAK_CLASSIFICATION = 0.65
FIELD_SUPPORT = 0.34
REQUIRED_SUPPORT = 0.75
CLUSTER_THRESHOLD = 0.35

# Words ignored when two field names are compared
KEY_STOP_WORDS = ["the", "a", "an", "of", "for", "with", "and", "type", "size"]
# Words ignored when a category is named
NAME_STOP_WORDS = ["the", "and", "for", "with", "type", "series", "model", "new", "high",
                   "industrial", "duty", "grade", "standard", "product", "item", "unit",
                   "mm", "inch", "kw", "hp", "pcs", "set", "kit", "assembly"]
# Spec keys that describe the feed row, not the product.  Any
# "<something>_brand" column is bookkeeping as well.
BOOKKEEPING_KEYS = ["vendor", "vendor_code", "manufacturer", "supplier", "source",
                    "part_manuf"]
MANUFACTURER_KEYS = ["manufacturer", "part manuf", "mfr"]
TRUE_WORDS = ["true", "yes", "y", "1", "self-priming", "self priming"]
FALSE_WORDS = ["false", "no", "n", "0", "none"]
BOOLEAN_WORDS = ["yes", "no", "true", "false", "y", "n"]

# Attribute group by name fragment, first hit wins
GROUP_FRAGMENTS = [
    ("Dimensions", ["diameter", "length", "width", "height", "size", "bore",
                    "thickness", "depth", "radius", "pitch", "od", "id"]),
    ("Performance", ["pressure", "speed", "flow", "power", "rating", "load",
                     "temp", "capacity", "torque", "accuracy", "range"]),
    ("Electrical", ["voltage", "current", "amp", "volt", "frequency", "phase",
                    "watt", "signal", "output", "supply"]),
    ("Materials", ["material", "coating", "finish", "housing", "body", "seal"]),
    ("Standards", ["standard", "certification", "compliance", "class",
                   "grade", "approval", "ip_"]),
]

# Distributor feed
PLACEHOLDER_RX = r'^\s*-{2,}\s*.*?\s*-{2,}\s*$'
PLACEHOLDER_LITERALS = ["-", "--", "commodity - unbranded", "n/a", "none", "unbranded"]
VENDOR_CODE_RX = r'\s*\(([^()]{2,10})\)\s*$'
ROW_COLUMNS = {
    "mfg part num": "mpn", "mfg part number": "mpn", "manufacturer part number": "mpn",
    "mpn": "mpn", "part desc": "description", "part description": "description",
    "description": "description", "e1 brand": "brand_e1", "dib brand": "brand_dib",
    "part manuf": "vendor", "part manufacturer": "vendor",
    "manufacturer name": "manufacturer", "sku": "sku", "sku my part number": "sku",
    "part number": "part_number", "dept": "dept", "class": "class", "fine": "fine",
}
SUPPLIER_COLUMNS = ["sku", "mpn", "brand", "name", "description", "category_hint",
                    "price", "currency", "source_url", "free_text"]

# Documents and pages
MAX_KEY_CHARS = 48
MAX_DOC_VALUE_CHARS = 120
MAX_WEB_VALUE_CHARS = 160
KEY_HEADERS = ["parameter", "property", "characteristic", "specification", "spec",
               "attribute", "feature", "description", "item"]
VALUE_HEADERS = ["value", "specification", "spec", "data", "rating", "detail"]
DOT_LEADER_RX = (r'^\s*([A-Za-z][A-Za-z0-9 ()/µ°%,.+-]{1,48}?)'
                 r'\s*[:.]{2,}\s*(.{1,120})\s*$')
COLON_RX = (r'^\s*([A-Za-z][A-Za-z0-9 ()/µ°%,.+-]{1,48}?)'
            r'\s*:\s+(\S.{0,120})\s*$')
LIST_PAIR_RX = (r'^([A-Za-z][A-Za-z0-9 ()/µ°%,+-]{1,48}?)'
                r'\s*:\s+(\S.{0,160})$')
HEADING_BOILERPLATE = ["datasheet", "data sheet", "technical data", "specification sheet",
                       "product data", "www.", "http", "page "]
SKIPPED_TAGS = ["script", "style", "noscript", "nav", "footer", "header", "form", "svg",
                "iframe", "template"]
SCHEMA_MEASURES = [("weight", "Weight"), ("color", "Color"), ("material", "Material"),
                   ("width", "Width"), ("height", "Height"), ("depth", "Depth"),
                   ("size", "Size"), ("pattern", "Pattern")]
SOFT_404_RX = (r'(?i)(?:\b404\b|not found|page (?:cannot|could not) be found'
               r'|no longer available|something has gone wrong)')

# Approved output units (measurement, abbreviation, accepted spellings)
UOM = [
    ("Length", "in", ["in", "in.", "inch", "inches", '"', "''"]),
    ("Length", "ft", ["ft", "ft.", "foot", "feet", "'"]),
    ("Length", "mm", ["mm", "millimeter", "millimeters", "millimetre", "millimetres"]),
    ("Length", "cm", ["cm", "centimeter", "centimeters"]),
    ("Length", "m", ["m", "meter", "meters", "metre", "metres"]),
    ("Weight", "lb", ["lb", "lbs", "lb.", "pound", "pounds"]),
    ("Weight", "oz", ["oz", "ounce", "ounces"]),
    ("Weight", "kg", ["kg", "kilogram", "kilograms"]),
    ("Weight", "g", ["g", "gram", "grams"]),
    ("Voltage", "V", ["v", "volt", "volts", "vac", "vdc"]),
    ("Current", "A", ["a", "amp", "amps", "ampere", "amperes"]),
    ("Current", "mA", ["ma", "milliamp", "milliamps"]),
    ("Power", "W", ["w", "watt", "watts"]),
    ("Power", "kW", ["kw", "kilowatt", "kilowatts"]),
    ("Power", "HP", ["hp", "horsepower"]),
    ("Frequency", "Hz", ["hz", "hertz"]),
    ("Noise", "dBA", ["dba", "db(a)", "decibel", "decibels", "db"]),
    ("Pressure", "psi", ["psi", "psig", "lbs/sq in", "pound per square inch"]),
    ("Pressure", "bar", ["bar", "bars"]),
    ("Pressure", "kPa", ["kpa", "kilopascal", "kilopascals"]),
    ("Pressure", "MPa", ["mpa", "megapascal", "megapascals"]),
    ("Tensile Strength", "ksi", ["ksi"]),
    ("Flow Rate", "gpm", ["gpm", "gal/min", "gallons per minute"]),
    ("Flow Rate", "L/min", ["l/min", "lpm", "liters per minute", "litres per minute"]),
    ("Flow Rate", "cfm", ["cfm", "cu ft/min", "cubic feet per minute"]),
    ("Temperature", "deg F", ["f", "°f", "degf", "deg f", "fahrenheit"]),
    ("Temperature", "deg C", ["c", "°c", "degc", "deg c", "celsius", "centigrade"]),
    ("Rotational Speed", "rpm", ["rpm", "r/min", "min-1", "revolutions per minute"]),
    ("Force", "lbf", ["lbf", "pound-force"]),
    ("Force", "kN", ["kn", "kilonewton", "kilonewtons"]),
    ("Force", "N", ["n", "newton", "newtons"]),
    ("Torque", "in-lb", ["in-lb", "in lb", "inch-pound", "inch pounds"]),
    ("Torque", "ft-lb", ["ft-lb", "ft lb", "foot-pound", "foot pounds"]),
    ("Torque", "Nm", ["nm", "n-m", "newton meter", "newton metre"]),
    ("Angle", "deg", ["deg", "°", "degree", "degrees"]),
    ("Volume", "gal", ["gal", "gallon", "gallons"]),
    ("Volume", "L", ["l", "liter", "liters", "litre", "litres"]),
    ("Capacity", "cu ft", ["cu ft", "cuft", "ft3", "cubic feet", "cubic foot"]),
    ("Time", "ms", ["ms", "millisecond", "milliseconds"]),
    ("Time", "sec", ["s", "sec", "second", "seconds"]),
    ("Time", "min", ["min", "minute", "minutes"]),
    ("Time", "hr", ["h", "hr", "hour", "hours"]),
    ("Thread Count", "TPI", ["tpi", "threads per inch"]),
    ("Gauge", "AWG", ["awg", "american wire gauge"]),
    ("Count", "ea", ["ea", "each", "pc", "pcs", "piece", "pieces"]),
]

# Short forms for the invoice line
ABBREVIATIONS = {
    "stainless steel": "SST", "carbon steel": "CS", "cast iron": "CI", "brass": "BRS",
    "bronze": "BRZ", "aluminum": "ALUM", "aluminium": "ALUM", "polypropylene": "PP",
    "polyamide": "PA", "galvanized": "GALV", "stainless": "SS",
    "dishwasher": "DISHWASHER", "refrigerator": "REFRIG", "coupling": "CPLG",
    "connector": "CONN", "adapter": "ADPT", "elbow": "ELL", "reducer": "RED",
    "nipple": "NIP", "bushing": "BUSH", "flange": "FLG", "threaded": "THRD",
    "female": "FEM", "male": "MALE", "pressure": "PRESS", "temperature": "TEMP",
    "diameter": "DIA", "assembly": "ASSY", "mounting": "MTG", "with": "W/",
    "without": "W/O", "built-in": "BLTLN", "built in": "BLTLN", "leg": "LEG",
}

# Words always written in capitals
ALWAYS_UPPER = ["mpn", "sku", "npt", "pvc", "cpvc", "ptfe", "abs", "ss", "sst", "led", "ul",
                "csa", "nsf", "iso", "ansi", "asme", "awg", "hp", "gpm", "psi", "rpm", "id",
                "od", "nps", "bspp", "bspt"]

# Label rules for written content
TERMINAL_ATTRIBUTES = ["material", "material_construction", "color", "colour", "finish", "size"]
SELF_DESCRIBING_UNITS = ["V", "A", "W", "kW", "HP", "Hz"]
PREFIX_LABEL_ATTRIBUTES = ["additional_information"]
LABEL_PREFIXES_TO_DROP = ["Number of "]
LABEL_SUFFIXES_TO_DROP = [" Type"]


def _tok(source, priority, **kw):
    return {"source": source, "priority": priority, **kw}


# The seven written formats
FORMATS = [
    {"id": "invoice_desc", "label": "Invoice Description", "max": 40, "case": "upper",
     "separator": " ", "compact": True, "abbreviate": True,
     "exclude_provenance": ["defaulted", "inferred"], "exclude_keys": ["feature"],
     "tokens": [_tok("item_type", 1, required=True), _tok("attr:mounting", 2),
                _tok("attr:wash_cycles", 3), _tok("attr:material", 4), _tok("attr:color", 5),
                _tok("attr:voltage", 6), _tok("attr:current", 7), _tok("attr:*", 9)]},
    {"id": "mobile_desc", "label": "Mobile Description", "min": 60, "max": 80,
     "case": "preserve", "separator": ", ", "exclude_provenance": ["defaulted"],
     "tokens": [_tok("manufacturer", 5), _tok("brand", 1, strip=True, space=True),
                _tok("item_type", 2, required=True), _tok("attr:series", 3), _tok("mpn", 4),
                _tok("attr:mounting", 6, with_label=True), _tok("attr:*", 8, with_label=True)]},
    {"id": "product_title", "label": "Short Description", "max": 200, "case": "title",
     "separator": " ", "tail_separator": ", ", "label_style": "hyphen_singular",
     "exclude_provenance": ["defaulted"],
     "tokens": [_tok("brand", 1, required=True), _tok("attr:series", 2),
                _tok("mpn", 1, required=True), _tok("item_type", 1, required=True),
                _tok("attr:feature", 3, prefix="With", single=True),
                _tok("attr:mounting", 4, tail=True, with_label=True),
                _tok("attr:wash_cycles", 5, tail=True, with_label=True),
                _tok("attr:material", 6, tail=True, with_label=True),
                _tok("attr:color", 7, tail=True, with_label=True)]},
    {"id": "retail_desc", "label": "Retail Description", "max": 200, "case": "title",
     "separator": " ", "tail_separator": ", ", "label_style": "hyphen_singular",
     "exclude_provenance": ["defaulted"],
     "tokens": [_tok("attr:series", 2), _tok("item_type", 1, required=True),
                _tok("attr:mounting", 4, tail=True, with_label=True),
                _tok("attr:wash_cycles", 5, tail=True, with_label=True),
                _tok("attr:material", 6, tail=True, with_label=True),
                _tok("attr:color", 7, tail=True, with_label=True)]},
    {"id": "long_description", "label": "Long Description", "max": 1000, "case": "preserve",
     "separator": " ", "tail_separator": ", ", "exclude_provenance": ["defaulted"],
     "tokens": [_tok("brand", 1, required=True), _tok("item_type", 1, required=True),
                _tok("attr:feature", 2, prefix="With", single=True),
                _tok("attr:series", 3, tail=True),
                _tok("attr:*", 5, tail=True, with_label=True)]},
    {"id": "with_clause", "label": "With", "case": "preserve", "separator": ", ",
     "exclude_provenance": ["defaulted"],
     "tokens": [_tok("attr:feature", 1, prefix="With")]},
    {"id": "product_name", "label": "Product Name", "case": "title", "separator": " ",
     "tokens": [_tok("item_type", 1, required=True)]},
]

# List of values for one classpath
LOV = {
    "Plumbing > Pipe, Tube & Fittings > Pipe Fittings": [
        {"key": "fitting_type", "label": "Fitting Type", "sequence": 1, "filterable": True,
         "values": ["Adapter", "Bushing", "Cap", "Coupling", "Cross", "Elbow", "Flange",
                    "Nipple", "Plug", "Reducer", "Tee", "Union"],
         "synonyms": {"cplg": "Coupling", "coup": "Coupling", "coupler": "Coupling",
                      "ell": "Elbow", "90 ell": "Elbow", "90 degree elbow": "Elbow",
                      "45 ell": "Elbow", "adptr": "Adapter", "adpt": "Adapter",
                      "nip": "Nipple", "red": "Reducer", "reducing coupling": "Reducer",
                      "flg": "Flange", "bush": "Bushing"}},
        {"key": "material", "label": "Material Construction", "sequence": 2, "filterable": True,
         "values": ["Brass", "Bronze", "Carbon Steel", "Cast Iron", "Copper", "CPVC",
                    "Ductile Iron", "Malleable Iron", "PEX", "Polypropylene", "PVC",
                    "Stainless Steel"],
         "synonyms": {"brs": "Brass", "bra": "Brass", "yellow brass": "Brass",
                      "red brass": "Brass", "brz": "Bronze", "ss": "Stainless Steel",
                      "sst": "Stainless Steel", "stainless": "Stainless Steel",
                      "304 ss": "Stainless Steel", "316 ss": "Stainless Steel",
                      "cs": "Carbon Steel", "black steel": "Carbon Steel",
                      "ci": "Cast Iron", "mi": "Malleable Iron",
                      "malleable": "Malleable Iron", "di": "Ductile Iron",
                      "poly": "Polypropylene", "pp": "Polypropylene", "c-pvc": "CPVC",
                      "cu": "Copper"}},
        {"key": "connection_type", "label": "Connection Type", "sequence": 3,
         "filterable": True,
         "values": ["Barbed", "Compression", "Flanged", "Grooved", "Push-Fit", "Socket Weld",
                    "Soldered", "Threaded", "Welded"],
         "synonyms": {"npt": "Threaded", "fnpt": "Threaded", "mnpt": "Threaded",
                      "thrd": "Threaded", "threaded fnpt": "Threaded",
                      "female threaded": "Threaded", "male threaded": "Threaded",
                      "bspp": "Threaded", "bspt": "Threaded", "sweat": "Soldered",
                      "solder": "Soldered", "c x c": "Soldered", "slip": "Socket Weld",
                      "socket": "Socket Weld", "push fit": "Push-Fit",
                      "pushfit": "Push-Fit", "quick connect": "Push-Fit",
                      "comp": "Compression", "grvd": "Grooved", "barb": "Barbed"}},
        {"key": "pressure_class", "label": "Pressure Class", "sequence": 4, "filterable": True,
         "values": ["125#", "150#", "200#", "250#", "300#", "600#", "3000#", "6000#"],
         "synonyms": {"class 150": "150#", "150 lb": "150#", "150lb": "150#",
                      "cl150": "150#", "class 300": "300#", "300 lb": "300#",
                      "cl300": "300#", "class 125": "125#"}},
    ],
}

# Prohibited sources (domain, kind, applies at any TLD)
BLOCKED_SOURCES = [
    ("amazon.com", "marketplace", True), ("ebay.com", "marketplace", True),
    ("walmart.com", "marketplace", False), ("alibaba.com", "marketplace", True),
    ("aliexpress.com", "marketplace", True), ("etsy.com", "marketplace", False),
    ("temu.com", "marketplace", False), ("wayfair.com", "marketplace", False),
    ("homedepot.com", "retailer", False), ("lowes.com", "retailer", False),
    ("grainger.com", "distributor", False), ("mcmaster.com", "distributor", False),
    ("zoro.com", "distributor", False), ("fastenal.com", "distributor", False),
    ("motionindustries.com", "distributor", False),
    ("globalindustrial.com", "distributor", False),
    ("reddit.com", "forum", False), ("quora.com", "forum", False),
    ("wikipedia.org", "encyclopedia", False), ("pinterest.com", "social", False),
]
# Second-level labels that belong to a country suffix
SLD_SUFFIXES = ["co", "com", "net", "org", "gov", "ac"]
# Brand, manufacturer, official domains, URL templates
MANUFACTURERS = [
    ("FRIGIDAIRE", "Electrolux Major Appliances North America", ["frigidaire.com"],
     ["https://www.frigidaire.com/en/p/owner-center/product-support/{mpn}"]),
    ("Whirlpool", "Whirlpool Corporation", ["whirlpool.com", "learnwhirlpool.com"],
     ["https://www.whirlpool.com/products/{mpn}.html"]),
    ("3M", "3M Company", ["3m.com"], []),
    ("TREX", "Trex Company, Inc.", ["trex.com"], []),
    ("Milwaukee", "Milwaukee Tool", ["milwaukeetool.com"],
     ["https://www.milwaukeetool.com/Products/{mpn}"]),
    ("Diablo", "Freud America, Inc.", ["diablotools.com", "freudtools.com"], []),
    ("Kichler", "Kichler Lighting LLC", ["kichler.com"], []),
    ("SKF", "AB SKF", ["skf.com"], ["https://www.skf.com/productinfo/{mpn}"]),
    ("ABB", "ABB Ltd", ["abb.com", "new.abb.com"], []),
    ("Makita", "Makita Corporation", ["makitatools.com", "makita.com"], []),
    ("AZEK", "The AZEK Company", ["azekco.com", "timbertech.com"], []),
    ("TIMBERTECH", "TimberTech", ["timbertech.com"], []),
]

# Brand probe -> (canonical, country, categories made)
BRANDS = {
    "skf": ("SKF", "Sweden", ["31171500"]), "fag": ("FAG", "Germany", ["31171500"]),
    "nsk": ("NSK", "Japan", ["31171500"]), "ntn": ("NTN", "Japan", ["31171500"]),
    "timken": ("Timken", "United States", ["31171500"]),
    "koyo": ("Koyo", "Japan", ["31171500"]),
    "swagelok": ("Swagelok", "United States", ["40141600"]),
    "parker hannifin": ("Parker Hannifin", "United States", ["40141600", "40142000"]),
    "parker": ("Parker Hannifin", "United States", ["40141600", "40142000"]),
    "festo": ("Festo", "Germany", ["40141600"]), "smc": ("SMC", "Japan", ["40141600"]),
    "siemens": ("Siemens", "Germany", ["26101100", "39121000"]),
    "abb": ("ABB", "Switzerland", ["26101100", "39121000"]),
    "weg": ("WEG", "Brazil", ["26101100"]),
    "baldor": ("Baldor", "United States", ["26101100"]),
    "bosch rexroth": ("Bosch Rexroth", "Germany", ["31161500"]),
    "wurth": ("Wurth", "Germany", ["31161500"]),
    "hilti": ("Hilti", "Liechtenstein", ["31161500"]),
    "ifm electronic": ("ifm electronic", "Germany", ["41111700"]),
    "pepperlfuchs": ("Pepperl+Fuchs", "Germany", ["41111700"]),
    "banner engineering": ("Banner Engineering", "United States", ["41111700"]),
    "grundfos": ("Grundfos", "Denmark", ["40151500"]),
    "ksb": ("KSB", "Germany", ["40151500"]),
    "3m": ("3M", "United States", ["46181500"]),
    "ansell": ("Ansell", "Australia", ["46181500"]),
    "honeywell": ("Honeywell", "United States", ["46181500"]),
    "sandvik coromant": ("Sandvik Coromant", "Sweden", ["27112700"]),
    "kennametal": ("Kennametal", "United States", ["27112700"]),
    "iscar": ("ISCAR", "Israel", ["27112700"]),
    "schneider electric": ("Schneider Electric", "France", ["39121000"]),
    "danfoss": ("Danfoss", "Denmark", ["39121000"]),
    "gates": ("Gates", "United States", ["40142000"]),
    "eaton": ("Eaton", "Ireland", ["40142000"]),
}

# Bearing designation -> bore, outer diameter, width (mm), C, C0 (kN), rpm
SERIES = {
    "6200": (10, 30, 9, 5.1, 2.36, 32000), "6202": (15, 35, 11, 7.8, 3.75, 24000),
    "6203": (17, 40, 12, 9.6, 4.75, 20000), "6204": (20, 47, 14, 12.7, 6.55, 18000),
    "6205": (25, 52, 15, 14.0, 7.8, 16000), "6208": (40, 80, 18, 32.5, 19.0, 10000),
    "6210": (50, 90, 20, 35.1, 23.2, 9000), "6300": (10, 35, 11, 8.1, 3.4, 30000),
    "6301": (12, 37, 12, 9.75, 4.15, 26000), "6302": (15, 42, 13, 11.4, 5.4, 24000),
    "6304": (20, 52, 15, 15.9, 7.8, 18000), "6305": (25, 62, 17, 22.5, 11.6, 15000),
}
SERIES_KEYS = ["bore_diameter", "outer_diameter", "width", "dynamic_load_rating",
               "static_load_rating", "max_speed"]
# Property class -> minimum tensile strength (MPa)
GRADES = {"4.6": 400, "8.8": 800, "10.9": 1000, "12.9": 1200, "Grade 2": 510,
          "Grade 5": 827, "Grade 8": 1034, "A2-70": 700, "A4-80": 800}


def _num(key, label, unit, group, rng=None, aliases=()):
    return {"key": key, "label": label, "type": "number", "unit": unit, "group": group,
            "values": [], "range": rng, "aliases": list(aliases)}


def _enum(key, label, group, values, aliases=()):
    return {"key": key, "label": label, "type": "enum", "unit": None, "group": group,
            "values": values, "range": None, "aliases": list(aliases)}


def _txt(key, label, group, aliases=(), kind="text"):
    return {"key": key, "label": label, "type": kind, "unit": None, "group": group,
            "values": [], "range": None, "aliases": list(aliases)}


# Category schemas
CATEGORIES = [
    {"code": "31171500", "noun": "Ball Bearing",
     "path": ["Industrial Components", "Bearings & Power Transmission", "Rolling Element Bearings"],
     "keywords": ["bearing", "ball bearing", "deep groove"],
     "mpn_patterns": [r"6[0-9]{3}(?![0-9])"], "required": ["brand", "mpn", "bore_diameter",
                                                          "outer_diameter", "width"],
     "cross_checks": ["bore_lt_od", "static_vs_dynamic", "sealed_speed"],
     "attributes": [
         _num("bore_diameter", "Bore Diameter", "mm", "Dimensions", (1, 1000), ["bore", "inner diameter", "id", "d"]),
         _num("outer_diameter", "Outer Diameter", "mm", "Dimensions", (3, 2000), ["od", "outside diameter"]),
         _num("width", "Width", "mm", "Dimensions", (1, 500), ["thickness"]),
         _enum("seal_type", "Seal Type", "Construction", ["Open", "2RS (Rubber Sealed)", "ZZ (Metal Shielded)"], ["sealing", "closure"]),
         _txt("material", "Ring Material", "Materials"),
         _enum("cage_material", "Cage Material", "Materials", ["Steel", "Brass", "Polyamide"], ["cage"]),
         _num("dynamic_load_rating", "Dynamic Load Rating (C)", "kN", "Performance", (0.1, 5000), ["dynamic load rating", "basic dynamic load"]),
         _num("static_load_rating", "Static Load Rating (C0)", "kN", "Performance", (0.05, 5000), ["static load rating", "basic static load"]),
         _num("max_speed", "Limiting Speed", "rpm", "Performance", (10, 200000), ["speed limit"]),
         _num("operating_temp_max", "Max Operating Temperature", "C", "Performance", (-50, 400), []),
         _txt("precision_class", "Precision Class", "Standards")],
     "defaults": {"material": "Chrome Steel (GCr15/52100)", "cage_material": "Steel",
                  "operating_temp_max": 120, "precision_class": "ABEC-1 / P0"}},
    {"code": "31161500", "noun": "Bolt",
     "path": ["Industrial Components", "Hardware", "Fasteners"],
     "keywords": ["fastener", "bolt", "hex bolt", "screw"],
     "mpn_patterns": [r"M[0-9]{1,2}x[0-9]+"],
     "required": ["brand", "mpn", "thread_size", "length", "material"],
     "cross_checks": ["stainless_grade", "grade_tensile"],
     "attributes": [
         _enum("fastener_type", "Fastener Type", "Configuration", ["Hex Bolt", "Socket Cap Screw", "Machine Screw", "Hex Nut"], []),
         _txt("thread_size", "Thread Size", "Dimensions", ["thread"]),
         _num("thread_pitch", "Thread Pitch", "mm", "Dimensions", (0.2, 10), ["pitch"]),
         _num("length", "Length", "mm", "Dimensions", (1, 1000), []),
         _txt("material", "Material", "Materials"),
         _enum("grade", "Grade / Property Class", "Standards", list(GRADES), ["property class", "strength class"]),
         _enum("finish", "Finish", "Materials", ["Plain", "Zinc Plated", "Passivated", "Hot Dip Galvanized"], []),
         _enum("drive_type", "Drive Type", "Configuration", ["External Hex", "Hex", "Torx", "Phillips"], []),
         _num("tensile_strength", "Tensile Strength", "MPa", "Performance", (100, 2500), []),
         _txt("standard", "Standard", "Standards")],
     "defaults": {"finish": "Plain", "standard": "ISO 4014"}},
    {"code": "40141600", "noun": "Valve",
     "path": ["Industrial Components", "Fluid Handling", "Industrial Valves"],
     "keywords": ["valve", "ball valve", "butterfly valve", "globe valve"],
     "mpn_patterns": [], "required": ["brand", "mpn", "nominal_size", "body_material", "pressure_rating"],
     "cross_checks": ["pvc_temp", "ptfe_temp", "brass_pressure"],
     "attributes": [
         _enum("valve_type", "Valve Type", "Configuration", ["Ball", "Butterfly", "Globe", "Gate", "Check", "Needle"], []),
         _num("nominal_size", "Nominal Size", "in", "Dimensions", (0.125, 60), ["size", "port size"]),
         _num("pressure_rating", "Pressure Rating", "psi", "Performance", (1, 20000), ["working pressure", "max pressure"]),
         _enum("body_material", "Body Material", "Materials", ["316 Stainless Steel", "304 Stainless Steel", "Brass", "Carbon Steel", "Bronze", "PVC", "Cast Iron", "Ductile Iron"], ["body"]),
         _enum("seat_material", "Seat Material", "Materials", ["PTFE", "EPDM", "Metal", "NBR"], ["seat"]),
         _enum("connection_type", "Connection Type", "Configuration", ["NPT Threaded", "Flanged", "Socket Weld", "Compression"], ["end connection"]),
         _enum("actuation", "Actuation", "Configuration", ["Manual Lever", "Manual Gear", "Pneumatic", "Electric"], []),
         _enum("port_configuration", "Port Configuration", "Configuration", ["2-Way", "3-Way", "4-Way"], []),
         _num("temp_rating_max", "Max Temperature", "C", "Performance", (-200, 1000), ["temperature rating"]),
         _num("cv_value", "Flow Coefficient (Cv)", None, "Performance", (0.01, 100000), ["cv"])],
     "defaults": {"actuation": "Manual Lever", "connection_type": "NPT Threaded",
                  "port_configuration": "2-Way", "seat_material": "PTFE"}},
    {"code": "26101100", "noun": "Electric Motor",
     "path": ["Industrial Components", "Power & Motion", "Electric Motors"],
     "keywords": ["motor", "induction motor", "electric motor"],
     "mpn_patterns": [], "required": ["brand", "mpn", "power_rating", "voltage", "speed", "frame_size"],
     "cross_checks": ["motor_power_current", "motor_pole_speed", "ip_plausible"],
     "attributes": [
         _num("power_rating", "Power Rating", "kW", "Performance", (0.01, 20000), ["power", "output power"]),
         _num("voltage", "Rated Voltage", "V", "Electrical", (1, 15000), ["voltage", "volts"]),
         _enum("phase", "Phase", "Electrical", ["Single Phase", "Three Phase"], ["phases"]),
         _num("frequency", "Frequency", "Hz", "Electrical", (1, 1000), []),
         _num("speed", "Rated Speed", "rpm", "Performance", (1, 60000), ["speed"]),
         _txt("frame_size", "Frame Size", "Mechanical", ["frame"]),
         _enum("efficiency_class", "Efficiency Class", "Performance", ["IE1 (Standard)", "IE2 (High)", "IE3 (Premium)", "IE4 (Super Premium)"], ["efficiency"]),
         _enum("enclosure", "Enclosure Type", "Mechanical", ["TEFC", "ODP", "TENV", "Explosion Proof"], ["enclosure"]),
         _enum("insulation_class", "Insulation Class", "Electrical", ["Class B", "Class F", "Class H"], ["insulation"]),
         _enum("mounting", "Mounting", "Mechanical", ["Foot (B3)", "Flange (B5)", "Foot & Flange (B35)"], []),
         _txt("ip_rating", "Ingress Protection", "Mechanical", ["ip rating"]),
         _num("full_load_current", "Full Load Current", "A", "Electrical", (0.05, 2000), ["rated current"])],
     "defaults": {"frequency": 60, "enclosure": "TEFC", "insulation_class": "Class F",
                  "mounting": "Foot (B3)", "efficiency_class": "IE3 (Premium)", "ip_rating": "IP55"}},
    {"code": "40151500", "noun": "Pump",
     "path": ["Industrial Components", "Fluid Handling", "Industrial Pumps"],
     "keywords": ["pump", "centrifugal pump", "gear pump"],
     "mpn_patterns": [], "required": ["brand", "mpn", "flow_rate", "max_head", "power_rating"],
     "cross_checks": ["pump_ports", "pp_temp"],
     "attributes": [
         _enum("pump_type", "Pump Type", "Configuration", ["Centrifugal", "Diaphragm (AODD)", "Gear", "Peristaltic"], []),
         _num("flow_rate", "Max Flow Rate", "L/min", "Performance", (0.01, 500000), ["flow", "flow rate", "capacity"]),
         _num("max_head", "Max Head", "m", "Performance", (0.1, 5000), ["head"]),
         _num("power_rating", "Motor Power", "kW", "Performance", (0.01, 20000), ["power", "power rating"]),
         _num("inlet_size", "Inlet Size", "in", "Dimensions", (0.1, 60), ["suction size"]),
         _num("outlet_size", "Outlet Size", "in", "Dimensions", (0.1, 60), ["discharge size"]),
         _txt("body_material", "Wetted Material", "Materials", ["body material"]),
         _enum("seal_type", "Seal Type", "Construction", ["Mechanical Seal", "Lip Seal", "Packed Gland"], []),
         _num("max_temp", "Max Fluid Temperature", "C", "Performance", (-100, 500), []),
         _txt("self_priming", "Self Priming", "Configuration", [], "boolean")],
     "defaults": {"seal_type": "Lip Seal"}},
    {"code": "39121000", "noun": "Drive",
     "path": ["Industrial Components", "Electrical", "Drives & Controls"],
     "keywords": ["variable frequency drive", "servo drive", "soft starter", "vfd"],
     "mpn_patterns": [], "required": ["brand", "mpn", "power_rating", "input_voltage"],
     "cross_checks": ["ip_plausible"],
     "attributes": [
         _enum("device_type", "Device Type", "Configuration", ["Variable Frequency Drive", "Servo Drive", "Soft Starter"], []),
         _num("power_rating", "Power Rating", "kW", "Performance", (0.01, 20000), ["power"]),
         _txt("input_voltage", "Input Voltage", "Electrical", ["input"]),
         _num("output_current", "Rated Output Current", "A", "Electrical", (0.1, 5000), ["output current"]),
         _enum("phase", "Input Phase", "Electrical", ["Single Phase", "Three Phase"], []),
         _enum("control_method", "Control Method", "Configuration", ["V/f Scalar", "Sensorless Vector", "Closed Loop Vector", "Servo"], []),
         _enum("communication", "Communication Protocol", "Connectivity", ["Modbus RTU", "EtherCAT", "PROFINET", "EtherNet/IP"], ["protocol"]),
         _txt("ip_rating", "Ingress Protection", "Mechanical", ["ip rating"]),
         _txt("overload_capacity", "Overload Capacity", "Performance")],
     "defaults": {"control_method": "Sensorless Vector", "communication": "Modbus RTU",
                  "overload_capacity": "150% for 60s"}},
    {"code": "27112700", "noun": "Cutting Tool",
     "path": ["Industrial Components", "Tooling", "Cutting Tools"],
     "keywords": ["end mill", "drill bit", "carbide", "ball nose"],
     "mpn_patterns": [], "required": ["brand", "mpn", "cutting_diameter", "flute_count", "material"],
     "cross_checks": ["flute_vs_overall"],
     "attributes": [
         _enum("tool_type", "Tool Type", "Configuration", ["End Mill", "Drill Bit", "Ball Nose End Mill", "Reamer"], []),
         _num("cutting_diameter", "Cutting Diameter", "mm", "Dimensions", (0.05, 500), ["diameter"]),
         _num("shank_diameter", "Shank Diameter", "mm", "Dimensions", (0.5, 200), ["shank"]),
         _num("overall_length", "Overall Length", "mm", "Dimensions", (5, 1500), ["oal"]),
         _num("flute_length", "Flute Length", "mm", "Dimensions", (0.5, 1000), ["length of cut"]),
         _num("flute_count", "Number of Flutes", None, "Configuration", (1, 30), ["flutes"]),
         _enum("material", "Tool Material", "Materials", ["Solid Carbide", "HSS", "HSS-Co (Cobalt)"], ["material"]),
         _enum("coating", "Coating", "Materials", ["TiN", "TiAlN", "AlTiN", "Uncoated"], []),
         _num("helix_angle", "Helix Angle", "deg", "Geometry", (0, 90), ["helix"])],
     "defaults": {}},
    {"code": "41111700", "noun": "Sensor",
     "path": ["Industrial Components", "Instrumentation", "Sensors & Transmitters"],
     "keywords": ["sensor", "pressure sensor", "proximity", "rtd", "transmitter"],
     "mpn_patterns": [], "required": ["brand", "mpn", "measuring_range", "output_signal", "supply_voltage"],
     "cross_checks": ["ip_plausible"],
     "attributes": [
         _enum("sensor_type", "Sensor Type", "Configuration", ["Inductive Proximity", "Capacitive Proximity", "Pressure", "Temperature (RTD)"], []),
         _txt("measuring_range", "Measuring Range", "Performance", ["sensing distance", "range"]),
         _enum("output_signal", "Output Signal", "Electrical", ["PNP Discrete", "NPN Discrete", "4-20 mA", "0-10 V"], ["output"]),
         _txt("supply_voltage", "Supply Voltage", "Electrical", ["supply"]),
         _txt("ip_rating", "Ingress Protection", "Mechanical", ["ip rating"]),
         _txt("housing_material", "Housing Material", "Materials", ["housing"]),
         _num("response_time", "Response Time", "ms", "Performance", (0.001, 60000), []),
         _num("operating_temp_max", "Max Operating Temperature", "C", "Performance", (-50, 1000), []),
         _txt("accuracy", "Accuracy", "Performance"),
         _txt("process_connection", "Process Connection", "Mechanical")],
     "defaults": {}},
    {"code": "40142000", "noun": "Hydraulic Hose",
     "path": ["Industrial Components", "Fluid Handling", "Hose & Fittings"],
     "keywords": ["hose", "hydraulic hose"],
     "mpn_patterns": [], "required": ["brand", "mpn", "inner_diameter", "working_pressure"],
     "cross_checks": ["burst_vs_working", "hose_id_od"],
     "attributes": [
         _num("inner_diameter", "Inner Diameter", "mm", "Dimensions", (1, 500), ["id", "inside diameter"]),
         _num("outer_diameter", "Outer Diameter", "mm", "Dimensions", (2, 600), ["od", "outside diameter"]),
         _num("working_pressure", "Working Pressure", "bar", "Performance", (0.5, 2000), ["max working pressure"]),
         _num("burst_pressure", "Burst Pressure", "bar", "Performance", (1, 8000), ["min burst pressure"]),
         _txt("material", "Tube Material", "Materials", ["material"]),
         _enum("reinforcement", "Reinforcement", "Construction", ["1-Wire Braid", "2-Wire Braid", "4-Wire Spiral", "Textile Braid"], []),
         _num("bend_radius", "Min Bend Radius", "mm", "Dimensions", (1, 5000), ["bend radius"]),
         _txt("temp_range", "Temperature Range", "Performance"),
         _txt("standard", "Standard", "Standards")],
     "defaults": {"material": "Synthetic Rubber (NBR)"}},
    {"code": "46181500", "noun": "Protective Equipment",
     "path": ["Safety & Facility", "Personal Protective Equipment", "Protective Equipment"],
     "keywords": ["ppe", "safety", "hard hat", "respirator", "gloves"],
     "mpn_patterns": [], "required": ["brand", "mpn", "size", "standard"],
     "cross_checks": [],
     "attributes": [
         _enum("ppe_type", "PPE Type", "Configuration", ["Safety Gloves", "Hard Hat", "Safety Goggles", "Respirator", "Ear Protection", "Fall Harness", "Face Shield", "Safety Footwear"], []),
         _txt("size", "Size", "Fit"),
         _txt("material", "Material", "Materials"),
         _txt("standard", "Standard / Certification", "Standards", ["standard", "certification"]),
         _txt("protection_level", "Protection Level", "Performance"),
         _txt("color", "Color", "Appearance", ["colour"]),
         _txt("reusable", "Reusable", "Configuration", [], "boolean")],
     "defaults": {"reusable": True}},
]
