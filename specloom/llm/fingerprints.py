"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (line) is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors, modulo 2^32.  Sums do not depend on order, and the fingerprint of
an edited document follows from the old one by subtracting what went and adding what came.

The vector of a paragraph has two parts.  EXACT lanes hold hashes of the whole paragraph: equal
multisets of paragraphs have equal sums.  NEAR lanes hold the sum of +1/-1 vectors of the
paragraph's pieces: the cosine of two such sums estimates how much of the two documents is the
same.  A paragraph is cut after words chosen by their own hash, and after eight words at most, and
a piece is two runs that follow each other: after a word that came or went, the cuts fall back
into step at the next chosen word.  A +1/-1 vector is the bits of one 64-bit hash; two bits of it are counted in one addition, in the halves of a long.

Only DataFrame functions are used.  Edited texts need the next document in order of id: rows are
dealt to ranges of ids whose bounds are documents' ids, and the first document of each range is
sent to the range before as well.

Defined results: null text is empty; an empty text has the zero fingerprint, which is alike to
itself (1) and to nothing else (0); rows that repeat an id follow each other in order of text; a
null id comes first; a document alone is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

WORD = r"[^\s]+"
RUN = r"[^\s]+(?: [^\s]+){0,7}"
#: One word in so many ends a run.
CUT = 4
EXACT = 8
HALVES = 32
LOW = (1 << 32) + 1
MASK = (1 << 32) - 1
#: Rows of a range of ids.
RANGE_ROWS = 5000
MAX_RANGES = 10_000


def parts(text: Column) -> Column:
    """Hashes of paragraphs and of pieces."""
    lines = F.filter(F.split(text, "\n"), lambda p: p != "")
    cut = lambda w: F.concat(w, F.when(F.pmod(F.xxhash64(w), F.lit(CUT)) == 0, F.lit("\n")).otherwise(F.lit(" ")))
    runs = F.transform(lines, lambda p: F.regexp_extract_all(F.array_join(F.transform(F.regexp_extract_all(p, F.lit(WORD), F.lit(0)), cut), ""), F.lit(RUN), F.lit(0)))
    pieces = F.flatten(F.transform(runs, lambda r: F.zip_with(r, F.slice(r, F.lit(2), F.size(r)), lambda x, y: F.xxhash64(x, y))))
    return F.struct(F.transform(lines, lambda p: F.xxhash64(p)).alias("lines"), pieces.alias("pieces"))


def summed(p: Column) -> Column:
    """The fingerprint vector: exact lanes, then packed counts of set bits, then the number of pieces."""
    zero = F.lit(0).cast("long")

    def exact(k: int) -> Column:
        half = F.aggregate(p["lines"], zero, lambda a, h: a + F.shiftrightunsigned(F.xxhash64(h, F.lit(k // 2)), 32 * (k % 2)).bitwiseAND(F.lit(MASK)))
        return half.bitwiseAND(F.lit(MASK))

    def near(s: int) -> Column:
        return F.aggregate(p["pieces"], zero, lambda a, h: a + F.shiftrightunsigned(h, s).bitwiseAND(F.lit(LOW)))

    return F.array(*map(exact, range(EXACT)), *map(near, range(HALVES)), F.size(p["pieces"]).cast("long"))


def plus(a: Column, b: Column) -> Column:
    """Fingerprint vector of two documents' paragraphs together."""
    return F.zip_with(F.transform(a, _with_place), b, lambda x, y: F.when(x["i"] < EXACT, (x["x"] + y).bitwiseAND(F.lit(MASK))).otherwise(x["x"] + y))


def minus(a: Column, b: Column) -> Column:
    """Fingerprint vector of a document without paragraphs that it holds."""
    return F.zip_with(F.transform(a, _with_place), b, lambda x, y: F.when(x["i"] < EXACT, (x["x"] - y).bitwiseAND(F.lit(MASK))).otherwise(x["x"] - y))


def _with_place(x: Column, i: Column) -> Column:
    return F.struct(x.alias("x"), i.alias("i"))


def lanes(v: Column) -> Column:
    """The signed near lanes of a vector, as doubles."""
    n = F.element_at(v, -1)
    packed = F.slice(v, EXACT + 1, HALVES)
    low = F.transform(packed, lambda x: (2 * x.bitwiseAND(F.lit(MASK)) - n).cast("double"))
    high = F.transform(packed, lambda x: (2 * F.shiftrightunsigned(x, 32) - n).cast("double"))
    return F.concat(low, high)


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two arrays of lanes, from 0 to 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(a == b, F.lit(1.0)).when(norms > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norms))).otherwise(F.lit(0.0))


def written(v: Column) -> Column:
    """A fingerprint vector as lower-case hex."""
    return F.lower(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (never null) and next_text, the text of the next document by id; after the last, the first."""
    least = -(1 << 63)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("__key"))
    count, low = rows.agg(F.count("*"), F.min("__key")).first()
    n = max(1, min(MAX_RANGES, count // RANGE_ROWS))
    inner = rows.agg(F.percentile_approx("__key", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    bounds = sorted({low if low is not None else least, *(inner or [])})
    first = F.array(*[F.lit(b).cast("long") for b in bounds]) if len(bounds) < 200 else F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    # The range is found by halving the sorted bounds.
    steps = max(1, len(bounds)).bit_length()
    at = F.lit(0)
    for k in reversed(range(steps)):
        at = at + F.when(F.get(first, at + (1 << k)) <= F.col("__key"), F.lit(1 << k)).otherwise(F.lit(0))
    rows = rows.withColumn("__range", at)
    # The first document of a range also ends the range before; that of the first range ends the last.
    leads = F.col("__key") == F.get(first, F.col("__range"))
    before = F.pmod(F.col("__range") - 1, F.lit(len(bounds)))
    rows = rows.withColumn("__place", F.explode(F.when(leads, F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("guest")),
                                                                         F.struct(before.alias("r"), F.lit(1).alias("guest"))))
                                                .otherwise(F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("guest"))))))
    order = Window.partitionBy("__place.r").orderBy("__place.guest", "__key", "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).where("__place.guest = 0").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its edited text, both fingerprint vectors, and the vector of the next document.

    In the edited text the last quarter of the code points is replaced by the first as many of
    the next document.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next_text", F.lit(1), quarter)))
    for name in ("text", "edited", "next_text"):
        rows = rows.withColumn(f"__{name}", parts(F.col(name)))
    return rows.select("doc_id", "n_chars", "text", "edited", summed(F.col("__text")).alias("vector"),
                       summed(F.col("__edited")).alias("edited_vector"), summed(F.col("__next_text")).alias("next_vector"))
