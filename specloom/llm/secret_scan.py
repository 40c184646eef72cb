"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov chains over the characters of tokens are trained from labelled samples:
one from random strings (digests written in base 64 and in hex, and values the patterns found),
one from ordinary tokens of the corpus.  A long token is a secret if its mean log-likelihood
ratio per transition exceeds the threshold.  Only DataFrame functions are used; the model is a
table of (alphabet size)^2 numbers.

Training reads about ``train_docs`` documents of each label at most, chosen by a hash of the text.

A span is (kind, start, end) in code points, end exclusive.  Pattern spans are leftmost and
non-overlapping within a kind; matches that are too short are dropped after matching.  Pattern
spans are cut out of a token, and only transitions that touch what remains are counted: the runs
that remain are Markov spans if their common mean exceeds the threshold, a run as long as a token
also if its own mean does.

Defined results: null text is empty and has no spans; repeated rows are scanned each; empty
tables give empty results; other columns are kept (``scan``
replaces columns of the names it adds, ``redact`` none).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .shared import aside

# Kinds, patterns and least lengths of the scan's contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "markov"]

#: The same runs as HEX and ACCESS, the short ones left out while matching: a run is taken from its first place, so no other match begins inside one.
LONG_ACCESS = r"AKIA[A-Z0-9]{14,}"
LONG_HEX = r"[0-9a-f]{16,}"
TOKEN_CHARS = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{TOKEN_CHARS},}}={{0,2}}"
ORDINARY = r"[A-Za-z0-9+/_-]{4,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
TRAIN_DOCS = 4000
GENERATED = 4000
THRESHOLD = 0.4
SMOOTHING = 0.5
#: Matches whose lengths are summed directly; longer lists are summed block by block.
BLOCK = 64
MASK = "[SECRET]"
ADDED = ["spans"]


def _ends(lengths: Column) -> Column:
    """Running sums of an array, in two levels."""
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")),
                         lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x))
    starts = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(starts, F.floor(i / BLOCK).cast("int") + 1) + F.aggregate(
        F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1), F.lit(0), lambda a, x: a + x))


def _matches(df: DataFrame, name: str, pattern: str, keep: Column | None = None) -> DataFrame:
    """Add column ``name``: array of (start, rank, end, value) of the pattern in ``__text``."""
    rank = KINDS.index(name)
    p = F.lit(pattern)
    kind = "array<struct<start:int,rank:int,end:int,value:string>>"
    hit = F.rlike("__text", p)
    df = (df.withColumn("__m", F.when(hit, F.regexp_extract_all("__text", p, F.lit(0))))
          .withColumn("__g", F.when(F.col("__m").isNotNull(), F.split("__text", pattern, -1)))
          .withColumn("__e", F.when(F.size("__m") > 0, _ends(F.transform("__m", lambda m, i: F.length(m) + F.length(F.get("__g", i)))))))
    value = (lambda m: F.regexp_extract(m, pattern, 2)) if name == "assign" else (lambda m: m)
    spans = F.transform("__m", lambda m, i: F.struct((F.get("__e", i) - F.length(m)).alias("start"), F.lit(rank).alias("rank"),
                                                     F.get("__e", i).alias("end"), value(m).alias("value")))
    if name == "assign":
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= 12)
    return df.withColumn(name, F.when(F.col("__m").isNotNull(), spans).otherwise(F.array().cast(kind))).drop("__m", "__g", "__e")


def with_patterns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with __text (never null) and the pattern spans as columns assign, access and hex."""
    df = docs.drop("__text", *KINDS).withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    for name, pattern in (("assign", ASSIGN), ("access", LONG_ACCESS), ("hex", LONG_HEX)):
        df = _matches(df, name, pattern)
    return df


def _transitions(tokens: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of character pairs, by place in ALPHABET (from 1), over a column ``token``."""
    chars = F.transform(F.filter(F.split("token", ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = tokens.select(chars.alias("c")).select(F.explode(F.arrays_zip(
        F.slice("c", F.lit(1), F.greatest(F.size("c") - 1, F.lit(0))).alias("a"), F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))).alias("b"))).alias("p"))
    return {(r[0], r[1]): r[2] for r in pairs.groupBy("p.a", "p.b").count().where("a > 0 AND b > 0").collect()}


def ratios(random: dict, ordinary: dict, smoothing: float = SMOOTHING) -> list[float]:
    """Log-likelihood ratio of each transition, row by row of the alphabet."""
    size = len(ALPHABET)

    def logs(counts):
        rows = [[counts.get((a, b), 0) + smoothing for b in range(1, size + 1)] for a in range(1, size + 1)]
        return [[math.log(x / sum(row)) for x in row] for row in rows]

    return [round(r - o, 6) for a, b in zip(logs(random), logs(ordinary)) for r, o in zip(a, b)]


def train(docs: DataFrame, text_col: str = "text", train_docs: int = TRAIN_DOCS) -> list[float]:
    """Transition ratios from labelled samples; without any text, from generated strings and no ordinary ones."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    has = F.rlike("text", F.lit(ASSIGN)) | F.rlike("text", F.lit(LONG_ACCESS)) | F.rlike("text", F.lit(LONG_HEX))
    n, n_has = texts.agg(F.count("*"), F.count_if(has)).first()
    share = lambda of: F.pmod(F.xxhash64("text"), F.lit(1 << 24)) < int((1 << 24) * min(1.0, train_docs / max(of, 1)))
    patterned = with_patterns(texts.where(share(n_has)).where(has))
    found = patterned.select(F.explode(F.concat("assign", "access", "hex")).alias("s")).select(F.col("s.value").alias("token")).distinct()
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    made = docs.sparkSession.range(GENERATED).select(F.when(F.col("id") % 4 == 0, digest).otherwise(F.base64(F.unhex(digest))).alias("token"))
    bare = texts.where(share(n)).select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("token")).distinct()
    ordinary = bare.join(found, "token", "left_anti").where(~F.rlike("token", F.lit(f"^({LONG_HEX}|{LONG_ACCESS})$")))
    return ratios(_transitions(found.unionByName(made)), _transitions(ordinary))


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with pattern spans (assign, access, hex), markov spans and all of them in order (spans)."""
    size = len(ALPHABET)
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    df = _matches(with_patterns(docs.drop(*ADDED), text_col), "markov", TOKEN)

    def total(token):
        chars = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        pairs = F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda a, b: F.get(table, a * size + b))
        return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)

    def remaining(s):
        """What pattern spans leave of a token, as (start, end)."""
        touching = F.array_sort(F.filter(F.concat("assign", "access", "hex"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        runs = lambda acc, end: F.when(end > acc["at"], F.concat(acc["runs"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))).otherwise(acc["runs"])
        zero = F.struct(s["start"].alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("runs"))
        return F.aggregate(touching, zero, lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), runs(acc, b["start"]).alias("runs")),
                           lambda acc: runs(acc, s["end"]))

    def weighed(s):
        """The remaining runs of a token with the sum and number of the transitions that touch them."""
        def weigh(r):
            first, last = F.greatest(r["start"] - 1, s["start"]), F.least(r["end"] + 1, s["end"])
            return F.struct(r["start"].alias("start"), F.lit(KINDS.index("markov")).alias("rank"), r["end"].alias("end"),
                            F.substring(s["value"], r["start"] - s["start"] + 1, r["end"] - r["start"]).alias("value"),
                            total(F.substring(s["value"], first - s["start"] + 1, last - first)).alias("sum"), (last - first - 1).alias("n"))
        return F.transform(remaining(s), weigh)

    def mean(runs):
        return F.aggregate(runs, F.lit(0.0), lambda a, r: a + r["sum"]) / F.aggregate(runs, F.lit(0), lambda a, r: a + r["n"])

    tokens = F.transform(F.filter(F.transform("markov", weighed), lambda runs: F.size(runs) > 0), lambda runs: F.struct(runs.alias("runs"), mean(runs).alias("mean")))
    secret = F.flatten(F.transform(tokens, lambda t: F.filter(t["runs"], lambda r: (t["mean"] > threshold) | (
        (r["end"] - r["start"] >= TOKEN_CHARS) & (r["sum"] / r["n"] > threshold)))))
    spans = F.transform(secret, lambda r: F.struct(*[r[c].alias(c) for c in ("start", "rank", "end", "value")]))
    df = df.withColumn("markov", F.when(F.size("markov") > 0, spans).otherwise(F.col("markov")))
    return df.withColumn("spans", F.array_sort(F.concat("assign", "access", "hex", "markov")))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span, or run of spans that overlap, replaced by MASK; other columns as they are, whatever their names."""
    return aside(docs, [text_col, "n_chars"], lambda df: _redacted(df, model, text_col, threshold))


def _redacted(docs: DataFrame, model: list[float], text_col: str, threshold: float) -> DataFrame:
    df = scan(docs, model, threshold, text_col)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        ahead = s["start"] >= acc["at"]
        piece = F.array(F.substring("__text", acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(ahead, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", start, step)
    df = df.withColumn("__done", F.when(F.size("spans") > 0, done))
    clean = F.concat(F.array_join("__done.out", ""), F.substring("__text", F.col("__done.at") + 1, F.length("__text")))
    df = df.withColumn(text_col, F.when(F.col("__done").isNotNull(), clean).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.col("__done").isNotNull(), F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])
