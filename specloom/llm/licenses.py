"""License scan with a positional index of rare words.

Licence texts are known by phrases; a template is a label and the phrases that must all occur.
Document frequencies of all words of the phrases are counted over all documents, and every
phrase is indexed under its two rarest words with their places in it.  A document is read for
such words only if it holds one; an occurrence proposes a start for each phrase posted under the
word, the proposals of the two rare words are intersected, and what is left is verified word by
word.  As every occurrence of a phrase holds both rare words at these places, none is missed.

Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters, counted from 0.  Only
DataFrame functions are used; the only shuffle is the count of word frequencies.

Defined results: null text is empty and has no words; repeated rows are scanned each; an empty
table gives an empty result; other columns are kept (columns the scan adds are replaced).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

# Words, base phrases and labels of the scan's contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further templates: label and the phrases that must all occur.
TEMPLATES = [
    ("mit", ["permission is hereby granted free of charge to any person obtaining a copy"]),
    ("bsd", ["redistribution and use in source and binary forms with or without modification are permitted"]),
    ("bsd", ["bsd license"]),
    ("isc", ["isc license"]),
    ("lgpl", ["gnu lesser general public license"]),
    ("agpl", ["gnu affero general public license"]),
    ("gpl-2.0", ["gnu general public license version 2"]),
    ("gpl-3.0", ["gnu general public license version 3"]),
    ("gpl-or-later", ["gnu general public license", "any later version"]),
    ("apache-2.0", ["apache license version 2 0"]),
    ("mpl", ["mozilla public license"]),
    ("epl", ["eclipse public license"]),
    ("boost", ["boost software license"]),
    ("cc-by-sa", ["cc by sa"]),
    ("cc-by-nc", ["cc by nc"]),
    ("cc-by-nd", ["cc by nd"]),
    ("cc-by", ["creative commons attribution"]),
    ("cc0", ["cc0 1 0 universal"]),
    ("unlicense", ["free and unencumbered software released into the public domain"]),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ["n_words", "places", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def phrases(templates=TEMPLATES) -> list[str]:
    """All phrases, those of the base first."""
    return list(dict.fromkeys([*BASE, *(p for _, needed in templates for p in needed)]))


def frequencies(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> dict[str, int]:
    """In how many documents each word of the phrases occurs."""
    vocabulary = sorted({w for p in phrases(templates) for w in p.split()})
    words = F.regexp_extract_all(F.lower(text_col), F.lit(WORD), F.lit(0))
    found = F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), words)
    counts = docs.where(F.col(text_col).isNotNull()).select(F.explode(found).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r[0]: r[1] for r in counts}


def rare_words(phrase: str, counts: dict[str, int]) -> tuple[str, str]:
    """The two rarest words of a phrase (the same twice if it has but one)."""
    ranked = sorted(set(phrase.split()), key=lambda w: (counts[w], w))
    return ranked[0], ranked[min(1, len(ranked) - 1)]


def _postings(known: list[str], words: list[str]) -> Column:
    """Map of a rare word to the (phrase, offset) pairs posted under it."""
    by: dict[str, list] = {}
    for k, (phrase, word) in enumerate(zip(known, words)):
        by.setdefault(word, []).append(F.struct(F.lit(k).alias("phrase"), F.lit(phrase.split().index(word)).alias("offset")))
    return F.create_map(*[x for word, posts in by.items() for x in (F.lit(word), F.array(*posts))])


def scan(docs: DataFrame, counts: dict[str, int], templates=TEMPLATES, text_col: str = "text") -> DataFrame:
    """``docs`` with words, verified places (phrase number, start word), labels and score.

    The score is the share of the words that licence phrases cover, at most 1.
    """
    known = phrases(templates)
    rare = [rare_words(p, counts) for p in known]
    first, second = _postings(known, [r[0] for r in rare]), _postings(known, [r[1] for r in rare])
    texts = F.array(*[F.array(*[F.lit(w) for w in p.split()]) for p in known])
    df = docs.drop(*ADDED, "__low", "__words", "__hits", "__found").withColumn("n_words", F.coalesce(
        F.regexp_count(text_col, F.lit(WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"))), F.lit(0)).cast("long"))
    # Both rare words of a phrase have to be there, as words or within words; most texts end here.
    df = df.withColumn("__low", F.lower(text_col))
    holds = reduce(or_, [F.col("__low").contains(a) & F.col("__low").contains(b) for a, b in sorted(set(rare))])
    words = F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(WORD), F.lit(0))
    df = df.withColumn("__words", F.when(holds, words))
    df = df.withColumn("__hits", F.filter(F.transform("__words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                                          lambda x: x["w"].isin(*sorted({w for r in rare for w in r}))))

    def proposals(postings):
        return F.flatten(F.transform("__hits", lambda x: F.coalesce(F.transform(F.element_at(postings, x["w"]), lambda p: F.struct(
            p["phrase"].alias("phrase"), (x["i"] - p["offset"]).alias("start"))), F.array().cast("array<struct<phrase:int,start:int>>"))))

    both = F.when(F.size("__hits") > 0, F.array_intersect(proposals(first), proposals(second)))
    df = df.withColumn("__found", both)
    verified = F.filter("__found", lambda c: (c["start"] >= 0) & (
        F.slice("__words", F.greatest(c["start"], F.lit(0)) + 1, F.size(F.get(texts, c["phrase"]))) == F.get(texts, c["phrase"])))
    df = df.withColumn("places", F.coalesce(F.array_sort(verified), F.array().cast("array<struct<phrase:int,start:int>>")))
    base = F.filter("places", lambda c: c["phrase"] < len(BASE))
    present = F.transform("places", lambda c: c["phrase"])
    base_label = F.array(*[F.lit(x) for x in BASE.values()])
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda c: F.get(base_label, c["phrase"]))))
    own = F.filter(F.array(*[F.when(F.forall(F.array(*[F.lit(known.index(p)) for p in needed]), lambda k: F.array_contains(present, k)), F.lit(label))
                             for label, needed in templates]), lambda x: x.isNotNull())
    covered = F.aggregate("places", F.lit(0), lambda a, c: a + F.size(F.get(texts, c["phrase"])))
    return df.withColumns({
        "n_base": F.size(base).cast("long"),
        "first_word": F.array_min(F.transform(base, lambda c: c["start"])).cast("long"),
        "last_word": F.array_max(F.transform(base, lambda c: c["start"])).cast("long"),
        "base_labels": F.array_join(base_labels, ","),
        "labels": F.array_join(F.array_sort(F.array_union(base_labels, own)), ","),
        "score": F.when(F.col("n_words") > 0, F.least(F.lit(1.0), covered / F.col("n_words"))).otherwise(F.lit(0.0)),
    }).drop("__low", "__words", "__hits", "__found")


def oracle() -> str:
    """The scan in SQL: every phrase looked for at every word."""
    known = phrases()
    steps, columns = [], []
    for k, p in enumerate(known):
        test = " AND ".join(f"w[i + {j + 1}] = '{word}'" for j, word in enumerate(p.split()))
        steps.append(f"list_filter(range(CAST(len(w) AS BIGINT) - {len(p.split()) - 1}), lambda i: {test}) AS p{k}")
    base = range(len(BASE))
    label = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{x}' END" for k, x in enumerate(BASE.values()))
    own = ", ".join("CASE WHEN " + " AND ".join(f"len(p{known.index(p)}) > 0" for p in needed) + f" THEN '{x}' END" for x, needed in TEMPLATES)
    joined = lambda items: f"array_to_string(list_sort(list_distinct(list_filter([{items}], lambda x: x IS NOT NULL))), ',')"
    every = " + ".join(f"len(p{k}) * {len(p.split())}" for k, p in enumerate(known))
    starts = "flatten([" + ", ".join(f"p{k}" for k in base) + "])"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, len(w)::BIGINT AS n, {', '.join(steps)} FROM d)
SELECT doc_id, n AS n_words, ({' + '.join(f'len(p{k})' for k in base)})::BIGINT AS n_base, list_min({starts})::BIGINT AS first_word, list_max({starts})::BIGINT AS last_word,
  {joined(label)} AS base_labels, {joined(label + ', ' + own)} AS labels,
  CASE WHEN n > 0 THEN least(1.0::DOUBLE, ({every})::DOUBLE / n) ELSE 0.0 END AS score FROM p"""
