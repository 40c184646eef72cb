"""Spelling variants: words one edit apart, by dense comparison of padded code-point matrices.

1. ``vocabulary`` reads whole texts: maximal runs of letters, A-Z lower-cased, counted per task
   and then over all tasks, so a word that is in every document is a few rows.
2. ``neighbours`` deals the words to tiles.  Two words of at most L code points, one of them of
   exactly L, are one edit apart if and only if their common prefix and common suffix together
   reach L - 1.  So they share the first a = (L - 1) // 2 code points or the last L - 1 - a, and a
   word belongs to four tiles: its own length and the next, by prefix and by suffix.  A tile
   is compared whole: words are rows of two matrices of code points, padded on the right and on
   the left, and the numbers of equal columns from either side give prefix and suffix of every pair.
   Tiles of many words are cut into blocks that meet pairwise.  A pair that shares both ends is
   reported by its prefix tile only.  A tile returns its words' numbers of near words and best near
   word, never the pairs.
3. ``variants`` takes the form, the near word of largest count, where that count is large enough, and
   follows forms to the root by doubling; counts grow by ``ratio`` along forms, so there are few rounds.

Planted omissions: a run whose crc32 with the document's id is divisible by ``omit`` loses one
code point, so that a corpus without errors has some.

Defined results: null or empty text has no words; a null id is written as nothing in the crc32;
rows that repeat count each; ties in the form go to the word first in code-point order; words
of any length are compared (long ones in smaller blocks); an empty table has no words; columns
other than the id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import light, stored

RUN = "[A-Za-zÀ-ÿ]"
LETTERS = 6
OCCURRENCES = 5
RATIO = 5
OMIT = 199
#: Distinct words a task holds before it passes on their counts.
HELD = 200_000
#: Words of a block, and code points of its matrix.
BLOCK = 512
CODES = 1 << 20
#: Code points of the pairs compared at once.
CELLS = 1 << 23


def words_of(text: str, doc_id: str, letters: int = LETTERS, omit: int = OMIT) -> Counter:
    """Counts of a text's lower-cased runs of at least ``letters`` code points, after planted omissions."""
    runs = Counter(re.findall(f"{RUN}{{{letters},}}", text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    found: Counter = Counter()
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % omit == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= letters:
            found[run] += n
    return found


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, omit: int = OMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that occur at least ``occurrences`` times."""
    def read(batches):
        held: Counter = Counter()

        def full():
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if text:
                    held.update(words_of(text, doc_id.as_py() or "", letters, omit))
                if len(held) > HELD:
                    yield full()
                    held.clear()
        if held:
            yield full()

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(light(read), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def matrices(words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points (all below 256) of the words, padded with zeros on the right, and on the left."""
    right, left = np.zeros((2, len(words), length), np.uint8)
    for i, word in enumerate(words):
        codes = np.frombuffer(word.encode("latin-1"), np.uint8)
        right[i, :len(codes)] = codes
        left[i, length - len(codes):] = codes
    return right, left


def _run(equal: np.ndarray) -> np.ndarray:
    """Number of true values before the first false one, along the last axis."""
    return np.where(equal.all(axis=-1), equal.shape[-1], equal.argmin(axis=-1))


def single_edits(a: list[str], b: list[str], length: int, by_suffix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of words of ``a`` and ``b`` one edit apart, the longer of them of ``length`` code points.

    Of a tile by suffix only pairs that do not share the prefix that names a tile.
    """
    (a_right, a_left), (b_right, b_left) = matrices(a, length), matrices(b, length)
    a_len, b_len = np.array([len(w) for w in a]), np.array([len(w) for w in b])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, CELLS // (max(1, len(b)) * length))
    for at in range(0, len(a), step):
        # Padding is a column of its own kind: two words of one length never meet in it, and of two
        # lengths the shorter one's padding differs from the longer one's letter.
        prefix = _run(a_right[at:at + step, None] == b_right[None])
        suffix = _run(a_left[at:at + step, None, ::-1] == b_left[None, :, ::-1])
        longer = np.maximum(a_len[at:at + step, None], b_len[None])
        near = (longer == length) & (prefix + suffix >= length - 1) & (prefix < length)
        if by_suffix:
            near &= prefix < (length - 1) // 2
        i, j = np.nonzero(near)
        found.append((i + at, j))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def _tiles(words: DataFrame, block: int) -> DataFrame:
    """(length, suffix, code, tile, side, word, n): the words of every tile; blocks of a large one meet pairwise."""
    shared = F.floor((F.col("length") - 1) / 2).cast("int")
    key = F.when(F.col("suffix"), F.expr("right(word, length - 1 - __a)")).otherwise(F.expr("left(word, __a)"))
    rows = (words.withColumn("length", F.explode(F.array(F.length("word"), F.length("word") + 1)))
            .withColumn("suffix", F.explode(F.array(F.lit(False), F.lit(True))))
            .withColumn("__a", shared).withColumn("code", key).drop("__a"))
    name = ["length", "suffix", "code"]
    most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(CODES) / F.col("length")))).cast("long")
    # A tile without a word of its full length, or with one word only, has no pair.
    sizes = (rows.groupBy(*name).agg(F.count("*").alias("__n"), F.max(F.length("word")).alias("__longest"))
             .where("__n > 1 AND __longest = length").withColumn("blocks", F.ceil(F.col("__n") / most).cast("int")).drop("__n", "__longest"))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    # Block i meets block j >= i in tile (i, j), as the left side; a block meets itself in (i, i).
    seats = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), F.when(k < F.col("own"), 1).otherwise(0).alias("side")))
    return (rows.join(sizes, name).withColumn("own", own).withColumn("seat", F.explode(seats))
            .select(*name, "seat.i", "seat.j", "seat.side", "word", "n"))


class Best:
    """Number of near words and the best of them, of the words of a tile."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, counts
        self.near = [0] * len(words)
        self.best = [-1] * len(words)

    def add(self, i: int, j: int) -> None:
        self.near[i] += 1
        k = self.best[i]
        if k < 0 or (-self.counts[j], self.words[j]) < (-self.counts[k], self.words[k]):
            self.best[i] = j


def settle(words: list[str], counts: list[int], sides: list[int], two: bool, length: int, by_suffix: bool) -> Best:
    """Near words within a tile: of its left side with its right side, or (not ``two``) of its words with each other."""
    best = Best(words, counts)
    left = [k for k, s in enumerate(sides) if not s]
    right = [k for k, s in enumerate(sides) if s]
    i, j = single_edits([words[k] for k in left], [words[k] for k in (right if two else left)], length, by_suffix)
    for x, y in zip(i.tolist(), j.tolist()):
        if two:
            best.add(left[x], right[y])
            best.add(right[y], left[x])
        else:
            best.add(left[x], left[y])
    return best


_TILE = ["length", "suffix", "code", "i", "j"]


def neighbours(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best): number of near words, and (n, word) of the best, of the words that have any."""
    tiles = _tiles(words, block).repartition(*_TILE).sortWithinPartitions(*_TILE, "side")

    def read(batches):
        key, held = None, []

        def done():
            best = settle([r[2] for r in held], [r[3] for r in held], [r[1] for r in held], key[3] != key[4], key[0], key[1])
            has = [k for k, n in enumerate(best.near) if n]
            return pa.record_batch([pa.array([best.words[k] for k in has], pa.string()), pa.array([best.near[k] for k in has], pa.int64()),
                                    pa.array([best.counts[best.best[k]] for k in has], pa.int64()), pa.array([best.words[best.best[k]] for k in has], pa.string())],
                                   names=["word", "near", "form_n", "form"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*_TILE, "side", "word", "n")]
            for row in zip(*columns):
                if row[:5] != key:
                    if len(held) > 1:
                        yield done()
                    key, held = row[:5], []
                held.append((None, *row[5:]))
        if len(held) > 1:
            yield done()

    found = tiles.mapInArrow(light(read), "word string, near bigint, form_n bigint, form string")
    first = F.min_by(F.struct("form_n", "form"), F.struct(-F.col("form_n"), F.col("form")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by doubling; a word's root is the last along its forms."""
    links = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("__far"))
        after = stored(links.join(ahead, "root", "left").select("word", F.coalesce("__far", "root").alias("root"), F.col("__far").isNotNull().alias("moved")))
        links = after.select("word", "root")
        if after.where("moved").isEmpty():
            return links


def variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO, omit: int = OMIT, block: int = BLOCK,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the vocabulary."""
    words = stored(vocabulary(docs, letters, occurrences, omit, id_col, text_col))
    near = neighbours(words, block)
    has = F.col("best.form_n") >= ratio * F.col("n")
    found = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.form")).alias("form"), F.when(has, F.col("best.form_n")).alias("form_n")))
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
