"""Language identification with hyperdimensional letter n-gram profiles.

Each letter has a random +1/-1 vector, drawn from a generator seeded by its code point.  The
vector of a letter trigram binds (multiplies) the letters' vectors, each rotated by its place;
a text bundles (adds) the vectors of all its trigrams, word edges counting as a letter.  The
prototype of a language is the bundle of its training texts, and a text gets the language whose
prototype has the largest cosine.  Sums are integers, so the order of addition does not matter.

Training reads at most about ``train_rows`` texts of each language, chosen by a hash of the text.

Defined results: a null text, or one without letters, is ``und`` with score 0; ties go to the
language first in code point order; with nothing to learn from every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import light, process_state

DIMENSIONS = 1024
TRAIN_ROWS = 20_000
SEED = 7
#: Letters handled in one matrix product.
BATCH_LETTERS = 1_000_000
COLUMNS = 4096
EDGE = 0


class Encoder:
    """Turns texts into bundled vectors; remembers the vectors of the trigrams it has met."""

    def __init__(self, dimensions: int, seed: int, limit: int = 20_000):
        self.dimensions, self.seed, self.limit = dimensions, seed, limit
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.memory = np.empty((0, dimensions), np.int8)
        self.is_letter: dict[int, bool] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            draw = np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.dimensions, np.int8)
            self.letters[code] = (2 * draw - 1).astype(np.int8)
        return self.letters[code]

    def symbols(self, text: str) -> np.ndarray:
        """Lower-case letters by code point, each run of other characters one EDGE, edges at both ends."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        distinct, place = np.unique(codes, return_inverse=True)
        known = self.is_letter
        keep = np.array([known[c] if c in known else known.setdefault(c, chr(c).isalpha()) for c in distinct.tolist()], bool)
        codes = np.concatenate([[EDGE], np.where(keep[place], codes, EDGE), [EDGE]])
        return codes[np.concatenate([[True], (codes[1:] != EDGE) | (codes[:-1] != EDGE)])]

    def vectors(self, trigrams: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(trigrams) > self.limit and len(self.rows):
            self.rows, self.memory = {}, np.empty((0, self.dimensions), np.int8)
        new = [t for t in trigrams.tolist() if t not in self.rows]
        if new:
            made = np.empty((len(new), self.dimensions), np.int8)
            for i, t in enumerate(new):
                made[i] = np.roll(self.letter(t >> 42), 2) * np.roll(self.letter(t >> 21 & 0x1FFFFF), 1) * self.letter(t & 0x1FFFFF)
                self.rows[t] = len(self.memory) + i
            self.memory = np.concatenate([self.memory, made])
        return self.memory[[self.rows[t] for t in trigrams.tolist()]]

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the texts, and which texts have a letter."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        lettered = np.zeros(len(texts), bool)
        grams, owner = [], []
        for i, text in enumerate(texts):
            s = self.symbols(text) if text else np.zeros(0, np.int64)
            if len(s) >= 3:
                lettered[i] = True
                grams.append(s[:-2] << 42 | s[1:-1] << 21 | s[2:])
                owner.append(np.full(len(s) - 2, i))
        if grams:
            distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
            owner = np.concatenate(owner)
            for first in range(0, len(distinct), COLUMNS):
                width = min(COLUMNS, len(distinct) - first)
                own = (place >= first) & (place < first + width)
                counts = np.bincount(owner[own] * width + place[own] - first, minlength=len(texts) * width)
                out += counts.reshape(len(texts), width).astype(np.float32) @ self.vectors(distinct[first:first + width]).astype(np.float32)
        return out, lettered


def _slices(texts: list[str | None]):
    """Consecutive runs of texts with a bounded number of characters and rows."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and (total + n > BATCH_LETTERS or i - start >= 512):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS,
        dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototype of each language, learned from the rows where ``train`` holds and the language is not null."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    part = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, train_rows / n)))])
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 24)) < F.element_at(part, F.col("lang")) * (1 << 24))

    def partial(batches):
        process_state()
        encoder, sums = Encoder(dimensions, seed), {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for a, b in _slices(texts):
                made, _ = encoder.bundle(texts[a:b])
                for lang, v in zip(langs[a:b], made):
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "sums"])

    def total(pdf):
        return pdf.head(1).assign(sums=np.sum([np.frombuffer(v) for v in pdf["sums"]], axis=0).tobytes())

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("sums", T.BinaryType())])
    found = picked.mapInArrow(light(partial), schema).groupBy("lang").applyInPandas(total, schema).collect()
    return {r[0]: np.frombuffer(bytes(r[1])).copy() for r in sorted(found, key=lambda r: r[0])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], text_col: str = "text",
            dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Columns ``keep`` of ``docs``, lang_pred and score (the largest cosine, negative ones as 0).

    Columns of ``docs`` called lang_pred or score are replaced.
    """
    names = list(prototypes)
    matrix = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names], np.float32).reshape(len(names), dimensions)
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    extra = [] if text_col in keep else [F.col(text_col).alias("__text")]
    chosen = docs.select(*[F.col(c) for c in keep], *extra)
    text_at = len(keep) if extra else keep.index(text_col)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label(batches):
        process_state()
        encoder = Encoder(dimensions, seed)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            langs, scores = [], []
            for a, b in _slices(texts):
                made, lettered = encoder.bundle(texts[a:b])
                if not names:
                    langs += ["und"] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                length = np.linalg.norm(made, axis=1)
                cosines = (made @ matrix.T) / np.where(length > 0, length, 1)[:, None]
                best = cosines.argmax(axis=1)
                langs += [names[k] if ok else "und" for k, ok in zip(best, lettered)]
                scores += np.where(lettered, np.clip(cosines[np.arange(b - a), best], 0, 1), 0).astype(float).tolist()
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.record_batch([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                  names=[*keep, "lang_pred", "score"])

    return chosen.mapInArrow(light(label), schema)
