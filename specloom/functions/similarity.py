"""String similarity that has no built-in equivalent.

The sequence-matching ratio needs Python; it runs in Arrow batches, remembers
pairs it has seen in the worker, and is only asked about strings the exact
tiers could not settle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher, get_close_matches

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

from .. import fixed

_MEMO_LIMIT = 300_000


def _memo(fn):
    """Per-task memory of pairs already compared; dropped when it grows too large."""
    seen = {}

    def remembered(*args):
        if args not in seen:
            if len(seen) >= _MEMO_LIMIT:
                seen.clear()
            seen[args] = fn(*args)
        return seen[args]

    return remembered


_STOP = frozenset(fixed.KEY_STOP_WORDS)
_NOT_WORD = re.compile(r"[^a-z0-9]+")


@_memo
def _slug(text: str) -> str:
    return _NOT_WORD.sub(" ", text.lower()).strip()


@_memo
def _tokens(text: str) -> frozenset[str]:
    return frozenset(t for t in _slug(text).split() if t not in _STOP)


@_memo
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


class NameTable:
    """The names of a category's attributes as one table, against which a key is scored at once.

    A name that equals the key scores 1.  Otherwise shared words give 0.55 + 0.4 x their share
    and the sequence ratio counts 0.9; the ratio is computed only where its length bound,
    twice the shorter length over both, could raise the score.
    """

    def __init__(self, attributes: list[tuple[str, ...]]):
        rows = [(j, s) for j, names in enumerate(attributes) for s in map(_slug, names) if s]
        self.attribute = np.array([j for j, _ in rows], int)
        self.names = [s for _, s in rows]
        self.lengths = np.array([len(s) for s in self.names], float)
        self.count = len(attributes)
        words = sorted({t for s in self.names for t in _tokens(s)})
        self.place = {t: i for i, t in enumerate(words)}
        self.table = np.zeros((len(rows), len(words)))
        for i, s in enumerate(self.names):
            self.table[i, [self.place[t] for t in _tokens(s)]] = 1
        self.seen: dict[str, list[float]] = {}

    def scores(self, key: str) -> list[float]:
        """Score of the key for every attribute, the best of its names."""
        if key not in self.seen:
            if len(self.seen) >= _MEMO_LIMIT:
                self.seen.clear()
            self.seen[key] = self._scores(_slug(key)).tolist()
        return self.seen[key]

    def _scores(self, probe: str) -> np.ndarray:
        best = np.zeros(self.count)
        if not probe or not self.names:
            return best
        words = _tokens(probe)
        shared = self.table[:, [self.place[t] for t in words if t in self.place]].sum(axis=1)
        either = self.table.sum(axis=1) + len(words) - shared
        score = np.where(shared > 0, 0.55 + 0.4 * shared / np.maximum(either, 1), 0.0)
        bound = 1.8 * np.minimum(self.lengths, len(probe)) / (self.lengths + len(probe))
        for i in np.flatnonzero(bound > score):
            score[i] = 1.0 if self.names[i] == probe else max(score[i], 0.9 * _ratio(probe, self.names[i]))
        score[[n == probe for n in self.names]] = 1.0
        np.maximum.at(best, self.attribute, score)
        return best


class OptionTable:
    """A list of permitted values against which texts are scored.

    A value's score is the larger of the share of its words that a text holds and the sequence ratio of
    both.  The shares of all values come from one table; the ratio of a value is computed, best bound
    first, only while twice the common characters over both lengths could still beat the best.
    """

    def __init__(self, options: tuple[str, ...]):
        self.options = [o for o in options if _tokens(o)]
        self.slugs = [_slug(o) for o in self.options]
        words = sorted({t for o in self.options for t in _tokens(o)})
        self.place = {t: i for i, t in enumerate(words)}
        self.table = np.zeros((len(self.options), len(words)))
        for i, o in enumerate(self.options):
            self.table[i, [self.place[t] for t in _tokens(o)]] = 1
        self.letters = [Counter(s) for s in self.slugs]
        self.seen: dict[str, tuple[str | None, float]] = {}

    def best(self, text: str) -> tuple[str | None, float]:
        """The first value of the highest score, and that score; none for a score of 0."""
        if text not in self.seen:
            if len(self.seen) >= _MEMO_LIMIT:
                self.seen.clear()
            self.seen[text] = self._best(_slug(text), _tokens(text))
        return self.seen[text]

    def _best(self, probe: str, words: frozenset[str]) -> tuple[str | None, float]:
        if not self.options:
            return None, 0.0
        score = self.table[:, [self.place[t] for t in words if t in self.place]].sum(axis=1) / self.table.sum(axis=1)
        own = Counter(probe)
        bound = np.array([2 * (own & c).total() / max(len(probe) + len(s), 1) for c, s in zip(self.letters, self.slugs)])
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < score.max():
                break
            score[i] = max(score[i], _ratio(probe, self.slugs[i]))
        top = int(score.argmax())
        return (self.options[top], float(score[top])) if score[top] > 0 else (None, 0.0)


@_memo
def near_miss(text: str, permitted: tuple[str, ...]) -> str | None:
    found = get_close_matches(text, permitted, n=1, cutoff=fixed.SUGGEST_THRESHOLD)
    return found[0] if found else None


def similarity_matrix(names_by_code: dict[str, list[tuple[str, ...]]]):
    """UDF(keys array, category code) -> score of every key for every attribute."""

    tables: dict[str, NameTable] = {}

    @F.pandas_udf("array<array<double>>")
    def scores(keys: pd.Series, code: pd.Series) -> pd.Series:
        def one(row_keys, row_code):
            if row_keys is None or row_code not in names_by_code:
                return None
            if row_code not in tables:
                tables[row_code] = NameTable(names_by_code[row_code])
            return [tables[row_code].scores(k or "") for k in row_keys]
        return pd.Series([one(k, c) for k, c in zip(keys, code)], dtype=object)

    return scores


def option_matcher(options_by_code: dict[str, list[tuple[str, ...]]], want: str, code: str, got: str):
    """Function of Arrow batches that adds ``got``, the nearest option and score for each text of ``want``.

    ``want`` has texts ``t`` with attribute indexes ``j``, ``code`` the category.  Batches come and go whole: no row
    waits in a queue of Spark's for its answer, as it does for that of a scalar UDF.
    """

    tables: dict[tuple[str, ...], OptionTable] = {}

    def table(options: tuple[str, ...]) -> OptionTable:
        if options not in tables:
            tables[options] = OptionTable(options)
        return tables[options]

    def one(asked: list[dict] | None, row_code: str | None) -> list[tuple]:
        options = options_by_code.get(row_code)
        if asked is None or options is None:
            return []
        return [table(options[x["j"]]).best(x["t"]) if x["t"] is not None else (None, 0.0) for x in asked]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("option", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            found = [one(*r) for r in zip(batch.column(want).to_pylist(), batch.column(code).to_pylist())]
            yield pa.record_batch([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, got])

    return nearest


@F.pandas_udf(T.ArrayType(T.StringType()))
def suggest_each(texts: pd.Series, permitted: pd.Series) -> pd.Series:
    """V3 for the values of one record: a near miss, or null, per text."""
    def one(row_texts, row_lists):
        if row_texts is None:
            return None
        return [None if t is None else near_miss(t, tuple(p)) for t, p in zip(row_texts, row_lists)]
    return pd.Series([one(t, p) for t, p in zip(texts, permitted)], dtype=object)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b)])


def _ship_by_value() -> None:
    """Pickle helpers by value so executors need no installed copy of this package."""
    import sys
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(fixed)


_ship_by_value()
