"""Sets of word n-grams as sorted 64-bit hashes, and digests of sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import light, small, stored

N = 5
MIX = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB]
#: Tables of nodes up to this many rows are broadcast.
BROADCAST_ROWS = 200_000
#: Rows of a batch whose sets are held at once.
ROWS = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX[1])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, n: int = N):
        self.n = n
        draw = np.random.Generator(np.random.PCG64(2024))
        self.byte = draw.integers(0, 1 << 64, 256, np.uint64)
        for upper in range(65, 91):
            self.byte[upper] = self.byte[upper + 32]
        self.place = draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.blank = np.zeros(256, bool)
        self.blank[[32, 9, 10, 11, 12, 13]] = True
        self.powers, self.inverses = self._powers(1 << 12)

    @staticmethod
    def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
        base = 0x5851F42D4C957F2D
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(b), np.uint64)]), dtype=np.uint64)
                     for b in (base, pow(base, -1, 1 << 64)))

    def words(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) >= len(self.powers):
            self.powers, self.inverses = self._powers(2 * len(data))
        blank = self.blank[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
        starts, ends = edge[::2], edge[1::2]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.byte[data] * self.powers[:len(data)], dtype=np.uint64)])
        return mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.words(text) if text else np.zeros(0, np.uint64)
        if not len(words):
            return words
        n = self.n
        if len(words) < n:
            grams = (words * self.place[:len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words))
        else:
            grams = words[:len(words) - n + 1] * self.place[0]
            for i in range(1, n):
                grams = grams + words[i:len(words) - n + 1 + i] * self.place[i]
        return np.unique(mixed(grams))


def node_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """family, node, n and grams of the ``wanted`` nodes (family, node, doc_id), from the texts."""
    wanted = small(stored(wanted.select("family", "node", F.col("doc_id").alias("__id"))), BROADCAST_ROWS)
    texts = (docs.select(F.col(f"`{id_col}`").alias("__doc"), F.col(f"`{text_col}`").alias("__text"))
             .join(wanted, F.col("__doc").eqNullSafe(F.col("__id"))).select("family", "node", F.col("__text").alias("text")))

    def read(batches):
        shingle = Shingler()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows = []
                for k, node in enumerate(batch.column("node").to_pylist()):
                    grams = shingle(batch.column("text")[k].as_py())
                    if len(grams) and node_of(grams) == node:  # not another row with the same id
                        rows.append((k, len(grams), grams.tobytes()))
                at_rows = pa.array([r[0] for r in rows], pa.int64())
                yield pa.record_batch([batch.column("family").take(at_rows), batch.column("node").take(at_rows), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                                      names=["family", "node", "n", "grams"])

    kind = wanted.schema["family"].dataType.simpleString()
    return texts.mapInArrow(light(read), f"family {kind}, node binary, n bigint, grams binary")
