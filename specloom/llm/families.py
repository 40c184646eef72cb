"""Exact links inside families of sets, settled in tiles so that no pair is ever a row.

A family is a group of sets outside which none of them has a link.  What moves is a set, once for
each tile it sits in; a task holds one tile, finds how many elements one set shares with all
others of the tile by an inverted index, and emits at most one link for each two groups it joins.
Sets of one group need no comparison, so a set is compared only with those of other groups, and
only sets outside the largest group are looked at.

1. A small family is one tile.  Of a large one every member first meets a few centers, which
   joins nearly all of a group of near copies by as many comparisons as it has members.
2. A large family that is still in several groups is cut into blocks by group, small groups together, and
   blocks meet pairwise, except those of one and the same group.

Block sizes follow from the number of elements, so a tile fits a task's memory whatever the sets
are (one larger set is a block of its own kind and no larger than its text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import light, small, stored

#: Elements of a block.
ELEMENTS = 400_000
#: Bits of the widest bitmaps of a tile.
WIDEST = 1 << 16
#: Members of a large family that all others meet first.
CENTERS = 4
#: Tables of large families up to this many rows are broadcast.
BROADCAST_ROWS = 100_000


def reaches(common, n_a, n_b, percent: int):
    """Do sets of these sizes with this many common elements link?  Also for arrays."""
    return 100 * common >= percent * (n_a + n_b - common)


def near_sizes(n_a, n_b, percent: int):
    return 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)


def bitmap_of(grams: np.ndarray, width: int | None = None) -> np.ndarray:
    """One bit for each element among ``width``, a power of two; if not given, the least that is at least twice their number."""
    width = width or max(64, 1 << int(2 * len(grams) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(grams & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits)


def folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    while len(bitmap) > size:
        bitmap = bitmap[:len(bitmap) // 2] | bitmap[len(bitmap) // 2:]
    return bitmap


def may_reach(n_a: int, a: np.ndarray, n_b: int, b: np.ndarray, percent: int) -> bool:
    """Can sets with these sizes and bitmaps reach the threshold?  Never false for sets that do."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    size = min(len(a), len(b))
    a, b = folded(a, size), folded(b, size)
    most = min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))
    return reaches(most, n_a, n_b, percent)


def bounds(bitmaps: np.ndarray, n: np.ndarray, x: int) -> np.ndarray:
    """Upper bounds on the common elements of set x with every set, by bits set in one bitmap and not in the other."""
    own = bitmaps[x]
    missing = np.bitwise_count(own & ~bitmaps).sum(axis=1, dtype=np.int64)
    extra = np.bitwise_count(bitmaps & ~own).sum(axis=1, dtype=np.int64)
    return np.minimum(n[x] - missing, n - extra)


class Bitmaps:
    """Bitmaps of sets, each as wide as its set asks for; two of different widths are compared at the smaller one."""

    def __init__(self, maps: list[bytes], n: np.ndarray):
        self.n, self.width = n, np.array([len(m) for m in maps])
        self.place, self.tables = np.zeros(len(maps), int), {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.place[own] = np.arange(len(own))
            self.tables[w] = np.frombuffer(b"".join(maps[i] for i in own), np.uint8).reshape(-1, w)

    def may_link(self, x: int, rows: np.ndarray, percent: int) -> np.ndarray:
        """Which of the sets ``rows`` bit counts leave a link with set x possible."""
        ok = np.zeros(len(rows), bool)
        for w in np.unique(self.width[rows]).tolist():
            own = np.flatnonzero(self.width[rows] == w)
            size = min(w, int(self.width[x]))
            mine = folded(self.tables[int(self.width[x])][self.place[x]], size)
            table = self.tables[w][self.place[rows[own]]]
            while table.shape[1] > size:
                table = table[:, :table.shape[1] // 2] | table[:, table.shape[1] // 2:]
            missing = np.bitwise_count(mine & ~table).sum(axis=1, dtype=np.int64)
            extra = np.bitwise_count(table & ~mine).sum(axis=1, dtype=np.int64)
            n = self.n[rows[own]]
            ok[own] = reaches(np.minimum(self.n[x] - missing, n - extra), self.n[x], n, percent)
        return ok


class Index:
    """Numbers of common elements of a set with each of a list of sets."""

    def __init__(self, sets: list[np.ndarray], rows: np.ndarray):
        self.rows = rows
        elements = np.concatenate([sets[r] for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
        order = np.argsort(elements, kind="stable")
        self.owner, elements = owner[order], elements[order]
        self.first = np.flatnonzero(np.concatenate([[True], elements[1:] != elements[:-1]]))
        self.values = elements[self.first]
        self.last = np.append(self.first[1:], len(elements))

    def common(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.values, own)
        hit = (at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == own)
        first, count = self.first[at[hit]], self.last[at[hit]] - self.first[at[hit]]
        places = np.arange(count.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        return np.bincount(self.owner[places], minlength=len(self.rows))


def links(sets: list[np.ndarray], groups: np.ndarray, sides: np.ndarray, percent: int, bitmaps: bool = False) -> list[tuple[int, int]]:
    """Links that join the groups of a tile, one for each two groups joined.

    Sets of side 0 meet those of side 1, or each other where there is no side 1.  Every two sets that
    may meet are compared unless they are in one group by then, or, with ``bitmaps``, bit counts leave no link possible.
    """
    n = np.array([len(s) for s in sets])
    _, label = np.unique(groups, return_inverse=True)
    label = label.copy()
    two = bool(sides.any())
    done = np.zeros(len(sets), bool)
    found: list[tuple[int, int]] = []
    index = Index(sets, np.arange(len(sets)))
    if bitmaps:
        width = min(WIDEST, max(64, 1 << int(2 * n.max() - 1).bit_length()))
        table = np.stack([bitmap_of(s, width) for s in sets])
    while True:
        sizes = np.bincount(label)
        open_ = ~done & (label != sizes.argmax()) if (sizes > 0).sum() > 1 else np.zeros(len(sets), bool)
        if not open_.any():
            return found
        if not done.any() and not two:
            x = int(np.argsort(n)[len(n) // 2])  # any set may go first; one of middling size has most partners
        else:
            x = int(np.flatnonzero(open_)[0])
        done[x] = True
        others = index.rows
        may = (label[others] != label[x]) & near_sizes(n[x], n[others], percent)
        if two:
            may &= sides[others] != sides[x]
        if bitmaps and may.any():
            may &= reaches(bounds(table, n, x), n[x], n, percent)
        if not may.any():
            continue
        # Where few sets are left to look for, an index of those is shorter.
        common = index.common(sets[x]) if 4 * may.sum() > len(others) else Index(sets, others[may]).common(sets[x]) if may.sum() > 64 else None
        if common is None:
            common = np.zeros(len(others), int)
            for k in np.flatnonzero(may):
                common[k] = len(np.intersect1d(sets[x], sets[others[k]], assume_unique=True))
        elif len(common) != len(others):
            spread = np.zeros(len(others), int)
            spread[may] = common
            common = spread
        ok = np.flatnonzero(may & reaches(common, n[x], n[others], percent))
        for k in ok:
            y = int(others[k])
            if label[y] != label[x]:
                found.append((x, y))
                label[label == label[y]] = label[x]


def _settled(tiles: DataFrame, percent: int, bitmaps: bool) -> DataFrame:
    """Links (a, b) of the tiles (tile, side, node, root, grams); rows of a tile may repeat."""
    dealt = tiles.repartition("tile").sortWithinPartitions("tile", "side", "node")

    def read(batches):
        key, rows, seen = None, [], set()

        def done():
            sets = [np.frombuffer(r[2], np.uint64) for r in rows]
            found = links(sets, _codes([r[1] for r in rows]), np.array([r[3] for r in rows]), percent, bitmaps)
            return pa.record_batch([pa.array([rows[x][0] for x, _ in found], pa.binary()), pa.array([rows[y][0] for _, y in found], pa.binary())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c) for c in ("tile", "side", "node", "root", "grams")]
            for k in range(batch.num_rows):
                tile, side, node, root, grams = (c[k].as_py() for c in columns)
                if tile != key:
                    if len(rows) > 1:
                        yield done()
                    key, rows, seen = tile, [], set()
                if (side, node) not in seen:
                    seen.add((side, node))
                    rows.append((node, root, grams, side))
        if len(rows) > 1:
            yield done()

    return dealt.select("tile", "side", "node", "root", "grams").mapInArrow(light(read), "a binary, b binary")


def _codes(names: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(x, len(numbers)) for x in names])


def settle(members: DataFrame, percent: int, components, elements: int | None = None, centers: int = CENTERS, bitmaps: bool = False) -> DataFrame:
    """All links that matter for connection, (a, b), of ``members``: family, node, root, n, grams (binary, sorted 64-bit numbers).

    ``members`` is a stored table; ``root`` names the group a node is known to be in.  ``components`` turns
    links into (node, root).
    """
    elements = elements or ELEMENTS
    sizes = members.groupBy("family").agg(F.sum("n").alias("total"), *[F.min_by("node", F.xxhash64("node", F.lit(k))).alias(f"c{k}") for k in range(centers)])
    large = stored(sizes.where(F.col("total") > elements).select(F.col("family").alias("__family"), F.ceil(F.col("total") / elements).cast("int").alias("slices"),
                                                                 F.array_distinct(F.array(*[f"c{k}" for k in range(centers)])).alias("centers")))
    large = small(large, BROADCAST_ROWS)
    placed = members.join(large, F.col("family") == F.col("__family"), "left").drop("__family")
    whole = placed.where("slices IS NULL").select(F.xxhash64("family").alias("tile"), F.lit(0).alias("side"), "node", "root", "grams")
    tile = lambda s: F.xxhash64("family", s)
    first = placed.where("slices IS NOT NULL").withColumn("center", F.array_contains("centers", F.col("node")))
    # A member sits in one slice; the centers are the left side of every slice.
    meeting = (first.select(tile(F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")).alias("tile"), F.lit(1).alias("side"), "node", "root", "grams")
               .union(first.where("center").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(tile(F.col("s")).alias("tile"), F.lit(0), "node", "root", "grams")))
    found = stored(_settled(whole.union(meeting), percent, bitmaps))
    if large.isEmpty():
        return found
    # What the centers left: groups of the large families, in blocks.
    known = components(found.union(members.where("node != root").select("node", "root")))
    again = (members.join(large.select(F.col("__family").alias("family")), "family").drop("root").join(known, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    groups = again.groupBy("family", "root").agg(F.sum("n").alias("total"))
    several = groups.groupBy("family").agg(F.count("*").alias("groups"), F.sum(F.when(F.col("total") * 4 < elements, F.col("total"))).alias("rest")).where("groups > 1").drop("groups")
    groups = stored(groups.join(several, "family").withColumn("own", F.col("total") * 4 >= elements).select(
        F.col("family").alias("__f"), F.col("root").alias("__r"), "own", F.greatest(F.lit(1), F.ceil(F.when(F.col("own"), F.col("total")).otherwise(F.col("rest")) / elements)).cast("int").alias("slices")))
    if groups.isEmpty():
        return found
    again = stored(again.join(groups, (F.col("family") == F.col("__f")) & (F.col("root") == F.col("__r"))).select(
        "family", "node", "root", "n", "grams", F.when(F.col("own"), F.xxhash64("root", F.pmod(F.xxhash64("node"), F.col("slices"))))
        .otherwise(F.xxhash64("family", F.lit("rest"), F.pmod(F.xxhash64("root"), F.col("slices")))).alias("block"), F.when(F.col("own"), F.col("root")).alias("group")))
    blocks = stored(again.select("family", "block", "group").distinct())
    other = blocks.toDF("family", "block_b", "group_b")
    meets = (blocks.join(other, "family").where("block < block_b AND (group IS NULL OR group_b IS NULL OR group != group_b) OR block = block_b AND group IS NULL")
             .select("family", F.xxhash64("family", "block", "block_b").alias("tile"), "block", "block_b"))
    seats = meets.select("family", "tile", "block", F.lit(0).alias("side")).union(meets.where("block != block_b").select("family", "tile", F.col("block_b"), F.lit(1)))
    rest = again.join(seats, ["family", "block"]).select("tile", "side", "node", "root", "grams")
    return stored(found.union(_settled(rest, percent, bitmaps)))
