"""Exact n-gram Jaccard self-join: linked groups of documents, without listing pairs.

A document's set holds the hashes of its distinct word 5-grams.  Two sets of a and b elements
(a <= b) can only reach the threshold t if a >= t * b, so sets meet in tiles of near size only,
and there a hashed bitmap of each set bounds the overlap from above before anything is compared
in full: every bit set in A's bitmap and not in B's is an element of A missing in B.  What
survives is settled by exact intersection of the sorted arrays.

1. ``profiles`` reads every text once: set size, a digest of the whole set (equal sets are one
   node from here on) and counts of shingles by hash bucket over all documents.
2. Two sets that reach the threshold share one of the first n - ceil(t n) + 1 elements of each in any
   common order.  Elements in frequent buckets come last in that order, so passages shared by
   many documents are rarely probed.  Nodes that share a probe, and for which the elements left
   after it could still make a link, meet in a tile; tiles of the same nodes are kept once.  In a
   tile nodes are connected where sizes and the bit counts of their bitmaps allow a link.  A task passes on
   which nodes it connected, at most one row for each, never the pairs.  Connected nodes are a
   family: no link leaves it.
3. The sets of a family's members are dealt to tiles by family and size band and settled there
   (``families``): links are all that leaves a tile, at most one for two groups.

The result is exact whatever the order is; it decides the cost only.

Defined results: a document without words (or null text) has an empty set and is its own group;
one with fewer than n words has the whole sequence as its only element; rows with equal sets are
linked; rows that repeat a doc_id stay rows of their own; a null doc_id never names a group
unless all of the group are null; an empty table gives an empty result; other columns are not
read (``join``) or kept (``deduplicated``), whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import families
from .families import bitmap_of, folded, may_reach  # noqa: F401
from .shared import aside, light, process_state, small, stored
from .shingles import MIX, N, Shingler, mixed, node_of, sets_of  # noqa: F401

PERCENT = 75
SKETCH = 1 << 20
CHUNKS = 64
#: Rows of one token that a task holds.
TOKEN_ROWS = 8192
#: Tables of ids and hashes, 17 bytes a row, up to this many rows are broadcast.
BROADCAST_ROWS = 1_000_000


def short(node: bytes | None) -> int | None:
    """64 bits of a node's digest, to name it where rows are many."""
    return None if node is None else int.from_bytes(node[:8], "little", signed=True)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row, by which rows that repeat a doc_id are told apart."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """One row per document (doc_id, row, n, node, nid, bitmap), and shingle counts by bucket over all documents."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("row", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("nid", T.LongType()),
                           T.StructField("bitmap", T.BinaryType()), T.StructField("chunk", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    arrow_id = to_arrow_type(id_type)

    def read(batches):
        process_state()
        shingle, sketch = Shingler(), np.zeros(SKETCH, np.int32)
        names = schema.names
        for batch in batches:
            n, node, bitmap = [], [], []
            for text in batch.column(2):
                grams = shingle(text.as_py())
                n.append(len(grams))
                bitmap.append(bitmap_of(grams).tobytes() if len(grams) else None)
                node.append(node_of(grams) if len(grams) else None)
                np.add.at(sketch, (grams >> np.uint64(44)).astype(np.int64), 1)
            rows = batch.num_rows
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()),
                                   pa.array([short(x) for x in node], pa.int64()), pa.array(bitmap, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        if sketch.any():
            parts = sketch.reshape(CHUNKS, -1)
            yield pa.record_batch([pa.nulls(CHUNKS, arrow_id), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.binary()), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.binary()),
                                   pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    both = stored(docs.select(F.col(f"`{id_col}`"), row_hash(docs).alias("__row"), F.col(f"`{text_col}`")).mapInArrow(light(read), schema))

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(*(c.to_pylist() for c in batch.columns)):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    sketch = np.zeros((CHUNKS, SKETCH // CHUNKS), np.int64)
    parts = both.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").mapInArrow(light(total), "chunk int, counts binary")
    for chunk, counts in parts.collect():
        sketch[chunk] = np.frombuffer(bytes(counts), np.int64)
    return both.where("chunk IS NULL").drop("chunk", "counts"), sketch.ravel()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; the root is the smallest node it is connected with.

    Every round each node adopts the smallest label of its neighbours and then the label of its
    label, each round is written to the shared folder, and rounds end when no label changes.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = (both.join(labels.toDF("b", "low"), "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low")))
        lower = labels.join(near, "node").select("node", F.least("root", "low").alias("next"), "root")
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = stored(lower.join(jump, "next").select("node", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("root")).alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")


def _probes(docs: DataFrame, sketch: np.ndarray, percent: int, text_col: str) -> DataFrame:
    """(token, place, nid, n): the rarest elements of each node, one of which any linked pair shares.

    ``place`` is the element's place in the node's order.  An element that may be in more than
    TOKEN_ROWS sets gets a token for every tile of two slices of the nodes, so that no token
    gathers more rows than a task can hold.
    """
    counts_of = docs.sparkSession.sparkContext.broadcast(np.minimum(sketch, np.iinfo(np.int32).max).astype(np.int32))
    token_rows = TOKEN_ROWS

    def read(batches):
        shingle, counts = Shingler(), counts_of.value
        for batch in batches:
            nodes, sizes, tokens, tiles = [], [], [], []
            for text in batch.column(0):
                grams = shingle(text.as_py())
                if not len(grams):
                    continue
                often = counts[(grams >> np.uint64(44)).astype(np.int64)]
                order = np.lexsort((grams, often))[:prefix_length(len(grams), percent)]
                node, own = node_of(grams), grams[order]
                slices = -(-often[order] // token_rows)
                nodes.append(short(node))
                sizes.append(len(grams))
                tokens.append(own.view(np.int64))
                tiles.append(_tiles(own, slices, int.from_bytes(node[:8], "little")) if (slices > 1).any() else [])
            lengths = pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32())
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                                   pa.ListArray.from_arrays(lengths, pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64))),
                                   pa.array(tiles, pa.list_(pa.struct([("token", pa.int64()), ("place", pa.int32())])))], names=["nid", "n", "tokens", "tiles"])

    found = docs.select(F.col(f"`{text_col}`")).mapInArrow(light(read), "nid bigint, n bigint, tokens array<bigint>, tiles array<struct<token: bigint, place: int>>")
    once = found.groupBy("nid").agg(*[F.any_value(c).alias(c) for c in ("n", "tokens", "tiles")])
    # An element with tiles is probed in its tiles only.
    plain = F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("token"), i.alias("place"))), lambda x: ~F.exists("tiles", lambda y: y["place"] == x["place"]))
    probes = F.when(F.size("tiles") == 0, F.transform("tokens", lambda t, i: F.struct(t.alias("token"), i.alias("place")))).otherwise(F.concat(plain, "tiles"))
    return once.select("nid", "n", F.explode(probes).alias("t")).select("t.token", "t.place", "nid", "n")


def _tiles(tokens: np.ndarray, slices: np.ndarray, node: int) -> list[dict]:
    """Tokens of the tiles a node belongs to, for elements with several slices of nodes: those of its slice with every slice."""
    out = []
    for place in np.flatnonzero(slices > 1):
        k = int(slices[place])
        own = node % k
        numbers = np.array([min(own, t) * k + max(own, t) for t in range(k)], np.uint64)
        out += [{"token": int(x), "place": int(place)} for x in mixed(tokens[place] + numbers * np.uint64(MIX[0])).view(np.int64)]
    return out


def connected(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Label of every row of one token: rows of near sizes that leave enough elements for a link are connected.

    If the token is the first that two sets share, they share at most the elements from it on;
    a pair that fails this here and is linked all the same is found at its first shared token.
    ``n`` is ascending.
    """
    left = n - place
    label = np.full(len(n), -1)
    free = np.ones(len(n), bool)
    first = np.searchsorted(n, -(-percent * n // 100))
    last = np.searchsorted(n, 100 * n // percent, side="right")
    # A row that could not even link with a set of its least size has no partner.
    alone = left * (100 + percent) < percent * (n + n[first])
    for start in np.flatnonzero(~alone):
        if not free[start]:
            continue
        free[start], label[start], front = False, start, [start]
        while front:
            x = front.pop()
            rows = first[x] + np.flatnonzero(free[first[x]:last[x]])
            near = rows[np.minimum(left[x], left[rows]) * (100 + percent) >= percent * (n[x] + n[rows])]
            free[near], label[near] = False, start
            front += near.tolist()
    return label


def _tiles_of(probes: DataFrame, percent: int) -> DataFrame:
    """(tile, nid): nodes that share a probe and may be linked, as far as sizes and the elements left tell; at most one row for each of ``probes``."""
    rows = probes.repartition("token").sortWithinPartitions("token", "n")

    def connect(batches):
        held: list[pa.RecordBatch] = []

        def settle(run: pa.Table) -> pa.RecordBatch:
            """Tiles of a table of whole tokens."""
            token, n, place, node = (run.column(c).to_numpy() for c in ("token", "n", "place", "nid"))
            edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
            sizes = np.diff(edges)
            # Two nodes, the usual case, all at once.
            x = edges[:-1][sizes == 2]
            left = np.minimum(n[x] - place[x], n[x + 1] - place[x + 1])
            x = x[(100 * n[x] >= percent * n[x + 1]) & (left * (100 + percent) >= percent * (n[x] + n[x + 1]))]
            at, start = [np.repeat(x, 2) + np.tile([0, 1], len(x))], [np.repeat(x, 2)]
            for a, b in zip(edges[:-1][sizes > 2], edges[1:][sizes > 2]):
                label = connected(n[a:b], place[a:b], percent)
                rows = np.flatnonzero(label >= 0)
                rows = rows[np.bincount(label[rows], minlength=b - a)[label[rows]] > 1]
                at.append(a + rows)
                start.append(a + label[rows])
            at, start = np.concatenate(at), np.concatenate(start)
            tile = mixed(token[start].view(np.uint64) ^ mixed(node[start].view(np.uint64)))
            return pa.record_batch([pa.array(tile.view(np.int64)), pa.array(node[at])], names=["tile", "nid"])

        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column("token").to_numpy()
            tail = int(np.argmax(token == token[-1]))  # the last token may go on in the next batch
            if tail:
                yield settle(pa.Table.from_batches([*held, batch.slice(0, tail)]))
                held = []
            elif held and held[-1].column("token")[0].as_py() != token[0]:
                yield settle(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(tail))
        if held:
            yield settle(pa.Table.from_batches(held))

    return rows.select("token", "place", "nid", "n").mapInArrow(light(connect), "tile bigint, nid bigint")


def _connections(probes: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect all nodes that share a probe and whose sizes and bitmaps allow a link; at most one for each row of ``probes``."""
    tiles = stored(_tiles_of(probes, percent))
    bags = tiles.groupBy("tile").agg(F.count("*").alias("size"), F.bit_xor("nid").alias("x"), F.bit_xor(F.xxhash64("nid")).alias("y"))
    kept = bags.groupBy("size", "x", "y").agg(F.min("tile").alias("tile")).select("tile")
    rows = tiles.join(kept, "tile", "left_semi").join(nodes.select("nid", "n", "bitmap"), "nid").repartition("tile").sortWithinPartitions("tile", "n", "nid")

    def connect(batches):
        key, held = None, []

        def done():
            nid, n = [r[0] for r in held], np.array([r[1] for r in held])
            maps = families.Bitmaps([r[2] for r in held], n)
            free = np.ones(len(n), bool)
            first, last = np.searchsorted(n, -(-percent * n // 100)), np.searchsorted(n, 100 * n // percent, side="right")
            out = []
            for start in range(len(n)):
                if not free[start]:
                    continue
                free[start], front, group = False, [start], [start]
                while front:
                    x = front.pop()
                    rows = first[x] + np.flatnonzero(free[first[x]:last[x]])
                    near = rows[maps.may_link(x, rows, percent)] if len(rows) else rows
                    free[near] = False
                    front += near.tolist()
                    group += near.tolist()
                least = min(nid[i] for i in group)  # the smallest node stands for all, in every tile alike
                out += [(least, nid[i]) for i in group if nid[i] != least]
            return out

        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != key:
                    if len(held) > 1:
                        found += done()
                    key, held = row[0], []
                held.append(row[1:])
            yield pa.record_batch([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        if len(held) > 1:
            found = done()
            yield pa.record_batch([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.select("tile", "nid", "n", "bitmap").mapInArrow(light(connect), "a bigint, b bigint").distinct()


def _banded(members: DataFrame, percent: int) -> DataFrame:
    """Members of families cut by size: bands lie in two rows, half a band apart, so that sets of near size share one."""
    level = F.log(F.col("n")) / F.log(F.lit(100 / percent))
    width = 2  # levels of a band; near sizes are at most one level apart
    bands = F.array(*[F.floor(level / width + half / 2).cast("int") * 2 + half for half in (0, 1)])
    return members.withColumn("band", F.explode(bands)).withColumn("family", F.xxhash64("family", "band")).drop("band")


def grouped(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, n_shingles, root (null for empty sets) and component_id of every document."""
    rows, sketch = profiles(docs, id_col, text_col)
    nodes = stored(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.any_value(c).alias(c) for c in ("n", "nid", "bitmap")]))
    # Candidates go by 64 bits of a node's name; two nodes of one short name are in one family.
    family = components(stored(_connections(_probes(docs, sketch, percent, text_col), nodes, percent)))
    wanted = nodes.join(family.select(F.col("node").alias("nid"), F.col("root").alias("family")), "nid").select("family", "node", "doc_id")
    members = stored(_banded(sets_of(docs, wanted, id_col, text_col).withColumn("root", F.col("node")), percent))
    groups = components(families.settle(members, percent, components, bitmaps=True))
    rooted = nodes.select("node", "doc_id").join(groups, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = stored(rooted.join(lowest, "root").select("node", "root", "component_id"))
    return (rows.join(of_node, "node", "left")
            .select("doc_id", "row", F.col("n").alias("n_shingles"), "root",
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def join(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id of the linked group) of every document."""
    return grouped(docs, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def deduplicated(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each linked group, the one with the smallest doc_id; documents without words all stay.  Columns may have any names."""
    return aside(docs, [id_col, text_col], lambda df: _one_of_each(df, percent, id_col, text_col))


def _one_of_each(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    found = stored(grouped(docs, percent, id_col, text_col))
    first = (found.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("s"))
             .select(F.col("s.doc_id").alias("__id"), F.col("s.row").alias("__row")))
    alone = found.where("root IS NULL").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct().withColumn("__many", F.lit(False))
    # Equal rows cannot be told apart; only those that repeat are brought together to keep one.
    repeated = found.groupBy(F.col("doc_id").alias("__i"), F.col("row").alias("__r")).count().where("count > 1").select("__i", "__r", F.lit(True).alias("__m"))
    first = (first.join(repeated, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__row") == F.col("__r")), "left")
             .select("__id", "__row", F.coalesce("__m", F.lit(False)).alias("__many")))
    kept = small(stored(first.union(alone)), BROADCAST_ROWS)
    chosen = docs.withColumn("__h", row_hash(docs)).join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__row")))
    once = chosen.where("__many").dropDuplicates([id_col, "__h"])
    return chosen.where("NOT __many").union(once).select(*[F.col(f"`{c}`") for c in docs.columns])
