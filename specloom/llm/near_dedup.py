"""Near-duplicate removal: MinHash signatures, joined by distance with several indexes.

A document's signature has ``PLACES`` places, each the low ``BITS`` bits of the smallest value of one hash
over its word 5-grams; two sets of Jaccard similarity s differ in a place with probability
1 - s.  The distance of two signatures is the number of places in which they differ.

1. ``profiles`` reads every text once: set size, digest of the set (equal sets are one node), signature.
2. Multi-index: a signature is cut into ``CHUNKS`` chunks.  Two signatures within ``DISTANCE`` have, by
   pigeonhole, a chunk with at most DISTANCE // CHUNKS errors; a chunk is indexed once for each way to leave that many
   places out, so such a pair shares an entry of the index for certain: none is missed.
3. Entries that hold the same nodes are kept once (the many entries two copies share become one).
   In each entry nodes are connected where size and distance allow a link; large entries are cut
   into slices that meet pairwise.  Connected nodes are a family: no candidate pair leaves it.
4. ``families.settle`` confirms links inside families on the full sets of shingles.

Below the distance the search is exact, and what it confirms is exact.  Two sets of similarity s are
further apart than DISTANCE = 23 of 60 places with the probability that a binomial variable of
60 trials and chance 1 - s exceeds 23: 2e-6 at s = 0.85, 1e-9 at 0.90; such a pair is still linked where a third copy connects it.

Defined results: null text or one without words has an empty set, links with nothing and is kept; one with
fewer than five words has the whole sequence as its element; equal sets are linked; rows that
repeat an id stay rows of their own (all kept, or none); a null id is never a component's
name unless all ids of the component are null, and then it counts as kept; an empty table gives an empty result; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import families
from .ngram_join import components
from .shared import light, process_state, stored
from .shingles import ROWS, Shingler, mixed, node_of, sets_of

PERCENT = 85
PLACES = 60
BITS = 16
CHUNKS = 12
DISTANCE = 23
#: Nodes of a slice of a large entry.
SLICE = 2048
#: Hash values held at once.
CELLS = 1 << 20


class Signer:
    """MinHash signatures of sets of 64-bit elements."""

    def __init__(self, places: int = PLACES, seed: int = 41):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.factors = draw.integers(0, 1 << 63, (places, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.masks = draw.integers(0, 1 << 64, (places, 1), np.uint64, endpoint=False)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max)
        for at in range(0, len(grams), step := CELLS // len(self.factors)):
            values = (grams[None, at:at + step] ^ self.masks) * self.factors
            least = np.minimum(least, (values ^ (values >> np.uint64(32))).min(axis=1))
        return (mixed(least) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def entries(signatures: np.ndarray, chunks: int = CHUNKS, errors: int = DISTANCE // CHUNKS) -> np.ndarray:
    """Index entries of signatures (rows): for every chunk and every choice of ``errors`` places left out, a hash of the others."""
    rows, places = signatures.shape
    width = places // chunks
    out = []
    for c in range(chunks):
        chunk = signatures[:, c * width:(c + 1) * width].astype(np.uint64)
        for k, left_out in enumerate(combinations(range(width), errors)):
            value = np.full(rows, c << 8 | k, np.uint64)
            for p in range(width):
                if p not in left_out:
                    value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + chunk[:, p])
            out.append(value.view(np.int64))
    return np.stack(out, axis=1)


def connected(signatures: np.ndarray, n: np.ndarray, percent: int, distance: int) -> np.ndarray:
    """Label of every node: nodes whose sizes and distance allow a link are connected."""
    label = np.full(len(n), -1)
    for start in range(len(n)):
        if label[start] >= 0:
            continue
        label[start], front = start, [start]
        while front:
            x = front.pop()
            free = np.flatnonzero(label < 0)
            if not len(free):
                break
            near = families.near_sizes(n[free], n[x], percent) & ((signatures[free] != signatures[x]).sum(axis=1) <= distance)
            label[free[near]] = start
            front += free[near].tolist()
    return label


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (set size), node (digest of the set) and signature of every document; the last two null for an empty set."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()),
                           T.StructField("node", T.BinaryType()), T.StructField("signature", T.BinaryType())])
    to_arrow_type(schema["doc_id"].dataType)

    def read(batches):
        process_state()
        shingle, sign = Shingler(), Signer()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n, node, signature = [], [], []
                for text in batch.column(1):
                    grams = shingle(text.as_py())
                    n.append(len(grams))
                    node.append(node_of(grams) if len(grams) else None)
                    signature.append(sign(grams).tobytes() if len(grams) else None)
                yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(signature, pa.binary())], names=schema.names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(light(read), schema)


def candidates(nodes: DataFrame, percent: int, distance: int = DISTANCE, slice_: int = SLICE) -> DataFrame:
    """Edges (a, b) that connect all nodes within ``distance`` whose sizes allow a link; few for each node, not all pairs."""
    errors = distance // CHUNKS

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                made = entries(np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, PLACES), CHUNKS, errors)
                yield pa.record_batch([batch.column("node"), pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, made.shape[1], dtype=np.int32)), pa.array(made.ravel()))], names=["node", "entries"])

    # Rows of the index name nodes by 64 bits; two nodes of one name are both looked at.
    rows = (nodes.select("node", "signature").mapInArrow(light(index), "node binary, entries array<bigint>")
            .select(F.xxhash64("node").alias("nid"), F.explode("entries").alias("entry")))
    held = rows.groupBy("entry").agg(F.count("*").alias("size"), F.bit_xor("nid").alias("x"), F.bit_xor(F.xxhash64("nid")).alias("y")).where("size > 1")
    # Entries of the same nodes: one is enough.
    kept = stored(held.groupBy("size", "x", "y").agg(F.min("entry").alias("entry")).select("entry", F.ceil(F.col("size") / slice_).cast("int").alias("slices")))
    own = F.pmod("nid", F.col("slices")).cast("int")
    seats = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    # The same plan at every size: shuffled sides, of which Spark can split large ones.
    tiles = (rows.join(kept.hint("merge"), "entry").select("entry", "nid", F.explode(seats).alias("seat")).select("entry", "seat.i", "seat.j", "nid")
             .join(nodes.select(F.xxhash64("node").alias("nid"), "node", "n", "signature"), "nid"))
    name = ["entry", "i", "j"]
    dealt = tiles.repartition(*name).sortWithinPartitions(*name)

    def connect(batches):
        key, held = None, []

        def done():
            signatures = np.frombuffer(b"".join(r[2] for r in held), np.uint16).reshape(-1, PLACES)
            label = connected(signatures, np.array([r[1] for r in held]), percent, distance)
            least: dict[int, bytes] = {}  # the smallest node stands for all, in every entry alike
            for i, k in enumerate(label.tolist()):
                least[k] = min(least.get(k, held[i][0]), held[i][0])
            return [(held[i][0], least[k]) for i, k in enumerate(label.tolist()) if held[i][0] != least[k]]

        for batch in batches:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*name, "node", "n", "signature"))):
                if row[:3] != key:
                    if len(held) > 1:
                        found += done()
                    key, held = row[:3], []
                held.append(row[3:])
            yield pa.record_batch([pa.array([e[k] for e in found], pa.binary()) for k in (0, 1)], names=["a", "b"])
        if len(held) > 1:
            found = done()
            yield pa.record_batch([pa.array([e[k] for e in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return dealt.select(*name, "node", "n", "signature").mapInArrow(light(connect), "a binary, b binary").distinct()


def grouped(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows = stored(profiles(docs, id_col, text_col))
    nodes = stored(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.any_value(c).alias(c) for c in ("n", "signature")]))
    edges = stored(candidates(nodes, percent))
    family = components(edges).select("node", F.col("root").alias("family"))
    wanted = nodes.join(family, "node").select("family", "node", "doc_id")
    members = stored(sets_of(docs, wanted, id_col, text_col).withColumn("root", F.col("node")))
    groups = components(families.settle(members, percent, components))
    rooted = nodes.select("node", "doc_id").join(groups, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = stored(rooted.join(lowest, "root").select("node", "component_id"))
    return (rows.join(of_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"),
                                                     F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def marked(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (is it its component's smallest doc_id?) of every document."""
    return grouped(docs, percent, id_col, text_col).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
