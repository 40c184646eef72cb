"""Sequence packing as a cutting-stock problem solved by column generation.

Documents are tokenised and cut into pieces: full ones of ``capacity`` tokens and one remainder.
The histogram of remainder lengths, in steps of ``unit`` tokens, is the demand of a cutting-stock
linear program whose columns are patterns (how many pieces of each length class share a
sequence).  A knapsack dynamic program prices new patterns from the dual values until none has
a reduced cost; pattern counts are rounded down and the few pieces left are packed first-fit.
The program sees the histogram only (``capacity / unit`` numbers), so its cost does not depend
on the number of documents.

Pieces are then ranked within their length class and looked up in the patterns: rank r of class
c belongs to one copy of one pattern.  Ranks come from counts by (class, hash block), so a class
with a third of all pieces is ranked by many tasks.

Padding: a sequence is padded to ``capacity`` unless its token count is a power of two.

Defined results: null text is empty and has the end token only; repeated rows are packed each;
an empty table gives no pieces; columns of the input other than the id and text are not read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T, Window

from .shared import batch_bytes, light, process_state, stored

CAPACITY = 2048
UNIT = 8
END_ID = 1
#: Hash blocks by which a length class is ranked.
BLOCKS = 1024
#: Chunks whose ids a worker remembers; some 50 bytes each.
REMEMBERED = 200_000
BREAK = "^[\\r\\n]"
#: A run of letters, maybe after line breaks, and what follows it in the chunk.
LETTERS = "^(?P<head>[\\r\\n]*[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)(?P<rest>(?s)[^A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\\pL].*)$"
#: Chunks given to the tokenizer in one text, and the character that stands for a blank in its vocabulary.
JOINED = 1000
BLANK = "\u0120"
#: Characters of the texts that are split into chunks at a time.
RUN_CHARS = 2_000_000
#: Bytes of ids and texts that a task is given at a time.
BATCH_BYTES = 4 << 20


def column_generation(demand: np.ndarray, capacity: int, limit: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and their counts in an optimal solution of the cutting-stock linear program.

    ``demand[i]`` pieces of length i + 1 are wanted, from stock of length ``capacity``.
    """
    kinds = np.flatnonzero(demand)
    m = len(kinds)
    if not m:
        return []
    sizes = kinds + 1
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    amounts = inverse @ demand[kinds].astype(float)
    worth = np.zeros(capacity + 1)
    for _ in range(limit):
        duals = np.maximum(inverse.sum(axis=0), 0)
        worth[:] = 0
        worth[sizes] = duals
        best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
        for room in range(1, capacity + 1):
            values = worth[1:room + 1] + best[room - 1::-1]
            choice[room] = values.argmax()
            best[room] = values[choice[room]]
        if best[capacity] <= 1 + 1e-7:
            break
        pattern, room = np.zeros(capacity + 1), capacity
        while room > 0:
            size = choice[room] + 1
            pattern[size] += worth[size] > 0
            room -= size
        column = pattern[sizes]
        direction = inverse @ column
        positive = direction > 1e-10
        ratios = np.where(positive, amounts / np.where(positive, direction, 1), np.inf)
        leaving = int(ratios.argmin())
        step = ratios[leaving]
        amounts = np.maximum(amounts - step * direction, 0)
        amounts[leaving] = step
        basis[:, leaving] = column
        row = inverse[leaving] / direction[leaving]
        inverse -= np.outer(direction, row)
        inverse[leaving] = row
    full = []
    for j in range(m):
        pattern = np.zeros(len(demand), int)
        pattern[kinds] = basis[:, j].round().astype(int)
        full.append((pattern, float(amounts[j])))
    return full


def whole_patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that meet the demand exactly."""
    left, out = demand.astype(np.int64).copy(), []
    for pattern, amount in sorted(column_generation(demand, capacity), key=lambda x: -x[1]):
        used = pattern > 0
        copies = min(int(amount + 1e-6), int((left[used] // pattern[used]).min())) if used.any() else 0
        if copies > 0:
            left -= copies * pattern
            out.append((pattern, copies))
    bins: list[list] = []
    for size in range(len(demand), 0, -1):
        for _ in range(int(left[size - 1])):
            for b in bins:
                if b[0] >= size:
                    break
            else:
                b = [capacity, np.zeros(len(demand), int)]
                bins.append(b)
            b[0] -= size
            b[1][size - 1] += 1
    return out + [(b[1], 1) for b in bins]


def _gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    at = np.repeat((starts - (ends - lens)).astype(kind), lens)
    at += np.arange(total, dtype=kind)
    return flat[at]


class TokenBytes:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    Between two characters that are not white space a single blank or a line break always starts
    a new pre-token, and so does what follows a run of letters.  The ids of a text are therefore
    those of its chunks, which start at a blank or with line breaks.  The distinct chunks of many
    texts are looked up in columns; of an unseen one, the letters it begins with and the rest are
    given to the tokenizer once each, many chunks in one text: a token that starts with a blank
    starts a chunk.  Texts with other blanks go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.blank = np.zeros(1 + max(vocabulary.values()), bool)
        self.blank[[i for token, i in vocabulary.items() if token.startswith(BLANK)]] = True
        self.words = pa.array([], pa.large_string())  # remembered chunks; each one's ids are a stretch of flat
        self.flat = np.zeros(0, np.uint32)
        self.starts, self.lens, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    @classmethod
    def of_process(cls, path: str) -> TokenBytes:
        """The instance of this worker process: it outlives a task, and so does what it remembers."""
        return process_state("packing", path, lambda: cls(path))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after the other, and how many each text has."""
        made = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *made]), np.array([len(x) for x in made], np.int64)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of chunks, each after a blank; chunks neither start nor end with white space."""
        out, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(chunks), JOINED):
            part = chunks[i:i + JOINED]
            ids, _ = self.encode([" " + " ".join(part)])
            edges = np.flatnonzero(self.blank[ids])
            if len(edges) == len(part) and edges[0] == 0:
                own = np.diff(np.append(edges, len(ids)))
            else:  # a vocabulary that writes blanks in another way
                ids, own = self.encode([" " + c for c in part])
            out.append(ids)
            lens.append(own)
        return np.concatenate(out), np.concatenate(lens)

    def add(self, words: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lens) - lens)
        self.flat = np.append(self.flat, ids)
        self.lens = np.append(self.lens, lens)
        self.uses = np.append(self.uses, np.zeros(len(words), np.int64))

    def forget(self, room: int) -> None:
        """Keep the ``room`` chunks that the most runs have used."""
        kept = np.sort(np.argpartition(self.uses, -room)[-room:])
        self.flat = _gather(self.flat, self.starts[kept], self.lens[kept])
        self.words, self.lens, self.uses = self.words.take(pa.array(kept)), self.lens[kept], self.uses[kept] // 2
        self.starts = np.cumsum(self.lens) - self.lens

    def learn(self, chunks: pa.Array) -> None:
        """Remember the ids of distinct chunks not seen before, those after a blank with the blank's."""
        split = pc.extract_regex(chunks, LETTERS)
        both, alone = chunks.filter(split.is_valid()), chunks.filter(split.is_null())
        heads = split.field("head").filter(split.is_valid()).dictionary_encode()
        rests = split.field("rest").filter(split.is_valid()).dictionary_encode()
        size, head = len(self.words), pc.index_in(heads.dictionary, value_set=self.words)
        unseen = heads.dictionary.filter(head.is_null())
        plain = pa.concat_arrays([alone, unseen.filter(pc.index_in(unseen, value_set=alone).is_null())])
        broken = pc.match_substring_regex(plain, BREAK)
        own, after = plain.filter(broken), plain.filter(pc.invert(broken))
        self.add(after, *self.encode_chunks(after.to_pylist()))
        self.add(own, *self.encode(own.to_pylist()))
        if len(both):
            ids, lens = self.encode(rests.dictionary.to_pylist())
            place = head.fill_null(-1).to_numpy().copy()
            place[place < 0] = pc.index_in(unseen, value_set=self.words.slice(size)).to_numpy() + size
            place, mark = place[heads.indices.to_numpy()], rests.indices.to_numpy()
            starts = np.stack([self.starts[place], len(self.flat) + (np.cumsum(lens) - lens)[mark]], 1).ravel()
            pairs = np.stack([self.lens[place], lens[mark]], 1)
            self.add(both, _gather(np.append(self.flat, ids), starts, pairs.ravel()), pairs.sum(axis=1))

    def __call__(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        if not len(texts):
            return []
        if len(self.words) > REMEMBERED:
            self.forget(REMEMBERED // 2)
        parts = pc.split_pattern(pc.replace_substring_regex(texts, r"([\r\n]+)", r" \1"), " ")
        counts = parts.value_lengths().to_numpy()
        first = np.cumsum(counts) - counts
        parts = parts.flatten()
        starting = parts.take(pa.array(first))
        found = parts.dictionary_encode()
        chunks, codes = found.dictionary, found.indices.to_numpy().copy()
        del parts, found
        place = pc.index_in(chunks, value_set=self.words)
        known = place.drop_null().to_numpy()
        self.uses[known] += 1
        size, unseen = len(self.words), chunks.filter(pc.is_null(place))
        # Line breaks may start a chunk; one with white space at another edge has no ids of its own, and its texts go whole.
        inner = pc.and_(pc.not_equal(unseen, ""), pc.equal(pc.utf8_rtrim_whitespace(unseen), unseen))
        inner = pc.and_(inner, pc.or_(pc.equal(pc.utf8_ltrim_whitespace(unseen), unseen), pc.match_substring_regex(unseen, BREAK)))
        self.learn(unseen.filter(inner))
        added = pc.index_in(unseen, value_set=self.words.slice(size)).fill_null(-1 - size).to_numpy() + size
        place = place.fill_null(-1).to_numpy().copy()
        place[place < 0] = added
        head_ids, head_lens = self.encode(starting.to_pylist())
        starts = np.concatenate([np.append(self.starts, 0)[place], len(self.flat) + np.cumsum(head_lens) - head_lens])
        lens = np.concatenate([np.append(self.lens, 0)[place], head_lens])
        good = np.concatenate([place >= 0, pc.and_(pc.equal(pc.utf8_rtrim_whitespace(starting), starting), pc.not_equal(starting, "")).to_numpy(zero_copy_only=False)])
        codes[first] = len(chunks) + np.arange(len(texts))
        own = lens[codes]
        data = _gather(np.append(self.flat, head_ids), starts[codes], own).astype("<u4", copy=False).tobytes()
        edges = 4 * np.append(0, np.cumsum(np.add.reduceat(own, first)))
        out = [data[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist())]
        for i in np.flatnonzero(~np.logical_and.reduceat(good[codes], first)):
            out[i] = self.encode([texts[int(i)].as_py()])[0].astype("<u4", copy=False).tobytes()
        return out


def _runs(sizes: list[int]):
    """Consecutive runs of texts of about RUN_CHARS characters."""
    first = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= RUN_CHARS:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids (binary)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                           T.StructField("doc_tokens", T.LongType())] + [T.StructField("ids", T.BinaryType())] * with_ids)

    def pieces(batches):
        encode = TokenBytes.of_process(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for first, last in _runs(sizes):
                texts = batch.column(1).slice(first, last - first)
                owner, start, length, crc, total, ids = [], [], [], [], [], []
                for i, data in enumerate(encode(texts), first):
                    data += end
                    for at in range(0, len(data), width):
                        part = data[at:at + width]
                        owner.append(i)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(len(data) // 4)
                        if with_ids:
                            ids.append(part)
                columns = [batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
                yield pa.record_batch(columns + [pa.array(ids, pa.binary())] * with_ids, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(light(pieces), schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, unit: int = UNIT, blocks: int = BLOCKS, **options) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset; pieces of a sequence lie end to end from 0."""
    spark = docs.sparkSession
    keyed = cut(docs, tokenizer, capacity, **options).withColumns({
        "__class": F.ceil(F.col("length") / unit).cast("int"),
        "__block": F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)).cast("int")})
    with batch_bytes(spark, BATCH_BYTES):
        pieces = stored(keyed)
    counts = stored(pieces.groupBy("__class", "__block").agg(F.count("*").alias("__n")))
    classes = capacity // unit
    demand = np.zeros(classes, np.int64)
    for k, n in counts.groupBy("__class").agg(F.sum("__n")).collect():
        demand[k - 1] = n
    # Pieces of the largest class fill a sequence each.
    patterns = [(np.eye(1, classes, classes - 1, dtype=int)[0], int(demand[-1]))] if demand[-1] else []
    patterns += whole_patterns(np.append(demand[:-1], 0), classes)
    runs: dict[int, list] = {k: [] for k in range(1, classes + 1)}
    ranked, sequence = np.zeros(classes, np.int64), 0
    for pattern, copies in patterns:
        for k in np.flatnonzero(pattern):
            runs[int(k) + 1].append((int(ranked[k]), int(pattern[k]), sequence))
            ranked[k] += copies * pattern[k]
        sequence += copies
    plan = spark.createDataFrame([(k, r) for k, r in runs.items()], "__c int, __runs array<struct<first: bigint, per: bigint, sequence: bigint>>")
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__class").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("__class").alias("__c"), F.col("__block").alias("__b"), before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__class", "__block").orderBy("doc_id", "start", "ids_crc32")) - 1
    # One row a length class, whatever the input: small enough for every executor.
    placed = (pieces.withColumn("__rank", rank)
              .join(offsets, (F.col("__class") == F.col("__c")) & (F.col("__block") == F.col("__b"))).drop("__c")
              .join(F.broadcast(plan), F.col("__class") == F.col("__c"))
              .withColumn("__rank", F.col("__rank") + F.col("__before"))
              .withColumn("__run", F.element_at(F.filter("__runs", lambda r: r["first"] <= F.col("__rank")), -1))
              .withColumn("sequence_id", F.expr("__run.sequence + (__rank - __run.first) div __run.per")))
    inside = Window.partitionBy("sequence_id").orderBy("__class", "__rank").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
            .drop("__class", "__block", "__rank", "__c", "__b", "__before", "__runs", "__run"))
