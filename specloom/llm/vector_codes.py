"""Vector codes: product quantisation in whole numbers, by Lloyd rounds with resident members.

A vector's components x become floor(1024 x) and the vector is cut into four parts of equal
length.  Every part position has a codebook of 256 entries, at first that part of the vectors
with the smallest ids.  A round assigns each part to the nearest entry (squared distance, the
lower index on ties) and replaces each entry by floor(sum / count) of its members.

Parts are rows placed by (position, entry, salt), their owner; an entry with many members has many
salts.  A round reads the resident rows where they lie: those that keep their entry are written
by the task that read them, without an exchange, and only those that change entry are shuffled to
their new owner.  In the same pass every task adds up the members it now holds, so an
entry's update is a sum over one small row a task.  Codebooks are the only thing that reaches the
driver: 256 vectors, whatever the input.  Each round is a table in the shared folder.

Sums and distances are exact: below ``EXACT`` by products of doubles that hold whole numbers,
beyond it by Python's integers.

Defined results: a vector takes part if it is not null, not empty and of finite components (also
times 1024), and has the length of the vector with the smallest id, which must be divisible by four (if it is not, there
is no result).  Rows that repeat an id are coded each, and each is a member; among the first 256 they stand in
the order of their components.  A null id comes after all others.  With fewer than 256 vectors
the codebooks are as short.  An error beyond a long is null.  An empty table gives no rows.  Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import light, small, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Members of an entry that share a salt, on average.
MEMBERS = 128
#: Whole numbers below this have exact sums of products of parts in doubles.
EXACT = 1 << 20
#: Sums of errors up to this many labels are broadcast.
BROADCAST_LABELS = 100_000
#: Distances that a task holds at once.
CELLS = 1 << 22

Book = list[list[int]]  # entries of one part position


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x) as doubles, which hold it exactly."""
    return np.floor(vectors.astype(np.float64) * SCALE)


def nearest_entry(parts: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of every part."""
    width = parts.shape[1]
    index, error = np.zeros(len(parts), np.int32), np.zeros(len(parts), object)
    largest = max([float(np.abs(parts).max(initial=0)), *(abs(x) for e in book for x in e)])
    exact = largest * largest * 4 * max(width, 1) < 1 << 53 and largest < EXACT
    entries = np.array(book, np.float64 if exact else object).reshape(len(book), width)
    for at in range(0, len(parts), step := max(1, CELLS // (len(book) * (1 if exact else max(width, 1))))):
        p = parts[at:at + step]
        if exact:
            d = (p * p).sum(1)[:, None] - 2 * (p @ entries.T) + (entries * entries).sum(1)[None, :]
            best = d.argmin(1)
            error[at:at + step] = [int(x) for x in d[np.arange(len(p)), best]]
        else:
            rows = [[int(x) for x in row] for row in p]
            far = [[sum((x - y) ** 2 for x, y in zip(row, e)) for e in entries.tolist()] for row in rows]
            best = np.array([f.index(min(f)) for f in far])
            error[at:at + step] = [f[i] for f, i in zip(far, best)]
        index[at:at + step] = best
    return index, error


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length of a list column as doubles."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _usable(vector) -> F.Column:
    limit = 1.7976931348623157e308 / SCALE
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= limit))


def _usable_vectors(table: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> tuple[DataFrame, list[Book]]:
    """(id, label, v) of the rows that take part, and the first codebooks."""
    vector = F.col(f"`{vector_col}`")
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    rows = table.where(F.coalesce(_usable(vector), F.lit(False))).select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    head = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    length = len(head[0].v) if head else 0
    if not length or length % PARTS:
        return rows.limit(0), [[] for _ in range(PARTS)]
    rows = rows.where(F.size("v") == length)
    # At most ENTRIES rows.
    firsts = np.array([r.v for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()], float).reshape(-1, length)
    return rows, [[[int(x) for x in e] for e in part] for part in np.split(whole(firsts), PARTS, axis=1)]


_PART = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("salt", T.LongType()),
                      T.StructField("spread", T.LongType()), T.StructField("part", T.ArrayType(T.DoubleType()))])
_OWNED = T.StructType([*_PART.fields, T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.StringType()))])


def _part_rows(position: int, entry: np.ndarray, salts: np.ndarray, spread: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """Rows of one position; ``salts`` has the number of salts of every entry."""
    salt = spread % np.maximum(salts[entry], 1) if len(entry) else spread
    lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32), part.ravel())
    return pa.record_batch([pa.array(np.full(len(entry), position, np.int32)), pa.array(entry), pa.array(salt), pa.array(spread), lists], names=_PART.names)


def first_parts(rows: DataFrame, books: list[Book], salts: np.ndarray) -> DataFrame:
    """Parts of all vectors with their first entry and salt; ``spread`` numbers them within a task."""
    def assign(batches):
        seen = 0
        for batch in batches:
            parts = np.split(whole(matrix(batch.column(0))), PARTS, axis=1)
            spread = np.arange(seen, seen + batch.num_rows, dtype=np.int64) + batch.column(1).to_numpy()
            seen += batch.num_rows
            for position, part in enumerate(parts if batch.num_rows else []):
                entry, _ = nearest_entry(part, books[position])
                yield _part_rows(position, entry, salts[position], spread, part)

    # A random start for each task keeps the salts of two tasks' rows apart.
    return rows.select("v", (F.xxhash64("id", "v").bitwiseAND(F.lit((1 << 40) - 1))).alias("spread")).mapInArrow(light(assign), _PART)


def _assigned(members: DataFrame, books: list[Book], salts: np.ndarray, moved: bool) -> DataFrame:
    """The members that change entry under ``books`` (with the new one), or those that do not."""
    def assign(batches):
        for batch in batches:
            at, entry = batch.column("position").to_numpy(), batch.column("entry").to_numpy()
            spread, part = batch.column("spread").to_numpy(), matrix(batch.column("part"))
            for position in np.unique(at):
                own = np.flatnonzero(at == position)
                now, _ = nearest_entry(part[own], books[position])
                chosen = (now != entry[own]) == moved
                if moved:
                    yield _part_rows(int(position), now[chosen], salts[position], spread[own][chosen], part[own][chosen])
                else:
                    yield batch.take(pa.array(own[chosen]))

    return members.select(*_PART.names).mapInArrow(light(assign), _PART)


def _owned(members: DataFrame) -> DataFrame:
    """The rows as they are, and for each task one row an entry with the count and sums of the members it holds."""
    def own(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            n = batch.num_rows
            yield pa.record_batch([*batch.columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.string()))], names=_OWNED.names)
            key = batch.column("position").to_numpy().astype(np.int64) * ENTRIES + batch.column("entry").to_numpy()
            part = matrix(batch.column("part"))
            order = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.diff(key[order], prepend=-1))
            exact = np.abs(part).max(initial=0) * max(n, 1) < 1 << 53
            if n and exact:
                sums = np.add.reduceat(part[order], edges, axis=0)
            for i, (a, b) in enumerate(zip(edges, [*edges[1:], n])):
                total = [int(x) for x in sums[i]] if exact else [sum(map(int, c)) for c in part[order[a:b]].T]
                name = divmod(int(key[order[a]]), ENTRIES)
                count, before = held.get(name, (0, [0] * len(total)))
                held[name] = count + int(b - a), [x + y for x, y in zip(before, total)]
        if held:
            n = len(held)
            yield pa.record_batch([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                                   pa.nulls(n, pa.list_(pa.float64())), pa.array([c for c, _ in held.values()], pa.int64()),
                                   pa.array([[str(x) for x in s] for _, s in held.values()], pa.list_(pa.string()))], names=_OWNED.names)

    return members.mapInArrow(light(own), _OWNED)


def _updated(state: DataFrame, books: list[Book]) -> tuple[list[Book], np.ndarray]:
    """Codebooks after an update by the owners' sums, and the number of members of every entry."""
    def total(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for position, entry, n, sums in zip(*(c.to_pylist() for c in batch.columns)):
                count, before = held.get((position, entry), (0, [0] * len(sums)))
                held[position, entry] = count + n, [x + int(y) for x, y in zip(before, sums)]
        yield pa.record_batch([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()),
                               pa.array([[str(x) for x in s] for _, s in held.values()], pa.list_(pa.string()))], names=["position", "entry", "n", "sums"])

    books, counts = [list(b) for b in books], np.zeros((PARTS, ENTRIES), np.int64)
    owners = state.where("n IS NOT NULL").select("position", "entry", "n", "sums")
    for position, entry, n, sums in owners.repartition("position", "entry").mapInArrow(total, "position int, entry int, n bigint, sums array<string>").collect():
        books[position][entry] = [int(x) // n for x in sums]
        counts[position, entry] = n
    return books, counts


def lloyd(rows: DataFrame, books: list[Book], rounds: int = ROUNDS, members: int = MEMBERS) -> list[Book]:
    """Codebooks after ``rounds`` rounds of assignment and update over all vectors."""
    n = rows.count()
    # Nothing is known of the entries yet: the first salts allow for all parts of a position at one entry.
    salts = np.full((PARTS, ENTRIES), 1 + n // members)
    state = None
    for _ in range(rounds):
        if state is None:
            now = first_parts(rows, books, salts).repartition("position", "entry", "salt")
        else:
            resident = state.where("n IS NULL")
            moving = _assigned(resident, books, salts, True).repartition("position", "entry", "salt")
            now = _assigned(resident, books, salts, False).union(moving)
        state = stored(_owned(now))
        books, counts = _updated(state, books)
        salts = 1 + counts // members
    return books


def written(books: list[Book]) -> str:
    """All numbers of all entries, by part, entry and place, comma-joined."""
    return ",".join(str(x) for book in books for entry in book for x in entry)


def encode(rows: DataFrame, books: list[Book]) -> DataFrame:
    """id, label, code and error of every vector, in one pass without an exchange."""
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("label", rows.schema["label"].dataType),
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def code(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [nearest_entry(p, b) for p, b in zip(np.split(whole(matrix(batch.column(2))), PARTS, axis=1), books)]
            error = [x if x < 1 << 63 else None for x in sum(e for _, e in found)]
            codes = ["".join(f"{i:02x}" for i in row) for row in zip(*(i.tolist() for i, _ in found))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=schema.names)

    to_arrow_type(schema["id"].dataType), to_arrow_type(schema["label"].dataType)  # both must have an Arrow form
    return rows.select("id", "label", "v").mapInArrow(light(code), schema)


def codes(table: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> tuple[DataFrame, list[Book]]:
    """id, label, code, error and label_error (error summed over equal labels) of every vector that takes part, and the codebooks."""
    rows, books = _usable_vectors(table, id_col, vector_col, label_col)
    rows = stored(rows)
    if books[0]:
        books = lloyd(rows, books, rounds)
    coded = stored(encode(rows, books))
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    sums = small(stored(sums), BROADCAST_LABELS)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label"), books


def digest(books: list[Book]) -> str:
    return hashlib.sha256(written(books).encode()).hexdigest()
