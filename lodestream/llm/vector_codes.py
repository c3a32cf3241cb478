"""Vector codes: vectors cut into parts, each part the number of the nearest entry of its codebook.

The codebooks are fitted in whole numbers by rounds of assignment and averaging, with the adaptive bounds of Drake and
Hamerly (2012). Each part of each vector keeps its entry with an upper bound of its distance, the b entries next to it
with a lower bound each, and one outer bound for all others. When entries move, the bounds move with them; where they
don't decide, distances are counted exactly, in whole numbers, to as many of the b entries as the bounds leave open. b
shrinks to what a round has needed. The bounds are written with the vectors after each round.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import bound_batches, extended, mapped, removed, small, table, written
from lodestream.llm.top_k import MOST, quantised

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of a larger magnitude count as this: the largest float times SCALE is below it.
LARGEST = 2**140
#: A sum goes through Spark as so many longs of LIMB bits.
LIMB, LIMBS = 40, 5
#: What the bounds give way for rounding: floats are good to 6e-8.
SLACK = 1e-6
#: Lower bounds stay below the largest float, so that what moves can be taken off them.
HIGHEST = 3e38
#: The share of parts whose needs b meets in the next round.
COVERED = 0.99


def whole(values: np.ndarray) -> np.ndarray:
    """Doubles that hold whole numbers, as int64 or, where some are large, as Python's integers."""
    if float(np.abs(values).max(initial=0)) < 1 << 26:
        return values.astype(np.int64)
    out = np.empty(values.shape, object)
    out.ravel()[:] = [max(-LARGEST, min(LARGEST, int(v))) for v in values.ravel().tolist()]
    return out


def _same_kind(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x, c) if x.dtype == c.dtype else (x.astype(object), c.astype(object))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The squared distances of all rows of x to all rows of c, exactly."""
    x, c = _same_kind(x, c)
    if x.dtype == object:
        return ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2) if x.shape[1] else np.zeros((len(x), len(c)), np.int64)
    a, b = x.astype(np.float64), c.astype(np.float64)
    reach = x.shape[1] * (float(np.abs(a).max(initial=0)) + float(np.abs(b).max(initial=0))) ** 2
    if reach < 1 << 52:  # doubles are exact
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)


def to_own(x: np.ndarray, c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The squared distances of rows of x to the rows ``at`` of c (for each row of x one, or some)."""
    x, c = _same_kind(x, c)
    return ((x.reshape(len(x), *[1] * (at.ndim - 1), x.shape[1]) - c[at]) ** 2).sum(axis=-1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def _up(x: np.ndarray) -> np.ndarray:
    return (x + np.abs(x) * SLACK).astype(np.float32)


def _down(x: np.ndarray) -> np.ndarray:
    return np.minimum(x - np.abs(x) * SLACK, HIGHEST).astype(np.float32)


def nearest(x: np.ndarray, c: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x: the nearest row of c (of equal ones the first), its upper bound, the next b, and their lower
    bounds with the outer bound behind them."""
    d = distances(x, c)
    rank = np.argsort(d, axis=1, kind="stable")[:, : b + 2]
    near = np.take_along_axis(d, rank, axis=1)
    root = _root(near)
    lower = np.full((len(x), b + 1), np.inf, np.float32)
    lower[:, : root.shape[1] - 1] = _down(root[:, 1:])
    order = np.zeros((len(x), b), np.uint8)
    order[:, : rank[:, 1 : b + 1].shape[1]] = rank[:, 1 : b + 1]
    return rank[:, 0].astype(np.uint8), _up(root[:, 0]), order, lower


def moved(x: np.ndarray, c: np.ndarray, move: np.ndarray, state: tuple, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The state of nearest() for entries that have moved, and how many of the next entries each row needed (b + 1: all
    entries). The state may have more than b entries; b is never raised."""
    at, upper, order, lower = state
    tail = _down(lower[:, -1] - move.max(initial=0))
    low = _down(lower[:, :-1] - move[order])
    if order.shape[1] > b:
        tail = np.minimum(tail, low[:, b:].min(axis=1))
        order, low = order[:, :b], low[:, :b]
    at, order, upper = at.copy(), order.copy(), _up(upper + move[at])
    lower = np.column_stack([low, tail])
    # a bound for the entries from each rank on
    onward = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]
    need = (onward <= upper[:, None]).sum(axis=1)
    open_ = np.flatnonzero(need)
    if len(open_):  # the distance to its own entry may settle it
        upper[open_] = _up(_root(to_own(x[open_], c, at[open_])))
        need[open_] = (onward[open_] <= upper[open_, None]).sum(axis=1)
    for n in np.unique(need).tolist():
        rows = np.flatnonzero(need == n)
        if n == b + 1:
            at[rows], upper[rows], order[rows], lower[rows] = nearest(x[rows], c, b)
        elif n:
            asked = np.sort(np.column_stack([at[rows], order[rows, :n]]), axis=1)  # so that of equal ones the first is taken
            d = to_own(x[rows], c, asked)
            rank = np.argsort(d, axis=1, kind="stable")
            asked, root = np.take_along_axis(asked, rank, axis=1), _root(np.take_along_axis(d, rank, axis=1))
            at[rows], upper[rows] = asked[:, 0], _up(root[:, 0])
            order[rows, :n], lower[rows, :n] = asked[:, 1:], _down(root[:, 1:])
    return at, upper, order, lower, need


# ---------------------------------------------------------------- the rows

_STATE = "q binary, at binary, upper binary, bounds binary, entries binary, need binary"


def _binary(values: np.ndarray) -> pa.Array:
    """A binary value for each row of an array."""
    values = np.ascontiguousarray(values)
    size = values.nbytes // max(1, len(values))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(values), [None, pa.py_buffer(values)]).cast(pa.binary()) if size else pa.array([b""] * len(values), pa.binary())


def _array(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _packed(values: np.ndarray) -> pa.Array:
    """A binary value for each row of doubles: integers of 16 bits if all of the rows fit, and else the doubles."""
    if float(np.abs(values).max(initial=0)) < 1 << 15:
        return _binary(values.astype(np.int16))
    return pa.array([(row.astype(np.int16) if np.abs(row).max() < 1 << 15 else row).tobytes() for row in values], pa.binary())


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a column of _packed() values as whole numbers."""
    rows = column.to_pylist()
    if all(len(row) == 2 * dim for row in rows):
        return np.frombuffer(b"".join(rows), np.int16).reshape(len(rows), dim).astype(np.int64)
    return whole(np.array([np.frombuffer(row, np.int16 if len(row) == 2 * dim else np.float64) for row in rows], np.float64))


def edges(dim: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of each part; the parts are equal if dim is a multiple of their number."""
    cut = [dim * j // parts for j in range(parts + 1)]
    return list(zip(cut, cut[1:], strict=False))


def _assign(dim: int, books: list[np.ndarray], moves: list[np.ndarray] | None, b: int):
    """Rows with the state that belongs to these codebooks."""
    spans = edges(dim, len(books))

    def run(batches):
        for batch in batches:
            n, q = batch.num_rows, batch.column("q")
            if not moves:
                q = _packed(q.flatten().to_numpy(zero_copy_only=False).reshape(n, dim))
            x = _vectors(q, dim)
            if moves:
                at, upper = _array(batch.column("at"), np.uint8, len(books)), _array(batch.column("upper"), np.float32, len(books))
                bounds, entries = _array(batch.column("bounds"), np.float32, len(books), -1), _array(batch.column("entries"), np.uint8, len(books), -1)
                old = [(at[:, j], upper[:, j], entries[:, j], bounds[:, j]) for j in range(len(books))]
                new = [moved(x[:, s:e], c, m, o, b) for (s, e), c, m, o in zip(spans, books, moves, old, strict=True)]
            else:
                new = [(*nearest(x[:, s:e], c, b), np.full(n, b + 1)) for (s, e), c in zip(spans, books, strict=True)]
            at, upper, order, lower, need = (np.stack([part[k] for part in new], axis=1) for k in range(5))
            state = [at, upper, lower, order, need.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], q, *map(_binary, state)], names=["id", "label", "q", "at", "upper", "bounds", "entries", "need"])

    return run


def _sums(dim: int, parts: int, entries: int, b: int):
    """One set of rows for each task: of each entry, the sums of the components and the number of its parts; and how many
    parts needed so many entries. ``slot`` numbers them."""
    spans = edges(dim, parts)

    def run(batches):
        total = [np.zeros((entries, e - s), object) for s, e in spans]
        count, needs = np.zeros((parts, entries), np.int64), np.zeros(b + 2, np.int64)
        for batch in batches:
            x, at = _vectors(batch.column("q"), dim), _array(batch.column("at"), np.uint8, parts)
            needs += np.bincount(_array(batch.column("need"), np.uint8, parts).ravel(), minlength=b + 2)
            for j, (s, e) in enumerate(spans):
                count[j] += np.bincount(at[:, j], minlength=entries)
                own = np.equal(np.arange(entries)[:, None], at[:, j])
                if x.dtype == object:
                    for i in range(entries):
                        total[j][i] += x[own[i], s:e].sum(axis=0)
                else:  # below 2^53, as a batch has few rows
                    total[j] = total[j] + (own.astype(np.float64) @ x[:, s:e].astype(np.float64)).astype(np.int64).astype(object)
        values = [int(v) for part in (*total, count, needs) for v in part.ravel().tolist()]
        limbs = [[v >> LIMB * k & (1 << LIMB) - 1 for v in values] for k in range(LIMBS - 1)]
        limbs.append([v >> LIMB * (LIMBS - 1) for v in values])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), *[pa.array(x, pa.int64()) for x in limbs]], names=["slot", *_LIMB_NAMES])

    return run


_LIMB_NAMES = [f"l{k}" for k in range(LIMBS)]


def _summed(state: DataFrame, dim: int, parts: int, entries: int, b: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    schema = "slot int, " + ", ".join(f"{name} bigint" for name in _LIMB_NAMES)
    found = state.select("q", "at", "need").mapInArrow(_sums(dim, parts, entries, b), schema)
    # a row for each component of each entry, however many vectors there are
    rows = found.groupBy("slot").agg(*[F.sum(name).alias(name) for name in _LIMB_NAMES]).orderBy("slot").collect()
    values = [sum(row[1 + k] << LIMB * k for k in range(LIMBS)) for row in rows]
    totals, at = [], 0
    for s, e in edges(dim, parts):
        totals.append(np.array(values[at : at + entries * (e - s)], object).reshape(entries, e - s))
        at += entries * (e - s)
    counts = np.array(values[at : at + parts * entries], np.int64).reshape(parts, entries)
    return totals, counts, np.array(values[at + parts * entries :], np.int64)


def _codes(dim: int, books: list[np.ndarray]):
    spans = edges(dim, len(books))

    def run(batches):
        for batch in batches:
            x, at = _vectors(batch.column("q"), dim), _array(batch.column("at"), np.uint8, len(books))
            found = [to_own(x[:, s:e], c, at[:, j]).astype(object) for j, ((s, e), c) in enumerate(zip(spans, books, strict=True))]
            error = [min(MOST, int(v)) for v in reduce(np.add, found).tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([row.tobytes().hex() for row in at], pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    return run


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if not book.size or max(abs(int(v)) for v in book.ravel().tolist()) < 1 << 26 else book


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """The codes of vectors (vec_id, embedding, label), and the codebook of each part.

    The codes are vec_id, label, code (an entry's number, as two hexadecimal digits, for each part) and error (the sum of
    the squared distances to the entries; beyond a long the largest long), in units of 1 / scale. Left out are null
    vectors, those with null or non-finite components, and those of another dimension than the vector of the smallest
    vec_id. The codebooks begin as the vectors of the smallest vec_ids (fewer, if there are fewer vectors; a null vec_id
    is largest; rows that repeat a vec_id count one by one, in the order of their components). If the dimension isn't a multiple of
    parts, parts differ by one component. Empty tables give no codes and no codebooks.

    Each round reads the vectors with their bounds and writes them with new ones; what comes to the driver are the sums
    of the entries. Tasks that are lost run again on what the round before has written.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    found = quantised(vectors.select("embedding", F.struct(F.col("vec_id").alias("id"), "label").alias("vec_id")), scale)
    found = found.select("vec_id.id", "vec_id.label", "dim", "q")
    first = found.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()
    first = [row for row in first if row["dim"] == first[0]["dim"]]
    kinds = f"id {found.schema['id'].dataType.simpleString()}, label {found.schema['label'].dataType.simpleString()}"
    if not first:
        return spark.createDataFrame([], f"{kinds}, code string, error bigint").withColumnRenamed("id", "vec_id"), []
    dim, k = first[0]["dim"], len(first)
    start = whole(np.array([row["q"] for row in first], np.float64).reshape(k, dim))
    books, moves = [start[:, s:e] for s, e in edges(dim, parts)], None
    b = max(1, min(k - 1, -(-k // 4)))
    state = found.where(F.col("dim") == dim).select("id", "label", "q")
    for turn in range(rounds + 1):
        plain = state.select("id", "label", "q", *(["at", "upper", "bounds", "entries"] if turn else []))
        schema = extended(state, _STATE, ["id", "label"])
        after = written(mapped(plain, _assign(dim, books, moves, b), schema), spark)
        if turn:
            removed(state)
        state = after
        if turn == rounds:
            break
        totals, counts, needs = _summed(state, dim, parts, k, b)
        new = []
        for book, total, count in zip(books, totals, counts, strict=True):
            mean = book.astype(object)
            for i in np.flatnonzero(count).tolist():
                mean[i] = [v // int(count[i]) for v in total[i].tolist()]
            new.append(_narrow(mean))
        moves = [_root(to_own(x, y, np.arange(k))) * (1 + SLACK) for x, y in zip(books, new, strict=True)]
        books = new
        if turn:  # b + 1 stands for all entries, which no b meets
            reach = np.cumsum(needs)
            b = max(1, min(b, int(np.searchsorted(reach, COVERED * reach[-1]))))
    codes = mapped(state.select("id", "label", "q", "at"), _codes(dim, books), extended(state.select("id", "label"), "code string, error bigint"))
    return codes.withColumnRenamed("id", "vec_id"), books


def reconstructed(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """codes with the column embedding: the entries that the code names, each component in the middle of its step."""

    def run(batches):
        for batch in batches:
            at = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8).reshape(batch.num_rows, len(books))
            values = np.concatenate([(book.astype(np.float64) + 0.5)[at[:, j]] / scale for j, book in enumerate(books)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(values), pa.list_(pa.float64()))], names=[*batch.schema.names, "embedding"])

    codes = codes.drop("embedding")
    return mapped(codes, run, extended(codes, "embedding array<double>"))


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal digits, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def by_label(codes: DataFrame) -> DataFrame:
    """codes (written) with label_error: the errors of all rows of the same label together; null labels are one, too.

    Errors are summed before the shuffle, to a row a label; beyond a long they count as the largest one.
    """
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("bigint")
    sums = codes.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "__label")
    return codes.join(small(written(sums, codes.sparkSession)), F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compressed(table(spark, sf_dir, "embeddings"))
    rows = by_label(written(codes, spark))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in SQL, round by round, all distances counted."""
    clauses = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, q) AS id, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), part AS MATERIALIZED (
  SELECT id, p, q[p * len(q) // {PARTS} + 1 : (p + 1) * len(q) // {PARTS}] AS x FROM v, range({PARTS}) t(p)
), book0 AS MATERIALIZED (
  SELECT p, (id - 1)::INTEGER AS i, x AS c FROM part WHERE id <= {ENTRIES}
)"""
    ]
    for r in range(ROUNDS + 1):
        clauses.append(
            f"""near{r} AS MATERIALIZED (
  SELECT id, p, min((list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - c[k]) * (x[k] - c[k])))::BIGINT, i)) AS best
  FROM part JOIN book{r} USING (p) GROUP BY id, p
)"""
        )
        if r < ROUNDS:
            clauses.append(
                f"""sum{r} AS (
  SELECT p, i, k, sum(x[k])::BIGINT AS s, count(*) AS n
  FROM (SELECT p, best[2] AS i, x, unnest(range(1, len(x) + 1)) AS k FROM near{r} JOIN part USING (id, p)) GROUP BY p, i, k
), mean{r} AS (
  SELECT p, i, list((s - ((s % n) + n) % n) // n ORDER BY k) AS c FROM sum{r} GROUP BY p, i
), book{r + 1} AS MATERIALIZED (
  SELECT p, i, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, i)
)"""
            )
    return (
        "WITH "
        + ", ".join(clauses)
        + f""", coded AS (
  SELECT id, string_agg(format('{{:02x}}', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{ROUNDS} GROUP BY id
), books AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, i, k)) AS codebooks_sha256
  FROM (SELECT p, i, unnest(range(len(c))) AS k, unnest(c) AS x FROM book{ROUNDS})
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN v USING (id) CROSS JOIN books
"""
    )


ORACLE = _oracle()
