"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm.common import table

#: Bytes of the components of a tile's queries, and as many of its candidates, about: a vector is sent once for each tile
#: that it is in, which square tiles make fewest.
TILE_BYTES = 16 << 20
#: Candidates of a block of queries whose scores are in memory at a time.
SCORE_BYTES = 32 << 20
#: Partial lists of a query that one merge step brings together, about.
FAN_IN = 16

#: Scores beyond a long count as the largest or smallest one.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, dim, q: floor(scale * x) of each component; only of vectors whose components are all finite numbers.

    Left out are null vectors and those that hold a null, an infinity or NaN; an empty vector has dim 0. q has doubles,
    which hold the floor of any double exactly, while a long is too small for the largest.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # floor() gives a long; from 2^53 on doubles are whole
    whole = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
    q = F.transform("embedding", lambda x: whole(F.lit(float(scale)) * x.cast("double")))
    return vectors.where(F.col("embedding").isNotNull() & ~bad).select("vec_id", F.size("embedding").alias("dim"), q.alias("q"))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly; those beyond a long are LEAST or MOST.

    left and right hold whole numbers, as floats or integers of 32 bits. While sums are below 2^53 doubles are exact, and floats below 2^24.
    Beyond that the products are those of longs, which wrap around; where the sum of the absolute terms may be beyond a
    long they are counted again with Python's integers.
    """
    bound = left.shape[1] * float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0))
    if bound < 1 << 53:
        kind = np.float32 if bound < 1 << 24 else np.float64
        return (left.astype(kind) @ right.astype(kind).T).astype(np.int64)
    wide = lambda x: np.clip(x.astype(np.float64), -(2.0**62), 2.0**62).astype(np.int64)
    scores = wide(left) @ wide(right).T
    reach = np.abs(left.astype(np.float64)) @ np.abs(right.astype(np.float64)).T
    for i, j in zip(*np.nonzero(reach >= 2.0**62), strict=True):
        scores[i, j] = min(MOST, max(LEAST, sum(int(a) * int(b) for a, b in zip(left[i].tolist(), right[j].tolist(), strict=True))))
    return scores


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), dim) if len(column) else np.zeros((0, dim))


def _tile(k: int):
    def run(key: tuple, tile: pa.Table) -> pa.Table:
        """The k best rows of the tile for each of its queries."""
        asks = tile.column("asks").to_numpy()
        own = tile.column("vec_id").to_numpy()
        dim, turn = key[0].as_py(), key[2].as_py()
        matrix = _matrix(tile.column("q"), dim)
        queries, ids = own[asks], own[~asks]
        order = np.argsort(ids, kind="stable")  # so that of equal scores the smaller id comes first
        ids, left, right = ids[order], matrix[asks], matrix[~asks][order]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, SCORE_BYTES // (8 * max(1, len(ids))))
        for at in range(0, len(queries) if len(ids) else 0, step):
            scores = products(left[at : at + step], right)
            taken = queries[at : at + step, None] != ids[None, :]
            n = min(k + 1, scores.shape[1])  # one more, as the query itself may be among them
            # everything that reaches the n-th best, ties included, then the best k of it in order
            floor = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
            for i, row in enumerate(scores):
                found = np.flatnonzero((row >= floor[i]) & taken[i])
                if len(found) < k:  # repeated rows of the query's own id were among the best
                    found = np.flatnonzero(taken[i])
                found = found[np.lexsort((np.arange(len(found)), _descending(row[found])))][:k]
                out.append((np.full(len(found), queries[at + i]), ids[found], row[found]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2], "j": pa.array(np.full(len(columns[0]), turn, np.int32))})

    return run


def _descending(scores: np.ndarray) -> np.ndarray:
    """Keys that sort scores from the largest to the smallest; unlike their negatives these can't overflow."""
    return ~scores


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query with the rows of its dimension.

    queries and rows come from quantised(). Products are exact; one beyond a long counts as the largest or smallest
    long. A row with the query's id is never its answer; ties go to the smaller id. Queries and rows are cut into blocks
    of bounded bytes; a block of queries meets each block of rows in one task, whose best k per query are merged in a
    tree, so no task holds more than a tile or the lists of a few tiles. Rows without an id take no part; of queries with
    one id the first by value asks, while repeated rows are candidates each, dealt over all blocks. Vectors of different
    dimensions don't meet.
    """
    once = queries.where(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min(F.struct("dim", "q")).alias("v")).select("vec_id", "v.dim", "v.q")
    rows = rows.where(F.col("vec_id").isNotNull())
    reach = F.max(F.aggregate("q", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x))))
    shape = lambda df: df.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0)), F.coalesce(reach, F.lit(0.0))).first()
    (n_queries, *ends), (n_rows, *others) = shape(once), shape(rows)
    widest, largest = map(max, zip(ends, others, strict=True))
    if largest < 1 << 31:  # components of usual embeddings are sent as integers
        once, rows = (df.withColumn("q", F.col("q").cast("array<int>")) for df in (once, rows))
    tiles = lambda n: max(1, -(-n * max(1, widest) * (4 if largest < 1 << 31 else 8) // TILE_BYTES))
    high, wide = tiles(n_queries), tiles(n_rows)
    spark = rows.sparkSession
    # small inputs are cut finer, so that all cores take part
    wide = max(wide, min(2 * spark.sparkContext.defaultParallelism, -(-n_rows // 1024) or 1))
    block = lambda n, *salt: F.pmod(F.xxhash64("vec_id", *salt), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = once.select("*", block(high, F.lit(1)).alias("i"), spread(wide).alias("j"), F.lit(True).alias("asks"))
    right = rows.select("*", block(wide, F.monotonically_increasing_id()).alias("j"), F.lit(False).alias("asks"))
    right = right.select(*rows.columns, spread(high).alias("i"), "j", "asks")
    parts = left.union(right).groupBy("dim", "i", "j").applyInArrow(_tile(k), "query_id bigint, vec_id bigint, score bigint, j int")
    order = [F.desc("score"), F.asc("vec_id")]
    while wide > FAN_IN:
        parts = parts.withColumn("j", (F.col("j") / FAN_IN).cast("int"))
        parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "j").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
        wide = -(-wide // FAN_IN)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where(F.col("vec_id") % 50 == 0), rows, 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
