"""Operator 5."""

import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.llm import top_k
from tests.llm import helpers
from tests.oracle import assert_same


def brute(rows, k=5):
    """Python's integers throughout; scores beyond a long are its ends."""
    vectors = [(i, [math.floor(256 * float(x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks = {}
    for i, v in vectors:
        if i % 50 == 0 and (i not in asks or (len(v), v) < (len(asks[i]), asks[i])):
            asks[i] = v
    out = []
    for q, a in asks.items():
        score = lambda b: min((1 << 63) - 1, max(-(1 << 63), sum(x * y for x, y in zip(a, b, strict=True))))  # noqa: B023, E731
        scores = sorted((-score(b), i) for i, b in vectors if i != q and len(a) == len(b))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, schema=helpers.VECTORS, k=5):
    vectors = top_k.quantised(spark.createDataFrame(rows, schema))
    return sorted(tuple(r) for r in top_k.top_k(vectors.where("vec_id % 50 = 0"), vectors, k).collect())


def single(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]


def test_op5_is_its_sql(spark, data):
    assert_same(top_k.op5_exact_top_k(spark, data), data, top_k.ORACLE)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)], 0) for i in range(160)]
    rows += [(200 + i, [0.5, 0.25, -0.5, 1.0], 0) for i in range(30)]  # ties
    rows += [(300, None, 0), (350, [1.0, None, 0.0, 0.0], 0), (400, [float("nan"), 0.0, 0.0, 0.0], 0), (450, [float("inf"), 0.0, 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0, 1.0], 0), (500, [1.0, 2.0], 0), (501, [3.0, 4.0], None), (550, [1e6, 1e6, 1e6, -1e6], 0), (600, [], 0), (601, [], 0)]
    rows += [(650, [9.0, 9.0, 9.0, 9.0], 0)] * 8  # repeated rows of a query, which are no answers of it
    rows = single(rows)
    assert found(spark, rows) == brute(rows)
    none = top_k.quantised(helpers.empty(spark, helpers.VECTORS))
    assert top_k.top_k(none, none).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    rows = single([(50, [1e6, 1 / 256], 0), (1, [1e6, 1 / 256], 0), (2, [1e6, 2 / 256], 0), (3, [1e6, 3 / 256], 0)])
    assert [r[2] for r in found(spark, rows)] == [3, 2, 1] and found(spark, rows) == brute(rows)
    rng = np.random.default_rng(8)
    large = [(i, [float(x) for x in rng.normal(size=6) * 10.0 ** rng.integers(0, 30)], 0) for i in range(0, 300, 10)]
    large += [(7, [3e38] * 6, 0), (8, [-3e38] * 6, 0), (9, [3e38, -3e38, 0.0, 0.0, 0.0, 1.0], 0)]
    assert found(spark, single(large)) == brute(single(large))


def test_doubles_and_columns_of_other_names(spark):
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), *[T.StructField(c, T.StringType()) for c in ("i", "j", "q", "dim", "asks", "score", "rank", "query_id", "a`b", "we.ird")]])
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 1e9], *["x"] * 10) for i in range(0, 300, 10)]
    assert found(spark, rows, kind) == brute([r[:3] for r in rows])


def test_tiles_and_merges(spark, monkeypatch):
    monkeypatch.setattr(top_k, "TILE_BYTES", 60)
    monkeypatch.setattr(top_k, "SCORE_BYTES", 200)
    monkeypatch.setattr(top_k, "FAN_IN", 2)
    rng = np.random.default_rng(6)
    rows = single([(i, [float(x) for x in rng.normal(size=3)], 0) for i in range(0, 400, 2)])
    assert found(spark, rows) == brute(rows)


def test_repeated_rows_are_dealt_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(top_k, "TILE_BYTES", 120)
    rows = single([(50, [1.0, 2.0], 0), *[(7, [3.0, 4.0], 0)] * 300])
    assert found(spark, rows) == brute(rows) and len(found(spark, rows)) == 5
    vectors = top_k.quantised(spark.createDataFrame(rows, helpers.VECTORS))
    tiles = vectors.select(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(10)).alias("j")).distinct().count()
    assert tiles == 10
