"""Operator 11."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from lodestream.llm import vector_codes as codes
from tests.llm import helpers
from tests.oracle import assert_same


def by_brute_force(rows, parts=8, entries=16, rounds=6):
    """vec_id, code, error, label_error of each row (vec_id, embedding, label), and the codebooks, in Python's integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return [], []
    edges = [len(kept[0][1]) * j // parts for j in range(parts + 1)]
    books = [[v[s:e] for _, v, _ in kept[:entries]] for s, e in zip(edges, edges[1:])]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for turn in range(rounds + 1):
        at = [[min((far(v[s:e], c), k) for k, c in enumerate(book)) for s, e, book in zip(edges, edges[1:], books)] for _, v, _ in kept]
        if turn < rounds:
            for j, (s, e) in enumerate(zip(edges, edges[1:])):
                for k in range(len(books[j])):
                    own = [v[s:e] for (_, v, _), a in zip(kept, at) if a[j][1] == k]
                    if own:
                        books[j][k] = [sum(column) // len(own) for column in zip(*own)]
    errors = [sum(d for d, _ in a) for a in at]
    most = (1 << 63) - 1
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + min(most, e)
    return [(i, "".join(f"{k:02x}" for _, k in a), min(most, e), min(most, by_label[label])) for (i, _, label), a, e in zip(kept, at, errors)], books


def place(row):
    return tuple((x is None, x or 0) for x in row)


def coded(spark, rows):
    vectors = spark.createDataFrame(rows, helpers.VECTORS).repartition(3)
    found, books = codes.compressed(vectors)
    found = codes.by_label(codes.written(found, spark))
    return sorted((tuple(r) for r in found.select("vec_id", "code", "error", "label_error").collect()), key=place), books


def check(spark, rows):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got, books = coded(spark, rows)
    expected, expected_books = by_brute_force(rows)
    assert got == sorted(expected, key=place)
    assert [book.tolist() for book in books] == expected_books
    return got


def test_op11_is_its_sql(spark, data):
    assert_same(codes.op11_vector_codes(spark, data), data, codes.ORACLE)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist(), i % 3 if i % 5 else None) for i in range(60)]
    rows += [(70, None, 1), (71, [None] + [0.5] * 15, 1), (72, [float("nan")] * 16, 1), (73, [float("inf")] + [0.0] * 15, 2), (74, [1.0] * 8, 2), (75, [], None)]
    rows += [rows[0], rows[0], (None, rows[1][1], 2), (None, rng.normal(size=16).tolist(), None)]
    assert len(check(spark, rows)) == 64


def test_ties_few_rows_and_large_components(spark):
    grid = [(i, [float((i * k) % 3) for k in range(8)], 0) for i in range(40)]
    check(spark, grid)  # many equal distances
    check(spark, grid[:5])
    check(spark, [(1, [0.1] * 11, None)])  # no multiple of the parts
    check(spark, [(i, [(-1.0) ** i * 10.0 ** (3 * i % 37) for _ in range(8)], i % 2) for i in range(30)])
    check(spark, [(i, [], 1) for i in range(3)])
    empty = spark.createDataFrame([], helpers.VECTORS)
    found, books = codes.compressed(empty)
    assert books == [] and found.count() == 0
    folder = helpers.folder(spark, embeddings=empty)
    assert codes.op11_vector_codes(spark, folder).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("scale", [3, 2000, 1 << 40])
@pytest.mark.parametrize("b", [1, 3, 7])
def test_bounds_give_what_all_distances_give(scale, b):
    rng = np.random.default_rng(b)
    x = rng.integers(-scale, scale, (400, 5))
    c = rng.integers(-scale, scale, (12, 5))
    if scale > 1 << 26:
        x, c = x.astype(object), c.astype(object)
    state, seen = codes.nearest(x, c, b), []
    for turn in range(12):
        moved = c + rng.integers(-1 - scale // (3 + 20 * turn), 2 + scale // (3 + 20 * turn), c.shape)
        move = np.sqrt(codes.to_own(c, moved, np.arange(12)).astype(np.float64)) * (1 + codes.SLACK)
        b, c = max(1, b - turn % 2), moved
        *state, need = codes.moved(x, c, move, state, b)
        assert state[0].tolist() == codes.distances(x, c).argmin(axis=1).tolist()
        assert state[2].shape == (400, b) and state[3].shape == (400, b + 1)
        seen.append((need == 0).mean())
    assert scale == 3 or seen[-1] > 0.8  # hardly any distance is counted while entries move little


def test_reconstruction_and_clashing_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), 1, "x", "y") for i in range(10)]
    schema = T.StructType([*helpers.VECTORS.fields, T.StructField("code", T.StringType()), T.StructField("q", T.StringType())])
    found, books = codes.compressed(spark.createDataFrame(rows, schema))
    back = {r["vec_id"]: r["embedding"] for r in codes.reconstructed(found, books).collect()}
    assert all(np.abs(np.array(back[i]) - v).max() <= 1 / 4096 for i, v, *_ in rows)  # each vector has its own entries
    assert codes.digest(books) == hashlib.sha256(",".join(str(int(x)) for b in books for row in b for x in row).encode()).hexdigest()
