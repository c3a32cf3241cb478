"""Operator 12."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import periodic_runs as periodic
from lodestream.llm.grammar import Grammar
from tests.llm import helpers
from tests.llm.test_dedup import WORD
from tests.oracle import assert_same


def runs(words, least=12):
    """start, length, period of each run, by brute force, by start and period."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > start and i - start + p >= max(least, 2 * p):
                found.setdefault((start, i - start + p), p)
            i += i == start
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def of_all(texts):
    """What runs_of() finds, for each text."""
    size = np.array([len(t) for t in texts], np.int64)
    ids = np.array([w for t in texts for w in t], np.int64)
    found = list(zip(*(x.tolist() for x in periodic.runs_of(ids, np.cumsum(size) - size, size)), strict=True))
    return [[r[1:] for r in found if r[0] == k] for k in range(len(texts))]


PARTS = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 6)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=4))
def test_runs_are_those_of_brute_force(texts):
    texts = [[w for part, times in parts for w in part * times] for parts in texts]
    assert of_all(texts) == [runs(t) for t in texts]


def test_words_of_fibonacci_and_long_runs():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    texts = [b, [7] * 300, list(range(50)) * 4, list(range(40)), [1, 2] * 30 + [1] * 30, [], [3]]
    assert of_all(texts) == [runs(t) for t in texts]
    many = np.arange(200_000) % 1000
    assert of_all([many.tolist()]) == [[(0, 200_000, 1000)]]


@settings(max_examples=100, deadline=None)
@given(PARTS, st.data())
def test_common_extensions(parts, data):
    values = [5, *(w for part, times in parts for w in part * times), 6]
    grammar = Grammar(np.array(values))
    i = data.draw(st.integers(0, len(values) - 2))
    j = data.draw(st.integers(i + 1, len(values) - 1))
    forward = next((k for k in range(len(values)) if j + k >= len(values) or values[i + k] != values[j + k]), 0)
    backward = next((k for k in range(len(values)) if i - k < 0 or values[i - k] != values[j - k]), 0)
    assert grammar.common(np.array([i]), np.array([j]), True).tolist() == [forward]
    assert grammar.common(np.array([i]), np.array([j]), False).tolist() == [backward]


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = runs(words)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_odd_rows(spark):
    texts = [*helpers.ODD, *(f"{'x ' * k}y {'a b c ' * k}" for k in range(20)), " ".join(f"w{i % 90}" for i in range(400))]
    docs = helpers.documents(spark, texts)
    folder = helpers.folder(spark, documents=docs)
    got = [tuple(r) for r in periodic.op12_periodic_runs(spark, folder).collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # brute force is too slow for the longest text, whose lines all differ
    assert sorted((g for g in got if g[0] != 7), key=str) == sorted((expected(*r) for r in rows if r[0] != 7), key=str)
    assert len(got) == len(rows) and texts[7] == helpers.LONG
    found = periodic.periodic_runs(docs)
    assert set(found.columns) == set(docs.columns) - {"text"} - {"runs"} | {"runs", "collapsed"}
    assert periodic.op12_periodic_runs(spark, helpers.folder(spark, documents=helpers.empty(spark))).count() == 0
    with pytest.raises(ValueError, match="12 words"):
        periodic.periodic_runs(docs, 6)


def test_op12_is_its_sql_and_brute_force(spark, data):
    assert_same(periodic.op12_periodic_runs(spark, data), data, periodic.ORACLE)
    docs = spark.read.parquet(f"{data}/documents.parquet").where("n_chars < 3000").limit(60)
    folder = helpers.folder(spark, documents=docs)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, periodic.op12_periodic_runs(spark, folder).collect())) == sorted(expected(*r) for r in rows)
