"""Operator 13."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import common, linking, minhash
from tests.llm import helpers
from tests.llm.test_dedup import pair_of_sets, roots, shingles, template
from tests.oracle import assert_same


def components(rows):
    """n_shingles and component of each row (doc_id, text), by brute force over all pairs."""
    sets = [frozenset(shingles(t or "", 2)) for _, t in rows]
    kinds = sorted({s for s in sets if s}, key=sorted)
    linked = [(i, j) for i, a in enumerate(kinds) for j, b in enumerate(kinds[:i]) if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b)]
    root = roots(range(len(kinds)), linked)
    group = {s: root[i] for i, s in enumerate(kinds)}
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            least[group[s]] = min(i, least.get(group[s], i))
    return sorted(((i, len(s), least.get(group[s]) if s else i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abBÉé \n\t中", max_size=30), max_size=5), st.integers(1, 3))
def test_sets_are_those_of_brute_force(texts, size):
    """Equal shingles have equal hashes and others don't, whatever text they stand in."""
    hashes, edges = minhash.shingle_sets(pa.array(texts, pa.large_string()), size)
    expected = [shingles(t, size) for t in texts]
    assert np.diff(edges).tolist() == list(map(len, expected))
    own = [set(hashes[a:b].tolist()) for a, b in zip(edges, edges[1:], strict=False)]
    assert all(len(x & y) == len(a & b) for x, a in zip(own, expected, strict=True) for y, b in zip(own, expected, strict=True))
    assert all((np.diff(hashes[a:b].astype(object)) > 0).all() for a, b in zip(edges, edges[1:], strict=False))


def test_op13_is_its_sql(spark, data):
    assert_same(minhash.op13_minhash_near_dedup(spark, data), data, minhash.ORACLE)


@pytest.mark.parametrize("broadcast", [0, common.BROADCAST_ROWS])
def test_odd_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    docs = helpers.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(3, "a b c d e f g h i j k"), (3, "other words of the same id"), (None, "a b c d e f g h i j k"), (None, "nothing else has this")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(minhash.near_duplicates(docs)) == components(rows)
    assert minhash.near_duplicates(helpers.empty(spark)).count() == 0
    with pytest.raises(ValueError, match="0.8"):
        minhash.near_duplicates(docs, 0.5)


def near_texts(seed=7):
    """Groups of texts of 1 to 400 words that differ in some words, near the least similarity, and chains of such."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(3000)}"
    texts = []
    for size in (1, 2, 3, 5, 6, 8, 12, 30, 60, 150, 400):
        for _ in range(6):
            base = [word() for _ in range(size)]
            texts.append(base)
            for _ in range(4):
                other = list(texts[-1] if rng.random() < 0.5 else base)
                for at in rng.integers(0, len(other), rng.integers(0, 2 + size // 18)):
                    other[at] = word()
                texts.append(other[: size - int(rng.integers(0, 2))] if size > 3 else other)
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in template(60, seed=3)]


@pytest.mark.parametrize("crowd", [2, linking.CROWD])
def test_links_are_those_of_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(linking, "CROWD", crowd)
    rows = near_texts()
    expected = components(rows)
    got = found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == expected and 60 < len({c for _, _, c in expected}) < len(rows) - 60


@pytest.mark.parametrize("both, each", [(4, 0), (8, 1), (40, 5), (160, 20), (1600, 200)])
def test_similar_sets_share_two_buckets(both, each):
    rng = np.random.default_rng(2)
    for _ in range(500):
        low = linking.minima(*pair_of_sets(rng, both, each), minhash.BINS)
        same = (low[0] == low[1]).reshape(minhash.BANDS, minhash.BAND).all(axis=1)
        assert same.sum() >= 2
