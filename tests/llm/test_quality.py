"""Operators 1 and 7."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import factorisation, quality_rules
from lodestream.llm.common import Words
from lodestream.llm.linear import Grams
from lodestream.llm.samples import labelled
from lodestream.llm.textstats import base_counts
from tests.llm import helpers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    threes = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), dup, len(covered)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b#中\U0001f600", max_size=60), max_size=6))
def test_base_counts_are_those_of_brute_force(texts):
    got = base_counts(Words(pa.array(texts, pa.large_string())))
    assert [tuple(int(got[c][i]) for c in quality_rules.COUNTS) for i in range(len(texts))] == [counts(t) for t in texts]


def test_odd_rows(spark):
    docs = helpers.documents(spark)
    rows = quality_rules.quality_rules(docs, None).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r[c] for c in quality_rules.COUNTS) == counts(r["text"] or "")
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"]) and r["score"] is None


@pytest.mark.parametrize("module", [quality_rules, factorisation])
def test_no_model_without_labels_of_both_kinds(spark, module):
    docs = helpers.documents(spark)
    assert module.fit(docs, helpers.empty(spark, helpers.LABELS)) is None
    assert module.fit(helpers.empty(spark), helpers.empty(spark, helpers.LABELS)) is None
    one = spark.createDataFrame([(None, 1, 0), (3, None, 0), (8, 1, None), (8, 0, None), (10, 1, 0)], helpers.LABELS)
    assert module.fit(docs, one) is None


def test_repeated_ids_bring_one_row_each(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    once = labelled(docs, labels, "quality", 30, 0)
    many = labelled(docs.union(docs).union(docs), labels.union(labels), "quality", 30, 0)
    assert once.count() == many.count() == 30
    assert {r["doc_id"] for r in once.collect()} == {r["doc_id"] for r in many.collect()}
    assert once.where("__fold = 0").count() == 0


@pytest.mark.parametrize("module", [quality_rules, factorisation])
def test_fits_do_not_depend_on_partitions(spark, data, module):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    one, two = (vars(module.fit(docs.repartition(n), labels)) for n in (3, 8))
    assert all(np.array_equal(one[k], two[k]) for k in one)


def test_empty_tables(spark):
    none = helpers.empty(spark)
    assert quality_rules.quality_rules(none, None).count() == 0
    assert factorisation.score_quality(none, None).count() == 0


def test_sparse_rows_give_the_logits():
    words = Words(pa.array(["the quick brown fox", "", "a", "the the the end"], pa.large_string()))
    weights = np.random.default_rng(1).normal(size=1 << 18)
    grams = Grams(words)
    assert np.allclose([v @ weights[b] for b, v in grams.rows()], grams.logits(weights))


def gram_score(model, text):
    """The calibrated probability by plain loops over words, pairs and character n-grams."""
    full, odd = (1 << 64) - 1, 0x9E3779B97F4A7C15
    words = WORD.findall(text)
    crc = [zlib.crc32(w.encode()) for w in words]
    weight = model.weights.tolist()
    one = [weight[c % 65536] for c in crc]
    two = [weight[65536 + ((a * 31 + b) * odd & full) // 2**48] for a, b in zip(crc, crc[1:], strict=False)]
    chars = []
    for word in words:
        points = [32, *map(ord, word), 32]
        for i in range(len(points)):
            code = 0
            for n, point in enumerate(points[i : i + 5], 1):
                code = code * 0x100000001B3 & full ^ point
                code ^= code >> 29
                if n >= 3:
                    chars.append(weight[131072 + (code * odd & full) // 2**47])
    logit = sum(sum(x) / max(1, len(x)) for x in (one, two, chars))
    return 1 / (1 + math.exp(-(model.slope * (logit + model.bias) + model.offset)))


def test_op1_is_brute_force(spark, data):
    """Every column of every row: counts, base rules, score and verdict."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = quality_rules.op1_quality_rules(spark, data).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(list(texts))
    for r in rows:
        own = counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality_rules.COUNTS) == own
        assert r["base_failed"] == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        score = gram_score(model, texts[r["doc_id"]])
        assert math.isclose(r["score"], score, abs_tol=1e-9)
        assert r["kept"] == (not r["base_failed"] and score >= 0.3)
    assert 0 < sum(r["kept"] for r in rows) < len(rows)


def test_op1_on_held_out_labels(spark, data):
    """Fold 0 takes no part in the fit."""
    got = {r["doc_id"]: r for r in quality_rules.op1_quality_rules(spark, data).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    good = [i for i, q in labels.items() if q == 1 and not got[i]["base_failed"]]
    bad = [i for i, q in labels.items() if q == 0]
    assert good and np.mean([got[i]["kept"] for i in good]) > 0.9
    assert not bad or np.mean([got[i]["kept"] for i in bad]) < 0.3


def machine_score(m, text, n_chars):
    """The machine's score with the sum over all pairs of features, from plain counts."""
    data, own = text.encode(), counts(text)
    words = WORD.findall(text)
    n, size = max(1, own[0]), max(1, len(data))
    share = lambda chars: sum(map(text.count, chars)) / size
    lines = text.count("\n") + 1
    stats = [
        math.log1p(own[0]), math.log1p(own[1] / n), len(set(words)) / math.sqrt(n), own[2] / size, own[4] / n, own[3] / lines,
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share("!?.,;:\"'()[]{}-_/\\=+~^@`"), math.log1p(own[0] / lines), sum(b > 127 for b in data) / size, math.log1p(n_chars),
    ]
    buckets = Counter(zlib.crc32(w.lower().encode()) % (1 << 15) for w in words)
    norm = math.sqrt(sum(k * k for k in buckets.values())) or 1
    at = [*buckets, *range(1 << 15, (1 << 15) + len(stats))]
    x = np.array([k / norm for k in buckets.values()] + [min(6, max(-6, (s - mean) / scale)) for s, mean, scale in zip(stats, m.mean, m.scale, strict=True)])
    each = x[:, None] * m.v[at]
    pairs = each @ each.T
    return 1 / (1 + math.exp(-(m.bias + m.w[at] @ x + (pairs.sum() - np.trace(pairs)) / 2)))


def test_op7_is_brute_force(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    machine = factorisation.fit(docs, labels)
    texts = {r["doc_id"]: r for r in docs.collect()}
    rows = factorisation.op7_quality_classifier(spark, data).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(list(texts))
    for r in rows:
        score = machine_score(machine, texts[r["doc_id"]]["text"], texts[r["doc_id"]]["n_chars"])
        assert math.isclose(r["score"], score, abs_tol=1e-6) and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_repeated_ids_have_a_defined_row(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (2, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, quality int")
    assert sorted((r["doc_id"], r["text"], r["__label"]) for r in labelled(docs, labels, "quality", 9, None).collect()) == [(1, "a", 1), (2, "z", 0)]


@pytest.mark.parametrize("score", [lambda d: quality_rules.quality_rules(d, None), lambda d: factorisation.score_quality(d, None)])
def test_columns_of_other_names(spark, score):
    rows = [(1, "a b", ("s",), "z", 2.5)]
    got = score(spark.createDataFrame(rows, "doc_id long, text string, `we.ird` struct<`a b`:string>, `b``t` string, score double")).first()
    assert (got["we.ird"]["a b"], got["b`t"]) == ("s", "z") and got["score"] != 2.5


def test_op7_on_held_out_labels(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    machine = factorisation.fit(docs, labels)
    rows = factorisation.score_quality(docs, machine).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.85


def test_machine_equals_all_pairs():
    """The sum-of-squares identity against the sum over pairs."""
    rng = np.random.default_rng(3)
    size = factorisation.WORD_BUCKETS + len(factorisation.STATISTICS)
    m = factorisation.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, factorisation.FACTORS)), np.zeros(len(factorisation.STATISTICS)), np.ones(len(factorisation.STATISTICS)))
    words = Words(pa.array(["one two three two", "four"], pa.large_string()))
    stats = factorisation.statistics(words, np.array([5.0, 4.0]))
    doc, bucket, value = factorisation.word_counts(words)
    z = m.logits(stats, doc, bucket, value)
    for i in range(2):
        x = np.zeros(size)
        np.add.at(x, bucket[doc == i], value[doc == i])
        x[factorisation.WORD_BUCKETS :] = m.standard(stats)[i]
        on = np.flatnonzero(x)
        pairs = sum(m.v[a] @ m.v[b] * x[a] * x[b] for k, a in enumerate(on) for b in on[k + 1 :])
        assert np.isclose(z[i], 0.3 + m.w @ x + pairs)


def test_scores_of_odd_rows(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    odd = helpers.documents(spark)
    rows = factorisation.score_quality(odd, factorisation.fit(docs, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    rows = quality_rules.quality_rules(odd, quality_rules.fit(docs, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
