"""Operators 4 and 8."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestream.llm import byte_bpe, packing
from tests.llm import helpers

BPE, WORDS = public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.path(packing.VOCABULARY)
with open(BPE, "rb") as lines:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TOKENIZER = Tokenizer.from_file(WORDS)
TOKENIZER.encode_special_tokens = True
PARTS = ["\x1c", "\x1f", "\x85", "\xa0", " ", "  ", "\n", "\t", "\0", "\x01", "a", "B", "é", "ß", "Σ", "İ", "中", "一", "\U0001f600", "​", "　", "0", "٣", "½", "́", "▁", "'s", "'ll", "<unk>", "<|endoftext|>", "ﬁ", "the", " of", "×", "÷", "À", "ÿ", "don't", "Œ"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_byte_bpe_is_that_of_tiktoken(texts):
    own = byte_bpe.codec(BPE)
    got = [x.tolist() for x in own.encode(texts)]
    assert got == [TIKTOKEN.encode_ordinary(t) for t in texts]
    assert [own.decode(x) for x in got] == [t.encode() for t in texts]


def held(memory):
    return sum(len(k) + len(v) + memory.ENTRY for part in (memory.young, memory.old) for k, v in part.items())


def test_caches_are_bounded_in_bytes(monkeypatch):
    """Indented code, and text without spaces."""
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 1 << 20)
    monkeypatch.setattr(packing, "CACHE_BYTES", 1 << 20)
    rng = random.Random(3)
    name = lambda: "".join(rng.choices("abcdefghij", k=7))
    code = ["\n".join(f"{'    ' * rng.randrange(4)}{name()} = {name()}({name()}, {rng.randrange(10**6)})" for _ in range(150)) for _ in range(150)]
    chinese = ["".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(3000)) for _ in range(150)]
    own, words = byte_bpe.Codec(RANKS), packing.WordTokens(WORDS)
    for at in range(0, 150, 10):
        for texts in (code[at : at + 10], chinese[at : at + 10]):
            assert [x.tolist() for x in own.encode(texts)] == TIKTOKEN.encode_ordinary_batch(texts)
            assert [x.tolist() for x in words.encode(pa.array(texts, pa.large_string()))] == [e.ids for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
            for memory in (own.pieces, own.known, words.known):
                assert held(memory) <= 1.5 * (1 << 20) and all(len(k) <= memory.LONGEST for k in memory.young)
    assert words.known.young or words.known.old


def test_op8_on_all_documents(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = byte_bpe.op8_byte_bpe(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = TIKTOKEN.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_byte_bpe_round_trip_of_odd_rows(spark):
    docs = helpers.documents(spark)
    out = byte_bpe.decode(byte_bpe.encode(docs, BPE), BPE)
    assert out.count() == docs.count()
    assert out.where(~F.col("bytes").eqNullSafe(F.coalesce("text", F.lit("")).cast("binary"))).count() == 0
    assert byte_bpe.encode(helpers.empty(spark), BPE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_word_tokens_are_those_of_the_library(texts):
    got = packing.word_tokens(WORDS).encode(pa.array(texts, pa.large_string()))
    assert [ids.tolist() for ids in got] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def filled(bins, capacity):
    used = Counter()
    for b in bins:
        assert b.count > 0 and sum(length * k for length, k in b.content) <= capacity
        for length, k in b.content:
            used[length] += k * b.count
    return used


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plans_hold_each_piece_once(counts):
    bins = packing.plan_bins(counts, 64)
    assert filled(bins, 64) == Counter(counts)
    at, seen = packing.places(bins), defaultdict(list)
    for length, n in counts.items():
        for rank in range(n):
            e = max(i for i in range(len(at["rank"])) if at["length"][i] == length and at["rank"][i] <= rank)
            turn, slot = divmod(rank - at["rank"][e], at["many"][e])
            seen[at["bin"][e] + turn].append((at["offset"][e] + slot * length, length))
    assert sorted(seen) == list(range(sum(b.count for b in bins)))
    for places in seen.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length


def test_configurations_pair_large_sizes():
    plan = packing.configurations([700, 660, 600], [300, 300, 300], 2048)
    used = np.sum([np.array(c) * n for c, n in plan], axis=0)
    assert used.tolist() == [300, 300, 300] and sum(n for _, n in plan) <= 302


def test_column_generation_ends_at_the_optimum(monkeypatch):
    tried = []
    best = packing._best_configuration
    monkeypatch.setattr(packing, "_best_configuration", lambda *a: tried.append(0) or best(*a))
    rng = random.Random(5)
    for spread in (0.3, 1.0, 2.0):
        lengths = Counter(min(2048, max(1, int(rng.lognormvariate(6.3, spread)))) for _ in range(20_000))
        for setting in packing.SETTINGS:
            tried.clear()
            packing._planned(lengths, packing.CAPACITY, *setting)
            assert len(tried) < packing.STEPS // 5


def test_plans_are_near_the_bound():
    rng = random.Random(2)
    lengths = Counter(min(2048, max(1, int(rng.lognormvariate(6.3, 1)))) for _ in range(20_000))
    bound = -(-sum(length * n for length, n in lengths.items()) // 2048)
    assert sum(b.count for b in packing.plan_bins(lengths)) <= 1.002 * bound + 1


def sequences(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    return by


def expected_pieces(texts):
    out = Counter()
    for i, text in texts:
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0], "<i4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            out[i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    return out


def test_op4_on_all_documents(spark, data):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows = packing.op4_best_fit_packing(spark, data).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected_pieces(texts)
    assert len(sequences(rows)) <= 1.01 * -(-sum(r["length"] for r in rows) // packing.CAPACITY) + 1


def test_packing_of_odd_rows(spark):
    docs = helpers.documents(spark)
    rows = packing.pack_documents(docs).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected_pieces([(r["doc_id"], r["text"]) for r in docs.collect()])
    sequences(rows)
    assert packing.pack_documents(helpers.empty(spark)).count() == 0
    lone = spark.createDataFrame([(1, 0, 5, "x")] * 3, "doc_id long, piece int, length long, `__n` string")
    assert sorted(r["offset"] for r in packing.pack(lone).collect()) == [0, 5, 10]
    odd = spark.createDataFrame([(1, 0, 5, ("x",), "y", 3)], "doc_id long, piece int, length long, `we.ird` struct<`a b`:string>, `b``t` string, offset int")
    got = packing.pack(odd).first()
    assert (got["we.ird"]["a b"], got["b`t"], got["offset"]) == ("x", "y", 0)
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 3000), (2, 0, 7)], "doc_id long, piece int, length long"))
    got = byte_bpe.encode(odd.withColumn("text", F.lit("a b")), BPE).first()
    assert (got["we.ird"]["a b"], got["b`t"], got["n_tokens"]) == ("x", "y", 2)
