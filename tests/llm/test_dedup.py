"""Operators 2 and 10."""

import re
import time
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.llm import common, line_dedup, linking, simhash
from lodestream.llm.components import components
from tests.llm import helpers
from tests.oracle import assert_same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    """The smallest node reachable from each, by brute force."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aBÉé \n\t中", max_size=40), max_size=5))
def test_fingerprints_are_those_of_brute_force(texts):
    assert simhash.fingerprints_of(pa.array(texts, pa.large_string())).tolist() == [fingerprint(t) for t in texts]


def test_keys_lose_no_pair_and_are_few():
    """Each way to put 4 differences into the halves of segments leaves a key without any."""
    ring = [h for bits in simhash._ring(simhash.SEGMENTS) for h in simhash._halves(bits)]
    assert sum(ring) == (1 << 64) - 1
    for chain, count in ((2, 10), (3, 25), (4, 70)):
        masks = [m for _, m in simhash.key_masks(chain)]
        assert len(masks) == count
        for wrong in combinations_with_replacement(ring, 4):
            diff = 0
            for bits in wrong:
                diff |= bits
            assert any(not m & diff for m in masks)
    assert min(m.bit_count() for _, m in simhash.key_masks(3)) >= 24


def near_values(count=40):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in range(1, 8)]
    # a dense group: all within two bits of one, and chains of steps of four bits
    dense = [int(base[0]) ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)]
    chain = [int(base[1])]
    for step in range(30):
        chain.append(chain[-1] ^ sum(1 << (7 * step + 5 * k) % 64 for k in range(4)))
    return np.unique(np.array([*base.tolist(), *near, *dense, *chain, 0, 1, (1 << 64) - 1], np.uint64)).view(np.int64).tolist()


@pytest.mark.parametrize("chain", [2, 3, 4])
def test_groups_lose_no_link(spark, chain):
    values = near_values()
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    found = dict(linking.groups(simhash.keyed(nodes, chain), ["choice", "bits"], simhash._near(chain)).collect())
    expected = roots(values, [(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4])
    assert {v: found.get(v, v) for v in values} == expected and len(found) > 800


def test_dense_groups_make_few_pairs(spark):
    base = 0x123456789ABCDEF
    values = [base ^ (1 << a) ^ (1 << b) for a in range(60) for b in range(a)]
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    seen = []

    def counting(pairs):
        seen.append(pairs.count())
        return pairs

    found = dict(linking.groups(simhash.keyed(nodes, 3), ["choice", "bits"], simhash._near(3), counting).collect())
    assert set(found.values()) == {min(values)} and len(found) == len(values)
    assert sum(seen) < 50 * len(values) < len(values) * (len(values) - 1) // 4


def shingles(text, size=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} or ({" ".join(words)} if words else set())


def alike(a, b):
    return not a | b or 10 * len(a & b) >= 8 * len(a | b)


def distinct_by_brute_force(docs):
    """The rows (doc_id, text) that stay: one of each group."""
    texts = sorted({t or "" for _, t in docs})
    sets = [shingles(t) for t in texts]
    root = roots(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])])
    group = {t: root[i] for i, t in enumerate(texts)}
    best = {}
    for i, t in docs:
        place = (i is None, i or 0)
        best[group[t or ""]] = min(best.get(group[t or ""], place), place)
    return sorted((none, i) for none, i in best.values())


def test_distinct_documents_are_those_of_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rng = np.random.default_rng(11)
    edited = []
    for n, (_, text) in enumerate(rows[:60]):
        words = text.split()
        for at in rng.integers(0, len(words), max(1, len(words) // 60)):
            words[at] = "edited"
        edited.append((100_000 + n, " ".join(words)))
    rows += edited
    got = simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((False, r["doc_id"]) for r in got) == distinct_by_brute_force(rows)
    assert len(got) < len(rows) - 30


@pytest.mark.parametrize("crowd", [1, 12])
def test_crowded_keys(spark, monkeypatch, crowd):
    """Texts that share a passage, near copies of some of them, and keys that count as crowded early on."""
    monkeypatch.setattr(linking, "CROWD", crowd)
    rng = np.random.default_rng(12)
    word = lambda: f"w{rng.integers(10**6)}"
    passage = " ".join(word() for _ in range(60))
    docs = []
    for n in range(60):
        own = [word() for _ in range(40 if n % 2 else 70)]
        docs.append((3 * n, " ".join([*own[:20], passage, *own[20:]])))
        if n % 4 == 0:
            docs.append((3 * n + 1, " ".join([*own[:20], passage, *own[20:-2], "other", "end"])))
    for n in range(30):  # near copies of one text
        words = docs[0][1].split()
        words[rng.integers(0, len(words))] = word()
        docs.append((1000 + n, " ".join(words)))
    got = simhash.distinct_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((False, r["doc_id"]) for r in got) == distinct_by_brute_force(docs)
    assert len(got) == 60


def test_distinct_documents_of_odd_rows(spark):
    docs = helpers.documents(spark)
    got = simhash.distinct_documents(docs)
    assert got.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == distinct_by_brute_force(rows)
    assert simhash.distinct_documents(helpers.empty(spark)).count() == 0
    many = spark.createDataFrame([(None, "a b c d e f")] * 3 + [(7, "g h i j k l")] * 3 + [(7, "m n o p q r")], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.distinct_documents(many).collect()) == ["a b c d e f", "g h i j k l", "m n o p q r"]


def template(pairs=200, size=150, seed=20):
    """Texts on one template, in pairs of a similarity of 0.80 to 0.85, while others have less than 0.8."""
    rng = np.random.default_rng(seed)
    base = [f"t{i}" for i in range(size)]
    docs = []
    for n in range(pairs):
        # words of its own near the end make the pair unlike all others, and some near the begin make two of it
        one = [*base[: size - 18], *(f"p{n}x{k}" for k in range(18))]
        other = list(one)
        for k in rng.choice(40, 3, replace=False).tolist():
            other[5 + k] = f"d{n}y{k}"
        docs += [(2 * n, " ".join(one)), (2 * n + 1, " ".join(other))]
    return docs


@pytest.mark.parametrize("crowd", [16, linking.CROWD])
def test_templates_lose_no_pair(spark, monkeypatch, crowd):
    """All texts meet in crowded keys, are close to the least similarity, and only their pairs have it."""
    monkeypatch.setattr(linking, "CROWD", crowd)
    docs = template()
    expected = distinct_by_brute_force(docs)
    sets = [shingles(t) for _, t in docs]
    share = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert 0.8 <= min(share) < 0.83 and len(expected) == 200
    got = simhash.distinct_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((False, r["doc_id"]) for r in got) == expected


def pair_of_sets(rng, both, each):
    """The hashes of two sets, so many in common and so many of each alone, and where they end."""
    common, own = rng.integers(0, 1 << 64, both, dtype=np.uint64), rng.integers(0, 1 << 64, (2, each), dtype=np.uint64)
    return np.concatenate([np.sort(np.concatenate([common, x])) for x in own]), np.array([0, both + each, 2 * (both + each)])


@pytest.mark.parametrize("both, each", [(8, 1), (40, 5), (160, 20), (1600, 200)])
def test_similar_texts_meet(both, each):
    """At the least similarity nearly all share a run of the ring, and in its rest a key of a crowded one."""
    rng = np.random.default_rng(1)
    runs = rest = 0
    for _ in range(600):
        low = linking.minima(*pair_of_sets(rng, both, each), simhash.MINIMA)
        same = low[0] == low[1]
        starts = [k for k in range(simhash.MINIMA) if all(same[(k + j) % simhash.MINIMA] for j in range(simhash.RUN))]
        runs += bool(starts)
        rest += any(same[(k + j) % simhash.MINIMA] and same[(k + j + 1) % simhash.MINIMA] for k in starts for j in range(simhash.RUN, simhash.MINIMA - 1, 2))
    assert runs >= 597 and rest >= 597


def test_parities_exclude_no_similar_sets_and_most_others(spark):
    rng = np.random.default_rng(4)
    rows = []
    for share, name in ((0.8, "alike"), (0.7, "apart")):
        for n in range(600):
            size = (30, 160, 2000)[n % 3]
            both = int(np.ceil(size * 2 * share / (1 + share)))
            marks = linking.parities(*pair_of_sets(rng, both, size - both)).tolist()
            rows.append((name, size, *[dict(zip(["n", *linking.PARITY_FIELDS], [size, *m], strict=True)) for m in marks]))
    kind = "struct<" + ",".join(f"{f}:bigint" for f in ["n", *linking.PARITY_FIELDS]) + ">"
    got = spark.createDataFrame(rows, f"name string, size int, a {kind}, b {kind}").where(linking.alike(F.col("a"), F.col("b"), 0.8)).groupBy("name", "size").count().collect()
    passed = {(r["name"], r["size"]): r["count"] for r in got}
    assert all(passed["alike", size] == 200 for size in (30, 160, 2000))
    assert passed.get(("apart", 30), 0) + passed.get(("apart", 160), 0) < 4


def test_minima_agree_as_often_as_sets_do():
    """Also of sets that fill few bins, and each bin by itself."""
    rng = np.random.default_rng(6)
    for both, each in ((1, 0), (4, 1), (16, 4), (60, 15), (400, 100)):
        same = np.zeros(128)
        for _ in range(300):
            low = linking.minima(*pair_of_sets(rng, both, each), 128)
            same += low[0] == low[1]
        share = both / (both + 2 * each)
        assert abs(same.mean() / 300 - share) < 0.03 and np.abs(same / 300 - share).max() < 0.16
    assert linking.minima(np.zeros(0, np.uint64), np.array([0, 0, 0]), 8).tolist() == [[0] * 8] * 2


def test_only_touched_texts_are_shuffled(spark, monkeypatch):
    """With more decisions than are broadcast, and none that may be."""
    rows = common.written(spark.range(20_000).selectExpr("concat('k', id) AS own", "id"), spark)
    found = common.written(spark.range(0, 20_000, 41).selectExpr("concat('k', id) AS key", "2 * id AS v"), spark)
    plain = common.brought_back(rows, found, "own", "key").collect()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    joined = common.brought_back(rows, found, "own", "key")
    assert sorted(joined.collect(), key=str) == sorted(plain, key=str)
    assert common.brought_back(rows, found, "own", "key", "inner").count() == found.count()
    empty = common.written(found.where("false"), spark)
    assert common.brought_back(rows, empty, "own", "key").where("v IS NULL").count() == 20_000
    # in the plan there is an exchange only of rows whose bit is set
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = common.brought_back(rows, found, "own", "key")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda line: len(re.match(r"[ :+-]*", line)[0])
    lines = plan.split("\n")
    union = next(i for i, line in enumerate(lines) if "Union" in line)
    branches = [i for i in range(union + 1, len(lines)) if depth(lines[i]) == depth(lines[union + 1])]
    assert len(branches) == 2 and "Exchange hashpartitioning" in "".join(lines[branches[0] : branches[1]])
    assert "Exchange hashpartitioning" not in "".join(lines[branches[1] :])
    sent = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(own" in line)
    assert "Filter coalesce" in "".join(lines[sent : sent + 4])


def test_results_are_the_same_without_broadcasts(spark, data, monkeypatch):
    """Of operators whose decisions come back to texts."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs = common.written(docs.union(docs.limit(20)), spark)
    ways = (line_dedup.line_dedup, simhash.distinct_documents, simhash.near_duplicates)
    before = [sorted(map(str, way(docs).collect())) for way in ways]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert [sorted(map(str, way(docs).collect())) for way in ways] == before


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 240)] + [(5, 5), (3, 1), (1, 3), (9, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    edges = [e for e in edges if e[0] != e[1]]
    expected = roots({x for e in edges for x in e}, edges)
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    docs = helpers.documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    texts = Counter((r["doc_id"], fingerprint(r["text"] or "")) for r in docs.collect())
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in rows) == texts
    nodes = {f for _, f in texts}
    root = roots(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for i, f in texts:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(i, least.get(root[f])) for i, f in texts}
    assert simhash.near_duplicates(helpers.empty(spark)).count() == 0


def test_op2_on_all_documents(spark, data):
    rows = simhash.op2_simhash_near_dedup(spark, data).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{fingerprint(t):016x}" for i, t in texts.items()}
    ids = {i: fingerprint(t) for i, t in texts.items()}
    expected = roots(ids, [(a, b) for a in ids for b in ids if a < b and (ids[a] ^ ids[b]).bit_count() <= 4])
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected


def deduped(docs, least=50):
    """Brute force: a line goes if it stands in a run of enough words that stands earlier; docs: (id, text) by id."""
    runs, out = {}, {}
    for i, text in docs:
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if WORD.search(x)]
        words = [len(WORD.findall(lines[k])) for k in full]
        gone = set()
        for a in range(len(full)):
            for b in range(a, len(full)):
                total = sum(words[a : b + 1])
                # minimal windows: one line less at one end is too few
                if total >= least and (total - words[b] < least or total - words[a] < least):
                    content = tuple(lines[k].strip(" \t\v\f\r") for k in full[a : b + 1])
                    first = runs.setdefault(content, (i, full[a], full[b]))
                    runs[content] = first = min(first, (i, full[a], full[b]))
        for a in range(len(full)):
            for b in range(a, len(full)):
                content = tuple(lines[k].strip(" \t\v\f\r") for k in full[a : b + 1])
                if content in runs:
                    first = runs[content]
                    if first[0] != i or full[a] > first[2]:
                        gone |= set(range(full[a], full[b] + 1))
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


TEN = " ".join("abcdefghij")
SIXTY = " ".join(f"w{i}" for i in range(60))
CASES = [
    (1, "\n".join([SIXTY, "tail"])),
    (2, "\n".join(["head", SIXTY, "other tail"])),  # one long line
    (3, "\n".join(f"{TEN} {i}" for i in range(12))),
    (4, "\n".join(["x", *(f"{TEN} {i}" for i in range(3, 9)), "", "y"])),  # a run of short lines within
    (5, "\n".join([*(f"{TEN} {i}" for i in range(0, 4)), "no more"])),  # too short a run
    (6, "\n".join(["same words here"] * 60)),  # repeats itself
    (7, "\n".join([*(f" {TEN} {i}\r" for i in range(4)), "", " ", *(f"{TEN} {i}" for i in range(4, 9))])),  # blank lines and ends
    (8, SIXTY), (9, SIXTY), (10, ""), (11, "\n\n"),
]


def test_line_dedup_is_brute_force(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(docs).collect()}
    assert got == deduped(CASES)
    assert got[2][0] == "head\nother tail" and got[8][0] == "" and got[5][2] == 0 and got[1][2] == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=12))
def test_windows_are_the_shortest_runs_with_enough_words(words):
    expected = set()
    for a in range(len(words)):
        for b in range(a + 1, len(words) + 1):
            total = sum(words[a:b])
            if total >= 5 and (total - words[b - 1] < 5 or total - words[a] < 5):
                expected.add((a, b))
    spans = line_dedup.windows(words, 5)
    assert spans == sorted(expected)
    hashes = [w * 7919 % 5 for w in words]  # with ties
    picked = line_dedup.selected(hashes, spans)
    before = -1
    for (a, b), i in zip(spans, picked, strict=True):
        least = [k for k in range(a, b) if hashes[k] == min(hashes[a:b])]
        assert i == (before if before in least else least[-1])
        before = i


def random_documents(count=60, seed=2):
    """Texts of few different lines of 5 to 60 words, so that runs stand in many places and lines in others without the rest."""
    rng = np.random.default_rng(seed)
    kinds = [" ".join(f"w{k}x{i}" for i in range(int(rng.choice([5, 12, 20, 30, 60])))) for k in range(14)] + ["", "  "]
    docs = [(i, "\n".join(kinds[k] for k in rng.integers(0, len(kinds), rng.integers(1, 14)))) for i in range(count)]
    for i in range(0, count, 7):  # passages of earlier texts
        lines = docs[(i * 3) % (i + 1)][1].split("\n")
        docs[i] = (i, docs[i][1] + "\n" + "\n".join(lines[1:6]))
    return docs


@pytest.mark.parametrize("seed", [2, 3])
def test_random_runs_are_cut_as_by_brute_force(spark, seed):
    docs = random_documents(seed=seed)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == deduped(docs) and sum(n for _, _, n in got.values()) > 60


def test_fewer_lines_are_selected_than_there_are_windows(data):
    import duckdb

    texts = [t.encode() for (t,) in duckdb.sql(f"SELECT DISTINCT text FROM '{data}/documents.parquet'").fetchall()]
    found = [x for x in map(line_dedup.sketch, texts) if x]
    spans, picked = sum(len(line_dedup.windows(x[2])) for x in found), sum(len(x[4]) for x in found)
    assert picked < 0.7 * spans


def test_a_line_that_stands_often_takes_linear_time():
    begin = time.process_time()
    one, two, words, _, picked = line_dedup.sketch(b"same words here\n" * 30_000)
    lines = one, two
    assert len(picked) < 2_000  # of equal hashes the one selected before
    picked = range(16, 30_000)
    within = line_dedup.matches(lines, words, lines, [(k, picked[0]) for k in picked], True)
    across = line_dedup.matches(lines, words, lines, [(k, picked[0]) for k in picked], False)
    assert {x for s, e in within for x in range(s, e)} == set(range(17, 30_000)) and len(within) < 60_000
    assert {x for s, e in across for x in range(s, e)} == set(range(30_000)) and len(across) < 10
    assert time.process_time() - begin < 10


def test_first_place_of_a_line_is_not_that_of_the_run(spark):
    """The selected line stands alone in the first text; the run around it in the second and the third."""
    run = [f"{TEN} {TEN} {k}" for k in range(6)]
    docs = [(k, f"{line}\nalone {k}") for k, line in enumerate(run)] + [(10, "\n".join(run)), (11, "\n".join(["x", *run, "y"]))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: t for i, (t, _, _) in deduped(docs).items()} and got[11] == "x\ny" and got[10] == "\n".join(run)


def test_line_dedup_of_columns_of_other_names(spark):
    rows = [(1, SIXTY, ("s",), "z", 3), (2, SIXTY, ("s",), "z", 3)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, `we.ird` struct<`a b`:string>, `b``t` string, n_lines int")).collect()
    assert sorted((r["doc_id"], r["text"], r["we.ird"]["a b"], r["b`t"], r["n_lines"], r["n_removed"]) for r in got) == [(1, SIXTY, "s", "z", 1, 0), (2, "", "s", "z", 1, 1)]


def test_line_dedup_of_odd_rows(spark):
    docs = helpers.documents(spark)
    out = line_dedup.line_dedup(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and set(docs.columns) - {"n_lines"} <= set(out.columns)
    assert all(r["text"] is not None for r in rows)
    assert line_dedup.line_dedup(helpers.empty(spark)).count() == 0


@pytest.mark.parametrize("at", ["data", "cases"])
def test_op10_is_its_sql(spark, data, at):
    folder = data if at == "data" else helpers.folder(spark, documents=spark.createDataFrame(CASES, "doc_id long, text string"))
    if at == "cases":
        import glob
        import os
        import shutil

        (part,) = glob.glob(f"{folder}/documents.parquet/part*.parquet")
        os.makedirs(f"{folder}/flat")
        shutil.copy(part, f"{folder}/flat/documents.parquet")
        folder += "/flat"
    assert_same(line_dedup.op10_line_dedup(spark, folder), folder, line_dedup.ORACLE)


def test_op2_is_its_sql(spark, data):
    assert_same(simhash.op2_simhash_near_dedup(spark, data), data, simhash.ORACLE)
