"""SimHash near duplicates, with candidates found by the pigeonring principle.

The bits of a fingerprint are a ring of five segments. If two fingerprints differ in 4 bits at most, the ring has a
segment from which every chain stays within its share of the differences (Qin and Xiao 2018): none in the first segment,
1 in the first two, 2 in three, 3 in four. With each later segment cut in halves, such a chain has enough halves without
a difference to make keys: so two fingerprints meet where they agree in a chain's first segment and in one of the few
choices of halves that cover all cases. What meets is held against the chain's shares, and only then the whole distance
is counted.

Documents of a given similarity are further apart than that, and no short key of a SimHash finds them; there the ring is
made of minima of shingle hashes, and SimHash prunes what meets before the shingles are compared.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations
from operator import and_, or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import Words, blocks, bound_batches, brought_back, columns, extended, mapped, small, table, texts_of, written
from lodestream.llm.linking import PARITY_FIELDS, alike, distinct_sets, groups, minima, parities, similar_enough

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Segments of the ring: one more than the distance, so that a chain's first one has no difference.
SEGMENTS = DISTANCE + 1
#: Segments of the chains that make keys: 25 keys of 25 or 26 bits for each fingerprint; and, from so many fingerprints
#: on, 70 keys of 31 or 32 bits.
CHAIN, LONG_CHAIN, LONG_FROM = 3, 4, 1 << 27

#: Near duplicates by similarity: words of a shingle, minima of the ring, and how many of them in a row make a key. Texts
#: that differ in 7 of 24 minima at most have three equal ones in a row, and at a similarity of 0.8 all but 1.6e-4 have.
SIMILARITY, SIMILAR_SHINGLE, MINIMA, RUN = 0.8, 5, 24, 3
#: Bits that fingerprints of similar texts differ in at most. At a similarity of 0.8 they differ in 9.7 of 64 on average,
#: with a standard deviation of 2.9; those of texts of four or five shingles in 12 and 3.1.
SIMILAR_DISTANCE, SIMILAR_SEGMENTS = 26, 8

#: Shingles of one text whose bits are in memory at a time.
_AT_ONCE = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(texts: pa.LargeStringArray, shingle: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the word shingles of all texts, in order, and where those of each text begin and end."""
    words = Words(texts, number=False)
    n, size = len(words.n), words.end - words.start
    # all words in lower case, with one space behind each that has white space behind it
    gap = ~words.inside
    space = np.zeros(len(size), bool)
    within = words.end < len(gap)
    space[within] = gap[words.end[within]]
    kept = words.inside.copy()
    kept[words.end[space]] = True
    lower = _LOWER[words.data]
    lower[gap] = 32
    text = lower[kept].tobytes()
    end = np.cumsum(size + space) - space
    first = np.arange(len(size))
    last = np.minimum(first + shingle, words.last[words.doc]) - 1
    whole = (first + shingle <= words.last[words.doc]) | (first == words.lead[words.doc])
    begins, ends = (end - size)[whole], end[last[whole]]
    edges = np.append(0, np.cumsum(np.bincount(words.doc[whole], minlength=n)))
    hashes = (xxhash.xxh64_intdigest(text[x:y], seed) for x, y in zip(begins.tolist(), ends.tolist(), strict=True))
    return np.fromiter(hashes, np.uint64, len(begins)), edges


def fingerprints(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is 1 if it is in over half of its hashes."""
    out = np.zeros((len(edges) - 1, 64), bool)
    for i, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
        total = np.zeros(64, np.int64)
        for at in range(a, b, _AT_ONCE):
            total += _column_sums(np.unpackbits(hashes[at : min(b, at + _AT_ONCE)].astype(">u8").view(np.uint8)).reshape(-1, 64))
        out[i] = 2 * total > b - a
    return np.packbits(out, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints_of(texts: pa.LargeStringArray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    return fingerprints(*shingle_hashes(texts, shingle, seed))


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of 0 and 1 down each of 64 columns; eight columns are added at a time while they can't overflow a byte."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(bits), 255):
        total += np.add.reduce(bits[k : k + 255].view(np.uint64), axis=0).view(np.uint8)
    return total


def simhash(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """documents with the column fp: the fingerprint as a signed integer, zero for texts that are null or hold no word."""
    bound_batches(documents.sparkSession)
    documents = documents.drop("fp")

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                fp = fingerprints_of(texts_of(part.column("text")), shingle, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp)], names=[*part.schema.names, "fp"])

    return mapped(documents, run, extended(documents, "fp bigint"))


# ---------------------------------------------------------------- the ring


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _ring(segments: int) -> list[int]:
    """The bits of each segment; 64 bits are shared out as evenly as whole bits allow."""
    edges = [64 * k // segments for k in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def _halves(bits: int) -> tuple[int, int]:
    low, high = (bits & -bits).bit_length() - 1, bits.bit_length()
    middle = (1 << (low + high) // 2) - 1
    return bits & middle, bits & ~middle


def key_masks(chain: int) -> list[tuple[int, int]]:
    """Start and mask of each key. Behind the first segment j segments have j differences at most, so of their 2 j halves
    j at least have none: the choices of halves are those that take j of the first 2 j or more."""
    ring, out = _ring(SEGMENTS), []
    for start in range(SEGMENTS):
        halves = [h for k in range(1, chain) for h in _halves(ring[(start + k) % SEGMENTS])]
        for chosen in combinations(range(len(halves)), chain - 1):
            if all(sum(c < 2 * j for c in chosen) >= j for j in range(1, chain)):
                out.append((start, ring[start] | sum(halves[c] for c in chosen)))
    return out


def _shares(diff: Column, distance: int, segments: int, start: int) -> Column:
    """Whether every chain from this segment on stays within its share of the distance."""
    ring = _ring(segments)
    reach = [sum(ring[(start + k) % segments] for k in range(n)) for n in range(1, segments)]
    return reduce(and_, (F.bit_count(diff.bitwiseAND(F.lit(_signed(bits)).cast("long"))) <= n * distance // segments for n, bits in enumerate(reach, 1)))


def within(a: Column, b: Column, distance: int, segments: int) -> Column:
    """Whether fingerprints differ in so many bits at most: chains first, from any segment, then the whole distance."""
    diff = a.bitwiseXOR(b)
    return reduce(or_, (_shares(diff, distance, segments, start) for start in range(segments))) & (F.bit_count(diff) <= distance)


def keyed(nodes: DataFrame, chain: int) -> DataFrame:
    """node, choice and bits for each key of each fingerprint (node: the fingerprint)."""
    masks = F.array(*[F.lit(_signed(mask)).cast("long") for _, mask in key_masks(chain)])
    return nodes.select("fp", F.posexplode(masks).alias("choice", "mask")).select(F.col("fp").alias("node"), "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))


def _near(chain: int) -> Callable[[Column, Column], Column]:
    """The condition on two fingerprints that meet at ``choice``: the shares of the chain that made the key."""
    starts = [start for start, _ in key_masks(chain)]

    def near(a: Column, b: Column, choice: Column) -> Column:
        diff = a.bitwiseXOR(b)
        shares = reduce(lambda out, s: F.when(choice.isin([c for c, x in enumerate(starts) if x == s]), _shares(diff, DISTANCE, SEGMENTS, s)).otherwise(out), range(1, SEGMENTS), _shares(diff, DISTANCE, SEGMENTS, 0))
        return shares & (F.bit_count(diff) <= DISTANCE)

    return near


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each row of documents (doc_id, text): the smallest doc_id reachable over links.

    Equal fingerprints are one node, found by a grouping that is combined before the shuffle, so copies cost one row
    each; links are sought between different fingerprints only, and texts are never shuffled. Null texts, empty ones
    and those without words have fingerprint zero and are linked like any other. Repeated rows are copies and each has
    its row. A null doc_id is never the smallest; a component of nothing else has a null id.
    """
    spark = documents.sparkSession
    marked = written(simhash(documents.select("doc_id", "text")).select("doc_id", "fp"), spark)
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), spark)
    chain = CHAIN if nodes.count() < LONG_FROM else LONG_CHAIN
    found = groups(keyed(nodes.select("fp"), chain), ["choice", "bits"], _near(chain))
    # only linked nodes have a component of more than themselves
    linked = nodes.join(small(found), nodes["fp"] == found["node"]).select("fp", "least", "root")
    least = written(linked.groupBy("root").agg(F.min("least").alias("component_id")), spark)
    wide = written(linked.join(small(least), "root").select(F.col("fp").alias("node"), "component_id"), spark)
    by_fp = nodes.join(small(wide), nodes["fp"] == wide["node"], "left").select("fp", F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- by similarity

#: The ring as fields of a row.
_MINIMA = [f"m{k}" for k in range(MINIMA)]
#: The fingerprint, the number of distinct shingles, the parities and the ring of a text.
_MARK = {"fp": "bigint", "n": "bigint", **dict.fromkeys(PARITY_FIELDS, "bigint"), **dict.fromkeys(_MINIMA, "int")}


def _marked(batches):
    for batch in batches:
        for part in blocks(batch, "text"):
            hashes, edges = shingle_hashes(texts_of(part.column("text")), SIMILAR_SHINGLE)
            fp = fingerprints(hashes, edges).view(np.int64)
            hashes, edges = distinct_sets(hashes, edges)
            low = minima(hashes, edges, MINIMA).astype(np.uint32).view(np.int32)
            marks = [fp, np.diff(edges), *parities(hashes, edges).T, *low.T]
            struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(m)) for m in marks], names=list(_MARK))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("copy"), struct], names=["doc_id", "copy", "mark"])


def _sets(batches):
    for batch in batches:
        for part in blocks(batch, "text"):
            hashes, edges = distinct_sets(*shingle_hashes(texts_of(part.column("text")), SIMILAR_SHINGLE))
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("node"), lists], names=["node", "shingles"])


def _ring_key(mark: Column, choice: int) -> Column:
    return F.xxhash64(F.lit(choice), *[mark[_MINIMA[(choice + k) % MINIMA]] for k in range(RUN)])


def _same_run(a: Column, b: Column, choice: int) -> Column:
    return reduce(and_, (a[m] == b[m] for m in (_MINIMA[(choice + k) % MINIMA] for k in range(RUN))))


def _rest_of_ring(mark: Column, choice: Column) -> Column:
    """Keys from two minima each of the ring behind a run: of 10 such keys texts of the similarity share one with a
    probability of 1 - 4e-5, and always if they differ in 7 minima at most, of which some are not in that rest."""
    ring = F.array(*[mark[m] for m in _MINIMA])
    at = lambda k: F.get(ring, F.pmod(choice + k, F.lit(MINIMA)))
    return F.array(*[F.xxhash64(F.lit(k), at(k), at(k + 1)) for k in range(RUN, MINIMA - 1, 2)])


def distinct_documents(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """documents, of each group of near duplicates one row: that of the smallest doc_id (null: largest).

    Two texts are linked if their sets of SIMILAR_SHINGLE-word shingles, in lower case, have that Jaccard similarity; a
    text of fewer words is one shingle, and texts without words (null texts too) are alike. Links reach over others.
    Candidates have RUN minima in a row in common, fingerprints within SIMILAR_DISTANCE, and parities that allow the
    similarity; of them the shingles are compared. In keys of more than linking.CROWD texts, those that the heads don't
    connect must have two more minima in common, of ten such pairs. Equal texts are one node, by their MD5. Of rows that
    repeat doc_id and text one stays. Only ids, hashes and the shingles of candidates are shuffled; of the texts, those
    that are candidates or stand more than once, if they are too many for a broadcast.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    plain = documents.columns
    copy = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    rows = documents.select("doc_id", copy.alias("copy"), "text")
    mark = ", ".join(f"{name}: {kind}" for name, kind in _MARK.items())
    marked = written(rows.mapInArrow(_marked, extended(rows, f"mark struct<{mark}>", ["doc_id", "copy"])), spark)
    id_ = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    nodes = marked.groupBy("copy").agg(F.min(id_).alias("least"), F.count("*").alias("n"), F.first("mark").alias("mark"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), spark)
    near = lambda a, b, _: within(a["fp"], b["fp"], SIMILAR_DISTANCE, SIMILAR_SEGMENTS) & alike(a, b, similarity)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, spark)
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        asked = written(asked.join(nodes.select("node", "copy", "least"), "node").select("node", F.col("copy").alias("__copy"), F.col("least.id").alias("__id")), spark)
        one = brought_back(rows, asked, "copy", "__copy", "inner").where(F.col("doc_id").eqNullSafe(F.col("__id"))).select("node", "text")
        sets = one.mapInArrow(_sets, "node bigint, shingles array<bigint>").groupBy("node").agg(F.first("shingles").alias("shingles"))
        return similar_enough(pairs, written(sets, spark), similarity)

    ring = F.posexplode(F.array(*[_ring_key(F.col("mark"), k) for k in range(MINIMA)])).alias("choice", "key")
    found = groups(nodes.select("node", ring), ["choice", "key"], near, verified, nodes.select("node", "mark"), _same_run, _rest_of_ring, MINIMA)
    linked = nodes.select("node", "least").join(small(found), "node")
    best = written(linked.groupBy("root").agg(F.min(F.struct("least", "node")).alias("best")), spark)
    lost = written(linked.join(small(best), "root").where("node <> best.node").select(F.col("node").alias("__node")), spark)
    # the texts that aren't simply kept: those that are lost, and those that have copies; of rows that are repeated one stays
    again = written(marked.groupBy("copy", "doc_id").count().where("count > 1").select(F.col("copy").alias("__again")).distinct(), spark)
    touched = nodes.select("node", "copy", "n", F.col("least.id").alias("__id")).join(small(lost), F.col("node") == F.col("__node"), "left")
    touched = touched.where("n > 1 OR __node IS NOT NULL").join(small(again), F.col("copy") == F.col("__again"), "left")
    touched = written(touched.select(F.col("copy").alias("__touched"), F.col("__node").isNotNull().alias("__lost"), F.col("__again").isNotNull().alias("__repeated"), "__id"), spark)
    judged = brought_back(documents.withColumn("__copy", copy), touched, "__copy", "__touched")
    kept = judged.where(F.col("__touched").isNull() | (~F.col("__lost") & F.col("doc_id").eqNullSafe(F.col("__id"))))
    if not touched.where("__repeated AND NOT __lost").head():
        return kept.select(*columns(plain))
    repeated = F.coalesce("__repeated", F.lit(False))
    return kept.where(~repeated).select(*columns(plain)).union(kept.where(repeated).dropDuplicates(["__copy"]).select(*columns(plain)))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _oracle() -> str:
    """XXH64 in whole numbers of 128 bits, on lanes of 8, 4 and 1 bytes; then bit by bit, and all pairs of fingerprints."""
    m, p1, p2, p3, p4, p5 = (f"{n}::UHUGEINT" for n in (1 << 64, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def rotated(x: str, by: int) -> str:
        return f"((({x}) * {1 << by}::UHUGEINT) % {m} + ({x}) // {1 << 64 - by}::UHUGEINT)"

    def lane(start: str, size: int) -> str:
        return "(" + " + ".join(f"b[{start} + {k + 1}] * {1 << 8 * k}::UHUGEINT" for k in range(size)) + ")"

    own = lambda x: f"{rotated(f'({x}) * {p2} % {m}', 31)} * {p1} % {m}"
    first = {1: f"({SEED}::UHUGEINT + {p1} + {p2}) % {m}", 2: f"({SEED}::UHUGEINT + {p2}) % {m}", 3: f"{SEED}::UHUGEINT", 4: f"({SEED}::UHUGEINT + {m} - {p1}) % {m}"}
    lanes = ", ".join(f"list_reduce(list_prepend({v}, list_transform(range(n // 32), lambda i: {lane(f'32 * i + {8 * (k - 1)}', 8)} * {p2} % {m})), lambda v, x: {rotated(f'(v + x) % {m}', 31)} * {p1} % {m}) AS v{k}" for k, v in first.items())
    joined = " + ".join(rotated(f"v{k}", by) for k, by in ((1, 1), (2, 7), (3, 12), (4, 18)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE doc AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingle AS MATERIALIZED (
  SELECT row, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')) END) AS s FROM doc
), bytes AS (
  SELECT s, octet_length(encode(s)) AS n, list_transform(range(octet_length(encode(s))), lambda i: (16 * (instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1)::UHUGEINT) AS b
  FROM (SELECT DISTINCT s, hex(encode(s)) AS x FROM shingle)
), lanes AS (
  SELECT s, n, b, {lanes} FROM bytes
), merged AS (
  SELECT s, n, b, CASE WHEN n < 32 THEN ({SEED}::UHUGEINT + {p5} + n::UHUGEINT) % {m}
    ELSE (list_reduce(list_prepend(({joined}) % {m}, [{", ".join(own(f"v{k}") for k in first)}]), lambda h, k: (xor(h, k) * {p1} + {p4}) % {m}) + n::UHUGEINT) % {m} END AS h
  FROM lanes
), eights AS (
  SELECT s, n, b, list_reduce(list_prepend(h, list_transform(range(n % 32 // 8), lambda i: {own(lane("n // 32 * 32 + 8 * i", 8))})), lambda h, k: ({rotated("xor(h, k)", 27)} * {p1} + {p4}) % {m}) AS h FROM merged
), fours AS (
  SELECT s, n, b, list_reduce(list_prepend(h, list_transform(range(n % 8 // 4), lambda i: {lane("n // 8 * 8", 4)} * {p1} % {m})), lambda h, k: ({rotated("xor(h, k)", 23)} * {p2} + {p3}) % {m}) AS h FROM eights
), ones AS (
  SELECT s, list_reduce(list_prepend(h, list_transform(range(n % 4), lambda i: b[n // 4 * 4 + i + 1] * {p5} % {m})), lambda h, k: {rotated("xor(h, k)", 11)} * {p1} % {m}) AS h FROM fours
), hashed AS MATERIALIZED (
  SELECT s, list_reduce([h, {1 << 33}::UHUGEINT, {1 << 29}::UHUGEINT, {1 << 32}::UHUGEINT], lambda h, k: xor(h, h // k) * CASE WHEN k = {1 << 33} THEN {p2} WHEN k = {1 << 29} THEN {p3} ELSE 1::UHUGEINT END % {m}) AS h FROM ones
), power AS (
  SELECT k, list_reduce(list_prepend(1::UHUGEINT, list_transform(range(k), lambda i: 2::UHUGEINT)), lambda x, y: x * y) AS p FROM range(64) t(k)
), bit AS (
  SELECT row, k, 2 * sum((h // p % 2::UHUGEINT)::BIGINT) > count(*) AS one
  FROM shingle JOIN hashed USING (s), power GROUP BY row, k
), print AS MATERIALIZED (
  SELECT row, doc_id, coalesce(hi, 0)::BIGINT AS hi, coalesce(lo, 0)::BIGINT AS lo
  FROM doc LEFT JOIN (SELECT row, sum(CASE WHEN one AND k >= 32 THEN 1::BIGINT << (k - 32) ELSE 0 END) AS hi, sum(CASE WHEN one AND k < 32 THEN 1::BIGINT << k ELSE 0 END) AS lo FROM bit GROUP BY row) USING (row)
), node AS MATERIALIZED (
  SELECT hi, lo, min(doc_id) AS least, row_number() OVER () AS id FROM print GROUP BY hi, lo
), link AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM node a JOIN node b ON a.id <> b.id AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= {DISTANCE}
), reach AS (
  SELECT id AS a, id AS b FROM node UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), component AS (
  SELECT x.hi, x.lo, min(y.least) AS component_id FROM reach JOIN node x ON a = x.id JOIN node y ON b = y.id GROUP BY x.hi, x.lo
)
SELECT doc_id, format('{{:08x}}{{:08x}}', hi, lo) AS fingerprint, component_id FROM print JOIN component USING (hi, lo)
"""


ORACLE = _oracle()
