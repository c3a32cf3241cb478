"""MinHash near duplicates: one-permutation hashing with optimal densification, bands, and stars in their buckets.

A document's set of shingles is hashed once; the smallest hash in each of BINS bins is its signature, and each BAND bins
in a row make a bucket. Documents of a similarity of 0.8 share one of the 32 buckets with a probability of 1 - 5e-8.
In a bucket edges go to its heads (see linking.groups); what those don't connect meets in the bucket, in crowded ones
only where another bucket is shared too. Candidates are confirmed on their full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import Words, blocks, bound_batches, brought_back, extended, small, table, texts_of, written
from lodestream.llm.linking import PARITY_FIELDS, alike, combined, distinct_sets, groups, minima, mixed, parities, similar_enough

SIMILARITY, SHINGLE, SEED = 0.8, 2, 42
BINS, BAND = 128, 4
BANDS = BINS // BAND

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """The texts with A to Z, and no other letters, in lower case."""
    size, data = len(texts), texts.buffers()[2]
    lower = pa.py_buffer(_LOWER[np.frombuffer(data, np.uint8)]) if data is not None else data
    return pa.LargeStringArray.from_buffers(size, texts.buffers()[1], lower, None, 0, texts.offset)


def shingle_sets(texts: pa.LargeStringArray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of the shingles of each text, ascending, and where those of each text begin and end.

    A text of fewer words has one shingle, the whole, and one without words none.
    """
    words = Words(lowered(texts))
    of = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words.vocab.to_pylist()), np.uint64, len(words.vocab))[words.id] if len(words.id) else np.zeros(0, np.uint64)
    at = np.arange(len(words.id))
    length = np.minimum(words.last[words.doc] - at, shingle)
    first = np.flatnonzero((length == shingle) | (at == words.lead[words.doc]))
    length = length[first]
    hashes = length.astype(np.uint64)
    for k in range(shingle):
        inside = np.flatnonzero(length > k)
        hashes[inside] = mixed(hashes[inside] * np.uint64(0x9E3779B97F4A7C15) + of[first[inside] + k])
    return distinct_sets(hashes, np.append(0, np.cumsum(np.bincount(words.doc[first], minlength=len(words.n)))))


#: The number of shingles, the parities and the buckets of a set.
_MARK = ["n", *PARITY_FIELDS, *(f"k{i}" for i in range(BANDS))]


def _signed(shingle: int):
    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                hashes, edges = shingle_sets(texts_of(part.column("text")), shingle)
                low = minima(hashes, edges, BINS)
                buckets = [combined(low[:, BAND * i : BAND * i + BAND], i).view(np.int64) for i in range(BANDS)]
                marks = [np.diff(edges), *parities(hashes, edges).T, *buckets]
                struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(m)) for m in marks], names=_MARK)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _digests(hashes, edges), pa.array(np.diff(edges)), struct], names=["doc_id", "set", "n_shingles", "mark"])

    return run


def _digests(hashes: np.ndarray, edges: np.ndarray) -> pa.Array:
    data = hashes.tobytes()
    return pa.array([xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)], pa.binary())


def _sets(shingle: int):
    """The sets of the rows that have the one that is asked for; another row may have the same doc_id."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                hashes, edges = shingle_sets(texts_of(part.column("text")), shingle)
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(hashes.view(np.int64)))
                right = pc.equal(_digests(hashes, edges), part.column("set"))
                yield pa.RecordBatch.from_arrays([part.column("node").filter(right), lists.filter(right)], names=["node", "shingles"])

    return run

    return run


def _same_bucket(a: Column, b: Column, i: int) -> Column:
    return a[f"k{i}"] == b[f"k{i}"]


def _other_buckets(mark: Column, choice: Column) -> Column:
    """The buckets but one, as keys: documents of the similarity share two of 32 nearly always (all but 10^-6)."""
    own = [F.when(choice != i, mark[f"k{i}"]) for i in range(BANDS)]
    return F.filter(F.array(*own), lambda k: k.isNotNull())


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of documents (doc_id, text): the smallest doc_id reachable over links.

    Documents are linked whose sets of distinct shingles, A to Z in lower case, have that Jaccard similarity (0.8 or
    more); a text of fewer words is one shingle. Null texts, and those without words, have an empty set and are linked with
    nothing: their component is their own id. Equal sets are one node, by a digest of 128 bits, found by a grouping that
    is combined before the shuffle; repeated rows are copies and each has its row. A null doc_id is never the smallest;
    a component of nothing else has a null id. Ids, digests and signatures are shuffled, and the shingles of candidates;
    texts aren't.
    """
    if similarity < 0.8:
        raise ValueError("the bands are made for a similarity of 0.8 or more")
    spark = documents.sparkSession
    bound_batches(spark)
    rows = documents.select("doc_id", "text")
    mark = ", ".join(f"{name}: bigint" for name in _MARK)
    marked = written(rows.mapInArrow(_signed(shingle), extended(rows, f"`set` binary, n_shingles bigint, mark struct<{mark}>", ["doc_id"])), spark)
    known = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    nodes = marked.where("n_shingles > 0").groupBy("set").agg(F.min(known).alias("least"), F.first("mark").alias("mark"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "set", F.col("least.id").alias("least"), "mark"), spark)
    near = lambda a, b, _: alike(a, b, similarity)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, spark)
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        asked = written(asked.join(nodes.select("node", "set", "least"), "node").withColumnRenamed("least", "__least"), spark)
        asked = asked.withColumn("__id", F.coalesce(F.col("__least").cast("string"), F.lit("")))  # no id is an empty text
        texts = brought_back(rows.withColumn("__own", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), asked, "__own", "__id", "inner").select("node", "set", "text")
        sets = texts.mapInArrow(_sets(shingle), "node bigint, shingles array<bigint>").groupBy("node").agg(F.first("shingles").alias("shingles"))
        return similar_enough(pairs, written(sets, spark), similarity)

    buckets = F.posexplode(F.array(*[F.col(f"mark.k{i}") for i in range(BANDS)])).alias("choice", "bucket")
    found = groups(nodes.select("node", buckets), ["choice", "bucket"], near, verified, nodes.select("node", "mark"), _same_bucket, _other_buckets, BANDS)
    linked = nodes.select("node", "set", "least").join(small(found), "node")
    best = written(linked.groupBy("root").agg(F.min("least").alias("component_id")), spark)
    wide = written(linked.join(small(best), "root").select(F.col("node").alias("__node"), "component_id"), spark)
    by_set = nodes.select("node", "set", "least").join(small(wide), F.col("node") == F.col("__node"), "left")
    by_set = by_set.select("set", F.when(F.col("__node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    full = marked.select("doc_id", "set", "n_shingles")
    filled = full.where("n_shingles > 0").join(written(by_set, spark), "set").select("doc_id", "n_shingles", "component_id")
    return filled.union(full.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""
WITH RECURSIVE doc AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingle AS MATERIALIZED (
  SELECT DISTINCT row, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM doc
), told AS MATERIALIZED (
  SELECT row, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS kind FROM shingle GROUP BY row
), kind AS MATERIALIZED (
  SELECT min(row) AS c, any_value(n) AS n, kind FROM told GROUP BY kind
), own AS MATERIALIZED (
  SELECT c, n, s FROM kind JOIN shingle ON c = row
), link AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM own a JOIN own b ON a.s = b.s AND a.c <> b.c AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.c, b.c HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT c AS a, c AS b FROM kind UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS MATERIALIZED (
  SELECT kind, min(doc_id) AS doc_id FROM told JOIN doc USING (row) GROUP BY kind
), component AS (
  SELECT x.kind, min(l.doc_id) AS component_id FROM reach JOIN kind x ON a = x.c JOIN kind y ON b = y.c JOIN least l ON l.kind = y.kind GROUP BY x.kind
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id,
       doc_id IS NOT DISTINCT FROM CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS kept
FROM doc LEFT JOIN told USING (row) LEFT JOIN component USING (kind)
"""
