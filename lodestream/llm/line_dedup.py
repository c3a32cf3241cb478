"""Line dedup by winnowing over line hashes.

A window is a run of lines that reaches MIN_WORDS words with its last line, or with its first: any run of that many words
holds one. Of each window the line with the smallest hash is selected, so that a run that stands twice has a selected
line in common in both places (Schleimer et al. 2003). Selected lines are joined with the first place of their hash, and
each match is extended line by line both ways, comparing 128 bits of each line. Runs of MIN_WORDS words or more go.

The first place of a line need not be where the rest of a run stands before. So windows whose selected line repeats, but
which no extended match covers, are grouped by their content once more: no repeat is lost, however common a line is.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import blocks, bound_batches, brought_back, columns, extended, mapped, small, table, texts_of, written

#: Words that a run has at least.
MIN_WORDS = 50

_BLANK = b" \t\v\f\r"


def windows(words: list[int] | np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """The windows of lines with so many words each: of each the first line and the one behind the last."""
    total = np.append(0, np.cumsum(words)).astype(np.int64)
    size = len(words)
    if not size or total[-1] < least:
        return []
    # the first end that gives a start enough words, and the last start that gives an end enough
    spans = {(s, e) for s, e in enumerate(np.searchsorted(total, total[:-1] + least).tolist()) if e <= size}
    spans |= {(s, e) for e, s in enumerate((np.searchsorted(total, total[1:] - least, "right") - 1).tolist(), 1) if s >= 0}
    return sorted(spans)


def selected(hashes: np.ndarray, spans: list[tuple[int, int]]) -> list[int]:
    """For each window the line that winnowing selects: of those with the smallest hash the one selected before, if it is
    among them, and else the last (robust winnowing)."""
    out, at, best = [], -1, None
    for s, e in spans:
        # windows move on, so the minimum of the one before holds while it is inside
        if s <= at < e:
            fresh = range(max(s, seen), e)
        else:
            fresh, best = range(s, e), None
        again = best is not None
        for i in fresh:
            if best is None or hashes[i] < best or hashes[i] == best and not again:
                at, best, again = i, hashes[i], False
        seen = e
        out.append(at)
    return out


def sketch(text: bytes, least: int = MIN_WORDS) -> tuple[list[int], list[int], list[int], list[int], list[int]] | None:
    """Of the lines with a word: two hashes, words and number of each, and which are selected. None if no window fits.

    White space at the ends of a line doesn't count.
    """
    number, count, one, two = [], [], [], []
    for i, line in enumerate(text.split(b"\n")):
        n = len(line.split())
        if n:
            number.append(i)
            count.append(n)
            digest = xxhash.xxh3_128_digest(line.strip(_BLANK))
            one.append(int.from_bytes(digest[:8], "little", signed=True))
            two.append(int.from_bytes(digest[8:], "little", signed=True))
    spans = windows(count, least)
    return (one, two, count, number, sorted(set(selected(one, spans)))) if spans else None


def _sketches(batches):
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    for batch in batches:
        for part in blocks(batch, "text"):
            found = [sketch(text) for text in texts_of(part.column("text")).cast(pa.large_binary()).to_pylist()]
            kept = pa.array([i for i, x in enumerate(found) if x], pa.int64())
            lists = zip(*[x for x in found if x], strict=True) if len(kept) else [[]] * 5
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(kept), part.column("node").take(kept), *[pa.array(x, k) for x, k in zip(lists, kinds, strict=True)]], names=["doc_id", "node", "one", "two", "words", "number", "selected"])


def matches(own: tuple[list[int], list[int]], words: list[int], other: tuple[list[int], list[int]], pairs: list[tuple[int, int]], same: bool, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """The runs of enough words (first line, behind the last) that extending the pairs of equal lines both ways gives.

    Within one text (same) a run may not share a line with its earlier place: then its windows are given that don't.
    Lines that a run covers aren't extended again, so that a line that stands often in a text costs little; what that
    may leave is grouped by content with the rest.
    """
    one, two = own
    first, second = other
    out, ends, covered = [], {}, []
    for k, o in sorted(pairs):
        d = k - o
        if ends.get(d, -1) > k or same and d <= 0 or covered and covered[-1][0] <= k < covered[-1][1]:
            continue
        s = e = k
        while s > 0 and s > d and one[s - 1] == first[s - 1 - d] and two[s - 1] == second[s - 1 - d]:
            s -= 1
        while e < len(one) and e - d < len(first) and one[e] == first[e - d] and two[e] == second[e - d]:
            e += 1
        ends[d] = e
        if not same:
            found = [(s, e)] if sum(words[s:e]) >= least else []
        else:
            found = [(s + a, s + b) for a, b in windows(words[s:e], least) if b - a <= d]
        for a, b in found:  # in order of their begins
            if covered and covered[-1][0] <= a <= covered[-1][1]:
                covered[-1] = (covered[-1][0], max(b, covered[-1][1]))
            else:
                covered.append((a, b))
        out += found
    return out


def _extended(batches):
    for batch in batches:
        rows = batch.to_pylist()
        runs = [matches((r["one"], r["two"]), r["words"], (r["first"], r["second"]), [(p["k"], p["o"]) for p in r["pairs"]], r["same"]) for r in rows]
        of = np.repeat(np.arange(len(rows)), [len(x) for x in runs])
        flat = np.array([x for run in runs for x in run], np.int32).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(of, pa.int64())), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["node", "s", "e"])


def _uncovered(batches):
    """Windows whose selected line repeats, but which no run covers, with a digest of their lines."""
    for batch in batches:
        node, out = [], []
        for r in batch.to_pylist():
            spans = windows(r["words"])
            repeated, runs = set(r["repeated"]), sorted((x["s"], x["e"]) for x in r["runs"] or ())
            begins = [s for s, _ in runs]
            reach = list(accumulate((e for _, e in runs), max))
            packed = np.array([r["one"], r["two"]], np.int64).T.tobytes()
            for (s, e), at in zip(spans, selected(r["one"], spans), strict=True):
                k = bisect_right(begins, s)
                if at in repeated and not (k and reach[k - 1] >= e):
                    node.append(r["node"])
                    out.append((s, e, hashlib.blake2b(packed[16 * s : 16 * e], digest_size=16).digest()))
        columns = zip(*out, strict=True) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.string()), *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)]], names=["node", "s", "e", "digest"])


def repeats(documents: DataFrame) -> DataFrame:
    """node, least, copied, whole, runs of the texts that are to be cut: documents has doc_id, text and node (its MD5).

    A text's place is that of its smallest doc_id (null is smallest), least; documents of larger ids are copies, cut
    by the run ``whole`` (copied: there are some). In the text itself the runs go that stand in a text before, or further
    up in it without sharing a line. Runs are first and last lines. Equal texts are one row from the first grouping on,
    which is combined before the shuffle, and so is the one that finds the first place of each selected line. Only of
    texts with a repeated line are the hashes of their lines joined with those of such first places.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    kind = documents.select("doc_id", "node")
    lists = "one array<bigint>, two array<bigint>, words array<int>, number array<int>, selected array<int>"
    found = documents.select("doc_id", "node", "text").mapInArrow(_sketches, extended(kind, lists))
    own = F.first(F.struct("one", "two", "words", "number", "selected")).alias("x")
    texts = found.groupBy("node").agg(F.min(F.struct("doc_id")).alias("a"), F.max(F.struct("doc_id")).alias("b"), own)
    texts = written(texts.select("node", F.col("a.doc_id").alias("least"), (F.col("a") != F.col("b")).alias("copied"), "x.*"), spark)

    lines = texts.select("node", "least", F.explode("selected").alias("k"), "one").select("node", "least", "k", F.element_at("one", F.col("k") + 1).alias("hash"))
    place = F.struct("least", "node", "k")
    origin = written(lines.groupBy("hash").agg(F.min(place).alias("o"), F.count("*").alias("n")).where("n > 1").select("hash", "o"), spark)
    hits = written(lines.join(small(origin), "hash").select("node", "k", F.col("o.node").alias("o_node"), F.col("o.k").alias("o")), spark)

    # positions of one pair of texts together, then extended on the hashes of both
    later = hits.where((F.col("node") != F.col("o_node")) | (F.col("k") != F.col("o")))
    pairs = written(later.groupBy("node", "o_node").agg(F.collect_list(F.struct("k", "o")).alias("pairs")), spark)
    there = texts.select(F.col("node").alias("o_node"), F.col("one").alias("first"), F.col("two").alias("second"))
    both = texts.select("node", "one", "two", "words").join(small(pairs, F.size("pairs")), "node").join(there, "o_node").withColumn("same", F.col("node") == F.col("o_node"))
    runs = written(both.mapInArrow(_extended, "node string, s int, e int"), spark)

    # what the first places of lines don't explain
    of = runs.groupBy("node").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    repeated = hits.groupBy("node").agg(F.collect_set("k").alias("repeated")).join(of, "node", "left")
    repeated = written(repeated, spark)
    open_ = texts.select("node", "one", "two", "words").join(small(repeated, F.size("repeated") + F.coalesce(F.size("runs"), F.lit(0))), "node")
    rest = written(open_.mapInArrow(_uncovered, "node string, s int, e int, digest binary"), spark)
    rest = rest.join(texts.select("node", "least"), "node")
    first = rest.groupBy("digest").agg(F.min(F.struct("least", "node", "s", "e")).alias("o"), F.count("*").alias("n")).where("n > 1").select("digest", "o")
    first = written(first, spark)
    more = rest.join(small(first), "digest").where((F.col("node") != F.col("o.node")) | (F.col("s") >= F.col("o.e"))).select("node", "s", "e")

    cut = runs.union(more).groupBy("node").agg(F.collect_set(F.struct("s", "e")).alias("x"))
    line = lambda i: F.element_at("number", i)
    ends = texts.select("node", "least", "copied", "number", F.struct(line(1).alias("first"), line(-1).alias("last")).alias("whole"))
    shaped = F.transform("x", lambda r: F.struct(line(r["s"] + 1).alias("first"), line(r["e"]).alias("last")))
    return ends.join(cut, "node", "left").where("copied OR x IS NOT NULL").select("node", "least", "copied", "whole", shaped.alias("runs"))


def _cut(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int]:
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, np.int64)
    for first, last in runs:
        gone[first] += 1
        gone[last + 1] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    return "\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g), len(lines), int(gone.sum())


def line_dedup(documents: DataFrame) -> DataFrame:
    """documents with the later repeats cut out of text, and n_lines and n_removed, the lines before and those cut.

    Runs of lines that hold MIN_WORDS words or more go wherever they stand again; the first place, by doc_id and line,
    keeps them. Lines without a word go with the run they stand in. Nothing else changes: shorter repeats stay. A null
    text becomes an empty one, of one line; a text may be empty afterwards. Rows that repeat both doc_id and text are
    one document, cut alike; of different texts of one doc_id that with the smaller MD5 is first. Own columns named
    n_lines and n_removed are replaced.
    """
    documents = documents.drop("n_lines", "n_removed").withColumn("text", F.coalesce("text", F.lit("")))
    plain = documents.columns
    marked = documents.withColumn("__node", F.md5(F.col("text").cast("binary")))
    cuts = written(repeats(marked.select("doc_id", "text", F.col("__node").alias("node"))), documents.sparkSession)
    cuts = cuts.select(F.struct("least", "whole", "runs").alias("__cut"), F.col("node").alias("__of"))
    joined = brought_back(marked, cuts, "__node", "__of", items=F.coalesce(F.size("__cut.runs"), F.lit(0)))
    copy = ~F.col("doc_id").eqNullSafe(F.col("__cut.least"))
    joined = joined.select(*columns(plain), F.when(F.col("__of").isNotNull(), F.when(copy, F.array("__cut.whole")).otherwise(F.col("__cut.runs"))).alias("__runs"))
    at = plain.index("text")

    def rewrite(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                runs = part.column("__runs").to_pylist()
                done = [_cut(t, [(r["first"], r["last"]) for r in own or ()]) for t, own in zip(part.column("text").to_pylist(), runs, strict=True)]
                out = [part.column(i) for i in range(len(plain))]
                out[at] = pa.array([d[0] for d in done], pa.string())
                yield pa.RecordBatch.from_arrays([*out, pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=[*plain, "n_lines", "n_removed"])

    return mapped(joined, rewrite, extended(documents, "n_lines bigint, n_removed bigint"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def deduped_sql(source: str, least: int = MIN_WORDS) -> str:
    """WITH clauses that end in deduped (doc_id, text, n_lines, n_removed), of a table or clause with unique doc_id."""
    return f"""
line AS (
  SELECT doc_id, unnest(range(len(ls)))::BIGINT AS i, unnest(ls) AS x
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {source})
), worded AS (
  SELECT doc_id, i, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS x, n,
         row_number() OVER w AS k, sum(n) OVER w AS total
  FROM (SELECT *, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS n FROM line)
  WHERE n > 0
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), span AS (
  SELECT a.doc_id, a.k AS s, min(b.k) AS e FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.total - a.total + a.n >= {least} GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.k) AS s, b.k AS e FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.total - a.total + a.n >= {least} GROUP BY b.doc_id, b.k
), win AS (
  SELECT doc_id, s, e, min(i) AS first, max(i) AS last, string_agg(x, chr(10) ORDER BY k) AS content
  FROM span JOIN worded USING (doc_id) WHERE k BETWEEN s AND e GROUP BY doc_id, s, e
), later AS (
  SELECT * FROM (SELECT *, first_value(doc_id) OVER o AS d0, first_value(last) OVER o AS l0
                 FROM win WINDOW o AS (PARTITION BY content ORDER BY doc_id, first))
  WHERE doc_id <> d0 OR first > l0
), gone AS (
  SELECT DISTINCT line.doc_id, line.i FROM line JOIN later ON line.doc_id = later.doc_id AND line.i BETWEEN later.first AND later.last
), deduped AS (
  SELECT l.doc_id, coalesce(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text, count(*) AS n_lines, count(g.i) AS n_removed
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)"""


ORACLE = f"WITH {deduped_sql('documents')}\nSELECT doc_id, n_lines, n_removed, length(text) AS n_chars, md5(text) AS text_md5 FROM deduped"
