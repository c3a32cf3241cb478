"""Periodic runs of words: found on a grid of multiples of each period, and extended by a grammar.

A run of period p that holds two periods has two neighbouring multiples of p in it, p apart, that agree. Pairs of them
that agree in their neighbours too are the candidates: of a text of n words there are n/1 + n/2 + ... pairs to look at.
Each candidate is extended both ways at once by the common extensions that the run-length grammar of the texts gives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import Words, blocks, bound_batches, extended, mapped, table, texts_of
from lodestream.llm.grammar import Grammar

#: Words that a run has at least.
LEAST = 12
#: Pairs on the grid that are looked at together.
AT_ONCE = 1 << 20

RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


class Texts:
    """Texts as one sequence, from the longest to the shortest, with a value of its own before, between and behind them."""

    def __init__(self, ids: np.ndarray, lead: np.ndarray, size: np.ndarray, docs: np.ndarray):
        self.docs = docs[np.argsort(-size[docs], kind="stable")]
        self.size = size[self.docs]
        self.begin = np.cumsum(self.size + 1) - self.size
        own = int(ids.max(initial=0)) + 1
        self.values = np.arange(own, own + int(self.size.sum()) + len(self.docs) + 1)
        within = np.arange(int(self.size.sum())) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.values[np.repeat(self.begin, self.size) + within] = ids[np.repeat(lead[self.docs], self.size) + within]

    def candidates(self, least: int):
        """Places and periods on the grid that may be in a run, some at a time.

        A run has max(least - p, p) or more values in a row that agree with those p further on, hence six or more if
        least is 12, and a place among them has two more such before it or behind it.
        """
        s, top = self.values, int(self.size.max(initial=0)) // 2
        period = np.arange(1, top + 1)
        # only texts of two periods count, which stand first
        fit = np.searchsorted(-self.size, -np.maximum(least, 2 * period), "right")
        ends = np.append(0, self.begin + self.size)[fit]
        counts = np.maximum(0, -(-(ends - period) // period))
        total, at = np.cumsum(counts), 0
        while at < top:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
            p = np.repeat(period[at:to], counts[at:to])
            # one period may have more pairs than are looked at together only if it is small
            turn = np.arange(len(p)) - np.repeat(np.cumsum(counts[at:to]) - counts[at:to], counts[at:to])
            g = turn * p
            hit = np.flatnonzero(s[g] == s[g + p])
            g, p = g[hit], p[hit]
            equal = lambda k: s[np.clip(g + k, 0, len(s) - 1)] == s[np.clip(g + k + p, 0, len(s) - 1)]  # noqa: B023, E731
            hit = equal(1) & equal(2) | equal(-1) & equal(-2)
            if hit.any():
                yield g[hit], p[hit]
            at = to


def runs_of(ids: np.ndarray, lead: np.ndarray, size: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and smallest period of each run of the texts, by text, start and period.

    ids are the words of all texts; of each text lead is its first one and size how many it has. A run is as long as
    its period holds, and has ``least`` (12 or more) words and two periods.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    docs = np.flatnonzero(size >= least)
    texts = Texts(ids, lead, size, docs)
    of = lambda g: np.searchsorted(texts.begin, g, "right") - 1
    some = [np.unique(of(g)) for g, _ in texts.candidates(least)]
    if not some:
        return none
    texts = Texts(ids, lead, size, texts.docs[np.unique(np.concatenate(some))])
    grammar, found = Grammar(texts.values), none
    for g, p in texts.candidates(least):
        start = g - grammar.common(g - 1, g + p - 1, False)
        end = g + grammar.common(g, g + p, True) + p
        kept = end - start >= np.maximum(least, 2 * p)
        doc = of(start[kept])
        new = (texts.docs[doc], start[kept] - texts.begin[doc], (end - start)[kept], p[kept])
        doc, start, length, p = (np.concatenate(x) for x in zip(found, new, strict=True))
        # of one stretch the smallest period counts; multiples of it hold as well
        order = np.lexsort((p, length, start, doc))
        doc, start, length, p = doc[order], start[order], length[order], p[order]
        first = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(doc)]
        found = doc[first], start[first], length[first], p[first]
    order = np.lexsort((found[3], found[1], found[0]))
    return tuple(x[order] for x in found)


def _found(least: int):
    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                words = Words(texts_of(part.column("text")))
                doc, start, length, period = runs_of(words.id, words.lead, words.n, least)
                change = np.zeros(len(words.id) + 1, np.int64)
                np.add.at(change, words.lead[doc] + start + period, 1)
                np.add.at(change, words.lead[doc] + start + length, -1)
                kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                edges = np.searchsorted(kept, np.append(words.lead, len(words.id)))
                offset = lambda x: pa.array(x, pa.int32())
                pieces = pa.ListArray.from_arrays(offset(edges), words.vocab.cast(pa.binary()).take(pa.array(words.id[kept])))
                collapsed = pc.binary_join(pieces, b" ").cast(pa.string())
                lists = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=["start", "length", "period"])
                runs = pa.ListArray.from_arrays(offset(np.searchsorted(doc, np.arange(len(words.n) + 1))), lists)
                own = [c for c, name in zip(part.columns, part.schema.names, strict=True) if name != "text"]
                yield pa.RecordBatch.from_arrays([*own, runs, collapsed], names=[*(x for x in part.schema.names if x != "text"), "runs", "collapsed"])

    return run


def periodic_runs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """documents with runs (start, length, period, by start and period) and collapsed in place of the text.

    The words are those between white space, numbered from 0. A run is a stretch of ``least`` (12 or more) words and two
    of its periods at least, of which each word equals the one a period further on, as far as that holds; its period is
    the smallest of which that is true. collapsed has the words that no run holds behind its first period, joined by one
    space. Texts that are null or have no word have no runs and an empty collapsed one. Each row is judged by itself:
    repeated rows give the same. Own columns named runs and collapsed are replaced. A text is handled whole, in about
    ten times its size.
    """
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words may be missed by the candidates' check")
    bound_batches(documents.sparkSession)
    documents = documents.drop("runs", "collapsed")
    rest = [name for name in documents.columns if name != "text"]
    return mapped(documents, _found(least), extended(documents, RUNS, rest))


def with_periods(documents: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts, chosen by the CRC-32 of their id, repeat themselves from some word on.

    Such a text has its words joined by one space. Rows with a null id or text, and texts without words, stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != "")
    # a column of its own, so that each expression is counted once
    rows = documents.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    word = lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    again = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), word), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE = f"""
WITH crc AS (
  SELECT doc_id, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda r, c: list_reduce(list_prepend(xor(r, c), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) END AS h
  FROM (SELECT DISTINCT doc_id FROM documents)
), plain AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), aimed AS (
  SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a, h // 10 AS g FROM plain LEFT JOIN crc USING (doc_id)
), doc AS MATERIALIZED (
  SELECT row, doc_id, CASE WHEN a < len(w) THEN list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) END]) ELSE w END AS w FROM aimed
), word AS MATERIALIZED (
  SELECT row, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS x FROM doc WHERE len(w) >= {LEAST}
), pair AS (
  SELECT a.row, b.i - a.i AS p, a.i FROM word a JOIN word b ON a.row = b.row AND a.x = b.x AND b.i > a.i AND 2 * (b.i - a.i) <= a.n
), stretch AS (
  SELECT row, p, min(i) AS s, count(*) + p AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY row, p ORDER BY i) AS k FROM pair) GROUP BY row, p, k
), run AS MATERIALIZED (
  SELECT row, s, len, min(p) AS p FROM stretch WHERE len >= greatest({LEAST}, 2 * p) GROUP BY row, s, len
), told AS (
  SELECT row, count(*) AS n_runs, min((-len, s, p)) AS best, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS listed FROM run GROUP BY row
), left_ AS (
  SELECT row, string_agg(x, ' ' ORDER BY i) AS kept
  FROM (SELECT row, unnest(range(len(w))) AS i, unnest(w) AS x FROM doc) u
  WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.row = u.row AND u.i >= r.s + r.p AND u.i < r.s + r.len) GROUP BY row
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[2]::BIGINT AS start, (-best[1])::BIGINT AS length, best[3]::BIGINT AS period,
       (-1000 * best[1] // best[3])::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM doc LEFT JOIN told USING (row) LEFT JOIN left_ USING (row)
"""
