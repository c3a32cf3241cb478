"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import Words, blocks, bound_batches, extended, mapped, numbered, table, texts_of
from lodestream.llm.linear import adam, sigmoid, word_hashes
from lodestream.llm.samples import fold, labelled
from lodestream.llm.textstats import base_counts

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 3000
WORD_BUCKETS, FACTORS = 1 << 15, 8
#: predicted is 1 from this score on.
POSITIVE_AT = 0.3

STATISTICS = ("words", "word_length", "distinct", "symbols", "repeats", "dup_lines", "upper", "digits", "marks", "line_length", "foreign", "length")

_CLASS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "marks": b"!?.,;:\"'()[]{}-_/\\=+~^@`"}
_TABLES = {}
for _name, _bytes in _CLASS.items():
    _TABLES[_name] = np.zeros(256, bool)
    _TABLES[_name][list(_bytes)] = True


def statistics(words: Words, length: np.ndarray) -> np.ndarray:
    """A row for each text: shares and logarithms that describe its structure; length is its metadata."""
    c = base_counts(words)
    n, size = np.maximum(1, c["n_words"]), np.maximum(1, words.offsets[1:] - words.offsets[:-1])
    _, kinds = numbered(words.doc * max(1, len(words.vocab)) + words.id)
    distinct = np.bincount(np.asarray(kinds) // max(1, len(words.vocab)), minlength=len(n))
    share = {k: words.per_doc(t[words.data]) / size for k, t in _TABLES.items()}
    lines = words.per_doc(words.data == 10) + 1
    columns = {
        "words": np.log1p(c["n_words"]), "word_length": np.log1p(c["word_chars"] / n), "distinct": distinct / np.sqrt(n), "symbols": c["n_symbols"] / size, "repeats": c["n_repeat_words"] / n,
        "dup_lines": c["n_dup_lines"] / lines, **share, "line_length": np.log1p(c["n_words"] / lines), "foreign": words.per_doc(words.data >= 128) / size, "length": np.log1p(length),
    }
    return np.stack([columns[k] for k in STATISTICS], axis=1)


def word_counts(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and weight of each hashed lower-cased word of a text; the squares of a text's weights add up to 1."""
    lowered = pc.utf8_lower(words.vocab.cast(pa.large_string(), safe=False))
    bucket = (word_hashes(lowered.cast(pa.large_binary())) & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
    code, kinds = numbered(words.doc * WORD_BUCKETS + bucket[words.id])
    kinds, count = np.asarray(kinds), np.bincount(code, minlength=len(kinds)).astype(float)
    doc = kinds // WORD_BUCKETS
    norm = np.sqrt(np.bincount(doc, weights=count * count, minlength=len(words.n)))
    return doc, kinds % WORD_BUCKETS, count / norm[doc]


@dataclass
class Machine:
    """bias, w and v are over word buckets and then statistics; mean and scale standardise the statistics."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, stats: np.ndarray, doc: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
        """bias + sum w x + half of the sum over factors of (sum v x)^2 - sum (v x)^2: linear in the number of features."""
        x = self.standard(stats)
        n = len(x)
        linear = np.bincount(doc, weights=value * self.w[bucket], minlength=n) + x @ self.w[WORD_BUCKETS:]
        pairs = np.zeros(n)
        for f in range(FACTORS):
            t = value * self.v[bucket, f]
            own = self.v[WORD_BUCKETS:, f]
            pairs += (np.bincount(doc, weights=t, minlength=n) + x @ own) ** 2 - np.bincount(doc, weights=t * t, minlength=n) - (x * x) @ (own * own)
        return self.bias + linear + pairs / 2

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -6, 6)


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums along each row from each start to its end; zeros where they are the same."""
    out = np.zeros((len(values), len(starts)), values.dtype)
    full = ends > starts
    if full.any():
        out[:, full] = np.add.reduceat(values, starts[full], axis=1)
    return out


def train(stats: np.ndarray, doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, label: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 1e-3) -> Machine:
    """Logistic loss, full gradients; the buckets that the sample doesn't have keep weight 0. doc is in order.

    The rows of weights are w and the factors, so that what belongs together in memory is added together.
    """
    used, column = np.unique(bucket, return_inverse=True)
    n, cut = len(label), len(used)
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    x = np.ascontiguousarray(np.clip((stats - mean) / scale, -6, 6).T.astype(np.float32))
    weights = np.zeros((1 + FACTORS, cut + len(STATISTICS)), np.float32)
    weights[1:] = np.random.default_rng(7).normal(0, 0.01, (weights.shape[1], FACTORS)).T
    bias, value = np.zeros(1), value.astype(np.float32)
    edges = np.searchsorted(doc, np.arange(n + 1))

    def gradient():
        terms = np.stack([row.take(column) for row in weights]) * value
        sums = _sums(terms, edges[:-1], edges[1:]) + weights[:, cut:] @ x
        squares = _sums(terms[1:] ** 2, edges[:-1], edges[1:]) + weights[1:, cut:] ** 2 @ (x * x)
        z = bias[0] + sums[0] + (sums[1:] ** 2 - squares).sum(axis=0) / 2
        off = ((sigmoid(z) - label) / n).astype(np.float32)
        back = sums * off
        back[0] = off
        each = off.take(doc)
        slopes = np.empty_like(weights)
        for f, row in enumerate(back):
            own = row.take(doc) - each * terms[f] if f else each
            slopes[f, :cut] = np.bincount(column, weights=own * value, minlength=cut)
        slopes[:, cut:] = back @ x.T
        slopes[1:, cut:] -= (x * x) @ off * weights[1:, cut:]
        return [np.array([off.sum()]), slopes + decay * weights / n]

    adam(gradient, [bias, weights], steps, rate)
    full = np.zeros((1 + FACTORS, WORD_BUCKETS + len(STATISTICS)))
    full[:, np.concatenate([used, WORD_BUCKETS + np.arange(len(STATISTICS))])] = weights
    return Machine(float(bias[0]), full[0], np.ascontiguousarray(full[1:].T), mean, scale)


def _length(part: pa.RecordBatch) -> np.ndarray:
    return np.maximum(0, pc.fill_null(part.column("__length"), 0).to_numpy(zero_copy_only=False).astype(float))


def _features(batches):
    for batch in batches:
        for part in blocks(batch, "text"):
            words = Words(texts_of(part.column("text")))
            stats = statistics(words, _length(part))
            doc, bucket, value = word_counts(words)
            order = np.argsort(doc, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(doc, minlength=len(words.n)))).astype(np.int32)
            nested = [pa.ListArray.from_arrays(ends, pa.array(a)) for a in (bucket[order].astype(np.int32), value[order].astype(np.float32))]
            rows = pa.array(list(stats), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("__label"), rows, *nested], names=["doc_id", "label", "stats", "buckets", "weights"])


def _with_length(documents: DataFrame) -> DataFrame:
    """The metadata that may enter a score: n_chars, 0 where it is null or missing."""
    return documents.withColumn("__length", F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)) if "n_chars" in documents.columns else F.lit(0.0))


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine | None:
    """The machine, from at most ``rows`` labelled documents outside fold 0 of crc32(doc_id) mod 5; None if they don't show both labels."""
    bound_batches(documents.sparkSession)
    sample = labelled(_with_length(documents).select("doc_id", "text", "__length"), labels, "quality", rows, held_out=0)
    sample = sample.select("doc_id", "text", "__length", "__label")
    got = sample.mapInArrow(_features, extended(sample, "label int, stats array<double>, buckets array<int>, weights array<float>", ["doc_id"])).toArrow()
    got = got.take(pc.sort_indices(got.column("doc_id"))).combine_chunks()  # the same sums whatever the shuffle's order
    label = got.column("label").to_numpy()
    if len(set(label.tolist())) < 2:
        return None
    stats = np.array(got.column("stats").to_pylist())
    nested = got.column("buckets").combine_chunks(), got.column("weights").combine_chunks()
    doc = np.repeat(np.arange(len(label)), pc.list_value_length(nested[0]).to_numpy())
    return train(stats, doc, np.asarray(nested[0].flatten()).astype(np.int64), np.asarray(nested[1].flatten()).astype(float), label.astype(float))


def score_quality(documents: DataFrame, machine: Machine | None) -> DataFrame:
    """documents with held_out, score and predicted.

    A null text scores as an empty one; a null n_chars counts as 0. Without a machine (no labels of both kinds) every
    score is 0.5. Rows are scored one by one, so repeated rows and other columns change nothing; own columns of these
    names are replaced. A null doc_id is in no fold: held_out is null.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    documents = _with_length(documents.drop("held_out", "score", "predicted"))
    shared = spark.sparkContext.broadcast(machine)

    def judge(batches):
        machine = shared.value
        for batch in batches:
            for part in blocks(batch, "text"):
                words = Words(texts_of(part.column("text")))
                score = sigmoid(machine.logits(statistics(words, _length(part)), *word_counts(words))) if machine else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, "score"])

    scored = mapped(documents, judge, extended(documents, "score double")).drop("__length")
    return scored.withColumn("held_out", fold(F.col("doc_id")) == 0).withColumn("predicted", (F.col("score") >= POSITIVE_AT).cast("int"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = fit(documents, table(spark, sf_dir, "labels"))
    return score_quality(documents, machine).select("doc_id", "held_out", "score", "predicted")
