"""Quality rules: fixed counts, then a calibrated logistic regression on hashed n-grams against a fixed threshold."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import Words, blocks, bound_batches, extended, mapped, table, texts_of
from lodestream.llm.linear import Grams, fit_logistic, fit_platt, sigmoid
from lodestream.llm.samples import labelled
from lodestream.llm.textstats import base_counts

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 1500
#: A document is kept if its calibrated probability of label 1 is at least this.
KEEP_AT = 0.3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, words: Words) -> np.ndarray:
        return sigmoid(self.slope * (Grams(words).logits(self.weights) + self.bias) + self.offset)


def _features(batches):
    for batch in batches:
        for part in blocks(batch, "text"):
            rows = Grams(Words(texts_of(part.column("text")))).rows()
            columns = [pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("__label"), part.column("__fold"), *columns], names=["doc_id", "label", "fold", "buckets", "weights"])


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """The model, from at most ``rows`` labelled documents; None if they don't show both labels.

    A fifth of them, the fold 1 of crc32(doc_id) mod 5, only calibrates the probability; fold 0 isn't used at all.
    """
    bound_batches(documents.sparkSession)
    sample = labelled(documents.select("doc_id", "text"), labels, "quality", rows, held_out=0)
    sample = sample.select("doc_id", "text", "__label", "__fold")
    got = sample.mapInArrow(_features, extended(sample, "label int, fold int, buckets array<int>, weights array<float>", ["doc_id"])).toArrow()
    order = pc.sort_indices(got.column("doc_id")).to_numpy()  # the same sums whatever the shuffle's order
    label, aside = got.column("label").to_numpy()[order], got.column("fold").to_numpy()[order] == 1
    flat = [got.column(c).combine_chunks() for c in ("buckets", "weights")]
    x = [(np.asarray(flat[0][i].values), np.asarray(flat[1][i].values)) for i in order.tolist()]
    if len(set(label[~aside].tolist())) < 2:
        return None
    weights, bias = fit_logistic([r for r, a in zip(x, aside, strict=True) if not a], label[~aside])
    if not aside.any():
        return Model(weights, bias, 1.0, 0.0)
    logit = np.array([r[1] @ weights[r[0]] + bias for r, a in zip(x, aside, strict=True) if a])
    return Model(weights, bias, *fit_platt(logit, label[aside]))


def quality_rules(documents: DataFrame, model: Model | None) -> DataFrame:
    """documents with the counts, base_failed, the calibrated score and kept.

    Words are runs of anything but space and \\t \\n \\v \\f \\r. Null texts count as empty: no words, base_failed, not
    kept. Without a model (no labels of both kinds) the score is null and the base rules alone decide. Rows are judged
    one by one, so repeated rows, ties and other columns change nothing; own columns of these names are replaced.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    added = [x.split()[0] for x in ADDED.split(", ")]
    documents = documents.drop(*added)
    pa.default_memory_pool().release_unused()  # what fitting in this process has left
    shared = spark.sparkContext.broadcast(model)

    def judge(batches):
        model = shared.value
        for batch in batches:
            for part in blocks(batch, "text"):
                words = Words(texts_of(part.column("text")))
                counts = base_counts(words)
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
                score = model.probability(words) if model else None
                verdict = ~failed & (score >= KEEP_AT) if model else ~failed
                columns = [pa.array(counts[c], pa.int64()) for c in COUNTS] + [pa.array(failed), pa.array(score, pa.float64()) if model else pa.nulls(len(failed), pa.float64()), pa.array(verdict)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *added])

    return mapped(documents, judge, extended(documents, ADDED))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return quality_rules(documents, model).select("doc_id", *COUNTS, "base_failed", "kept", F.col("score"))
