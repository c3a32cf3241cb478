"""A training corpus from raw documents: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import line_dedup as lines
from lodestream.llm import packing, pii, quality_rules, simhash
from lodestream.llm.common import columns, table, written


def _columns(docs: DataFrame, source: DataFrame) -> DataFrame:
    """docs with the columns of source only; n_chars follows the text."""
    if "n_chars" in source.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(source.schema["n_chars"].dataType))
    return docs.select(*columns(source.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; the model is fitted on labelled rows of docs.

    A null text has no words and goes; without labels of both kinds the base rules alone decide. Each row is judged by
    itself, so repeated rows fare alike; of an empty table an empty one is left.
    """
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(docs, model).where("kept").select(*columns(docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the runs of lines that stand earlier in the corpus.

    A document that loses lines is judged again by the rule on length: with fewer words left than quality_rules.MIN_WORDS
    it goes, as nearly all of it stands in earlier documents. A null text is an empty one; the first of repeated lines is
    that of the smallest doc_id, and rows that repeat an id and a text are cut alike.
    """
    done = lines.line_dedup(docs)
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != ""))
    return _columns(done.where((F.col("n_removed") == 0) | (words >= quality_rules.MIN_WORDS)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, linked by a similarity of 0.8 of their five-word shingles, one document.

    That of the smallest doc_id stays (a null one is largest), once; texts that are null or hold no word are one group.
    """
    return simhash.distinct_documents(docs).select(*columns(docs.columns))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data and secrets.

    Null texts stay null (n_chars too); repeated rows get the same surrogates; an empty table stays empty.
    """
    return _columns(pii.pseudonymised(docs, pii.key_of(spark)), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each document.

    A null text is packed as an empty one, of one token; each of several equal rows has its pieces; pieces of one length
    may stand in either's place. An empty table has no pieces.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("pii", private),
    ("packing", packed),
]

#: The quality model and the tokens have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, from the table documents on; what each returns is written to the shared folder and read again.

    Nulls, repeated rows, ties and empty tables are treated as the stages say: documents with null or short texts go in
    the first one, of repeated rows one stays in the third, and of an empty table the result is empty.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), spark)
    return STAGES[-1][1](spark, docs, sf_dir)
