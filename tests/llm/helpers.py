"""Tables that are hard to handle."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import types as T

#: Names that operators use for columns of their own.
CLASHING = ("fp", "kept", "score", "base_failed", "n_words", "held_out", "predicted", "entities", "row", "runs", "key", "a", "b", "node", "root", "mark", "copy", "set", "choice", "bits", "bucket", "part", "head", "busy", "n_tokens", "ids", "sequence_id", "offset", "component_id", "n_shingles", "n_lines", "n_removed", "least", "text_md5", "refers_to", "record_type", "collapsed", "w", "n", "g")

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])

LONG = "\n".join(f"line {i} of a very long text with {i * i} words in it and some more" for i in range(40_000))
ODD = ["", None, " \t\n\r\n ", "one", "a b", "ünï cödé \U0001f600 中文", "x\x00y \x01 \x1c z", LONG, "same text here\nsame text here", "same text here\nsame text here", "word " * 400, "Mail ANN.LEE@Example.com or ann.lee@example.com", "\n\n\n", "a\n" * 200]


def documents(spark, texts=ODD):
    rows = [(i, t, "en", "s", None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in enumerate(texts)]
    rows += [(None, "no id", None, None, None, *[None] * len(CLASHING)), rows[4], rows[4]]
    return spark.createDataFrame(rows, DOCUMENTS)


def empty(spark, schema=DOCUMENTS):
    return spark.createDataFrame([], schema)


def folder(spark, **tables) -> str:
    path = tempfile.mkdtemp(prefix="spark-")
    for name, df in tables.items():
        df.coalesce(1).write.parquet(os.path.join(path, f"{name}.parquet"))
    return path
