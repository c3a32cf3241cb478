"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a task holds in numpy arrays at a time (one longer text is a block of its own).
BLOCK_BYTES = 1 << 20

#: Rows and bytes of an Arrow batch that Spark hands to Python.
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches by bytes, so that many long texts don't meet in one batch.

    Spark reads these settings when a job runs. A user's own settings, told by not being Spark's defaults, are kept.
    """
    for name, default, most in (("maxRecordsPerBatch", "10000", ARROW_ROWS), ("maxBytesPerBatch", "67108864b", ARROW_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def column(name: str) -> Column:
    """The column of this name, whatever characters the name has."""
    return F.col(f"`{name.replace('`', '``')}`")


def columns(names: Iterable[str]) -> list[Column]:
    return [column(name) for name in names]


def extended(df: DataFrame, added: str, names: Iterable[str] | None = None) -> T.StructType:
    """The schema of df, or of its columns of these names, and the added columns (DDL) behind it."""
    kept = df.schema.fields if names is None else [df.schema[name] for name in names]
    return T.StructType([*kept, *T._parse_datatype_string(added).fields])


def mapped(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any names; what run yields has the schema's columns in order.

    Names with other characters than letters, digits and underscores have others while Python has the rows.
    """
    safe = lambda names: [name if re.fullmatch(r"\w+", name) else f"__odd{i}" for i, name in enumerate(names)]
    after = safe(schema.names)

    def renamed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=after)

    fields = [T.StructField(name, f.dataType, f.nullable) for name, f in zip(after, schema.fields, strict=True)]
    return df.toDF(*safe(df.columns)).mapInArrow(renamed, T.StructType(fields)).toDF(*schema.names)


#: Rows of a table that is broadcast by small(), at most; an item of a list counts as a row.
BROADCAST_ROWS = 1 << 18


def small(df: DataFrame, items: Column | None = None) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it is counted to have BROADCAST_ROWS at most.

    items: how many items the lists of a row have. Larger tables are left to a shuffled join, whose hot keys Spark splits.
    """
    count = df.count() if items is None else df.agg(F.coalesce(F.sum(items + 1), F.lit(0))).first()[0]
    return F.broadcast(df) if count <= BROADCAST_ROWS else df


#: Bits of a bitmap for each key in it, and in all at least and at most (64 MB).
_BITS_A_KEY, _LEAST_BITS, _MOST_BITS = 64, 1 << 15, 1 << 29


def brought_back(rows: DataFrame, found: DataFrame, on: str, key: str, how: str = "left", items: Column | None = None) -> DataFrame:
    """rows (wide, with texts) joined with found (written, narrow; its column ``key`` is unique) where on = key.

    items: how many items the lists of a row of found have. A found of BROADCAST_ROWS rows and items or fewer is
    broadcast. Otherwise a bitmap of the hashes of its keys is, of 64 MB at
    most, and only rows whose bit is set are shuffled: those that found has, and one in 64 of the others (more from 8
    million keys on). The rest of rows stays where it is.
    """
    count, size = found.agg(F.count("*"), F.coalesce(F.sum((F.lit(0) if items is None else items) + 1), F.lit(0))).first()
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found), F.col(on) == F.col(key), how)
    bits = max(_LEAST_BITS, min(_MOST_BITS, 1 << (_BITS_A_KEY * count - 1).bit_length()))
    place = lambda name: F.pmod(F.xxhash64(name), F.lit(bits))
    maps = found.select(place(key).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("__bucket"))
    maps = written(maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("__map")), rows.sparkSession)
    bit = F.bitmap_bit_position(place(on))
    byte = F.conv(F.hex(F.substring("__map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.coalesce((byte / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1, F.lit(False))
    probed = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place(on)) == F.col("__bucket"), "left").withColumn("__maybe", set_).drop("__bucket", "__map")
    asked = probed.where("__maybe").drop("__maybe").join(found, F.col(on) == F.col(key), how)
    if how == "inner":
        return asked
    rest = probed.where("NOT __maybe").drop("__maybe")
    return asked.union(rest.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields]))


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the folder that driver and executors share.

    It is spark.checkpoint.dir. Where that is unset a temporary folder serves in local mode, in which there is one
    machine; on a cluster it is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(sc, "_lodestream_dir", None)
        if not base:
            base = sc._lodestream_dir = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/lodestream-{uuid.uuid4().hex}"


def written(df: DataFrame, spark: SparkSession) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: it cuts the lineage and survives lost executors."""
    path = shared_dir(spark)
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._written_at = path
    return again


def removed(df: DataFrame) -> None:
    """Deletes the files of a table that written() returned and nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns what a worker has freed to the system, where the C library can: workers live through many stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """The column as one array of strings without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def blocks(batch: pa.RecordBatch, name: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with at most so many bytes in the named string column, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if batch.num_rows > begin:
        yield batch.slice(begin)
    give_back()


def raw(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts together, and the offsets of the texts in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.LargeBinaryArray:
    """Consecutive pieces of data, of the given lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def numbered(values: pa.Array | np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number from 0 for each value, equal for equal values; and the values by number."""
    coded = (pa.array(values) if isinstance(values, np.ndarray) else values).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


class Memory:
    """What a worker remembers of short keys, in a bounded number of bytes.

    It has two generations: when the younger has half the bytes it becomes the older, whose entries are forgotten unless
    they were asked for since. Keys of more than LONGEST characters or bytes aren't kept.
    """

    LONGEST, ENTRY = 64, 200  # bytes that an entry takes besides its contents

    def __init__(self, most: int = 64 << 20):
        self.most, self.young, self.old, self.size = most, {}, {}, 0

    def lookup(self, keys: list, learn) -> list:
        """The values of the keys, which are distinct; learn(keys) gives those of the keys that aren't known."""
        found = list(map(self.young.get, keys))
        at = [i for i, v in enumerate(found) if v is None]
        if at and self.old:
            for i in at:
                found[i] = self.old.get(keys[i])
            self.keep({keys[i]: found[i] for i in at if found[i] is not None})
            at = [i for i in at if found[i] is None]
        if at:
            new = [keys[i] for i in at]
            values = learn(new)
            for i, v in zip(at, values, strict=True):
                found[i] = v
            self.keep(dict(zip(new, values, strict=True)))
        return found

    def keep(self, entries: dict) -> None:
        short = {k: v for k, v in entries.items() if len(k) <= self.LONGEST}
        self.young.update(short)
        self.size += sum(map(len, short)) + sum(map(len, short.values())) + self.ENTRY * len(short)
        if self.size > self.most // 2:
            self.old, self.young, self.size = self.young, {}, 0


#: The separators of words: space and \t \n \v \f \r.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a block of texts, as arrays over all of them.

    doc: the text of each word; id: its number; vocab: the words (bytes) by number; per text: n (words), lead and
    last (its first word and the one after its last). Without ``number`` there are no id and vocab.
    """

    def __init__(self, texts: pa.LargeStringArray, number: bool = True):
        self.data, self.offsets = raw(texts)
        n, size = len(texts), len(self.data)
        gap = SEPARATOR[self.data]
        before, after = np.ones(size, bool), np.ones(size, bool)
        before[1:], after[:-1] = gap[:-1], gap[1:]
        edges = self.offsets[1:-1]
        before[edges[edges < size]] = True
        after[edges[edges > 0] - 1] = True
        self.inside = ~gap
        self.start = np.flatnonzero(self.inside & before)
        self.end = np.flatnonzero(self.inside & after) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.n = np.bincount(self.doc, minlength=n)
        self.last = np.cumsum(self.n)
        self.lead = self.last - self.n
        if number:
            self.id, self.vocab = numbered(strings(self.data[self.inside], self.end - self.start))

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each text has."""
        edges = self.offsets.tolist()
        return np.fromiter((np.count_nonzero(flags[a:b]) for a, b in zip(edges, edges[1:], strict=False)), np.int64, len(edges) - 1)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each run of ``size`` words within one text: its first word, a number (equal for equal runs), and how many numbers there are."""
        first = np.arange(len(self.id))
        first = first[first + size <= self.last[self.doc]] if len(first) else first
        code, count = self.id[first], len(self.vocab)
        for k in range(1, size):
            code, values = numbered(code * max(1, len(self.vocab)) + self.id[first + k])
            count = len(values)
        return first, code, count
