"""Best-fit packing of token sequences, planned on how many pieces there are of each length.

No length is over the capacity, so the table of lengths is bounded however many pieces there are: the plan is made on it
alone, in the driver, and says which ranks of a length go to which places. Pieces then look up their place by their rank
within their length, which is counted in shards, so neither a task nor the driver ever holds all pieces of a length.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm.common import Memory, Words, blocks, bound_batches, columns, extended, mapped, numbered, strings, table, texts_of, written

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
#: (share, groups): lengths over capacity // share count as large, and are rounded up within so many groups of equal
#: cardinality. Rounding costs room that only small pieces can fill, so what is best depends on how many there are: each
#: pair makes a plan, and the plan with the fewest bins is taken.
SETTINGS = ((2, 20), (3, 10), (8, 40))
#: Columns that column generation tries for a plan; on tables of lengths as they come it takes a tenth of them.
STEPS = 5000
#: Bytes of pre-tokens and their ids that a worker remembers.
CACHE_BYTES = 80 << 20

# ---------------------------------------------------------------- tokens


class WordTokens:
    """Ids of texts, by words between ASCII white space, which no pre-token of the vocabulary crosses.

    Words of plain characters are put in lower case and cut into pre-tokens (letters, a digit, other characters) for all
    texts of a block at once, and only new pre-tokens are encoded, many at a time, with a mark between them that is a
    token of its own. Words of other characters, whose normal form or class may depend on the library's tables, and
    those with an apostrophe, which may begin a pre-token, are encoded whole.
    """

    MARK = "\x01"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        (self.mark,) = self._ids([self.MARK])[0]
        self.known = Memory(CACHE_BYTES)  # ids of pre-tokens and of whole words, as 32-bit integers

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.LargeStringArray) -> list[np.ndarray]:
        """The ids of each text. The pre-tokens of all texts are numbered first, so that each different one is looked up once."""
        words = Words(texts, number=False)
        data, plain, first = _pre_tokens(words)
        start = np.flatnonzero(first)
        code, vocab = numbered(strings(data[words.inside], np.diff(np.append(np.cumsum(words.inside)[start] - 1, np.count_nonzero(words.inside)))))
        kinds = vocab.to_pylist()
        easy = np.zeros(len(kinds), bool)
        easy[code] = plain[start]
        simple = lambda: dict(zip(kinds, easy.tolist(), strict=True))
        found = self.known.lookup(kinds, lambda new: self._learn(new, simple()))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, begin = np.frombuffer(b"".join(found), "<i4"), np.cumsum(size) - size
        many = size[code]
        end = np.append(0, np.cumsum(many))
        flat = ids[np.arange(end[-1]) + np.repeat(begin[code] - end[:-1], many)]
        edges = end[np.searchsorted(start, words.offsets)].tolist()
        return [flat[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def _learn(self, new: list[bytes], simple: dict[bytes, bool]) -> list[bytes]:
        fresh, other = [k for k in new if simple[k]], [k for k in new if not simple[k]]
        out = dict(zip(fresh, self._encode([k.decode() for k in fresh]), strict=True))
        out.update(zip(other, (np.array(own, "<i4").tobytes() for own in self._ids([k.decode() for k in other])), strict=True))
        return [out[k] for k in new]

    def _encode(self, pieces: list[str], at_once: int = 2000) -> Iterator[bytes]:
        parts = [pieces[i : i + at_once] for i in range(0, len(pieces), at_once)]
        for part, ids in zip(parts, self._ids([f" {self.MARK} ".join(p) for p in parts]), strict=True):
            own = np.array(ids, "<i4")
            ends = np.append(np.flatnonzero(own == self.mark), len(own)).tolist()
            data, begin = own.tobytes(), 0
            for end in ends:
                yield data[4 * begin : 4 * end]
                begin = end + 1


#: Classes of the bytes of plain words: 1 letters, 2 digits, 3 others, 0 for what isn't plain.
_BYTES = np.zeros(256, np.uint8)
_BYTES[0x21:0x7F] = 3
_BYTES[list(b"0123456789")] = 2
_BYTES[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_BYTES[ord("'")] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _pre_tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a block with plain words in lower case; which bytes are of plain words; which begin a pre-token.

    Plain are ASCII without the apostrophe and the letters from À to ÿ, in UTF-8 the byte C3 and another. A word that
    isn't plain is one pre-token.
    """
    data = words.data
    kind = _BYTES[data]
    lead = data == 0xC3
    if lead.any():
        # in UTF-8 a byte follows each C3; × and ÷ are no letters
        at = np.flatnonzero(lead)
        letter = (data[at + 1] != 0x97) & (data[at + 1] != 0xB7)
        kind[at[letter]] = kind[at[letter] + 1] = 1
    odd = np.append(0, np.cumsum((kind == 0) & words.inside))
    plain = odd[words.start] == odd[words.end]
    of = np.zeros(len(data), np.int8)
    of[words.start[plain]] = 1
    within = words.end[plain]
    of[within[within < len(data)]] -= 1  # a word may begin where another ends
    own = np.cumsum(of, dtype=np.int8).view(bool) if len(data) else np.zeros(0, bool)
    lower = data.copy()
    lower[own] = _LOWER[data[own]]
    if lead.any():
        second = at[own[at]] + 1
        up = second[(data[second] >= 0x80) & (data[second] <= 0x9E)]
        lower[up] += 0x20
    first = np.zeros(len(data), bool)
    first[1:] = own[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    first[words.start] = True
    return lower, own, first


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids, if wanted) of each piece of each document.

    A document is its ids and a closing id 0; only one longer than capacity is cut. Null and empty texts are the id 0.
    Each row of documents makes its own pieces, repeated or not. The vocabulary must be at ``path`` on every machine.
    """
    bound_batches(documents.sparkSession)

    def run(batches):
        own = word_tokens(path)
        for batch in batches:
            for part in blocks(batch, "text"):
                row, number, start, length, crc, kept = [], [], [], [], [], []
                for i, found in enumerate(own.encode(texts_of(part.column("text")))):
                    data = found.tobytes() + b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        piece = data[at : at + 4 * capacity]
                        row.append(i)
                        number.append(k)
                        start.append(at // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        if ids:
                            kept.append(np.frombuffer(piece, "<i4"))
                columns = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])])

    added = "piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")
    return documents.select("doc_id", "text").mapInArrow(run, extended(documents, added, ["doc_id"]))


# ---------------------------------------------------------------- plan


@dataclass
class Bins:
    """So many bins with the same content: (length, how many) in order."""

    count: int
    content: tuple[tuple[int, int], ...]

    def with_more(self, count: int, length: int, many: int) -> Bins:
        if self.content and self.content[-1][0] == length:
            return Bins(count, (*self.content[:-1], (length, self.content[-1][1] + many)))
        return Bins(count, (*self.content, (length, many)))


def _grouped(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Linear grouping: lengths from large to small in groups of nearly equal cardinality; of each its largest length and its [length, count]."""
    total, out, taken = sum(counts.values()), [], 0
    share = -(-total // groups)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if taken % share == 0 or not out:
                out.append((length, []))
            n = min(left, share - taken % share)
            out[-1][1].append([length, n])
            taken, left = taken + n, left - n
    merged: list[tuple[int, list[list[int]]]] = []
    for size, items in out:  # groups of one size are one size for the configurations
        if merged and merged[-1][0] == size:
            merged[-1][1].extend(items)
        else:
            merged.append((size, items))
    return merged


def _best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> np.ndarray:
    """Of all multisets of sizes that fit, one of the largest worth (unbounded knapsack)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    down = np.array(sizes)  # from large to small
    for room in range(1, capacity + 1):
        at = len(sizes) - int(np.searchsorted(down[::-1], room, "right"))
        best[room] = best[room - 1]
        if at < len(sizes):
            gain = best[room - down[at:]] + worth[at:]
            g = int(np.argmax(gain))
            if gain[g] > best[room] + 1e-12:
                best[room], pick[room] = gain[g], at + g
    config, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            config[pick[room]] += 1
            room -= sizes[pick[room]]
    return config


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (how many of each size) and how many bins to fill by each, for at least the demand.

    The linear programme over all configurations is solved by column generation, to its optimum unless that takes more
    than STEPS columns: the plan then holds every piece all the same, in more bins perhaps. Its solution is rounded down,
    and what is left over, less than a bin for each size, goes to configurations filled largest first.
    """
    demand_ = np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])  # a column is a configuration
    x = demand_ / np.diag(basis)
    for _ in range(STEPS):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = _best_configuration(sizes, worth, capacity)
        if column @ worth <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, x / np.where(change > 1e-9, change, 1), np.inf)
        out = int(np.argmin(ratio))
        x = x - ratio[out] * change
        x[out] = ratio[out]
        basis[:, out] = column
        x = np.maximum(x, 0)
    left, plan = list(demand), []
    for config, bins in zip(basis.T.round().astype(int), np.floor(x + 1e-6).astype(int), strict=True):
        use = np.minimum(config, capacity)
        fits = min([int(bins), *(left[g] // int(k) for g, k in enumerate(use) if k)])
        if fits > 0:
            plan.append((tuple(int(k) for k in use), fits))
            left = [n - fits * int(k) for n, k in zip(left, use, strict=True)]
    while any(left):
        room, config = capacity, [0] * len(sizes)
        for g, size in enumerate(sizes):
            config[g] = min(left[g], room // size)
            room -= config[g] * size
        many = min(left[g] // k for g, k in enumerate(config) if k)
        plan.append((tuple(config), many))
        left = [n - many * k for n, k in zip(left, config, strict=True)]
    return plan


def _substituted(plan: list[tuple[tuple[int, ...], int]], groups: list[tuple[int, list[list[int]]]]) -> list[Bins]:
    """The configurations with actual lengths in place of the rounded ones; runs of equal bins stay together."""
    queues = [list(reversed([list(i) for i in items])) for _, items in groups]
    out = []
    for config, count in plan:
        while count:
            # each slot takes from the front of its group's queue; equal lengths last for the whole run
            run, content = count, []
            for g, k in enumerate(config):
                if not k:
                    continue
                length, n = queues[g][-1]
                if n >= k:
                    run = min(run, n // k)
                    content.append([(length, k)])
                else:  # the bin takes the end of one length and the start of others
                    mixed, need = [], k
                    for length, n in reversed(queues[g]):
                        mixed.append((length, min(n, need)))
                        need -= mixed[-1][1]
                        if not need:
                            break
                    run = 1
                    content.append(mixed)
            for g, taken in zip([g for g, k in enumerate(config) if k], content, strict=True):
                for length, k in taken:
                    queues[g][-1][1] -= run * k
                    if not queues[g][-1][1]:
                        queues[g].pop()
            out.append(Bins(run, tuple(t for taken in content for t in taken)))
            count -= run
    return out


def _best_fit(bins: list[Bins], small: dict[int, int], capacity: int) -> list[Bins]:
    """Small lengths, largest first, each into the fullest bins with room for it, then into new ones."""
    rooms: dict[int, list[Bins]] = {}
    for b in bins:
        rooms.setdefault(capacity - sum(length * k for length, k in b.content), []).append(b)
    keys = sorted(rooms)

    def put(room: int, b: Bins) -> None:
        if room not in rooms:
            bisect.insort(keys, room)
            rooms[room] = []
        rooms[room].append(b)

    for length in sorted(small, reverse=True):
        left = small[length]
        while left:
            at = bisect.bisect_left(keys, length)
            room = keys[at] if at < len(keys) else capacity
            each = room // length
            if at < len(keys):
                b = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], keys[at]
            else:
                b = Bins(-(-left // each), ())
            full = min(b.count, left // each)
            if full:
                put(room - each * length, b.with_more(full, length, each))
                left -= full * each
            rest = b.count - full
            if rest and left and left < each:
                put(room - left * length, b.with_more(1, length, left))
                left, rest = 0, rest - 1
            if rest:
                put(room, Bins(rest, b.content))
    return [b for room in keys for b in rooms[room]]


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, settings: tuple[tuple[int, int], ...] = SETTINGS) -> list[Bins]:
    """Bins for so many pieces of each length (1 to capacity); the plan's size depends on capacity and settings only."""
    return min((_planned(counts, capacity, *s) for s in settings), key=lambda bins: sum(b.count for b in bins))


def _planned(counts: dict[int, int], capacity: int, share: int, groups: int) -> list[Bins]:
    counts = {length: n for length, n in counts.items() if n}
    whole = counts.pop(capacity, 0)
    edge = max(1, capacity // share)
    large, small = {k: n for k, n in counts.items() if k > edge}, {k: n for k, n in counts.items() if k <= edge}
    bins = [Bins(whole, ((capacity, 1),))] if whole else []
    if large:
        grouped = _grouped(large, groups)
        demand = [sum(n for _, n in items) for _, items in grouped]
        bins += _substituted(configurations([size for size, _ in grouped], demand, capacity), grouped)
    return _best_fit(bins, small, capacity)


def places(bins: list[Bins]) -> dict[str, np.ndarray]:
    """For each length the ranks from ``rank`` on, until the next entry: which bins they fill, how many in each, and where in it."""
    entry, used, first = [], {}, 0
    for b in bins:
        offset = 0
        for length, many in b.content:
            rank = used.get(length, 0)
            entry.append((length, rank, first, many, offset))
            used[length] = rank + many * b.count
            offset += many * length
        first += b.count
    entry.sort()
    columns = np.array(entry, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "bin", "many", "offset"), columns, strict=True))


# ---------------------------------------------------------------- packing


def pack(rows: DataFrame, capacity: int = CAPACITY, settings: tuple[tuple[int, int], ...] = SETTINGS) -> DataFrame:
    """rows (doc_id, piece, length, and what else they hold) with sequence_id and offset.

    Lengths are 1 to capacity. rows must give the same rows each time it is read (a written table). Sequences are
    numbered from 0; in each the pieces follow each other from offset 0 without gaps. Of an empty table the result is
    empty. Equal rows get a place each. Own columns named sequence_id and offset are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("sequence_id", "offset")
    # the ranks of a length are counted in shards, so that a length that many pieces have is no task of its own
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("__shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    counted = written(rows.groupBy("length", "__shard").agg(F.count("*").alias("__n")), spark)
    if counted.where(F.col("length").isNull() | ~F.col("length").between(1, capacity)).head():
        raise ValueError(f"lengths must be 1 to {capacity}")
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # capacity rows at most
    shared = spark.sparkContext.broadcast(places(plan_bins(counts, capacity, settings)))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__shard")) - F.col("__n")
    base = counted.select("length", "__shard", before.alias("__base"))
    order = [F.col(c) for c in rows.columns if c in ("doc_id", "piece", "start", "ids_crc32")]
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__shard").orderBy(*order)))
    ranked = ranked.join(base, ["length", "__shard"]).withColumn("__rank", F.col("__rank") - 1 + F.col("__base")).select(*columns(c for c in rows.columns if c != "__shard"), "__rank")
    plain = [c for c in ranked.columns if c != "__rank"]

    def place(batches):
        at = shared.value
        wide = 1 << 44
        keys = at["length"] * wide + at["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            e = np.searchsorted(keys, length * wide + rank, "right") - 1
            turn, slot = np.divmod(rank - at["rank"][e], at["many"][e])
            found = [pa.array(at["bin"][e] + turn), pa.array(at["offset"][e] + slot * length)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(plain))], *found], names=[*plain, "sequence_id", "offset"])

    return mapped(ranked, place, extended(ranked, "sequence_id bigint, offset bigint", plain))


def pack_documents(documents: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each document."""
    return pack(written(pieces(documents, public_tokenizers.path(VOCABULARY)), documents.sparkSession))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
