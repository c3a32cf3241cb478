"""Byte-level BPE through a sentencepiece model that is serialised from the ranks themselves."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import Memory, blocks, bound_batches, extended, mapped, table, texts_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Byte b is written as the character FIRST + b, which no normalisation or white-space rule touches.
FIRST = 0x4E00
#: Bytes of pre-tokens, and of pieces of text, that a worker remembers with their ids.
CACHE_BYTES = 192 << 20
#: Marks the piece at the start of a text.
HEAD = "\0"

#: White space as Unicode defines it; the library's \s has four control characters more.
_SPACE = r"\t-\r \x85\xa0  -     　"


def pre_token_pattern(pattern: str = public_tokenizers.PATTERN):
    """The pattern, with \\s and \\S as Unicode's White_Space."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol buffer field: bytes, varint, or float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def characters(token: bytes) -> str:
    return "".join(chr(FIRST + b) for b in token)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece 0 is unknown, piece rank + 1 is the token, scored by its negative rank."""
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("the ranks aren't 0, 1, 2 ...")
    normal, unknown = 1, 2
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)]
    pieces += [_field(1, characters(token).encode()) + _field(2, float(-rank)) + _field(3, normal) for token, rank in by_rank]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes as the ranks say; remembers short pieces of text and pre-tokens in bounded memory.

    A pre-token holds a space only as its first character, or within a run of white space. So a text may be cut at
    each space that stands between two characters that are none, and the pieces be matched and remembered one by one.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.tokens = ranks, [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.find, self.runs = pre_token_pattern(pattern).findall, re.compile(r"\s (?:\s|\Z)").search
        self.cuts = re.compile(r"(?<=\S) (?=\S)").split
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.table = {b: chr(FIRST + b) for b in range(256)}
        self.known, self.pieces = Memory(CACHE_BYTES), Memory(CACHE_BYTES)  # ids as 32-bit integers

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text: each pre-token is a token of the vocabulary, or what the merges make of it."""
        cut = [self._cut(text) for text in texts]
        kinds = list(set(chain.from_iterable(cut)))
        ids = dict(zip(kinds, self.pieces.lookup(kinds, self._matched), strict=True)).__getitem__
        return [np.frombuffer(b"".join(map(ids, pieces)), np.int32) for pieces in cut]

    def _cut(self, text: str) -> list[str]:
        """Pieces that stand behind a space which they leave out; HEAD marks one that stands at the start of the text."""
        text = HEAD + text
        if self.runs(text) or HEAD in text[1:]:
            first, *rest = self.cuts(text)
            # what begins with HEAD itself stays with the piece before it
            out = [first]
            for piece in rest:
                if piece[0] == HEAD:
                    out[-1] += " " + piece
                else:
                    out.append(piece)
            return out
        return text.split(" ")

    def _matched(self, pieces: list[str]) -> list[bytes]:
        found = [self.find(piece[1:] if piece[:1] == HEAD else " " + piece) for piece in pieces]
        kinds = list(set(chain.from_iterable(found)))
        ids = dict(zip(kinds, self.known.lookup(kinds, self._merged), strict=True)).__getitem__
        return [b"".join(map(ids, tokens)) for tokens in found]

    def _merged(self, tokens: list[str]) -> list[bytes]:
        out = {}
        merge = []
        for token in tokens:
            rank = self.ranks.get(token.encode())
            if rank is None:
                merge.append(token)
            else:
                out[token] = struct.pack("=i", rank)
        for token, ids in zip(merge, self.model.encode([t.encode().decode("latin-1").translate(self.table) for t in merge], num_threads=1), strict=True):
            out[token] = struct.pack(f"={len(ids)}i", *[i - 1 for i in ids])
        return [out[token] for token in tokens]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a rank file, made once in each worker."""
    with open(path, "rb") as lines:
        return Codec({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


def encode(documents: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """documents with n_tokens, ids_sha256, decoded_sha256, and the ids themselves if wanted.

    The ids are decoded again for the last digest. A null text counts as empty: no ids. Rows are encoded one by one, so
    repeated rows and other columns change nothing; own columns of these names are replaced. The rank file must be at
    ``path`` on every machine.
    """
    added = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if ids else {})
    bound_batches(documents.sparkSession)
    documents = documents.drop(*added)

    def run(batches):
        own = codec(path)
        texts_as = [str(i) for i in range(len(own.tokens))]
        for batch in batches:
            for part in blocks(batch, "text"):
                counts, digests, decoded, kept = [], [], [], []
                for got in map(np.ndarray.tolist, own.encode(texts_of(part.column("text")).to_pylist())):
                    counts.append(len(got))
                    digests.append(hashlib.sha256(",".join(map(texts_as.__getitem__, got)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(got)).hexdigest())
                    if ids:
                        kept.append(got)
                columns = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), *([pa.array(kept, pa.list_(pa.int32()))] if ids else [])]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *added])

    return mapped(documents, run, extended(documents, ", ".join(f"{k} {v}" for k, v in added.items())))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with the column bytes: what its ids stand for (null ids: null)."""
    encoded = encoded.drop("bytes")

    def run(batches):
        own = codec(path)
        for batch in batches:
            got = [None if x is None else own.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*batch.schema.names, "bytes"])

    return mapped(encoded, run, extended(encoded, "bytes binary"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(documents, public_tokenizers.path(VOCABULARY), ids=False).select("doc_id", "n_tokens", F.col("ids_sha256"), F.col("decoded_sha256"))
