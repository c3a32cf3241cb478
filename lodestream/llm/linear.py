"""Hashed word and character n-grams, and logistic regression on them."""

from __future__ import annotations

import zlib

import numpy as np

from lodestream.llm.common import Words

#: Buckets of words, of word pairs, and of character 3- to 5-grams.
WORD_BUCKETS, PAIR_BUCKETS, CHAR_BUCKETS = 1 << 16, 1 << 16, 1 << 17
BUCKETS = WORD_BUCKETS + PAIR_BUCKETS + CHAR_BUCKETS
CHAR_SIZES = (3, 4, 5)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(vocab) -> np.ndarray:
    """32 bits for each word (bytes)."""
    return np.fromiter(map(zlib.crc32, vocab.to_pylist()), np.uint64, len(vocab))


def _mixed(code: np.ndarray, buckets: int) -> np.ndarray:
    return ((code * _ODD) >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def char_grams(vocab) -> tuple[np.ndarray, np.ndarray]:
    """For each character n-gram within a word, with a space at either end: the word's number and the bucket."""
    words = b"".join(b" %b " % w for w in vocab.to_pylist()).decode("utf-8", "replace")
    points = np.frombuffer(words.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    # words hold no space, so every second space ends a word
    of = (np.cumsum(points == 32) - 1) // 2
    word, bucket = [], []
    code = np.zeros(len(points), np.uint64)
    for k in range(max(CHAR_SIZES)):
        live = len(points) - k
        if live <= 0:
            break
        code = (code[:live] * np.uint64(0x100000001B3)) ^ points[k:]
        code ^= code >> np.uint64(29)
        if k + 1 in CHAR_SIZES:
            same = of[:live] == of[k:]
            word.append(of[:live][same])
            bucket.append(_mixed(code[same], CHAR_BUCKETS))
    return (np.concatenate(word), np.concatenate(bucket)) if word else (np.zeros(0, np.int64),) * 2


class Grams:
    """The hashed n-grams of a block: per word number a bucket, per word pair number a bucket, per word number its character n-grams."""

    def __init__(self, words: Words):
        hashes = word_hashes(words.vocab)
        self.words, self.word = words, (hashes & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
        first = np.arange(max(0, len(words.id) - 1))
        self.first = first[first + 2 <= words.last[words.doc[first]]]
        a, b = hashes[words.id[self.first]], hashes[words.id[self.first + 1]]
        self.pair = WORD_BUCKETS + _mixed(a * np.uint64(31) + b, PAIR_BUCKETS)
        self.char_of, char = char_grams(words.vocab)
        self.char = WORD_BUCKETS + PAIR_BUCKETS + char

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """For each text, the sum over the three kinds of the mean weight of its n-grams."""
        w, n = self.words, len(self.words.n)
        doc2 = w.doc[self.first]
        chars = np.bincount(self.char_of, minlength=len(w.vocab))
        char = np.bincount(self.char_of, weights=weights[self.char], minlength=len(w.vocab))
        mean = lambda doc, x, count: np.bincount(doc, weights=x, minlength=n) / np.maximum(1, count)
        return mean(w.doc, weights[self.word][w.id], w.n) + mean(doc2, weights[self.pair], np.bincount(doc2, minlength=n)) + mean(w.doc, char[w.id], np.bincount(w.doc, weights=chars[w.id], minlength=n))

    def rows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its buckets and the weight of each, such that logits() is their product with the weights."""
        w, out = self.words, []
        order = np.argsort(self.char_of, kind="stable")
        char, at = self.char[order], np.searchsorted(self.char_of[order], np.arange(len(w.vocab) + 1))
        pairs = np.searchsorted(self.first, np.append(w.lead, len(w.id)))
        for i, (lead, last) in enumerate(zip(w.lead, w.last, strict=True)):
            ids = w.id[lead:last]
            pair = self.pair[pairs[i] : np.searchsorted(self.first, last)]
            kinds, count = np.unique(ids, return_counts=True)
            sizes = at[kinds + 1] - at[kinds]
            chars = np.concatenate([char[at[k] : at[k + 1]] for k in kinds]) if len(kinds) else char[:0]
            total = max(1, int((sizes * count).sum()))
            buckets = np.concatenate([self.word[ids], pair, chars])
            values = np.concatenate([np.full(len(ids), 1 / max(1, len(ids))), np.full(len(pair), 1 / max(1, len(pair))), np.repeat(count, sizes) / total])
            kept, where = np.unique(buckets, return_inverse=True)
            out.append((kept, np.bincount(where, weights=values, minlength=len(kept))))
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def adam(gradient, params: list[np.ndarray], steps: int, rate: float) -> None:
    """Moves the parameters, in place, against the gradients that gradient() returns."""
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, m, v in zip(params, gradient(), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, steps: int = 120, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sparse rows, by full gradients."""
    size = np.array([len(b) for b, _ in rows])
    some, starts = size > 0, np.cumsum(size) - size
    values = np.concatenate([v for _, v in rows])
    used, column = np.unique(np.concatenate([b for b, _ in rows]), return_inverse=True)
    weights, bias = np.zeros(len(used)), np.zeros(1)

    def gradient():
        sums = np.zeros(len(rows))
        if some.any():
            sums[some] = np.add.reduceat(weights.take(column) * values, starts[some])
        off = (sigmoid(sums + bias[0]) - label) / len(rows)
        return [np.bincount(column, weights=values * np.repeat(off, size), minlength=len(used)) + decay * weights / len(rows), np.array([off.sum()])]

    adam(gradient, [weights, bias], steps, rate)
    full = np.zeros(BUCKETS)
    full[used] = weights
    return full, float(bias[0])


def fit_platt(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn logits into probabilities (Platt scaling with its smoothed targets)."""
    up, down = label.sum(), len(label) - label.sum()
    if not up or not down:
        return 1.0, 0.0
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    slope, offset = np.ones(1), np.zeros(1)

    def gradient():
        off = sigmoid(slope[0] * logit + offset[0]) - target
        return [np.array([(off * logit).mean()]), np.array([off.mean()])]

    adam(gradient, [slope, offset], 400, 0.05)
    return float(max(slope[0], 1e-3)), float(offset[0])
