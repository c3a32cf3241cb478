"""Counts over whole texts that quality rules and classifiers use, for a block of texts at a time."""

from __future__ import annotations

import numpy as np

from lodestream.llm.common import Words, numbered, strings

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(words.n)
    heads = (words.data & 0xC0) != 0x80  # the first byte of each code point
    return {
        "n_words": words.n.astype(np.int64),
        "word_chars": words.per_doc(heads & words.inside),
        "n_symbols": words.per_doc(_SYMBOLS[words.data]),
        "n_dup_lines": _dup_lines(words, n),
        "n_repeat_words": _repeat_words(words, n),
    }


def lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of each line between \\n, in order."""
    n, feed = len(words.n), np.flatnonzero(words.data == 10)
    doc, wide = np.searchsorted(words.offsets, feed, "right") - 1, len(words.data) + 2
    starts = np.sort(np.concatenate([np.arange(n) * wide + words.offsets[:-1], doc * wide + feed + 1]))
    ends = np.sort(np.concatenate([np.arange(n) * wide + words.offsets[1:], doc * wide + feed]))
    return starts // wide, starts % wide, ends % wide


def _dup_lines(words: Words, n: int) -> np.ndarray:
    doc, starts, ends = lines(words)
    full = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    line, kinds = numbered(strings(words.data[words.data != 10], ends - starts))
    doc, line = doc[full], line[full]
    _, distinct = numbered(doc * max(1, len(kinds)) + line)
    return np.bincount(doc, minlength=n) - np.bincount(np.asarray(distinct) // max(1, len(kinds)), minlength=n)


def _repeat_words(words: Words, n: int) -> np.ndarray:
    first, code, count = words.grams(3)
    doc = words.doc[first]
    key, kinds = numbered(doc * max(1, count) + code)
    again = first[np.bincount(key, minlength=len(kinds))[key] > 1] if len(key) else first
    covered = np.zeros(len(words.id), bool)
    for k in range(3):
        covered[again + k] = True
    return np.bincount(words.doc[covered], minlength=n)
