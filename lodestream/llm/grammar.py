"""A run-length grammar of a sequence by recompression, and what it tells of common extensions.

Blocks of equal symbols and pairs of different ones are replaced by new symbols in turn (Jez 2016): the symbols are split
in two by a hash, and each pair of one from the first half and one from the second is replaced. As that looks at
neighbours only, equal stretches are replaced alike but for their ends. So two places are compared by climbing while the
symbols above agree and by descending where they don't, in about as many steps as there are levels (I 2017).
"""

from __future__ import annotations

import numpy as np

from lodestream.llm.common import numbered


class Grammar:
    """All levels of the grammar of a sequence, whose first and last value must occur once.

    A node is a symbol in its place on one level; the nodes of a level are in a row, those of the sequence first. Of each
    node: sym (on one level, equal for equal stretches), size (values below it), up (the node above, -1 at the top),
    low and high (the first and the last node below, -1 at the bottom) and block (whether what is below are equal
    symbols).
    """

    def __init__(self, values: np.ndarray):
        sym, size = values.astype(np.int64), np.ones(len(values), np.int64)
        syms, sizes, ups, lows, highs, blocks = [], [], [], [np.full(len(sym), -1)], [np.full(len(sym), -1)], [np.zeros(len(sym), bool)]
        fresh, base, level = int(sym.max(initial=0)) + 1, 0, 0
        while len(sym) > 1:
            level += 1
            begin, made, fresh = self._blocks(sym, fresh) if level % 2 else self._pairs(sym, fresh, level)
            if len(begin) == len(sym):  # nothing was replaced
                continue
            syms.append(sym)
            sizes.append(size)
            group = np.zeros(len(sym), np.int64)
            group[begin[1:]] = 1
            ups.append(base + len(sym) + np.cumsum(group))
            end = np.append(begin[1:], len(sym))
            lows.append(base + begin)
            highs.append(base + end - 1)
            blocks.append(np.full(len(begin), bool(level % 2)))
            base += len(sym)
            sym, size = made, np.add.reduceat(size, begin)
        syms.append(sym)
        sizes.append(size)
        ups.append(np.full(len(sym), -1))
        kind = np.int32 if base + len(sym) < 1 << 31 else np.int64
        together = lambda parts, kind: np.concatenate(parts).astype(kind)
        self.sym, self.size, self.up = together(syms, np.int64), together(sizes, kind), together(ups, kind)
        self.low, self.high, self.block = together(lows, kind), together(highs, kind), together(blocks, bool)

    @staticmethod
    def _blocks(sym: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Where the blocks of equal symbols begin, and the symbols for them; a block of one keeps its own."""
        begin = np.flatnonzero(np.append(True, sym[1:] != sym[:-1]))
        times = np.diff(np.append(begin, len(sym)))
        made, many = sym[begin], np.flatnonzero(times > 1)
        if len(many):
            code, kinds = numbered(made[many] * (int(times.max()) + 1) + times[many])
            made[many] = fresh + code
            fresh += len(kinds)
        return begin, made, fresh

    @staticmethod
    def _pairs(sym: np.ndarray, fresh: int, level: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Where the pairs and the other symbols begin, and the symbols for them."""
        side = (sym.astype(np.uint64) + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)
        side = (side ^ (side >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)
        step = side[:-1].astype(np.int8) - side[1:].astype(np.int8)
        first = np.flatnonzero(step == (1 if np.count_nonzero(step == 1) > np.count_nonzero(step == -1) else -1))
        if not len(first):
            return np.arange(len(sym)), sym, fresh
        short = numbered(sym)[0]
        code, kinds = numbered(short[first] * len(sym) + short[first + 1])
        made = sym.copy()
        made[first] = fresh + code
        begin = np.ones(len(sym), bool)
        begin[first + 1] = False
        begin = np.flatnonzero(begin)
        return begin, made[begin], fresh + len(kinds)

    def common(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How many values agree from the places a and b on (forward), or up to them (backward). a and b differ."""
        near, far, sign = (self.low, self.high, 1) if forward else (self.high, self.low, -1)
        total, rows = np.zeros(len(a), np.int64), np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(rows):
            over_a, over_b = self.up[a].astype(np.int64), self.up[b].astype(np.int64)
            inner = (over_a >= 0) & (over_b >= 0)
            climb = inner & (near[over_a] == a) & (near[over_b] == b) & (self.sym[over_a] == self.sym[over_b])
            same = ~climb & (self.sym[a] == self.sym[b])
            # within blocks, as many at once as both have left
            times = np.where(inner & self.block[over_a] & self.block[over_b], np.minimum((far[over_a] - a) * sign, (far[over_b] - b) * sign) + 1, 1)
            total[rows[same]] += (times * self.size[a])[same]
            down = ~climb & ~same & (near[a] >= 0)
            a, b = (np.where(climb, over, np.where(same, x + sign * times, np.where(down, near[x], x))) for over, x in ((over_a, a), (over_b, b)))
            going = climb | same | down
            if not going.all():
                rows, a, b = rows[going], a[going], b[going]
        return total
