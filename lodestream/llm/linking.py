"""Groups of nodes that are linked, from keys that linked nodes share; and links by the similarity of sets of shingles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import small, written
from lodestream.llm.components import components

#: Nodes of one key from which on it is crowded, and is split where it can be.
CROWD = 1 << 12
#: Keys whose choices differ by a multiple of this pick their heads alike, so that a node meets the same ones again.
STARS = 4


def groups(
    keys: DataFrame,
    key: list[str],
    near: Callable[..., Column],
    verified: Callable[[DataFrame], DataFrame] | None = None,
    marks: DataFrame | None = None,
    shared: Callable[[Column, Column, int], Column] | None = None,
    split: Callable[[Column, Column], Column] | None = None,
    choices: int = 0,
) -> DataFrame:
    """node, root: for each node with a link the smallest node that it is connected with.

    keys has a row (node and the key columns, of which the first is the choice, the number of the key) for each key of
    each node, marks the column ``mark`` for each node (None: the node itself). Nodes of one key are linked if
    near(mark, mark, choice) holds and verified(), on pairs (a, b), returns them. In each key first all nodes are held
    against two of them, the heads, picked by a hash, so that edges form stars. Most nodes of a dense group are then
    connected, and pairs among those needn't be looked at: only nodes that are not connected with the first head of a
    key are held against the others of the key. So a group of k near copies makes some k pairs, not k * k, and no link is
    lost that would connect anything.

    shared(mark, mark, i) tells whether two nodes share the key of choice i, of so many choices: with it two nodes that
    are not connected with a head meet once rather than in each key that they share. split(mark, choice) lists further
    keys for a node: in keys of more than CROWD nodes, two nodes that are not connected with the head are held against
    each other where one of those is equal too. The caller sees to it that linked nodes have one in common.
    """
    spark = keys.sparkSession
    verified = verified or (lambda pairs: pairs)
    order = F.xxhash64("node", F.col(key[0]) % STARS)
    heads = keys.groupBy(*key).agg(F.min_by("node", order).alias("head"), F.max_by("node", order).alias("second"), F.count("*").alias("n"))
    heads = written(heads.where("n > 1").withColumn("crowd", (F.col("n") > CROWD) & F.lit(split is not None)).drop("n"), spark)
    met = written(keys.join(small(heads), key), spark)
    choice = F.col(key[0])

    def marked(df: DataFrame, node: str, mark: str) -> DataFrame:
        if marks is None:
            return df.withColumn(mark, F.col(node))
        return df.join(small(some.select(F.col("node").alias(node), F.col("mark").alias(mark)), F.lit(8)), node)

    if marks is not None:
        some = written(marks.join(small(written(met.select("node").distinct(), spark)), "node"), spark)
    ways = [F.struct(F.least(h, "node").alias("a"), F.greatest(h, "node").alias("b")) for h in ("head", "second")]
    by = [choice] if marks is None else []
    met_heads = met.select(*by, F.explode(F.array(*ways)).alias("x")).select(*by, "x.*").where("a <> b").distinct()
    star = marked(marked(met_heads, "a", "a_mark"), "b", "b_mark").where(near(F.col("a_mark"), F.col("b_mark"), choice)).select("a", "b").distinct()
    roots = written(components(verified(star)), spark)

    def root_of(df: DataFrame, name: str, root: str) -> DataFrame:
        own = small(roots.select(F.col("node").alias("__node"), F.col("root").alias("__root")))
        return df.join(own, F.col(name) == F.col("__node"), "left").withColumn(root, F.coalesce("__root", name)).drop("__node", "__root")

    rooted = root_of(root_of(met.select(*key, "node", "head", "crowd"), "node", "root"), "head", "head_root").withColumn("foreign", F.col("root") != F.col("head_root"))
    # of the keys in which all are connected nothing is left to do
    open_ = written(rooted.where("foreign").groupBy(*key).agg(F.max("crowd").alias("__any")), spark)
    if not open_.head():
        return roots
    rooted = rooted.join(small(open_.select(*key)), key).where("foreign OR node <> head")
    if open_.where("__any").head():
        busy = written(rooted.where("crowd").groupBy("node").agg(F.collect_set(choice).alias("busy")).withColumnRenamed("node", "__busy"), spark)
        rooted = rooted.join(small(busy), F.col("node") == F.col("__busy"), "left").drop("__busy")
        rooted = written(marked(rooted, "node", "mark"), spark)
        part = F.when(F.col("crowd"), split(F.col("mark"), choice)).otherwise(F.array(F.lit(0).cast("long")))
        rooted = rooted.withColumn("part", F.explode(part))
    else:
        rooted = written(marked(rooted.withColumn("busy", F.lit(None).cast("array<int>")), "node", "mark"), spark).withColumn("part", F.lit(0).cast("long"))
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in (*key, "part", "node", "mark", "root", "foreign", "crowd", "busy")])
    left, right = side(rooted.where("foreign"), "f"), side(rooted, "m")
    same = reduce(and_, (F.col(f"f_{c}") == F.col(f"m_{c}") for c in (*key, "part")))
    # two foreign nodes meet twice, and count in order
    once = ~F.col("m_foreign") | (F.col("f_node") < F.col("m_node"))
    meet = same & (F.col("f_root") != F.col("m_root")) & once & near(F.col("f_mark"), F.col("m_mark"), F.col(f"f_{key[0]}"))
    if shared:  # the first key that both have counts, unless it is crowded
        own, busy = F.col(f"f_{key[0]}"), F.coalesce("f_busy", F.array().cast("array<int>"))
        before = (((own <= i) | F.array_contains(busy, i) | ~shared(F.col("f_mark"), F.col("m_mark"), i)) for i in range(choices))
        meet &= F.col("f_crowd") | reduce(and_, before)
    pairs = left.join(right, meet).select(F.least("f_node", "m_node").alias("a"), F.greatest("f_node", "m_node").alias("b"))
    found = verified(written(pairs.distinct(), spark))
    above = root_of(root_of(found, "a", "x"), "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    above = written(components(above), spark).select(F.col("node").alias("__from"), F.col("root").alias("__to"))
    lifted = roots.join(small(above), F.col("root") == F.col("__from"), "left").select("node", F.coalesce("__to", "root").alias("root"))
    alone = above.join(roots, F.col("__from") == F.col("node"), "left_anti").select(F.col("__from").alias("node"), F.col("__to").alias("root"))
    return written(lifted.union(alone), spark)


# ---------------------------------------------------------------- sets of shingles

#: Bits of the parity sketch of a set, and of that of an eighth of it.
PARITY, SAMPLED, RATE = 1024, 512, 8
#: Standard deviations that the eighth may be off.
DEVIATIONS = 7


def distinct_sets(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the distinct hashes, ascending, and where those of each text begin and end."""
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))[: len(hashes)]
    return hashes[new], np.append(0, np.cumsum(np.bincount(doc[new], minlength=len(edges) - 1)))


def mixed(x: np.ndarray) -> np.ndarray:
    """Other 64-bit hashes of these."""
    for by, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def preferences(bins: int) -> np.ndarray:
    """For each bin the others in the order in which it asks them when it is empty: the same for all texts."""
    turn = np.arange(bins, dtype=np.uint64)
    return np.argsort(mixed(turn[:, None] * np.uint64(bins) + turn[None, :] + np.uint64(1)), axis=1)


def minima(hashes: np.ndarray, edges: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation hashing: of each text the smallest hash in each of so many bins of its distinct hashes (ascending).

    An empty bin takes that of the first bin in its order that isn't empty (optimal densification, Shrivastava 2017), so
    that two texts agree in it with the probability of their similarity, whatever happens in others. Without hashes all
    are 0.
    """
    n = len(edges) - 1
    slot = np.repeat(np.arange(n), np.diff(edges)) * bins + ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])[: len(slot)])
    low, full = np.zeros(n * bins, np.uint64), np.zeros(n * bins, bool)
    low[slot[begin]], full[slot[begin]] = hashes[begin], True
    some = np.repeat(np.diff(edges) > 0, bins)
    empty, asks = np.flatnonzero(~full & some), preferences(bins)
    for turn in range(bins):
        if not len(empty):
            break
        donor = empty // bins * bins + asks[empty % bins, turn]
        hit = full[donor]
        low[empty[hit]] = low[donor[hit]]
        empty = empty[~hit]
    return low.reshape(n, bins)


def combined(low: np.ndarray, start: int) -> np.ndarray:
    """One hash of each row of minima and of a number."""
    key = np.full(len(low), start + 1, np.uint64)
    for column in low.T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ column)
    return key


def parities(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each text, as longs: whether an odd number of its distinct hashes falls on each of PARITY places; and the same
    for an eighth of them, on SAMPLED places."""
    n = len(edges) - 1
    doc, own = np.repeat(np.arange(n), np.diff(edges)), mixed(hashes)
    take = (own >> np.uint64(32)) % np.uint64(RATE) == 0
    out = []
    for doc_, place, bits in ((doc, own % np.uint64(PARITY), PARITY), (doc[take], (own[take] >> np.uint64(40)) % np.uint64(SAMPLED), SAMPLED)):
        odd = np.bincount(doc_ * bits + place.astype(np.int64), minlength=n * bits) & 1
        out.append(np.packbits(odd.astype(bool).reshape(n, bits), axis=1).view(np.int64))
    return np.concatenate(out, axis=1)


PARITY_FIELDS = [f"p{k}" for k in range((PARITY + SAMPLED) // 64)]


def alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether sizes (n) and parities allow the similarity.

    A place that differs stands for a hash that one of the sets lacks, so there are as many such hashes at least: this
    excludes no pair of that similarity. That of the eighth does with a probability below 10^-9.
    """
    most = (a["n"] + b["n"]) * ((1 - similarity) / (1 + similarity)) + 1e-6
    counts = lambda fields: sum((F.bit_count(a[f].bitwiseXOR(b[f])) for f in fields[1:]), F.bit_count(a[fields[0]].bitwiseXOR(b[fields[0]])))
    eighth = most / RATE
    sizes = F.least(a["n"], b["n"]) >= F.greatest(a["n"], b["n"]) * similarity - 1e-6
    return sizes & (counts(PARITY_FIELDS[: PARITY // 64]) <= most) & (counts(PARITY_FIELDS[PARITY // 64 :]) <= eighth + DEVIATIONS * F.sqrt(eighth) + DEVIATIONS)


def similar_enough(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) whose sets (node, shingles) have the Jaccard similarity, exactly (two empty sets: 1).

    One of the sets moves with each pair, the other once for each node. As candidates differ in size by a fifth at most, it
    doesn't matter which; what keeps this small is that stars make few pairs.
    """
    side = lambda name, out: sets.select(F.col("node").alias(name), F.col("shingles").alias(out))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y")).cast("bigint")
    share = F.lit(round(least * 10**6)).cast("bigint")  # in whole numbers, as 0.8 is no double
    return both.where(common * F.lit(10**6) >= share * (F.size("x") + F.size("y") - common)).select("a", "b")
