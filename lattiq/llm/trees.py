"""Decision trees fitted and applied with DataFrame operations.

Features are cut into a few bins at sample quantiles. Each level of a tree (of all trees of a forest at once) is one
aggregation of label sums by node, feature and bin, whose size is bounded by nodes x features x bins; only
these sums reach the driver, which picks the splits. The rows are a bounded sample, kept in one partition so
that a level needs no shuffle. A fitted tree is a column expression.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.llm._common import cut

#: Quantile bins of a feature.
BINS = 16


@dataclass
class Node:
    """A leaf with a value, or a split: rows with feature <= threshold go left."""

    value: float = 0.0
    feature: str | None = None
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def column(self) -> Column:
        """The value of the leaf that a row falls in."""
        if self.feature is None:
            return F.lit(float(self.value))
        return F.when(F.col(self.feature) <= self.threshold, self.left.column()).otherwise(self.right.column())

    def leaves(self, numbers: dict[int, Node]) -> Column:
        """The number of a row's leaf; numbers maps id(leaf) to it through ``numbers``."""
        if self.feature is None:
            number = len(numbers)
            numbers[number] = self
            return F.lit(number)
        return F.when(F.col(self.feature) <= self.threshold, self.left.leaves(numbers)).otherwise(self.right.leaves(numbers))


def thresholds(rows: DataFrame, features: list[str]) -> dict[str, list[float]]:
    """Bin edges of each feature from the quantiles of the sample."""
    cuts = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(f, cuts, 1000).alias(f) for f in features]).first()
    return {f: sorted({float(x) for x in found[f] or [] if x is not None}) for f in features}


def _bins(edges: dict[str, list[float]]) -> Column:
    """array of (f, bin): the number of edges below each feature's value."""
    each = []
    for k, (feature, own) in enumerate(edges.items()):
        number = reduce(lambda a, b: a + b, [(F.col(feature) > x).cast("int") for x in own], F.lit(0))
        each.append(F.struct(F.lit(k).alias("f"), number.alias("bin")))
    return F.array(*each)


def _sums(rows: DataFrame, edges: dict[str, list[float]]) -> dict[tuple[int, int], dict[int, dict[int, tuple[float, float]]]]:
    """{(tree, leaf): {feature: {bin: (a, b)}}} of rows(tree, leaf, a, b, features)."""
    binned = rows.select("tree", "leaf", "a", "b", F.explode(_bins(edges)).alias("x"))
    summed = binned.groupBy("tree", "leaf", "x.f", "x.bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found: dict = {}
    for r in summed.collect():
        found.setdefault((r.tree, r.leaf), {}).setdefault(r.f, {})[r.bin] = (r.a, r.b)
    return found


def _split(node: Node, by_feature: dict, edges: dict[str, list[float]], gain, value, least: float, allowed=None) -> bool:
    """Set the leaf's value, and split it where that gains most. by_feature has the (a, b) sums of its bins."""
    names = list(edges)
    first = next(iter(by_feature.values()))
    total = tuple(sum(x[j] for x in first.values()) for j in (0, 1))
    node.value = value(*total)
    best = (1e-9, None, None, None)
    for f, bins in sorted(by_feature.items()):
        if allowed is not None and f not in allowed:
            continue
        left = [0.0, 0.0]
        for k, edge in enumerate(edges[names[f]]):
            a, b = bins.get(k, (0.0, 0.0))
            left = [left[0] + a, left[1] + b]
            right = [total[0] - left[0], total[1] - left[1]]
            if min(left[1], right[1]) < least:
                continue
            won = gain(*left) + gain(*right) - gain(*total)
            if won > best[0]:
                best = (won, names[f], edge, (value(*left), value(*right)))
    if best[1] is None:
        return False
    node.feature, node.threshold = best[1], best[2]
    node.left, node.right = Node(best[3][0]), Node(best[3][1])
    return True


def boosted(rows: DataFrame, features: list[str], rounds: int = 8, depth: int = 3, rate: float = 0.4) -> list[Node]:
    """Gradient-boosted trees for rows(label, features): the log-odds are the sum of their values."""
    edges = thresholds(rows, features)
    held = cut(rows.select(F.col("label").cast("double").alias("label"), *features).groupBy("label", *features).agg(F.count("*").alias("n")).coalesce(1))
    n, positive = held.agg(F.sum("n"), F.sum(F.col("label") * F.col("n"))).first()
    if not n:
        return [Node(0.0)]
    share = min(max(positive / n, 1e-3), 1 - 1e-3)
    trees = [Node(math.log(share / (1 - share)))]
    if positive in (0, n):
        return trees
    gain = lambda g, h: g * g / (h + 1.0)
    value = lambda g, h: rate * g / (h + 1.0)
    for _ in range(rounds):
        chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-score(trees)))
        scored = held.withColumn("chance", chance)
        tree = Node()
        for _ in range(depth):
            leaves: dict[int, Node] = {}
            at = tree.leaves(leaves)
            each = scored.select(
                F.lit(0).alias("tree"),
                at.alias("leaf"),
                ((F.col("label") - F.col("chance")) * F.col("n")).alias("a"),
                (F.col("chance") * (1 - F.col("chance")) * F.col("n")).alias("b"),
                *features,
            )
            found = _sums(each, edges)
            if not any([_split(leaves[leaf], own, edges, gain, value, 1.0) for (_, leaf), own in sorted(found.items())]):
                break
        trees.append(tree)
    return trees


def forest(rows: DataFrame, features: list[str], trees: int = 12, depth: int = 5) -> list[Node]:
    """Random forest for rows(row, label, features): the chance of label 1 is the mean of the trees' values.

    Each tree sees each row as often as a Poisson draw from a hash says, and each split a random third or more of
    the features.
    """
    edges = thresholds(rows, features)
    drawn = F.pmod(F.xxhash64("row", "tree"), F.lit(10_000)) / 10_000
    times = F.when(drawn < 0.368, 0).when(drawn < 0.736, 1).when(drawn < 0.920, 2).when(drawn < 0.981, 3).otherwise(4)
    held = (
        rows.select("row", F.col("label").cast("double").alias("label"), *features)
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("n", times.cast("double"))
        .where("n > 0")
    )
    held = cut(held.coalesce(1))
    grown = [Node() for _ in range(trees)]
    gain = lambda a, b: a * a / b + (b - a) * (b - a) / b if b > 0 else 0.0
    value = lambda a, b: (a + 0.5) / (b + 1.0)
    for level in range(depth):
        numbers: list[dict[int, Node]] = [{} for _ in grown]
        at = F.element_at(F.array(*[t.leaves(own) for t, own in zip(grown, numbers)]), F.col("tree") + 1)
        each = held.select("tree", at.alias("leaf"), (F.col("label") * F.col("n")).alias("a"), F.col("n").alias("b"), *features)
        split = False
        for (t, leaf), own in sorted(_sums(each, edges).items()):
            order = sorted(range(len(features)), key=lambda f: hashlib.md5(f"{t} {level} {leaf} {f}".encode()).digest())
            split |= _split(numbers[t][leaf], own, edges, gain, value, 2.0, set(order[: max(2, (len(features) + 2) // 3)]))
        if not split:
            break
    return grown


def score(trees: list[Node]) -> Column:
    """The sum of the trees' values."""
    return reduce(lambda a, b: a + b, [t.column() for t in trees])
