"""Links between members of buckets: comparison within a bucket, and buckets of any size.

A bucket of more than BLOCK members is dealt into blocks, which are compared each in its
own task; then come those of every two blocks that links don't connect by then.  No pair is
left out, and a task never has more than two blocks of one bucket.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm.staging import partitions
from textsieve.llm.textbytes import spans

BLOCK, MIXES = 2048, 3
#: Bytes that a task gathers, about.
TASK_BYTES = 24 << 20
#: Pairs that are looked at together, about.
PAIRS = 1 << 20
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


class Forest:
    """Sets that are united by links; remembers the links that united two."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def unite(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[a] = b
            self.links.append((x, y))


def unite_groups(cut: np.ndarray, forest: Forest, near: Callable[[np.ndarray, np.ndarray], Pairs], alike: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Unites members cut[g] to cut[g + 1] - 1 of each group g that are alike.

    near: of pairs, those worth comparing and how likely they are alike.  alike: whether pairs are.
    Groups are taken together as far as PAIRS allows; the likeliest pairs go first, and those that
    links connect by then are left out.
    """
    size = np.diff(cut)
    groups = np.argsort(size, kind="stable")
    groups = groups[size[groups] > 1]
    wave = np.cumsum(size[groups] * (size[groups] - 1) // 2) // PAIRS
    for w in np.unique(wave):
        mine = groups[wave == w]
        first, n = cut[mine], size[mine]
        found = []
        for d in range(1, int(n.max())):  # members d places apart
            on = np.searchsorted(n, d, "right")  # groups with more than d members; sizes ascend
            i = spans(first[on:], n[on:] - d)
            found.append(near(i, i + d))
        x, y, share = (np.concatenate(v) for v in zip(*found))
        likely = np.argsort(-share, kind="stable")
        x, y = x[likely], y[likely]
        step = max(512, int(n.sum()))  # links that may be needed
        while len(x):
            ok = alike(x[:step], y[:step])
            for i, j in zip(x[:step][ok].tolist(), y[:step][ok].tolist()):
                forest.unite(i, j)
            x, y = x[step:], y[step:]
            used, back = np.unique(np.concatenate([x, y]), return_inverse=True)
            now = np.array([forest.find(i) for i in used.tolist()], np.int64)[back]
            apart = now[: len(x)] != now[len(x) :]
            x, y, step = x[apart], y[apart], min(2 * step, 1 << 16)


def dealt(met: DataFrame) -> DataFrame:
    """(key, b, ...) with the size n of its bucket, and its block there.

    Large buckets are dealt out MIXES times in different ways, so that the links of one deal connect
    the blocks of another and few are left to be compared with one another.
    """
    size = met.groupBy("key").agg(F.count("*").alias("n"))
    mixed = met.join(size, "key").withColumn("mix", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > BLOCK, MIXES - 1).otherwise(0))))
    return mixed.withColumn("block", (F.pmod(F.xxhash64("b", "key", "mix"), F.ceil(F.col("n") / BLOCK)) * MIXES + F.col("mix")).cast("int"))


def across(met: DataFrame, roots: DataFrame, *keep: str) -> DataFrame:
    """From dealt members those of every two blocks of a bucket that links don't connect already.

    Two blocks are number `block`, a member's own is its `side`, and `root` is what links connect it to.
    """
    cut = met.where((F.col("n") > BLOCK) & (F.col("mix") == 0)).join(roots, F.col("b") == F.col("u"), "left").select("key", "b", "block", F.coalesce("v", "b").alias("root"), *keep)
    ends = cut.groupBy("key", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    i, j = (ends.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("block", "low", "high"))) for k in "ij")
    two = i.join(j, "key").where("block_i < block_j AND NOT (low_i = high_i AND low_j = high_j AND low_i = low_j)")
    two = two.select("key", F.hash("block_i", "block_j").alias("pair"), F.explode(F.array("block_i", "block_j")).alias("side"))
    return cut.withColumnRenamed("block", "side").join(two, ["key", "side"]).withColumnRenamed("pair", "block")


class Sides:
    """Members of two blocks: of one root are connected, and pairs within a block are left out."""

    def __init__(self, forest: Forest, own: np.ndarray, side: np.ndarray, root: np.ndarray):
        first: dict[tuple[int, int], int] = {}
        forest.up = [first.setdefault(pair, i) for i, pair in enumerate(zip(own.tolist(), root.tolist()))]
        self.side, self.root = side, np.array(forest.up, np.int64)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (self.side[x] != self.side[y]) & (self.root[x] != self.root[y])


def tasks(df: DataFrame, rows: int, bytes_of_row: float) -> int:
    """Partitions for so many rows, that grow with them."""
    return max(partitions(df.sparkSession), int(rows * bytes_of_row / TASK_BYTES) + 1)
