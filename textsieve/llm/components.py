"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm.staging import Staged


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    return small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()


def components(edges: DataFrame, staged: Staged) -> DataFrame:
    """From edges (u, v) to (u, v): v is the least node of u's component; least nodes have no row of their own.

    Neighbours are reduced to their minimum before any shuffle of a hub, no node's neighbours are
    gathered, and each step is written, so the number of steps is logarithmic and lineage is short.
    """
    now = staged.put(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen, name, step = mark(now), "edges", 0
    while seen[0]:
        step += 1
        after = staged.put(_stars(now), f"step{step}")
        staged.drop(name)
        now, name, last = after, f"step{step}", seen
        seen = mark(now)
        if seen == last:
            break
    return now
