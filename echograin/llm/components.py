"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: (u, v) with u > v. Large: each node's larger neighbours move to its smallest one; small: the smaller ones do, with the node."""
    sides = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    least = shared.written(sides.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "star-least")
    joined = shared.join_groups(sides, least, ["u"], "n", "inner")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return shared.written(moved.where("u <> v").distinct(), "star-pairs", pairs, least)


def _settled(pairs: DataFrame) -> bool:
    """Whether pairs are stars: each u has one v, which is no u. Then the v are the roots."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(pairs.select(F.col("v").alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = ends.groupBy("x").agg(F.sum("a").alias("a"), F.max("b").alias("b"))
    most, both = each.agg(F.max("a"), F.max((F.col("a") > 0) & (F.col("b") > 0))).first()
    return not most or (most == 1 and not both)


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (a, b): root is the smallest node of its component.

    Each step's result is written to the shared folder and the one before deleted. Nodes with a large share of the
    edges are joined by broadcast. Edges may repeat and point either way; a = b and nulls are left out; without edges there are no rows.
    """
    pairs = shared.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star-pairs")
    for _ in range(most_rounds):
        if _settled(pairs):
            break
        pairs = _star(_star(pairs, True), False)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
