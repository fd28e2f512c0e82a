"""Radius search in dense clouds: grid cells that are halved where many points meet, until cells or few points decide.

points.within() compares points cell by cell, which takes the product of two dense cells' points. Here a pair of cells whose points would be more
than PAIRS comparisons is cut into halves along each axis instead. Of two cells the least and the largest distance of
any two points are known: cells farther apart than the radius are dropped, and where one of the other side's is nearer for
certain, all points of a cell are settled without comparing any. What stays undecided lies in a thin shell around the radius.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import points as G

#: Comparisons of the points of one cell at most; beyond that the cell is cut.
PAIRS = 1 << 20
#: Halvings at most: then a cell is no longer than the radius over 2**40, far less than coordinates' rounding.
LEVELS = 40
#: Share of the radius by which the distances of cells may be off through rounding.
SLACK = 1e-9

_P = ["p0", "p1", "p2"]
_L, _R = ["l0", "l1", "l2"], ["r0", "r1", "r2"]


def within_refined(left: DataFrame, right: DataFrame, radius: float, keys: list[str], to: str, how: str = "left_semi") -> DataFrame:
    """points.within() for clouds of any density: rows of left that have a point of right at most `radius` away, or with how="left_anti" those that have none.

    Tables of each round are written to new folders below `to`, which all executors see, and are read again. Rounds go on until no
    cell has more than PAIRS comparisons; each works on the cells that were too full in the one before only.

    Defined results: as within(); rows with a null coordinate or key are near to nothing; repeated rows of left are kept as often as they occur;
    other columns, of any name, are carried.
    """
    if how not in ("left_semi", "left_anti"):
        raise ValueError(f"how: {how}")
    xyz = ["pos_x", "pos_y", "pos_z"]
    if radius == 0:
        return left.join(right.select(*keys, *xyz).distinct(), [*keys, *xyz], how)
    folder = f"{to.rstrip('/')}/radius-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    ks = [f"k{i}" for i in range(len(keys))]
    places = lambda df: df.select(*[F.col(c).alias(n) for c, n in zip([*keys, *xyz], [*ks, *_P], strict=True)]).dropna().distinct()
    near = _near(written(places(left), "left"), written(places(right), "right"), radius, ks, written)
    near = near.select(*[F.col(n).alias(c) for c, n in zip([*keys, *xyz], [*ks, *_P], strict=True)])
    return left.join(near, [*keys, *xyz], how).select(*[f"`{c}`" for c in left.columns])


def _cells(names: list[str], radius: float, level: int) -> list[Column]:
    """The cell of a point at a level. Sides are the radius over a power of two, so halves lie in their cell exactly."""
    return [F.floor(F.col(p) / F.lit(radius / 2**level)).alias(n) for p, n in zip(_P, names, strict=True)]


def _near(left: DataFrame, right: DataFrame, radius: float, ks: list[str], written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Places of left (keys, p0 to p2) with one of right within the radius."""
    lc, rc = [*ks, *_L], [*ks, *_R]
    step = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    around = left.select(*ks, *_cells(_L, radius, 0)).distinct()
    for a, b in zip(_L, _R, strict=True):
        around = around.withColumn("_s", step).withColumn(b, F.col(a) + F.col("_s")).drop("_s")
    pairs = around.join(right.select(*ks, *_cells(_R, radius, 0)).distinct(), rc, "left_semi")
    parts = []
    for level in range(LEVELS + 1):
        left, right = (df.select(*ks, *_P, *_cells(names, radius, level)) for df, names in ((left, _L), (right, _R)))
        pairs = pairs.join(right.groupBy(*rc).agg(F.count(F.lit(1)).alias("nr")), rc)
        cost = pairs.groupBy(*lc).agg(F.sum("nr").alias("nr")).join(left.groupBy(*lc).agg(F.count(F.lit(1)).alias("nl")), lc)
        heavy = (F.col("nr").cast("double") * F.col("nl") > PAIRS) & F.lit(level < LEVELS)
        cost = cost.select(*lc, heavy.alias("heavy"))
        pairs = written(pairs.drop("nr").join(cost, lc), f"pairs-{level}")
        light = pairs.where("NOT heavy").drop("heavy")
        other = right.select(*rc, *[F.col(p).alias(f"q{i}") for i, p in enumerate(_P)])
        square = sum(((F.col(p) - F.col(f"q{i}")) ** 2 for i, p in enumerate(_P)), F.lit(0.0))
        met = left.join(light, lc).join(other, rc).where(square <= radius * radius)
        parts.append(met.select(*ks, *_P))
        full = pairs.where("heavy").drop("heavy")
        if full.isEmpty():
            break
        left = written(left.join(full.select(*lc).distinct(), lc, "left_semi").select(*ks, *_P), f"left-{level}")
        right = written(right.join(full.select(*rc).distinct(), rc, "left_semi").select(*ks, *_P), f"right-{level}")
        pairs, settled = _halved(full, left, right, radius, level + 1, ks, written)
        parts.append(left.select(*ks, *_P, *_cells(_L, radius, level + 1)).join(settled, lc, "left_semi").select(*ks, *_P))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.distinct()


def _halved(full: DataFrame, left: DataFrame, right: DataFrame, radius: float, level: int, ks: list[str], written: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Pairs of the next level's cells that may be within the radius, and those of left that are for certain, of pairs of this level."""
    lc, rc, side = [*ks, *_L], [*ks, *_R], radius / 2**level
    children = lambda df, names: df.select(*ks, *_cells([f"c{n}" for n in names], radius, level)).distinct().select("*", *[F.floor(F.col(f"c{n}") / 2).alias(n) for n in names])
    joined = full.join(children(left, _L), lc).join(children(right, _R), rc)
    apart = [F.abs(F.col(f"c{a}") - F.col(f"c{b}")) for a, b in zip(_L, _R, strict=True)]
    least = sum((F.greatest(d - 1, F.lit(0)) ** 2 for d in apart), F.lit(0.0)) * side**2
    most = sum(((d + 1) ** 2 for d in apart), F.lit(0.0)) * side**2
    joined = joined.select(*ks, *[F.col(f"c{n}").alias(n) for n in (*_L, *_R)], (most <= (radius * (1 - SLACK)) ** 2).alias("sure"), (least <= (radius * (1 + SLACK)) ** 2).alias("may"))
    joined = written(joined.where("may").drop("may"), f"halves-{level}")
    settled = written(joined.where("sure").select(*lc).distinct(), f"settled-{level}")
    return joined.drop("sure").join(settled, lc, "left_anti"), settled


def without_ghost_neighbours_refined(points: DataFrame, radius: float, keys: list[str], to: str) -> DataFrame:
    """points.without_ghost_neighbours() for clouds of any density."""
    if radius <= 0:
        return points
    return within_refined(points, points.where(F.col("label") == G.C.GHOST), radius, keys, to, "left_anti")
