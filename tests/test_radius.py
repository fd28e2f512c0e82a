"""Radius search by cells that refine, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograin.operators import points, radius

SCHEMA = "cloud_id string, p0 string, pos_x double, pos_y double, pos_z double"


def rows(spark, cloud, xyz, more=()):
    return spark.createDataFrame([(cloud, "mine", *map(float, p)) for p in xyz] + list(more), SCHEMA)


def near(a, b, r):
    return {tuple(p) for p in a if len(b) and (((b - p) ** 2).sum(axis=1) <= r * r).any()}


@pytest.mark.parametrize("pairs", [1 << 20, 50, 1])
def test_equals_all_pairs(spark, tmp_path, monkeypatch, pairs):
    monkeypatch.setattr(radius, "PAIRS", pairs)
    rng = np.random.default_rng(pairs)
    a, b = rng.uniform(-1, 1, (300, 3)), rng.uniform(-1, 1, (200, 3))
    left, right = rows(spark, "c", a), rows(spark, "c", b, [("other", "", *map(float, a[0])), ("c", "", None, 0.0, 0.0)])
    for r in (0.05, 0.3) if pairs > 1 else (0.3,):
        want = near(a, b, r)
        got = radius.within_refined(left, right, r, ["cloud_id"], str(tmp_path))
        assert got.columns == left.columns and {(x.pos_x, x.pos_y, x.pos_z) for x in got.collect()} == want
        rest = radius.within_refined(left, right, r, ["cloud_id"], str(tmp_path), "left_anti").collect()
        assert {(x.pos_x, x.pos_y, x.pos_z) for x in rest} == {tuple(p) for p in a} - want


def test_distances_of_just_the_radius_and_repeats(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(radius, "PAIRS", 1)
    a = np.array([[0, 0, 0], [0, 0, 0], [3, 0, 0], [0.5, 0.5, 0.5], [-0.25, 0, 0]])
    b = np.array([[1, 0, 0], [4.5, 0, 0], [-1.25, 0, 0]])
    left = rows(spark, "c", a, [("c", "no place", None, 1.0, 1.0), (None, "no cloud", 1.0, 0.0, 0.0)])
    got = radius.within_refined(left, rows(spark, "c", b), 1.0, ["cloud_id"], str(tmp_path)).collect()
    assert sorted((x.pos_x, x.pos_y) for x in got) == sorted((p[0], p[1]) for p in map(tuple, a) if tuple(p) in near(a, b, 1.0))
    rest = radius.within_refined(left, rows(spark, "c", b), 1.0, ["cloud_id"], str(tmp_path), "left_anti").collect()
    assert {x.p0 for x in rest} == {"mine", "no place", "no cloud"} and len(rest) == 7 - len(got)
    assert radius.within_refined(left, left, 0, ["cloud_id"], str(tmp_path)).count() == 5


def test_dense_clouds_around_the_radius(spark, tmp_path):
    """Two cells of 50,000 points each whose distances lie just under and over the radius: 2,500 million pairs, of which few are compared."""
    rng = np.random.default_rng(7)
    n, r = 50_000, 1.0
    a, b = rng.uniform(0, 0.02, (n, 3)), rng.uniform(0, 0.02, (n, 3)) + [1.01, 0, 0]
    left, right = rows(spark, "c", a), rows(spark, "c", b)
    got = {(x.pos_x, x.pos_y, x.pos_z) for x in radius.within_refined(left, right, r, ["cloud_id"], str(tmp_path)).collect()}
    for p in a[rng.integers(0, n, 400)]:  # by all pairs, for some
        assert (tuple(p) in got) == bool((((b - p) ** 2).sum(axis=1) <= r * r).any())
    assert 0.3 * n < len(got) < 0.7 * n
    folders = sorted(tmp_path.glob("radius-*/pairs-*"))
    assert len(folders) > 2  # cells were cut
    most = 0
    for f in folders:
        pairs = spark.read.parquet(str(f)).where("NOT heavy")
        level = int(f.name.split("-")[1])
        cells = radius._cells(radius._L, r, level), radius._cells(radius._R, r, level)
        places = [df.selectExpr("pos_x AS p0", "pos_y AS p1", "pos_z AS p2") for df in (left, right)]
        nl, nr = (p.select(*c).groupBy(*names).count().withColumnRenamed("count", f"n{names[0]}") for p, c, names in zip(places, cells, (radius._L, radius._R)))
        most = max(most, pairs.join(nl, radius._L).join(nr, radius._R).selectExpr("coalesce(max(nl0 * nr0), 0) AS n").first().n)
    assert most <= radius.PAIRS


def test_ghosts_of_any_density(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = [("c", "", *map(float, p), int(k % 4)) for k, p in enumerate(rng.uniform(-1, 1, (200, 3)))]
    df = spark.createDataFrame(data, SCHEMA + ", label int")
    want = points.without_ghost_neighbours(df, 0.3, ["cloud_id"]).collect()
    assert sorted(radius.without_ghost_neighbours_refined(df, 0.3, ["cloud_id"], str(tmp_path)).collect()) == sorted(want)
    assert radius.without_ghost_neighbours_refined(df, 0, ["cloud_id"], str(tmp_path)) is df


def test_columns_of_any_name_stay(spark, tmp_path):
    names = ["_sure", "_cx", "_cxr", "_s", "__cy", "odd.name"]
    df = spark.createDataFrame([("c", 0.0, 0.0, float(k), *names) for k in range(6)], "cloud_id string, pos_x double, pos_y double, pos_z double, " + ", ".join(f"`{n}` string" for n in names))
    right = rows(spark, "c", [[0, 0, 0.2], [0, 0, 3.9]])
    for found in (points.within(df, right, 0.5, ["cloud_id"]), radius.within_refined(df, right, 0.5, ["cloud_id"], str(tmp_path))):
        assert found.columns == df.columns and sorted(map(tuple, found.collect())) == [("c", 0.0, 0.0, z, *names) for z in (0.0, 4.0)]
    assert points.within(df, right, 0.5, ["cloud_id"], "left_anti").count() == 4
    scaled = points.distance_scale(df.withColumns({"_lo": F.lit(1), "_hi": F.lit(2)}))
    assert set(scaled.columns) == {*df.columns, "_lo", "_hi", "scale"} and {(r["_lo"], r["_hi"]) for r in scaled.collect()} == {(1, 2)}
