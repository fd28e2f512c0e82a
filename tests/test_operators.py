"""Properties and edge cases of resampling, tiles, points, metrics and samples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograin import fixtures
from echograin.functions import waveform as W
from echograin.operators import metrics, points, resample, sampling, tiles
from echograin.sources import catalog, volumes

WAVES = "frame_id int, x int, y int, hist array<bigint>"
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n,m", [(31, 23), (675, 256), (700, 256), (64, 64), (5, 1), (2, 2), (399, 398)])
def test_picks_equal_linspace(spark, n, m):
    got = spark.range(m).select(W.pick_index(F.col("id").cast("int"), n, m).alias("i")).collect()
    assert [r.i for r in got] == np.linspace(0, n - 1, m, dtype=int).tolist()


def test_resampling_round_trip(spark):
    rows = spark.createDataFrame([(0, 0, 0, list(range(1, 24)))], WAVES)
    spread = resample.upsample_zero(spark.createDataFrame([(0, 0, 0, b, b + 1) for b in range(23)], "frame_id int, x int, y int, bin int, label int"), 23, 64)
    assert [r.bin for r in spread.orderBy("bin").collect()] == np.linspace(0, 63, 23, dtype=int).tolist()
    up = resample.upsample_linear(rows, 50).first().hist
    assert up == [int(v) for v in np.interp(np.linspace(0, 22, 50), np.arange(23), np.arange(1, 24))]
    assert resample.downsample(rows, 23).first().hist == list(range(1, 24))
    assert resample.upsample_linear(rows, 10).first().hist == list(range(1, 24))
    with pytest.raises(Exception, match="fewer than 24"):
        resample.downsample(rows, 24).collect()


def test_crops(spark):
    rows = spark.createDataFrame([(0, x, y, [x, y, 3, 4]) for x in range(4) for y in range(4)], WAVES)
    with pytest.raises(ValueError):
        resample.crop_y(rows, 2, 2, 4)
    assert resample.crop_z(rows, 3, 1).count() == 0
    cropped = resample.random_crop(rows, resample.random_starts(rows, (4, 4, 4), (2, 3, 9)), (2, 3, 9)).collect()
    assert len(cropped) == 6 and {(r.x, r.y) for r in cropped} == {(x, y) for x in range(2) for y in range(3)} and all(len(r.hist) == 4 for r in cropped)


def test_tiles_cover(spark):
    for size in (1, 5, 8, 9, 16):
        for window in (1, 3, 8, 20):
            got = tiles.positions(size, window)
            assert {p for b in got for p in range(b, b + window)} >= set(range(size))
            assert size <= window or max(got) == size - window


def test_masks_and_patches(spark):
    rows = spark.createDataFrame([(f, p) for f in range(3) for p in range(64)], "frame_id int, patch_id int")
    counts = tiles.patch_mask(rows, 0.7, 64).where("masked").groupBy("frame_id").count().collect()
    assert [r["count"] for r in counts] == [44] * 3
    with pytest.raises(ValueError):
        tiles.patchify(rows, (64, 8, 8), (10, 4, 4))


def test_radius_join_equals_brute_force(spark):
    random.seed(11)
    a = [("c", k, *[random.uniform(-1, 1) for _ in range(3)]) for k in range(300)]
    b = [("c", k, *[random.uniform(-1, 1) for _ in range(3)]) for k in range(200)] + [("other", 0, 0.0, 0.0, 0.0)]
    schema = "cloud_id string, point_id long, pos_x double, pos_y double, pos_z double"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for radius in (0.05, 0.2, 0.7):
        want = {p[1] for p in a if any(q[0] == "c" and sum((p[2 + i] - q[2 + i]) ** 2 for i in range(3)) <= radius * radius for q in b)}
        near = points.within(left, right, radius, ["cloud_id"])
        assert {r.point_id for r in near.collect()} == want
        assert {r.point_id for r in points.within(left, right, radius, ["cloud_id"], "left_anti").collect()} == set(range(300)) - want
        assert "NestedLoop" not in near._jdf.queryExecution().executedPlan().toString()
    assert points.within(left, left, 0, ["cloud_id"]).count() == 300


def test_fwhm_edges(spark):
    rows = spark.createDataFrame([(0, 0, 0, [4, 8, 8, 8], 1), (0, 1, 0, [0, 8, 0, 9, 0], 3), (0, 2, 0, [0] * 30 + [3, 9, 3], 31)], "frame_id int, x int, y int, hist array<bigint>, bin int")
    got = {r.x: r for r in points.with_fwhm(rows, saturation=9).collect()}
    assert got[0].start_fwhm_bin == 0 and got[0].end_fwhm_bin == 1 and "no half maximum on the right" in got[0].notes and "negative distance" in got[0].notes
    assert "several peaks above half maximum" in got[1].notes and "saturated" in got[1].notes
    assert abs(got[2].distance_m - (31 * 10e-10 * 299792458 / 2 - 1.2)) < 1e-9 and got[2].notes == ["saturated"]


def test_metrics_edges(spark):
    rows = spark.createDataFrame([("s", 1, 1), ("s", 1, -1), ("s", 2, 1)], "scene_id string, ann int, pred int")
    prf = {r["class"]: r for r in metrics.scene_prf(rows).collect()}
    assert prf[3].precision == prf[3].recall == prf[3].f1 == 0 and prf[1].precision == 0.5 and prf[1].recall == 1.0
    acc = metrics.accuracy(rows, ["scene_id"]).first()
    assert (acc.total, acc.correct) == (3, 1)
    assert metrics.confusion(rows, []).agg(F.sum("n")).first()[0] == 2
    assert {r["class"]: r.iou for r in metrics.iou(rows).collect()}[3] == 1.0
    clouds = spark.createDataFrame([("a", "gt", 0, 0.0, 0.0, 0.0, 1), ("a", "pred", 0, 0.0, 0.0, 0.0, 1), ("b", "gt", 0, 0.0, 0.0, 0.0, 3)], "cloud_id string, role string, point_id long, pos_x double, pos_y double, pos_z double, label int")
    only = metrics.ghost_removal(clouds, 0.1).collect()
    assert len(only) == 1 and only[0].removal_rate == 0 and only[0].object_residual_rate == 1


def test_samples(spark):
    frames = spark.createDataFrame([(f"f{k}",) for k in range(47)], "frame_id string")
    assert sampling.sample_frames(frames, 5).count() == 9
    parts = sampling.split_frames(frames).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in parts} == {"train": 37, "valid": 10}
    voxels = fixtures.cells(spark, SF).select("frame_id", "x", "y", "ann", "pred")
    assert sampling.random_pixel(voxels).count() == voxels.select("frame_id").distinct().count()
    none = spark.createDataFrame([(0, x, y, 0, 0) for x in range(5) for y in range(4)], "frame_id int, x int, y int, ann int, pred int")
    assert tuple(sampling.random_pixel(none).first()) == (0, 2, 2)
    assert sampling.cap_rows(frames, 10, ["frame_id"]).count() == 10


def test_files(spark, tmp_path):
    folder = tmp_path / "scene001" / "data" / "hist002"
    folder.mkdir(parents=True)
    volume = np.arange(3 * 2 * 4, dtype=np.uint16).reshape(3, 2, 4)
    np.save(folder / "20240101000000_5_000007.npy", volume)
    (folder / "broken.npy").write_bytes(b"no array")
    np.save(folder / "flat.npy", np.zeros(4))
    rows = volumes.read_volumes(spark, str(tmp_path), 1)
    good = {(r.x, r.y): r.hist for r in rows.where("error IS NULL").collect()}
    assert good == {(x, y): volume[x, y, 1:].tolist() for x in range(3) for y in range(2)}
    assert rows.where("error IS NOT NULL").count() == 2
    assert catalog.list_files(spark, [str(tmp_path)], "2024*.npy").count() == 0 and catalog.list_files(spark, [str(folder)], "2024*.npy").count() == 1
    assert {r.status: r.frames for r in catalog.status(volumes.outcomes(rows)).collect()} == {"ok": 1, "failed": 2}
    mapped = volumes.read_volumes(spark, str(tmp_path), 1, mounted=True)
    assert {(r.x, r.y): r.hist for r in mapped.where("error IS NULL").collect()} == good and mapped.where("error IS NOT NULL").count() == 2
    listed = catalog.keys(catalog.list_files(spark, [str(tmp_path)], "2024*.npy", True)).collect()
    assert [(r.scene_id, r.hist_id, r.frame_id, r.t, r.seq) for r in listed] == [("scene001", "hist002", "20240101000000_5_000007", 5, 7)]
    with pytest.raises(ValueError):
        volumes.write_points(spark.createDataFrame([], "cloud_id string, role string, point_id bigint, pos_x double, pos_y double, pos_z double, label int"), str(tmp_path / "none"))
        volumes.read_points(spark, str(tmp_path / "none"))


def test_hist_strings(spark):
    got = spark.createDataFrame([("[1 2  3]",), ("[ 4\n5 ]",), ("[]",), (" 7 ",)], "s string").select(W.parse_hist(F.col("s")).alias("h")).collect()
    assert [r.h for r in got] == [[1, 2, 3], [4, 5], [], [7]]


def test_pixel_tables_and_object_arrays(spark, tmp_path):
    np.savez(tmp_path / "good.npz", pixel_x=np.array([1, 2]), pixel_y=np.array([0, 5]), hist_data=np.array(["[1 2 3]", "[4 5]"]))
    np.savez(tmp_path / "short.npz", pixel_x=np.array([1]), pixel_y=np.array([0]))
    table = np.empty((2, 3), object)
    table[0], table[1] = [3, 4, np.array([7, 8, 9])], [5, 6, "[1 1]"]
    np.save(tmp_path / "table.npy", table, allow_pickle=True)
    rows = volumes.read_volumes(spark, str(tmp_path), 1)
    assert {(r.x, r.y): r.hist for r in rows.where("error IS NULL").collect()} == {(1, 0): [2, 3], (2, 5): [5]}
    assert rows.where("error LIKE '%lacks pixel_%' OR error LIKE '%lacks hist_data%'").count() == 1 and rows.where("error IS NOT NULL").count() == 2
    trusted = volumes.read_volumes(spark, str(tmp_path), 0, trusted=True)
    assert {(r.x, r.y): r.hist for r in trusted.where("error IS NULL AND path LIKE '%/table.npy'").collect()} == {(3, 4): [7, 8, 9], (5, 6): [1, 1]}


def test_peak_list_source(spark, tmp_path):
    lists = np.empty((2, 3), object)
    lists[0], lists[1] = [0, 1, [[5, 9.5, 2.0], [7, 1.0, 1.5, 0.5]]], [2, 3, []]
    np.save(tmp_path / "a_peak.npy", lists, allow_pickle=True)
    (tmp_path / "b_peak.npy").write_bytes(b"no array")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.x: r.peaks for r in volumes.unpack_peak_lists(files).where("error IS NULL").collect()}
    assert got == {0: [[5.0, 9.5, 2.0], [7.0, 1.0, 1.5, 0.5]], 2: []}
    assert volumes.unpack_peak_lists(files).where("error IS NOT NULL").count() == 1
    with pytest.raises(ValueError, match="no peak lists"):
        volumes.read_peak_lists(spark, str(tmp_path))


def test_sinks_keep_what_other_calls_wrote(spark, tmp_path):
    schema = "scene_id string, hist_id string, frame_id int, x int, y int, bin int, label int"
    path = str(tmp_path / "predictions")
    for frame, label in ((1, 1), (2, 1), (2, 3)):
        volumes.write_predictions(spark.createDataFrame([("s", "h", frame, 0, 0, b, label) for b in range(3)], schema), path)
    got = {(r.frame_id, r.label): r["count"] for r in spark.read.parquet(path).groupBy("frame_id", "label").count().collect()}
    assert got == {(1, 1): 3, (2, 3): 3}
    points = spark.createDataFrame([("c", "gt", k, k / 7, -k / 3, 0.5, 1) for k in range(20)], "cloud_id string, role string, point_id bigint, pos_x double, pos_y double, pos_z double, label int")
    volumes.write_points(points, str(tmp_path / "points"))
    assert sorted(map(tuple, volumes.read_points(spark, str(tmp_path / "points")).select(*points.columns).collect())) == sorted(map(tuple, points.collect()))


def test_later_tile_overrules_with_noise(spark):
    rows = spark.createDataFrame([(0, x, y, [1, 2]) for x in range(3) for y in range(2)], WAVES)
    rule = lambda hist, tile: F.transform(hist, lambda v: F.when(tile == 0, 2).otherwise(0))
    got = tiles.estimate(rows, 3, 2, (2, 2), (0, 0, 0), 2, 2, rule)
    assert {(r.x, r.y, r.bin, r.label) for r in got.collect()} == {(0, y, b, 2) for y in range(2) for b in range(2)}  # tile 1 covers x = 1 and 2 and says noise


def test_fwhm_is_one_pass(spark):
    rows = spark.createDataFrame([(0, 0, 0, [0, 4, 9, 4, 0, 3, 8, 3, 0], 2)], "frame_id int, x int, y int, hist array<bigint>, bin int")
    for df in (points.with_fwhm(rows), points.range_by_methods(rows), points.ranged(points.P.relative_peaks(rows, ranged=True))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    assert points.range_by_methods(rows, bin_offset=2, place=points.srl_points).count() == 4
    assert points.range_by_method(rows, "first_peak").first().bin == 2
    with pytest.raises(ValueError):
        points.range_by_method(rows, "best")


def test_dense_cells(spark):
    random.seed(4)
    wall = [("c", k, random.uniform(0, 0.05), random.uniform(0, 0.05), 0.0) for k in range(1500)]
    edge = [("c", 5000 + k, 0.149 + k * 0.0001, 0.02, 0.0) for k in range(30)]
    schema = "cloud_id string, point_id long, pos_x double, pos_y double, pos_z double"
    left, right = spark.createDataFrame(wall + edge, schema), spark.createDataFrame(wall, schema)
    want = {p[1] for p in wall + edge if any((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 0.1 * 0.1 for q in wall)}
    assert {r.point_id for r in points.within(left, right, 0.1, ["cloud_id"]).collect()} == want
    assert {r.point_id for r in points.within(left, right, 0.1, ["cloud_id"], "left_anti").collect()} == {p[1] for p in wall + edge} - want
    assert 1500 < len(want) < 1530


def test_peak_positions_follow_crops(spark):
    tensors = spark.createDataFrame([(0, 2, 1, 0, 10.0, 5.0, 1.0), (0, 3, 1, 0, 2.0, 5.0, 1.0), (0, 9, 1, 0, 10.0, 5.0, 1.0)], "frame_id int, x int, y int, k int, position double, height double, width double")
    moved = tiles.crop_peak_tensors(tensors, (2, 5), (1, 3), (4, 15), (11, 6)).collect()
    assert [(r.x, r.y, r.position) for r in moved] == [(0, 0, 3.0)]
    assert {r.position for r in tiles.crop_peak_tensors(tensors, (2, 5), (1, 3), (4, 15), (11, 6), as_reference=True).collect()} == {10.0, 2.0}
    starts = spark.createDataFrame([(0, 2, 0, 8)], "frame_id int, x0 int, y0 int, z0 int")
    assert [(r.x, r.position) for r in resample.random_crop(tensors, starts, (2, 4, 4)).collect()] == [(0, 2.0)]


def test_samples_resolve_one_part_of_the_draw(spark):
    frames = spark.createDataFrame([(f"f{k}",) for k in range(500)], "frame_id string")
    order = sorted(r.frame_id for r in frames.select("frame_id", sampling.draw(["frame_id"], 0).alias("h")).orderBy("h").limit(100).collect())
    assert sorted(r.frame_id for r in sampling.sample_frames(frames, 5).collect()) == order
    assert sampling.sample_frames(frames, 501).count() == 0 and sampling.sample_frames(frames, 1).count() == 500
    assert "TakeOrdered" not in sampling.sample_frames(frames, 5)._jdf.queryExecution().executedPlan().toString()


def test_cloud_status_and_scene_names(spark):
    rows = spark.createDataFrame([("/c/a_gt.pcd",), ("/c/a.pcd",), ("/c/b_gt.pcd",), ("/c/d.pcd",), ("/c/e.pcd",)], "path string")
    assert {r.status: r.clouds for r in catalog.cloud_status(rows).collect()} == {"paired": 1, "truth only": 1, "prediction only": 2}
    names = {"scene12_a_b.pcd": "scene12", "run_7_gt.pcd": "run", "plain.pcd": "plain", "-x_a.pcd": "-x_a", "a_b_c-d_e.pcd": "a_b", "_x_y.pcd": "_x_y", "a_b__c.pcd": "a_b", "scene.pcd": "scene"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", catalog.scene_name(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == names
