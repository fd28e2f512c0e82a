"""Array files by byte ranges, predictions found again, and the table function."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograin.functions import table
from echograin.operators import peaks
from echograin.sources import catalog, npy, volumes

WAVES = "frame_id int, x int, y int, hist array<bigint>"


def rows_of(df):
    return sorted(((r.path.rsplit("/", 1)[-1], r.x, r.y, r.hist, r.error) for r in df.collect()), key=str)


def test_slabs_equal_whole_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "deep").mkdir()
    for name, shape, kind in (("a", (5, 7, 9), "<u2"), ("deep/b", (1, 1, 3), ">i4"), ("c", (40, 30, 4), "<u1"), ("none", (0, 4, 4), "<i8"), ("flat", (3, 2, 0), "<i8")):
        np.save(tmp_path / f"{name}.npy", rng.integers(0, 99, shape).astype(kind))
    for offset in (0, 2, 20):
        whole = volumes.read_volumes(spark, str(tmp_path), offset)
        for slab in (100, 1000, 1 << 20):
            assert rows_of(npy.read_slabs(spark, str(tmp_path), offset, slab)) == rows_of(whole)


def test_broken_files_are_rows(spark, tmp_path):
    np.save(tmp_path / "good.npy", np.ones((2, 2, 3), np.int64))
    np.save(tmp_path / "real.npy", np.ones((2, 2, 3)))
    np.save(tmp_path / "turned.npy", np.asfortranarray(np.arange(24).reshape(2, 3, 4)))
    (tmp_path / "text.npy").write_bytes(b"no array at all")
    np.save(tmp_path / "cut.npy", np.ones((20, 20, 30), np.int64))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "cut.npy").read_bytes()[:-1000])
    got = npy.read_slabs(spark, str(tmp_path), 0, 10_000)
    status = {r.path.rsplit("/", 1)[-1]: (r.status, r.error) for r in volumes.outcomes(got).collect()}
    assert {n for n, (s, _) in status.items() if s == "ok"} == {"good.npy"} and len(status) == 5
    assert "ends inside" in status["cut.npy"][1] and "by columns" in status["turned.npy"][1]
    assert got.where("error IS NOT NULL").count() == 4


def test_a_full_frame_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "frame.npy"
    held = np.lib.format.open_memmap(path, "w+", np.uint16, (400, 512, 700))
    held[:, :, 0] = np.arange(400)[:, None]
    held[:, :, 699] = np.arange(512)[None, :]
    held.flush()
    reader = npy.SlabReader({"path": str(path), "slabBytes": str(36 << 20)})
    slabs = reader.partitions()
    assert len(slabs) == 8 and path.stat().st_size / len(slabs) < 100 << 20
    rows = npy.read_slabs(spark, str(path), 0, 36 << 20)
    assert rows.rdd.getNumPartitions() == 8
    sums = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("x").alias("n"), F.sum(F.abs(F.col("x") - F.col("hist")[0]) + F.abs(F.col("y") - F.col("hist")[699])).alias("off")).collect()
    assert len(sums) == 8 and sum(r.n for r in sums) == 400 * 512 and all(r.off == 0 for r in sums) and max(r.n for r in sums) < 26_000


def test_many_small_files_share_tasks(spark, tmp_path, monkeypatch):
    for n in range(60):
        np.save(tmp_path / f"{n}.npy", np.full((4, 4, 64), n, np.int64))
    want = rows_of(npy.read_slabs(spark, str(tmp_path), 60, 2_000))
    monkeypatch.setattr(npy, "TASKS", 16)
    parts = npy.SlabReader({"path": str(tmp_path), "slabBytes": "2000"}).partitions()
    assert len(parts) <= 20 and sum(len(p.slabs) for p in parts) == 300
    rows = npy.read_slabs(spark, str(tmp_path), 60, 2_000)
    assert rows_of(rows) == want and len(want) == 60 * 16


def test_empty_and_missing_folders(spark, tmp_path):
    assert npy.read_slabs(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="missing"):
        npy.read_slabs(spark, str(tmp_path / "missing")).count()


def test_written_volumes_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0, [1, 2, 3, 4]), (1, 1, 1, [5]), (1, 9, 9, [7]), (2, 0, 1, None)], WAVES)
    made = npy.write_volumes(rows, f"file:{tmp_path}/out", (2, 2, 3)).collect()
    assert {r.frame_id for r in made} == {1, 2} and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["1.npy", "2.npy"]
    assert np.load(tmp_path / "out" / "1.npy").tolist() == [[[1, 2, 3], [0, 0, 0]], [[0, 0, 0], [5, 0, 0]]]
    assert not np.load(tmp_path / "out" / "2.npy").any()


def test_odd_names_of_written_predictions(spark, tmp_path):
    rows = spark.createDataFrame([("scene 1", "h=2", "a+b%c:d", 0, 0, 0, 1), ("s", "h", "plain", 0, 0, 0, 1)], "scene_id string, hist_id string, frame_id string, x int, y int, bin int, label int")
    volumes.write_predictions(rows, str(tmp_path / "p"))
    found = catalog.written_predictions(spark, str(tmp_path / "p"))
    assert {(r.scene_id, r.hist_id, r.frame_id) for r in found.collect()} == {("scene 1", "h=2", "a+b%c:d"), ("s", "h", "plain")}
    frames = spark.createDataFrame([("s", "h", "plain", "/d/x")], "scene_id string, hist_id string, frame_id string, path string")
    assert {r.frame_id: (r.path, r.status) for r in catalog.resolve_written(found, frames).collect()} == {"plain": ("/d/x", "ok"), "a+b%c:d": (None, "no source")}


def test_files_of_predictions_do_not_grow_with_frames(spark, tmp_path):
    def rows(frames, label):
        return spark.createDataFrame([("01", "h", str(n), b, 0, 0, label) for n in frames for b in range(2)], "scene_id string, hist_id string, frame_id string, x int, y int, bin int, label int")

    path = str(tmp_path / "p")
    volumes.write_predictions(rows(range(200), 1), path)
    volumes.write_predictions(rows(range(150, 300), 2), path)
    assert len(list((tmp_path / "p").rglob("*.parquet"))) <= volumes.PARTS
    got = sorted((int(r.frame_id), r.x, r.label) for r in spark.read.parquet(path).collect())
    assert got == [(n, b, 1 + (n >= 150)) for n in range(300) for b in range(2)]
    found = catalog.written_predictions(spark, path).collect()
    assert sorted(int(r.frame_id) for r in found) == list(range(300)) and {r.scene_id for r in found} == {"01"}


def test_table_function(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(n, x, 0, rng.integers(0, 30, 40).tolist()) for n in range(3) for x in range(20)] + [(9, 0, 0, None), (9, 1, 0, []), (9, 2, 0, [4, 4])], WAVES)
    rows.createOrReplaceTempView("waves_of_test")
    table.register(spark)
    columns = ["frame_id", "x", "y", "bin", "height", "prominence", "width"]
    for options, want in (
        ("", peaks.find_peaks(rows)),
        (", share => 0.5, distance => 4", peaks.relative_peaks(rows, 0.5, None, 4)),
        (", height => 10, prominence => 6, width => 1.2", peaks.find_peaks(rows, height=10, prominence=6, width=1.2)),
    ):
        for by in ("", " PARTITION BY frame_id", " PARTITION BY (frame_id, x)"):
            got = spark.sql(f"SELECT * FROM find_peaks(TABLE(waves_of_test){by}{options})")
            assert got.columns == columns
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_table_function_says_what_is_wrong(spark):
    table.register(spark)
    spark.range(1).selectExpr("id", "array(1, 2) AS hist", "1 AS bin").createOrReplaceTempView("odd_of_test")
    for call, said in (("TABLE(SELECT id FROM odd_of_test)", "column hist"), ("TABLE(SELECT id AS hist FROM odd_of_test)", "no array"), ("TABLE(SELECT id, hist FROM odd_of_test), depth => 3", "no option"), ("TABLE(odd_of_test)", "bin already")):
        with pytest.raises(Exception, match=said):
            spark.sql(f"SELECT * FROM find_peaks({call})").collect()


def test_label_joins_on_buckets_move_nothing(spark, tmp_path):
    from echograin.operators import points
    from echograin.sources import bucketed

    rng = np.random.default_rng(2)
    keys = [tuple(map(int, r)) for r in {tuple(r) for r in rng.integers(0, 5, (400, 4))}]
    found = bucketed.write_bucketed(spark.createDataFrame(keys[:300], "frame_id int, x int, y int, bin int"), str(tmp_path / "p"), 4)
    tables = [bucketed.write_bucketed(spark.createDataFrame([(*k, 1 + n) for k in keys[150 * n : 150 * n + 200]], "frame_id int, x int, y int, bin int, label int"), str(tmp_path / f"l{n}"), 4) for n in (0, 1)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = points.labelled(points.labelled(found, tables[0], "ann"), tables[1], "pred")
        got = rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Join" in plan and "Exchange" not in plan
    want = {k: (int(k in set(keys[:200])), 2 * (k in set(keys[150:350]))) for k in keys[:300]}
    assert {(r.frame_id, r.x, r.y, r.bin): (r.ann, r.pred) for r in got} == want


def test_label_joins_on_buckets_broadcast_nothing(spark, tmp_path):
    from echograin.operators import points
    from echograin.sources import bucketed

    found = spark.createDataFrame([(0, 0, 0, b) for b in range(9)], "frame_id int, x int, y int, bin int")
    tables = [bucketed.write_bucketed(rows, str(tmp_path / name), 4) for name, rows in (("p", found), ("a", found.withColumn("label", F.lit(1))), ("b", found.where("bin < 3").withColumn("label", F.lit(2))))]
    rows = points.labelled(points.labelled(tables[0], tables[1], "ann"), tables[2], "pred")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    assert {r.bin: (r.ann, r.pred) for r in rows.collect()} == {b: (1, 2 * (b < 3)) for b in range(9)}
