"""Models of whole windows, estimation that is interrupted and resumed, and failures as rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograin.operators import estimation, outcomes, peaks, tiles
from echograin.plans.tiles import box_model, failing_model

WAVES = "frame_id int, x int, y int, hist array<bigint>"


def frame(number, width=7, height=6, bins=5, skip=()):
    rng = np.random.default_rng(number)
    return [(number, x, y, rng.integers(0, 9, bins).tolist()) for x in range(width) for y in range(height) if (x, y) not in skip]


def volume(rows, width, height, bins):
    out = np.zeros((width, height, bins), np.int64)
    for _, x, y, hist in rows:
        out[x, y, : len(hist)] = hist
    return out


@pytest.mark.parametrize("batch", [7, 10_000])
def test_whole_windows_at_any_batch_size(spark, batch):
    data = {n: frame(n, skip={(0, 0), (6, 5)} if n == 2 else ()) for n in range(3)}
    rows = spark.createDataFrame([r for f in data.values() for r in f], WAVES)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = tiles.score_whole_tiles(rows, 7, 6, (4, 4), box_model).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 3 * 4 * 16 and all(r.error is None for r in got)
    for r in got:
        whole = volume(data[r.frame_id], 7, 6, 5)[r.x0 : r.x0 + 4, r.y0 : r.y0 + 4]
        assert r.labels == box_model()(whole, r.tile_id)[r.dx, r.dy].tolist()


def test_windows_larger_than_the_frame(spark):
    rows = spark.createDataFrame(frame(1, 2, 2), WAVES)
    got = tiles.score_whole_tiles(rows, 2, 2, (3, 4), box_model).collect()
    assert len(got) == 12 and {(r.dx, r.dy) for r in got} == {(x, y) for x in range(3) for y in range(4)}
    assert tiles.extract_tiles(rows, 2, 2, (3, 4)).count() == 12


def test_tiles_of_sparse_frames(spark):
    rows = spark.createDataFrame([(0, 3, 3, [1, 2]), (0, 6, 0, [3]), (0, 9, 9, [4]), (0, -1, 0, [5])], WAVES)
    got = tiles.extract_tiles(rows, 7, 6, (4, 4)).collect()
    assert len(got) == 4 * 16
    held = {(r.tile_id, r.dx, r.dy): r.hist for r in got if any(r.hist)}
    assert held == {(0, 3, 3): [1, 2], (1, 3, 1): [1, 2], (2, 0, 3): [1, 2], (3, 0, 1): [1, 2], (2, 3, 0): [3]}
    assert all(r.hist == [0, 0] for r in got if not any(r.hist))


def test_waveforms_are_not_shuffled_into_tiles(spark):
    plan = tiles._placed(spark.createDataFrame(frame(0), WAVES), 7, 6, (4, 4))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_models_are_loaded_once_per_worker():
    loads = []

    def load():
        loads.append(1)
        return len

    key = tiles._named(load)
    assert [tiles._model(key, load) for _ in range(3)] == [len] * 3 and len(loads) == 1
    assert tiles._named(box_model) == tiles._named(box_model) != tiles._named(failing_model)


def test_failures_of_models_are_rows(spark):
    def load():
        def run(volume, tile):
            if tile == 1:
                raise ValueError("no good")
            return volume if tile else volume[:1]

        return run

    rows = spark.createDataFrame(frame(0) + [(1, 0, 0, [1, None])], WAVES)
    got = {(r.frame_id, r.tile_id, r.error) for r in tiles.score_whole_tiles(rows, 7, 6, (4, 4), load).collect()}
    assert {g for g in got if g[2] is None} == {(0, 2, None), (0, 3, None)}
    assert (0, 1, "ValueError: no good") in got and any(g[:2] == (0, 0) and "shape" in g[2] for g in got) and (1, 0, "ValueError: a waveform has null counts") in got


OPTIONS = (7, 6, (4, 4), (0, 1, 1), 5, 3)


def job(spark, to, rows, **options):
    frames = spark.createDataFrame([("s", f"h {n % 2}", n) for n in range(9)], "scene_id string, hist_id string, frame_id int")
    return estimation.estimate_written(spark.createDataFrame(rows, WAVES), frames, to, *OPTIONS, failing_model, **options)


def test_resumed_run_equals_one_run(spark, tmp_path):
    rows = [r for n in range(8) for r in frame(n)]  # frame 8 has no waveforms

    def both(to):
        return sorted(map(tuple, estimation.predictions(spark, to).select("frame_id", "x", "y", "bin", "label").collect())), sorted(map(tuple, estimation.ledger(spark, to).collect()), key=str)

    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    assert job(spark, whole, rows).count() == 9

    def stop(number):
        if number == 1:
            raise InterruptedError

    with pytest.raises(InterruptedError):
        job(spark, parts, rows, frames_each=2, after_each=stop)
    finished = {r.frame_id for r in estimation.ledger(spark, parts).collect()}
    assert 0 < len(finished) < 9
    done = []
    job(spark, parts, rows, frames_each=2, after_each=done.append)
    assert len(done) <= 5 and both(parts) == both(whole)
    assert job(spark, parts, rows, after_each=done.append).count() == 9
    assert {p.name for p in (tmp_path / "parts").iterdir()} == {"labels", "ledger"}
    labels, ledger = both(whole)
    by_frame = {r[2]: r for r in ledger}
    assert by_frame[8][3:] == ("failed", 0, "no waveforms")
    assert {r[0] for r in labels} == {n for n, r in by_frame.items() if r[4]}
    assert all((r[3] == "ok") == (r[5] is None) for r in ledger)
    for n in range(8):
        small = volume(frame(n), 7, 6, 5)[:, :5, [1, 2, 4]]
        sums = [small[x0 : x0 + 4, y0 : y0 + 4].sum() for x0 in (0, 3) for y0 in (0, 1)]
        assert (by_frame[n][3] == "failed") == any(v % 13 == 0 for v in sums)


def test_groups_and_passes_over_waveforms_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(estimation, "GROUPS", 3, raising=False)
    read, done = spark.sparkContext.accumulator(0), []
    rows = spark.createDataFrame([r for n in range(9) for r in frame(n)], WAVES).coalesce(1)

    def counted(batches):
        read.add(1)
        yield from batches

    frames = spark.createDataFrame([("s", "h", n) for n in range(9)], "scene_id string, hist_id string, frame_id int")
    to = str(tmp_path / "out")
    estimation.estimate_written(rows.mapInArrow(counted, WAVES), frames, to, *OPTIONS, failing_model, frames_each=1, after_each=done.append)
    assert done == [0, 1, 2] and read.value == 1
    assert estimation.ledger(spark, to).count() == 9
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"labels", "ledger"}


def test_bad_waveforms_fail_their_frames_only(spark, tmp_path):
    rows = [(0, 0, 0, [1, 5, 1]), (0, 1, 0, [1, None, 1]), (1, 0, 0, [0, 3, 0, 4, 0]), (2, 0, 0, None), (3, 0, 0, []), (4, 0, 0, [2, 2])]
    df = spark.createDataFrame(rows, WAVES).coalesce(1)
    kernels = (
        lambda r: peaks.find_peaks(r, height=1, errors=True),
        lambda r: peaks.baseline_peaks(r, errors=True),
        lambda r: peaks.filtered(r, errors=True),
        lambda r: peaks.at_bins(r, F.array(F.lit(1)), peaks.KEYS, errors=True),
    )
    for find in kernels:
        path = str(tmp_path / f"rows{len(list(tmp_path.iterdir()))}")
        find(df).write.parquet(path)
        good, status = outcomes.split(spark.read.parquet(path), df.select("frame_id").distinct())
        assert {r.frame_id: (r.status, r.error) for r in status.collect()} == {0: ("failed", "ValueError: a waveform has null counts")} | {k: ("ok", None) for k in (1, 2, 3, 4)}
        assert 0 not in {r.frame_id for r in good.collect()}
    assert peaks.find_peaks(df, height=1, errors=True).where("bin IS NOT NULL").count() == 3
    with pytest.raises(Exception, match="null counts"):
        peaks.find_peaks(df, height=1).collect()


def test_ranks_without_a_shuffle(spark):
    rows = spark.createDataFrame([(0, 0, 0, [0, 5, 0, 7, 0, 5, 0]), (0, 0, 1, [0, 1, 0])], WAVES)
    found = peaks.peaks_above_median(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.y, r.bin): (r["rank"], r.label) for r in found.collect()} == {(0, 3): (1, 1), (0, 1): (2, 0), (0, 5): (3, 0), (1, 1): (1, 1)}


def test_intensity_carries_no_waveforms(spark):
    from echograin.operators import points

    rows = spark.createDataFrame(frame(0) + frame(1), WAVES).withColumns({"bin": F.lit(2), "_i": F.lit("mine"), "_most": F.lit("mine")})
    found = points.intensity(rows, 2.0, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and found.columns == ["frame_id", "x", "y", "bin", "_i", "_most", "raw", "normalised"]
    assert {r["m"] for r in found.groupBy("frame_id").agg(F.max("normalised").alias("m")).collect()} == {1.0}


def test_all_frames_fail(spark, tmp_path):
    def load():
        raise OSError("no weights")

    frames = spark.createDataFrame([("s", "h", 0)], "scene_id string, hist_id string, frame_id int")
    to = str(tmp_path / "out")
    done = estimation.estimate_written(spark.createDataFrame(frame(0), WAVES), frames, to, *OPTIONS, load).collect()
    assert [(r.status, r.labels, r.error) for r in done] == [("failed", 0, "OSError: no weights")]
    assert estimation.predictions(spark, to).count() == 0


def test_from_files_to_predictions(spark, tmp_path):
    files = tmp_path / "in"
    for n in range(6):
        folder = files / f"scene00{n % 2}" / f"hist00{n % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        np.save(folder / f"frame{n}_voxel.npy", volume(frame(n), 7, 6, 5))
    (files / "scene000" / "hist000" / "broken_voxel.npy").write_bytes(b"no array")
    np.save(files / "scene000" / "real_voxel.npy", np.ones((7, 6, 5)))
    one, other = str(tmp_path / "one"), str(tmp_path / "other")
    done = estimation.estimate_files(spark, str(files), one, *OPTIONS, failing_model, 300, frames_each=3).collect()
    rows = spark.createDataFrame([(f"frame{r[0]}", *r[1:]) for n in range(6) for r in frame(n)], WAVES.replace("frame_id int", "frame_id string"))
    frames = spark.createDataFrame([(f"scene00{n % 2}", f"hist00{n % 3}", f"frame{n}") for n in range(6)], "scene_id string, hist_id string, frame_id string")
    want = estimation.estimate_written(rows, frames, other, *OPTIONS, failing_model).collect()
    broken = {r.frame_id: r for r in done if r.frame_id in ("broken", "real")}
    assert {(r.status, r.labels) for r in broken.values()} == {("failed", 0)} and "array" in broken["broken"].error and "whole numbers" in broken["real"].error
    assert broken["real"].hist_id == "unknown" and sorted(r for r in done if r.frame_id not in broken) == sorted(want)
    labels = [sorted(map(tuple, estimation.predictions(spark, to, "string").collect())) for to in (one, other)]
    assert labels[0] == labels[1] and labels[0]
