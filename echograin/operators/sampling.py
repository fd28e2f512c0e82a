"""Samples and splits by hash order: the same rows every time, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(columns: list[str], seed: int) -> Column:
    """A row's place in the draw: the MD5 of seed and columns, as other engines give it too."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def _lowest(ids: DataFrame, count: Column, seed: int) -> DataFrame:
    """The `count` distinct frame_ids (an expression over n, their number) with the lowest places in the draw.

    Places are counted by their first four digits; the digits where the count is reached are resolved by rank, so no task
    holds more than one of 65,536 parts of the ids.
    """
    placed = ids.select("frame_id", draw(["frame_id"], seed).alias("_h")).withColumn("_d", F.substring("_h", 1, 4))
    digits = placed.groupBy("_d").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)  # 65,536 rows at most
    digits = digits.withColumns({"_upto": F.sum("_c").over(upto), "n": F.sum("_c").over(Window.partitionBy(F.lit(0)))})
    digits = digits.withColumn("_left", count - (F.col("_upto") - F.col("_c"))).where("_left > 0").select("_d", "_c", "_left")
    joined = placed.join(F.broadcast(digits), "_d")
    some = joined.where("_left < _c").withColumn("_r", F.row_number().over(Window.partitionBy("_d").orderBy("_h", "frame_id"))).where("_r <= _left")
    return joined.where("_left >= _c").select("frame_id").unionByName(some.select("frame_id"))


def sample_frames(frames: DataFrame, divide: int, seed: int = 0) -> DataFrame:
    """Exactly n // divide of the n frames (distinct frame_id): those with the lowest places in the draw."""
    ids = frames.select("frame_id").distinct()
    return frames.join(_lowest(ids, F.floor(F.col("n") / divide), seed), "frame_id", "left_semi")


def split_frames(frames: DataFrame, share: float = 0.8, seed: int = 0) -> DataFrame:
    """frames with split: train for a share of the frames by the draw, valid for the others."""
    ids = frames.select("frame_id").distinct()
    train = _lowest(ids, F.floor(F.col("n") * F.lit(share)), seed).withColumn("split", F.lit("train"))
    return frames.join(train, "frame_id", "left").withColumn("split", F.coalesce("split", F.lit("valid")))


def scene_split(frames: DataFrame, splits: DataFrame, held_out: str = "test") -> DataFrame:
    """frames with the split of their directory; training directories of a scene that is held out are left out."""
    out = splits.where(F.col("split") == held_out).select("scene_id").distinct()
    clean = splits.where(F.col("split") == held_out).unionByName(splits.where(F.col("split") != held_out).join(out, "scene_id", "left_anti"))
    return frames.join(clean, ["scene_id", "hist_id"])


def random_pixel(voxels: DataFrame, seed: int = 0) -> DataFrame:
    """frame_id, x, y of one pixel of each frame with a label and at least two distinct values in truth and prediction together; the middle pixel where there is none.

    voxels: frame_id, x, y, ann, pred.
    """
    values = F.size(F.array_distinct(F.flatten(F.collect_set(F.array("ann", "pred")))))
    fine = voxels.groupBy("frame_id", "x", "y").agg(values.alias("_v"), F.max((F.col("ann") != 0) | (F.col("pred") != 0)).alias("_any")).where("_v >= 2 AND _any")
    pick = fine.groupBy("frame_id").agg(F.min_by(F.struct("x", "y"), F.struct(draw(["frame_id", "x", "y"], seed), F.col("x"), F.col("y"))).alias("_p"))
    middle = voxels.groupBy("frame_id").agg(F.floor((F.max("x") + 1) / 2).cast("int").alias("_x"), F.floor((F.max("y") + 1) / 2).cast("int").alias("_y"))
    return middle.join(pick, "frame_id", "left").select("frame_id", F.coalesce("_p.x", "_x").alias("x"), F.coalesce("_p.y", "_y").alias("y"))


def random_peak(peaks: DataFrame, seed: int = 0) -> DataFrame:
    """frame_id, x, y, bin of one peak of each frame, drawn evenly; frames without a peak are left out."""
    spot = F.struct(draw(["frame_id", "x", "y", "bin"], seed), F.col("x"), F.col("y"), F.col("bin"))
    return peaks.groupBy("frame_id").agg(F.min_by(F.struct("x", "y", "bin"), spot).alias("_p")).select("frame_id", "_p.x", "_p.y", "_p.bin")


def cap_rows(rows: DataFrame, most: int, columns: list[str], seed: int = 0) -> DataFrame:
    """At most `most` rows for display, by hash order."""
    return rows.orderBy(draw(columns, seed), *columns).limit(most)


def pixel_series(waveforms: DataFrame, labels: DataFrame, predictions: DataFrame, peaks: DataFrame, pixel: tuple[int, int, int]) -> DataFrame:
    """bin, cnt, ann, pred, is_peak of one pixel (frame_id, x, y)."""
    at = lambda df: df.where((F.col("frame_id") == pixel[0]) & (F.col("x") == pixel[1]) & (F.col("y") == pixel[2]))
    series = at(waveforms).select(F.posexplode("hist").alias("bin", "cnt"))
    series = series.join(at(labels).select("bin", F.col("label").alias("ann")), "bin", "left").join(at(predictions).select("bin", F.col("label").alias("pred")), "bin", "left")
    marked = series.join(at(peaks).select("bin", F.lit(True).alias("is_peak")), "bin", "left")
    return marked.select("bin", "cnt", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ann", "pred")], F.coalesce("is_peak", F.lit(False)).alias("is_peak"))


