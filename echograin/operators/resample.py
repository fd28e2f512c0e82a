"""Crops, resampling, sparse and dense forms of waveforms and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echograin.functions import waveform as W

KEYS = ["frame_id", "x", "y"]


def filled(order: Column, place: str, value: str, n: int, zero: Column) -> Column:
    """An array of n values from an array of structs sorted by place, one per place at most; `zero` where there is none.

    One pass over the entries. `order` must be a column, not an expression, which each entry would evaluate anew.
    """
    gap = lambda e, i: e[place] - F.coalesce(F.get(order, i - 1)[place], F.lit(-1)) - 1
    body = F.flatten(F.transform(order, lambda e, i: F.concat(F.array_repeat(zero, gap(e, i).cast("int")), F.array(e[value]))))
    rest = F.lit(n - 1) - F.coalesce(F.try_element_at(order, F.lit(-1))[place], F.lit(-1))
    return F.concat(body, F.array_repeat(zero, rest.cast("int")))


def densify(cells: DataFrame, bins: int, keys: list[str] | None = None, value: str = "cnt") -> DataFrame:
    """One row per pixel with the counts of all bins, from one row per occupied bin; other bins are 0. Of bins outside 0 .. bins - 1 nothing is kept."""
    keys = keys or KEYS
    grouped = cells.where(F.col("bin").between(0, bins - 1)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", value))).alias("_e"))
    return grouped.select(*keys, filled(F.col("_e"), "bin", value, bins, F.lit(0).cast("bigint")).alias("hist"))


def crop_y(rows: DataFrame, bottom: int, top: int, height: int) -> DataFrame:
    """Lines bottom .. height - top - 1, counted from 0 anew."""
    if bottom + top >= height:
        raise ValueError("the crop leaves no lines")
    return rows.where(F.col("y").between(bottom, height - top - 1)).withColumn("y", F.col("y") - bottom)


def crop_z(rows: DataFrame, front: int, back: int = 0) -> DataFrame:
    """Waveforms without their first and last bins; those with no bin left are left out."""
    if front < 0 or back < 0:
        raise ValueError("crops are not negative")
    left = F.size("hist") - front - back
    return rows.where(left > 0).withColumn("hist", F.slice("hist", F.lit(front + 1), left))


def crop_box(rows: DataFrame, x: tuple[int, int | None], y: tuple[int, int | None], z: tuple[int, int | None], shape: tuple[int, int, int]) -> DataFrame:
    """A box, half open and held inside `shape`, re-based to 0; an end of None is the full size."""
    (x0, x1), (y0, y1), (z0, z1) = ((max(0, a), min(n, n if b is None else b)) for (a, b), n in zip((x, y, z), shape, strict=True))
    kept = rows.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    return kept.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0, "hist": F.slice("hist", z0 + 1, max(0, z1 - z0))})


def crop_xy(rows: DataFrame, x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    """Pixels of a range, both ends included; places are kept."""
    return rows.where(F.col("x").between(*x) & F.col("y").between(*y))


def crop_labels(labels: DataFrame, x: tuple[int, int], y: tuple[int, int], shape: tuple[int, int], first_bin: int = 0) -> DataFrame:
    """Sparse labels of a half-open box held inside `shape`, without bins before first_bin, re-based to 0."""
    (x0, x1), (y0, y1) = ((max(0, a), min(n, b)) for (a, b), n in zip((x, y), shape, strict=True))
    kept = labels.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("bin") >= first_bin))
    return kept.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0, "bin": F.col("bin") - first_bin})


def random_starts(frames: DataFrame, shape: tuple[int, int, int], target: tuple[int, int, int], seed: int = 0) -> DataFrame:
    """frame_id with the start of a crop on each axis, drawn evenly from what fits by the MD5 of seed, frame and axis."""
    number = lambda axis: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("frame_id").cast("string"), F.lit(axis))), 1, 12), 16, 10).cast("bigint")
    draw = lambda axis, n, t: F.pmod(number(axis), F.lit(max(0, n - t) + 1)).cast("int").alias(f"{axis}0")
    return frames.select("frame_id").distinct().select("frame_id", *[draw(a, n, t) for a, n, t in zip("xyz", shape, target, strict=True)])


def random_crop(rows: DataFrame, starts: DataFrame, target: tuple[int, int, int]) -> DataFrame:
    """Waveforms inside each frame's crop, re-based; with a column bin, or position of peaks, instead of hist, sparse rows inside it."""
    kept = rows.join(starts, "frame_id")
    x, y = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    kept = kept.where((x >= 0) & (x < target[0]) & (y >= 0) & (y < target[1])).withColumns({"x": x, "y": y})
    if "hist" in rows.columns:
        kept = kept.withColumn("hist", F.slice("hist", F.col("z0") + 1, F.lit(target[2])))
    else:
        name = "bin" if "bin" in rows.columns else "position"
        z = F.col(name) - F.col("z0")
        kept = kept.where((z >= 0) & (z < target[2])).withColumn(name, z)
    return kept.drop("x0", "y0", "z0")


def downsample(rows: DataFrame, target: int) -> DataFrame:
    """Bins picked evenly, the first and the last included."""
    n = F.size("hist")
    picked = F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda i: F.get("hist", W.pick_index(i, n, target)))
    checked = F.when(n >= target, picked).otherwise(F.raise_error(F.lit(f"fewer than {target} bins")))
    return rows.withColumn("hist", checked)


def downsample_labels(labels: DataFrame, bins: int, target: int) -> DataFrame:
    """Sparse labels of the bins that downsample() picks, renumbered."""
    if target > bins:
        raise ValueError(f"fewer than {target} bins")
    spark = labels.sparkSession
    picks = spark.range(target).select(W.pick_index(F.col("id").cast("int"), bins, target).alias("bin"), F.col("id").cast("int").alias("_new"))
    return labels.join(F.broadcast(picks), "bin").withColumn("bin", F.col("_new")).drop("_new")


def upsample_zero(labels: DataFrame, bins: int, target: int) -> DataFrame:
    """Sparse rows of `bins` bins spread evenly over `target` bins; the bins between stay empty. No change where target is not larger."""
    if target <= bins:
        return labels
    return labels.withColumn("bin", W.pick_index(F.col("bin"), target, bins))


def upsample_linear(rows: DataFrame, target: int) -> DataFrame:
    """Waveforms stretched to `target` bins by linear interpolation, cut to whole counts. No change where target is not larger."""
    n = F.size("hist")
    step = (n - 1).cast("double") / F.lit(float(max(1, target - 1)))

    def at(j: Column) -> Column:
        pos = j * step
        low = F.least(F.floor(pos).cast("int"), n - 2)
        a, b = F.get("hist", low).cast("double"), F.get("hist", low + 1).cast("double")
        return F.when(n == 1, F.get("hist", F.lit(0))).when(j == target - 1, F.get("hist", n - 1)).otherwise((a + (b - a) * (pos - low)).cast("bigint"))

    return rows.withColumn("hist", F.when(n >= target, F.col("hist")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(target - 1)), at)))


def sparsify(volume: DataFrame, shape: tuple[int, int], x_offset: int = 0, y_offset: int | None = None, label_height: int | None = None, value: str = "hist") -> DataFrame:
    """Dense labels (x, y, array) as rows of the labels that are not noise, moved by the offsets and held inside `shape`.

    The default y offset centres label_height lines in the height.
    """
    if y_offset is None:
        y_offset = (shape[1] - (label_height or shape[1])) // 2
    keys = [c for c in volume.columns if c not in ("x", "y", value)]
    moved = volume.select(*keys, (F.col("x") + x_offset).alias("x"), (F.col("y") + y_offset).alias("y"), F.posexplode(value).alias("bin", "_l"))
    return moved.where((F.col("_l") != 0) & F.col("x").between(0, shape[0] - 1) & F.col("y").between(0, shape[1] - 1)).select(*keys, "x", "y", "bin", F.col("_l").cast("int").alias("label"))
