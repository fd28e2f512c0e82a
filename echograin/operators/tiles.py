"""Tiles, patches, peak tensors and scoring: the data side of a voxel model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from echograin.functions import waveform as W

from . import outcomes, resample, sampling

KEYS = ["frame_id", "x", "y"]


def positions(size: int, window: int) -> list[int]:
    """Begins of windows that cover `size`: the last is pulled back to end with it; one at 0 if the window is larger."""
    if size <= window:
        return [0]
    return [min(k * window, size - window) for k in range(-(-size // window))]


def tile_list(width: int, height: int, window: tuple[int, int]) -> Column:
    """Array of tile_id, x0, y0 of every window, numbered x first."""
    tiles = [(x, y) for x in positions(width, window[0]) for y in positions(height, window[1])]
    return F.array(*[F.struct(F.lit(k).alias("tile_id"), F.lit(x).alias("x0"), F.lit(y).alias("y0")) for k, (x, y) in enumerate(tiles)])


def _covering(place: Column, size: int, window: int) -> Column:
    """Numbers of the windows along one axis that hold a place: the one of its own, and the last one, which is pulled back."""
    last = len(positions(size, window)) - 1
    own = F.least(F.floor(place / window).cast("int"), F.lit(last))
    return F.array_distinct(F.array(own, F.when(place >= positions(size, window)[-1], F.lit(last)).otherwise(own)))


def _placed(waveforms: DataFrame, width: int, height: int, window: tuple[int, int]) -> DataFrame:
    """frame_id, tile_id, x0, y0, dx, dy, hist of every window's pixels that are there. A pixel names its windows by arithmetic, four at most; nothing is joined or shuffled."""
    across, down = positions(width, window[0]), positions(height, window[1])
    begin = lambda at, number: F.element_at(F.array(*[F.lit(p) for p in at]), F.col(number) + 1)
    rows = waveforms.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).select(*KEYS, "hist", F.explode(_covering(F.col("x"), width, window[0])).alias("_a"))
    rows = rows.select("*", F.explode(_covering(F.col("y"), height, window[1])).alias("_b"))
    rows = rows.select("frame_id", (F.col("_a") * len(down) + F.col("_b")).alias("tile_id"), begin(across, "_a").alias("x0"), begin(down, "_b").alias("y0"), "x", "y", "hist")
    return rows.select("frame_id", "tile_id", "x0", "y0", (F.col("x") - F.col("x0")).alias("dx"), (F.col("y") - F.col("y0")).alias("dy"), "hist")


def extract_tiles(waveforms: DataFrame, width: int, height: int, window: tuple[int, int]) -> DataFrame:
    """Every pixel of every window: frame_id, tile_id, x0, y0, dx, dy, hist; zeros, as many as the frame's longest waveform has bins, where the frame has no pixel.

    Waveforms stay where they are. Only windows that lack pixels are opened into their places, which are
    then told apart from those that are there by an anti join on keys.
    """
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    there = _placed(waveforms, width, height, window)
    frames = waveforms.groupBy("frame_id").agg(F.max(F.size("hist")).alias("_n"))
    counts = there.groupBy("frame_id", "tile_id").agg(F.count(F.lit(1)).alias("_c"))
    lacking = frames.select("frame_id", "_n", F.inline(tile_list(width, height, window))).join(counts, ["frame_id", "tile_id"], "left").where(F.coalesce("_c", F.lit(0)) < window[0] * window[1])
    spots = lacking.withColumn("dx", axis(window[0])).withColumn("dy", axis(window[1]))
    absent = spots.join(there.select("frame_id", "tile_id", "dx", "dy"), ["frame_id", "tile_id", "dx", "dy"], "left_anti")
    return there.unionByName(absent.select("frame_id", "tile_id", "x0", "y0", "dx", "dy", F.array_repeat(F.lit(0).cast("bigint"), F.col("_n")).alias("hist")))


def stitch(tiles: DataFrame, value: str = "label") -> DataFrame:
    """One value per voxel of overlapping tiles (tile_id, x0, y0, dx, dy, bin): that of the later tile."""
    placed = tiles.withColumns({"x": F.col("x0") + F.col("dx"), "y": F.col("y0") + F.col("dy")})
    return placed.groupBy(*KEYS, "bin").agg(F.max_by(value, "tile_id").alias(value))


def patchify(waveforms: DataFrame, shape: tuple[int, int, int], patch: tuple[int, int, int]) -> DataFrame:
    """frame_id, patch_id, values: the volume (bin, y, x) cut into patches, numbered and laid out in this axis order.

    shape and patch are (bins, lines, columns); a patch's sides divide the shape. Missing pixels are zeros, and so are
    bins that a waveform lacks. Columns of pixels meet by frame and place; an Arrow kernel lays each patch column out as arrays.
    """
    if any(n % p for n, p in zip(shape, patch, strict=True)):
        raise ValueError("patches do not divide the volume")
    (bins, h, w), (pd_, ph, pw) = shape, patch
    deep, size = bins // pd_, ph * pw
    rows = waveforms.where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1))
    column = F.floor(F.col("y") / ph) * (w // pw) + F.floor(F.col("x") / pw)
    spot = (F.col("y") % ph) * pw + F.col("x") % pw
    grouped = rows.groupBy("frame_id", column.cast("int").alias("_c")).agg(F.collect_list(F.struct(spot.cast("int").alias("s"), "hist")).alias("_e"))  # a patch has size pixels
    frame = waveforms.schema["frame_id"].dataType.simpleString()
    per_batch = max(1, (1 << 20) // (bins * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, per_batch) for b in batches for at in range(0, b.num_rows, per_batch)):
            entries = batch.column(2)
            pixels, hists = entries.flatten().field("s").to_numpy(zero_copy_only=False), entries.flatten().field("hist")
            owner = np.repeat(np.arange(batch.num_rows), entries.value_lengths().to_numpy(zero_copy_only=False))
            lengths = hists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            begins = np.cumsum(lengths) - lengths
            at = np.arange(lengths.sum()) - np.repeat(begins, lengths)
            inside = at < bins
            volume = np.zeros((batch.num_rows, bins, size), np.int64)
            volume[np.repeat(owner, lengths)[inside], at[inside], np.repeat(pixels, lengths)[inside]] = hists.flatten().to_numpy(zero_copy_only=False)[inside]
            n = batch.num_rows * deep
            number = (np.arange(deep) * (h // ph) * (w // pw) + batch.column(1).to_numpy(zero_copy_only=False)[:, None]).ravel()
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * pd_ * size, pa.int32()), pa.array(volume.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), deep))), pa.array(number.astype(np.int32)), values], names=["frame_id", "patch_id", "values"])

    return grouped.mapInArrow(run, f"frame_id {frame}, patch_id int, values array<bigint>")


def unpatchify(patches: DataFrame, shape: tuple[int, int, int], patch: tuple[int, int, int], masked_only: bool = False) -> DataFrame:
    """frame_id, bin, y, x, value of every voxel; with masked_only, voxels of patches that are not masked are 0."""
    (_, h, w), (_, ph, pw) = shape, patch
    nh, nw = h // ph, w // pw
    rows = patches.select("frame_id", "patch_id", *(["masked"] if masked_only else []), F.posexplode("values").alias("_i", "value"))
    p, i = F.col("patch_id"), F.col("_i")
    div = lambda a, n: F.floor(a / n).cast("int")
    out = rows.withColumns({"bin": div(p, nh * nw) * patch[0] + div(i, ph * pw), "y": div(p, nw) % nh * ph + div(i, pw) % ph, "x": p % nw * pw + i % pw})
    if masked_only:
        out = out.withColumn("value", F.when(F.col("masked"), F.col("value")).otherwise(F.lit(0).cast("bigint")))
    return out.select("frame_id", "bin", "y", "x", "value")


def patch_mask(patches: DataFrame, ratio: float, count: int, seed: int = 0) -> DataFrame:
    """patches with masked: whole part of count * ratio of each frame's `count` patches, drawn by a hash of frame, patch and seed."""
    order = Window.partitionBy("frame_id").orderBy(sampling.draw(["frame_id", "patch_id"], seed), "patch_id")
    return patches.withColumn("masked", F.row_number().over(order) <= int(count * ratio))


def peak_tensors(lists: DataFrame, shape: tuple[int, int, int], k: int = 4, min_fields: int = 4) -> DataFrame:
    """frame_id, x, y, k, position, height, width: the first peaks of each pixel's list of arrays [position, height, width, ...].

    Peaks with fewer fields, or outside the volume (x, y, bins), are left out: absent places are 0.
    """
    rows = lists.where(F.col("x").between(0, shape[0] - 1) & F.col("y").between(0, shape[1] - 1))
    rows = rows.select(*KEYS, F.posexplode(F.slice("peaks", 1, k)).alias("k", "_p"))
    at = lambda i: F.get("_p", F.lit(i))
    rows = rows.where((F.size("_p") >= min_fields) & (at(0) >= 0) & (at(0) < shape[2]))
    return rows.select(*KEYS, "k", at(0).alias("position"), at(1).alias("height"), at(2).alias("width"))


def crop_peak_tensors(tensors: DataFrame, x: tuple[int, int], y: tuple[int, int], bins: tuple[int, int] | None = None, resampled: tuple[int, int] | None = None, as_reference: bool = False) -> DataFrame:
    """Tensors of a half-open window, x and y counted from its begin.

    bins is the half-open window of bins and resampled the numbers of bins before and after downsample(): positions
    are moved and scaled along with the waveforms, and peaks outside the bins are left out. With as_reference, positions are kept as they are.
    """
    kept = tensors.where((F.col("x") >= x[0]) & (F.col("x") < x[1]) & (F.col("y") >= y[0]) & (F.col("y") < y[1]))
    kept = kept.withColumns({"x": F.col("x") - x[0], "y": F.col("y") - y[0]})
    if as_reference:
        return kept
    if bins:
        kept = kept.where((F.col("position") >= bins[0]) & (F.col("position") < bins[1])).withColumn("position", F.col("position") - bins[0])
    if resampled:
        scale = (resampled[1] - 1) / max(1, resampled[0] - 1)
        kept = kept.withColumn("position", F.col("position") * F.lit(scale))
    return kept


def patch_peak_mean(tensors: DataFrame, patch: tuple[int, int], columns: int) -> DataFrame:
    """frame_id, patch_id, k and the means of position, height and width over a patch's pixels, absent ones as 0. columns: patches side by side."""
    patch_id = F.floor(F.col("y") / patch[0]) * columns + F.floor(F.col("x") / patch[1])
    mean = lambda c: (F.sum(c) / float(patch[0] * patch[1])).alias(c)
    return tensors.groupBy("frame_id", patch_id.cast("int").alias("patch_id"), "k").agg(*[mean(c) for c in ("position", "height", "width")])


def stub_label(hist: Column, tile: Column | None = None) -> Column:
    """A rule instead of a model: labels from counts, bin by bin; every tile is judged alike."""
    return F.transform(hist, lambda v, i: F.when(v == 0, F.lit(0)).otherwise((v + i) % 4).cast("int"))


#: Models of this Python worker by the pickled function that loads them: a worker loads each once, whatever tasks it runs.
_MODELS: dict[bytes, Callable] = {}


def _model(key: bytes, load: Callable[[], Callable]) -> Callable:
    if key not in _MODELS:
        _MODELS.clear()  # one model at a time
        _MODELS[key] = load()
    return _MODELS[key]


def _named(load: Callable[[], Callable]) -> bytes:
    return hashlib.sha256(cloudpickle.dumps(load)).digest()


def score_tiles(tiles: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], columns: list[str]) -> DataFrame:
    """tiles with labels, from a user's model of single pixels: load() runs once per Python worker and returns a function from rows to a series of arrays."""
    key = _named(load)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(key, load)
        for part in parts:
            yield part[columns].assign(labels=model(part))

    schema = StructType([*[tiles.schema[c] for c in columns], StructField("labels", ArrayType(LongType()))])
    return tiles.mapInPandas(run, schema)


SCORED = "tile_id int, x0 int, y0 int, dx int, dy int, labels array<int>, error string"


def score_whole_tiles(waveforms: DataFrame, width: int, height: int, window: tuple[int, int], load: Callable[[], Callable[[np.ndarray, int], np.ndarray]]) -> DataFrame:
    """frame_id, tile_id, x0, y0, dx, dy, labels, error of every pixel of every window, from a user's model of whole windows.

    load() runs once per Python worker; it returns a function of a volume (x, y, bin) of counts, zero where there is no pixel or bin, and
    the window's number that gives labels of the volume's shape. The volume has the window's size, also where it
    goes beyond the frame, and as many bins as the window's longest waveform. A window's pixels meet in one task, whatever
    the size of Arrow batches: as many as the window has places. What a model, or a waveform with null counts, raises is one row of the window with the error and without
    place and labels, and stops nothing. Windows without any pixel are not scored.
    """
    key = _named(load)
    frame = waveforms.schema["frame_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        names = ["frame_id", *[c.split()[0] for c in SCORED.split(", ")]]
        head = [table.column(c)[:1] for c in ("frame_id", "tile_id", "x0", "y0")]
        try:
            dx, dy = (table.column(c).to_numpy() for c in ("dx", "dy"))
            hists = table.column("hist").combine_chunks()
            lengths = hists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = hists.flatten()
            if values.null_count:
                raise ValueError("a waveform has null counts")
            volume = np.zeros((*window, int(lengths.max(initial=0))), np.int64)
            row = np.repeat(np.arange(len(dx)), lengths)
            volume[dx[row], dy[row], np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values.to_numpy(zero_copy_only=False)
            labels = np.asarray(_model(key, load)(volume, head[1][0].as_py()))
            if labels.shape != volume.shape:
                raise ValueError(f"the model gives labels of shape {labels.shape} for a volume of {volume.shape}")
            flat = labels.astype(np.int32).reshape(window[0] * window[1], -1)
        except Exception as e:  # any failure of a window becomes a row
            return pa.table([*head, *[pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.list_(pa.int32()))], pa.array([f"{type(e).__name__}: {e}"[:200]])], names=names)
        n = len(flat)
        spot = np.arange(n, dtype=np.int32)
        ends = pa.array(np.arange(n + 1) * flat.shape[1], pa.int32())
        columns = [c.take(pa.array(np.zeros(n, np.int64))) for c in head]
        return pa.table([*columns, pa.array(spot // window[1]), pa.array(spot % window[1]), pa.ListArray.from_arrays(ends, pa.array(flat.ravel())), pa.nulls(n, pa.string())], names=names)

    return _placed(waveforms, width, height, window).groupBy("frame_id", "tile_id").applyInArrow(run, f"frame_id {frame}, {SCORED}")


def _small(waveforms: DataFrame, height: int, crop: tuple[int, int, int], target: int) -> DataFrame:
    bottom, top, front = crop
    return resample.downsample(resample.crop_z(resample.crop_y(waveforms, bottom, top, height), front), target)


def estimate(waveforms: DataFrame, width: int, height: int, window: tuple[int, int], crop: tuple[int, int, int], bins: int, target: int, score: Callable[[Column, Column], Column] = stub_label) -> DataFrame:
    """frame_id, x, y, bin, label: crop, downsample, tile, score, stitch, and spread the labels over the cropped bins again.

    crop is (bottom, top, front); score gives labels from a waveform and the number of its tile. A later tile
    overrules an earlier one also where it says noise, which is dropped only after stitching. estimate_frames() does the same with a model of whole tiles.
    """
    small = _small(waveforms, height, crop, target)
    tiles = extract_tiles(small, width, height - crop[0] - crop[1], window)
    scored = tiles.select("frame_id", "tile_id", "x0", "y0", "dx", "dy", score(F.col("hist"), F.col("tile_id")).alias("labels"))
    return resample.upsample_zero(stitch_scored(scored), target, bins - crop[2])


def stitch_scored(scored: DataFrame) -> DataFrame:
    """frame_id, x, y, bin, label of rows of windows' pixels with labels (tile_id, x0, y0, dx, dy, labels): of each pixel the labels of the latest window, without noise. Arrays of labels move, and bins are taken apart only after that."""
    placed = scored.select("frame_id", (F.col("x0") + F.col("dx")).alias("x"), (F.col("y0") + F.col("dy")).alias("y"), "tile_id", "labels")
    latest = placed.groupBy(*KEYS).agg(F.max_by("labels", "tile_id").alias("labels"))
    return latest.select(*KEYS, F.posexplode("labels").alias("bin", "label")).where("label <> 0")


def estimate_frames(waveforms: DataFrame, width: int, height: int, window: tuple[int, int], crop: tuple[int, int, int], bins: int, target: int, load: Callable[[], Callable[[np.ndarray, int], np.ndarray]], to: str) -> tuple[DataFrame, DataFrame]:
    """Labels of all frames without a failure (frame_id, x, y, bin, label), and frame_id, status and error of each, by a model of whole windows.

    The model runs once: what it gives is written to the folder `to`, from which both results are read. Windows without
    pixels are noise. Labels that fall outside the frame, where a window is larger than it, are left out. Where waveforms have a column
    error, as a source of files gives it, rows with an error fail their frame.
    """
    broken = waveforms.where("error IS NOT NULL").select("frame_id", "error") if "error" in waveforms.columns else None
    waves = waveforms if broken is None else waveforms.where("error IS NULL").drop("error")
    small = _small(waves, height, crop, target)
    high = height - crop[0] - crop[1]
    scored = score_whole_tiles(small, width, high, window, load)
    if broken is not None:
        scored = scored.unionByName(broken, allowMissingColumns=True)
    scored.write.mode("overwrite").parquet(to)
    scored = waveforms.sparkSession.read.parquet(to)
    good, status = outcomes.split(scored, waveforms.select("frame_id").distinct())
    labels = stitch_scored(good.where("error IS NULL")).where((F.col("x") < width) & (F.col("y") < high))
    return resample.upsample_zero(labels, target, bins - crop[2]), status


def frame_labels(logits: DataFrame, column: str, threshold: float | None = None, below: int = 0, ignored: tuple[int, ...] = ()) -> DataFrame:
    """Rows with label and confidence of their logits."""
    return logits.withColumn("_l", W.logits_to_label(F.col(column), threshold, below, ignored)).select("*", "_l.*").drop("_l")
