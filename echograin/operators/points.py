"""Ranging, geometry, colours and radius joins of points."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echograin import constants as C
from echograin.functions import waveform as W

from . import peaks as P

KEYS = ["frame_id", "x", "y"]


def free(df: DataFrame, name: str) -> str:
    """A name for a working column that no column of df has in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _place(distance: Column, azimuth: Column, altitude: Column, turn: int) -> dict[str, Column]:
    a, o = F.radians(azimuth), F.radians(altitude)
    return {"pos_x": distance * F.cos(a) * F.cos(o), "pos_y": turn * distance * F.sin(a) * F.cos(o), "pos_z": -distance * F.sin(o)}


def spd_points_a(rows: DataFrame, distance: str = "distance_m") -> DataFrame:
    """pos_x, pos_y, pos_z with altitudes counted down from the top line; Y turns with x."""
    return rows.withColumns(_place(F.col(distance), F.col("x") * C.STEP_X, C.TOP_Y - F.col("y") * C.STEP_Y, 1))


def spd_points_b(rows: DataFrame, distance: str = "distance_m") -> DataFrame:
    """pos_x, pos_y, pos_z with altitudes counted up from line 0; Y turns against x."""
    return rows.withColumns(_place(F.col(distance), F.col("x") * C.STEP_X, F.col("y") * C.STEP_Y, -1))


def srl_points(rows: DataFrame, distance: str = "distance_m") -> DataFrame:
    """pos_x, pos_y, pos_z of the second sensor."""
    # Hundredths of a degree.
    return rows.withColumns(_place(F.col(distance), (F.col("x") * 47 - 4512) / 100.0, (F.col("y") * 47 - 1316) / 100.0, -1))


def depth_points(rows: DataFrame, mode: int) -> DataFrame:
    """pos_x, pos_y, pos_z from a given column Depth, for sensor modes that measure it."""
    if mode not in (1, 5, 12):
        raise ValueError(f"mode {mode} has no depth column")
    return spd_points_b(rows, "Depth")


def ranged(found: DataFrame, saturation: int | None = None, bin_offset: int = 0) -> DataFrame:
    """Rows with the kernel's columns peaks.FWHM, ranged: distance_m and notes instead of the code and count."""
    r = W.fwhm(*[F.col(c) for c in ("start_fwhm_bin", "end_fwhm_bin", "fwhm_code", "above_half", "height")], saturation, bin_offset)
    kept = [c for c in found.columns if c not in ("fwhm_code", "above_half")]
    return found.withColumn("_f", r).select(*kept, F.col("_f.distance_m").alias("distance_m"), F.col("_f.notes").alias("notes"))


def with_fwhm(rows: DataFrame, saturation: int | None = None, bin_offset: int = 0) -> DataFrame:
    """rows (hist, bin and others) with distance_m, start_fwhm_bin, end_fwhm_bin and notes; rows whose bin is null or outside their waveform are left out.

    The note on several peaks counts all peaks of at least half the peak's count. One pass of the peak kernel, no shuffle.
    """
    carried = [c for c in rows.columns if c != "bin"]
    found = ranged(P.at_bins(rows, F.array("bin"), carried), saturation, bin_offset)
    return found.select(*rows.columns, "distance_m", "start_fwhm_bin", "end_fwhm_bin", "notes")


METHODS = ("strongest", "centroid", "average", "first_peak")


def range_by_methods(rows: DataFrame, methods: tuple[str, ...] = METHODS, keys: list[str] | None = None, place: Callable[[DataFrame], DataFrame] | None = None, bin_offset: int = 0, saturation: int | None = None) -> DataFrame:
    """method and keys with bin, range and pos_x, pos_y, pos_z, by each method; waveforms for which it gives no bin are left out.

    All methods share one pass of the peak kernel. place is the geometry: spd_points_b, or srl_points for the second sensor.
    """
    keys = keys or KEYS
    by_column = {"strongest": W.strongest_bin, "centroid": W.centroid_bin, "average": W.average_bin}
    if unknown := [m for m in methods if m not in METHODS]:
        raise ValueError(f"unknown method: {unknown[0]}")
    first = "first_peak" in methods
    named = [m for m in methods if m != "first_peak"]
    bins = F.array(W.strongest_bin(F.col("hist")), *[by_column[m](F.col("hist")) for m in named])
    found = P.at_bins(rows, bins, keys, (3, 2) if first else None).where("number > 0")
    method = F.element_at(F.array(*[F.lit(m) for m in [*named, "first_peak"]]), F.col("number"))
    placed = (place or spd_points_b)(ranged(found.withColumn("method", method).drop("number"), saturation, bin_offset))
    return placed.drop("height")


def range_by_method(rows: DataFrame, method: str, keys: list[str] | None = None, **options) -> DataFrame:
    """range_by_methods() for one method, without its name."""
    return range_by_methods(rows, (method,), keys, **options).drop("method")


def intensity(rows: DataFrame, gain: float, stack: int, use_block_gain: bool = True) -> DataFrame:
    """rows (frame_id, y, bin, hist and others) with raw (whole, at most 255) and normalised (over the frame's largest), without hist.

    A frame's largest comes from a grouped maximum joined back, so waveforms do not move and a large frame needs no single task.
    """
    value = F.get("hist", F.col("bin"))
    block = W.block_gain(F.col("y")) if use_block_gain else F.lit(1.0)
    found = (value * block + W.plateau(F.col("hist"), F.col("bin")) * F.lit(float(gain))) / F.lit(float(stack))
    kept = [c for c in rows.columns if c not in ("hist", "raw", "normalised")]
    value, most = free(rows, "_i"), free(rows, "_most")
    rows = rows.select(*kept, F.least(found, F.lit(255.0)).alias(value))
    tops = rows.groupBy("frame_id").agg(F.max(value).alias(most))
    share = F.col(value) / F.when(F.col(most) == 0, 1.0).otherwise(F.col(most))
    return rows.join(tops, "frame_id").select(*kept, F.floor(value).cast("int").alias("raw"), share.alias("normalised"))


def raster(pixels: DataFrame, value: str) -> DataFrame:
    """Every pixel of each frame up to its largest x and y, with the value, 0 where there is none."""
    size = pixels.groupBy("frame_id").agg(F.max("x").alias("_x"), F.max("y").alias("_y"))
    grid = size.select("frame_id", F.explode(F.sequence(F.lit(0), "_x")).alias("x"), "_y").select("frame_id", "x", F.explode(F.sequence(F.lit(0), "_y")).alias("y"))
    return grid.join(pixels.select("frame_id", "x", "y", value), KEYS, "left").withColumn(value, F.coalesce(value, F.lit(0)))


# --- colours --------------------------------------------------------------------------------------------------------

# Colours of labels.
COLOURS = {0: (0.5, 0.5, 0.5), 1: (0.0, 1.0, 0.0), 2: (0.0, 0.0, 1.0), 3: (1.0, 0.0, 0.0), -1: (1.0, 1.0, 1.0)}


# Colours of labels in charts of voxels, and in viewers of single waveforms (other labels are grey).
CHART = {0: "#808080", 1: "#1f77b4", 2: "#ff7f0e", 3: "#2ca02c"}
VIEWER = {1: "#00a65a", 2: "#1f77b4", 3: "#d62728"}


def hex_colour(label: Column, palette: dict[int, str] | None = None, other: str = "#808080") -> Column:
    """Colour of a label as #rrggbb."""
    return reduce(lambda c, item: c.when(label == item[0], item[1]), (palette or CHART).items(), F.when(F.lit(False), "")).otherwise(other)


def coloured(points: DataFrame) -> DataFrame:
    """points with r, g, b of their label; other labels are black."""

    def channel(k: int) -> Column:
        return reduce(lambda c, item: c.when(F.col("label") == item[0], F.lit(item[1][k])), COLOURS.items(), F.when(F.lit(False), F.lit(0.0))).otherwise(0.0)

    return points.withColumns({n: channel(k) for k, n in enumerate("rgb")})


def colour_class(points: DataFrame) -> DataFrame:
    """points with colour_label, the class whose colour r, g, b are, or null."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    off, on = (lambda c: c < 0.1), (lambda c: c > 0.9)
    grey = reduce(lambda x, c: x & c.between(0.4, 0.6), (r, g, b), F.lit(True))
    found = F.when(off(r) & on(g) & off(b), C.OBJECT).when(off(r) & off(g) & on(b), C.GLASS).when(on(r) & off(g) & off(b), C.GHOST).when(grey, C.NOISE)
    return points.withColumn("colour_label", found)


def distance_scale(points: DataFrame, cloud: str = "cloud_id") -> DataFrame:
    """points with scale: log(1 + distance from the origin), 0 to 1 inside each cloud, 0 where all are equal. A cloud's bounds come from a grouped count joined back, so a large cloud needs no single task."""
    far = F.log1p(F.sqrt(F.col("pos_x") ** 2 + F.col("pos_y") ** 2 + F.col("pos_z") ** 2))
    low, high = free(points, "_lo"), free(points, "_hi")
    bounds = points.groupBy(cloud).agg(F.min(far).alias(low), F.max(far).alias(high))
    joined = points.join(bounds, cloud)
    return joined.withColumn("scale", F.when(F.col(high) > F.col(low), (far - F.col(low)) / (F.col(high) - F.col(low))).otherwise(0.0)).drop(low, high)


# --- radius joins ---------------------------------------------------------------------------------------------------


def _celled(points: DataFrame, size: float, around: bool, tag: str) -> DataFrame:
    """points with the grid cell they lie in, or a row for each of the 27 cells around; names of new columns begin with tag."""
    cells = {f"{tag}{n}": F.floor(F.col(a) / F.lit(size)) for n, a in (("cx", "pos_x"), ("cy", "pos_y"), ("cz", "pos_z"))}
    points = points.withColumns(cells)
    if around:
        for n in cells:
            points = points.withColumn(f"{tag}s", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(n, F.col(n) + F.col(f"{tag}s")).drop(f"{tag}s")
    return points


#: Side of a small cell over the radius: two points of one such cell are nearer than the radius for certain (1 / sqrt(3) is 0.57735).
SURE = 0.577


def within(left: DataFrame, right: DataFrame, radius: float, keys: list[str], how: str = "left_semi") -> DataFrame:
    """Rows of left that have a point of right (same keys) at most `radius` away, or with how="left_anti" those that have none.

    Radius 0 is equality of coordinates. Otherwise a point that shares a small cell with one of right has it near for
    certain: an equal join on these cells, which right fills once each, settles dense places without comparing points. What
    is left meets right's points by an equal join on grid cells as large as the radius, right's points going to the 27
    cells around them after copies in one place are taken once; Spark splits cells with many points of left among tasks (adaptive skew join).
    Where very many points of both sides lie in cells about the radius apart, radius.within_refined() compares far fewer.
    """
    xyz = ["pos_x", "pos_y", "pos_z"]
    if radius == 0:
        return left.join(right.select(*keys, *xyz).distinct(), [*keys, *xyz], how)
    tag = "_"
    while any(c.lower().startswith(tag) for c in left.columns):
        tag += "_"
    points = right.select(*keys, *xyz).distinct()
    cells = [f"{tag}{n}" for n in ("cx", "cy", "cz")]
    small = _celled(points, radius * SURE, False, tag).select(*keys, *cells).distinct()
    own, sure = [f"`{c}`" for c in left.columns], f"{tag}sure"
    sifted = _celled(left, radius * SURE, False, tag).join(small.withColumn(sure, F.lit(True)), [*keys, *cells], "left").select(*own, sure)
    near = _celled(points, radius, True, tag).select(*[F.col(k).alias(f"{tag}r{k}") for k in [*keys, *xyz]], *[F.col(c).alias(f"{c}r") for c in cells])
    cond = [F.col(k) == F.col(f"{tag}r{k}") for k in keys] + [F.col(c) == F.col(f"{c}r") for c in cells]
    square = sum(((F.col(a) - F.col(f"{tag}r{a}")) ** 2 for a in xyz), F.lit(0.0))
    rest = _celled(sifted.where(F.col(sure).isNull()), radius, False, tag).join(near, [*cond, square <= radius * radius], how).select(*own)
    return rest if how == "left_anti" else sifted.where(sure).select(*own).unionByName(rest)


def without_ghost_neighbours(points: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """points without ghosts and without what lies at most `radius` from one; all points for a radius of 0 or less."""
    if radius <= 0:
        return points
    return within(points, points.where(F.col("label") == C.GHOST), radius, keys, "left_anti")


def visible(points: DataFrame, noise: bool = False, undefined: bool = False, skip_ghosts: bool = False) -> DataFrame:
    """points without noise and undefined ones unless asked for, and without ghosts if asked."""
    hidden = [C.NOISE] * (not noise) + [C.UNDEFINED] * (not undefined) + [C.GHOST] * skip_ghosts
    return points.where(~F.col("label").isin(hidden)) if hidden else points


def labelled(peaks: DataFrame, labels: DataFrame, column: str = "label", keys: list[str] | None = None) -> DataFrame:
    """peaks with the label of their voxel; noise where there is none."""
    keys = keys or KEYS
    return peaks.join(labels.select(*keys, "bin", F.col("label").alias(column)), [*keys, "bin"], "left").withColumn(column, F.coalesce(column, F.lit(C.NOISE)))


def peaks_to_points(waveforms: DataFrame, labels: DataFrame, noise: bool = False, undefined: bool = False, skip_ghosts: bool = False, ghost_radius: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """Labelled, ranged and placed points of all relative peaks of the waveforms."""
    keys = keys or KEYS
    found = visible(labelled(P.relative_peaks(waveforms, keys=keys, ranged=True), labels, keys=keys), noise, undefined, skip_ghosts)
    points = spd_points_a(ranged(found)).drop("height", "prominence", "width")
    return without_ghost_neighbours(points, ghost_radius, keys[:1]) if ghost_radius else points


