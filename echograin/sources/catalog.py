"""Frame catalogues from file names, and pairing of files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folders: list[str], pattern: str, recursive: bool = False) -> DataFrame:
    """path and length of files by name pattern, in order of path; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folders)
    return files.select("path", "length").orderBy("path")


def _folder(path: Column, word: str) -> Column:
    """The topmost folder whose name holds `word`."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.coalesce(F.get(F.filter(folders, lambda f: f.contains(word)), F.lit(0)), F.lit("unknown"))


def keys(paths: DataFrame) -> DataFrame:
    """paths with frame_id (stem without the kind of file), scene_id and hist_id ("unknown" where no folder names them), and ts, t and seq from stamped names."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    frame = F.regexp_replace(stem, r"(_annotation)?_voxel$|_peak$", "")
    part = lambda k: F.nullif(F.regexp_extract(frame, r"^(\d{14})_(\d+)_(\d+)$", k), F.lit(""))
    return paths.withColumns({"frame_id": frame, "scene_id": _folder(F.col("path"), "scene"), "hist_id": _folder(F.col("path"), "hist"), "ts": F.try_to_timestamp(part(1), F.lit("yyyyMMddHHmmss")), "t": part(2).cast("bigint"), "seq": part(3).cast("int")})


def volumes(paths: DataFrame) -> DataFrame:
    """Files of counts: annotation files end alike and are left out."""
    return paths.where(F.col("path").endswith("_voxel.b2") & ~F.col("path").endswith("_annotation_voxel.b2"))


def exclude(frames: DataFrame, denied: DataFrame) -> DataFrame:
    """frames without those in a list of broken ones."""
    return frames.join(denied.select("frame_id").distinct(), "frame_id", "left_anti")


def status(results: DataFrame) -> DataFrame:
    """Frames by outcome."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("frames"))


def pair_frames(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files of two kinds by scene, hist and frame, with status paired, left only or right only."""
    on = ["scene_id", "hist_id", "frame_id"]
    both = left.select(*on, F.col("path").alias("left_path")).join(right.select(*on, F.col("path").alias("right_path")), on, "full_outer")
    state = F.when(F.col("left_path").isNull(), "right only").when(F.col("right_path").isNull(), "left only").otherwise("paired")
    return both.withColumn("status", state)


def pair_peaks(left: DataFrame, peaks: DataFrame) -> DataFrame:
    """Volumes with the peak file of their frame; of several, that with the last path."""
    last = peaks.groupBy("frame_id").agg(F.max("path").alias("peak_path"))
    return left.join(last, "frame_id")


def latest_annotation(paths: DataFrame, expand: bool = False) -> DataFrame:
    """Of each frame's annotation files, that in the folder annotation_v{N} (with expand, annotation_v{N}_expand) of the largest N."""
    # Fixed value: the form of annotation folders' names.
    version = F.regexp_extract("path", rf"/annotation_v(\d+){'_expand' * expand}/", 1)
    found = paths.withColumn("version", F.when(version != "", version.cast("int"))).where("version IS NOT NULL")
    order = Window.partitionBy("scene_id", "hist_id", "frame_id").orderBy(F.desc("version"), F.desc("path"))
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def resolve_predictions(predictions: DataFrame, frames: DataFrame) -> DataFrame:
    """Prediction files with the data file of the frame that their names tell; status ok, no source or bad name."""
    name = F.element_at(F.split("prediction_path", "/"), -1)
    # Fixed value: the form of prediction files' names.
    part = lambda k: F.regexp_extract(name, r"^(.+?)_(hist\d+)_(.+)_prediction_voxel\.b2$", k)
    named = predictions.withColumns({"scene_id": part(1), "hist_id": part(2), "frame_id": part(3)})
    joined = named.join(frames.select("scene_id", "hist_id", "frame_id", "path"), ["scene_id", "hist_id", "frame_id"], "left")
    return joined.withColumn("status", F.when(F.col("scene_id") == "", "bad name").when(F.col("path").isNull(), "no source").otherwise("ok"))


def written_predictions(spark: SparkSession, path: str) -> DataFrame:
    """scene_id, hist_id, frame_id and prediction_path (a folder) of each frame that volumes.write_predictions() has written below path. Of the files' columns only frame_id is read."""
    try:
        kind = spark.read.parquet(path).schema["frame_id"].dataType.simpleString()
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], "scene_id string, hist_id string, frame_id string, prediction_path string")
    rows = spark.read.schema(f"frame_id {kind}, scene_id string, hist_id string").parquet(path)
    folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("prediction_path")
    return rows.select("scene_id", "hist_id", F.col("frame_id").cast("string").alias("frame_id"), folder).distinct()


def resolve_written(predictions: DataFrame, frames: DataFrame) -> DataFrame:
    """written_predictions() with the path of their frame's data file and a status: ok, or no source."""
    on = ["scene_id", "hist_id", "frame_id"]
    joined = predictions.join(frames.select(*[F.col(c).cast("string").alias(c) for c in on], "path"), on, "left")
    return joined.withColumn("status", F.when(F.col("path").isNull(), "no source").otherwise("ok"))


def pair_clouds(paths: DataFrame) -> DataFrame:
    """stem, gt_path, path: clouds X_gt with their X; those alone are dropped."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.pcd$", "")
    rows = paths.select("path", stem.alias("stem"))
    truth = rows.where(F.col("stem").endswith("_gt")).select(F.regexp_replace("stem", "_gt$", "").alias("stem"), F.col("path").alias("gt_path"))
    return truth.join(rows, "stem")


def cloud_status(paths: DataFrame) -> DataFrame:
    """status, clouds: how many clouds are paired, and how many have a truth or a prediction only."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.pcd$", "")
    truth = stem.endswith("_gt")
    each = paths.groupBy(F.when(truth, F.regexp_replace(stem, "_gt$", "")).otherwise(stem).alias("stem")).agg(F.bool_or(truth).alias("_t"), F.bool_or(~truth).alias("_p"))
    state = F.when(F.col("_t") & F.col("_p"), "paired").when(F.col("_t"), "truth only").otherwise("prediction only")
    return each.groupBy(state.alias("status")).agg(F.count(F.lit(1)).alias("clouds"))


def scene_name(name: Column) -> Column:
    """Of a cloud's file name, sceneNNN at its begin; else the part before the last underscore of its leading run of letters, digits and underscores; else the name."""
    name = F.regexp_replace(name, r"(_gt)?\.pcd$", "")
    digits = F.length(F.regexp_extract(name, r"^scene(\d*)", 1))
    run = F.substring_index(F.regexp_extract(name, r"^\w*", 0), "__", 1)
    doubled = F.substring(name, F.length(run) + 1, F.lit(2)) == "__"
    cut = F.when(doubled, F.length(run)).otherwise(F.length(run) - F.length(F.substring_index(run, "_", -1)) - 1)
    head = F.when((cut > 0) & ~run.startswith("_"), F.substring(name, F.lit(1), cut))
    return F.coalesce(F.when(digits > 0, F.substring(name, F.lit(1), digits + 5)), head, name)
