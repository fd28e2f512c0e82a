"""Queries of catalogues, pairing, samples and sinks."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from echograin import fixtures as X
from echograin.operators import peaks as P
from echograin.operators import sampling as S
from echograin.plans.base import new_folder, query, rounded
from echograin.plans.points import clouds
from echograin.sources import catalog as K
from echograin.sources import npy as N
from echograin.sources import volumes as V

#: Frames and their files, the same text in both engines: a frame for each 400 orders.
FRAMES = """SELECT n, concat('scene', lpad(CAST(n % 3 AS string), 3, '0')) AS scene_id, concat('hist', lpad(CAST(n % 10 AS string), 3, '0')) AS hist_id,
 concat('20240115', lpad(CAST(n % 24 AS string), 2, '0'), '3000_', CAST(n AS string), '_', lpad(CAST(n % 7 AS string), 3, '0')) AS frame_id
 FROM (SELECT DISTINCT CAST(floor(l_orderkey / 400) AS int) AS n FROM {lineitem}) q"""
PATHS = """SELECT concat('/d/', scene_id, '/data/', hist_id, '/', frame_id, '_voxel.b2') AS path FROM {f} UNION ALL
 SELECT concat('/d/', scene_id, '/annotation_v1/', hist_id, '/', frame_id, '_annotation_voxel.b2') FROM {f} WHERE n % 5 <> 4 UNION ALL
 SELECT concat('/d/', scene_id, '/annotation_v12/', hist_id, '/', frame_id, '_annotation_voxel.b2') FROM {f} WHERE n % 2 = 0 UNION ALL
 SELECT concat('/d/', scene_id, '/annotation_v3/', hist_id, '/', frame_id, '_annotation_voxel.b2') FROM {f} WHERE n % 3 = 0 UNION ALL
 SELECT concat('/d/peak/', frame_id, '_peak.npy') FROM {f} WHERE n % 4 <> 3 UNION ALL
 SELECT concat('/d/peak_old/', frame_id, '_peak.npy') FROM {f} WHERE n % 4 = 1"""
PREDICTIONS = """SELECT CASE WHEN n % 11 = 5 THEN concat('/p/odd_', frame_id, '.b2') ELSE concat('/p/', scene_id, '_', hist_id, '_', frame_id, CASE WHEN n % 7 = 3 THEN 'x' ELSE '' END, '_prediction_voxel.b2') END AS prediction_path FROM {f}"""
CLOUDS = """SELECT concat('/c/', scene_id, '_', frame_id, '.pcd') AS path FROM {f} WHERE n % 5 <> 2 UNION ALL SELECT concat('/c/', scene_id, '_', frame_id, '_gt.pcd') FROM {f} WHERE n % 6 <> 1"""
D = "WITH f AS (" + FRAMES.format(lineitem="lineitem") + "), p AS (" + PATHS.format(f="f") + r"""), k AS (SELECT path, regexp_replace(regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', ''), '(_annotation)?_voxel$|_peak$', '') AS frame_id,
 CASE WHEN path LIKE '%/scene%' THEN regexp_extract(path, '/(scene[^/]*)/', 1) ELSE 'unknown' END AS scene_id, CASE WHEN path LIKE '%/hist%' THEN regexp_extract(path, '/(hist[^/]*)/', 1) ELSE 'unknown' END AS hist_id FROM p) """


def frames(spark, d):
    return spark.sql(FRAMES.format(lineitem="{lineitem}"), lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))


def paths(spark, d):
    return K.keys(spark.sql(PATHS.format(f="{f}"), f=frames(spark, d)))


@query(D + "SELECT path FROM p WHERE path LIKE '%\\_voxel.b2' ESCAPE '\\' AND path NOT LIKE '%\\_annotation\\_voxel.b2' ESCAPE '\\'")
def frame_catalog(spark, d):
    return K.volumes(paths(spark, d)).select("path")


@query(D + "SELECT path, frame_id, scene_id, hist_id, CAST(split_part(frame_id, '_', 2) AS bigint) AS t, CAST(split_part(frame_id, '_', 3) AS int) AS seq, strftime(strptime(split_part(frame_id, '_', 1), '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S') AS ts FROM k")
def frame_keys(spark, d):
    return paths(spark, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


LEFT = "v AS (SELECT * FROM k WHERE path LIKE '%/data/%'), a AS (SELECT * FROM k WHERE path LIKE '%/annotation_v1/%')"


@query(D + f", {LEFT} SELECT scene_id, hist_id, frame_id, v.path AS left_path, a.path AS right_path, CASE WHEN v.path IS NULL THEN 'right only' WHEN a.path IS NULL THEN 'left only' ELSE 'paired' END AS status FROM v FULL JOIN a USING (scene_id, hist_id, frame_id)")
def pair_frames(spark, d):
    rows = paths(spark, d)
    return K.pair_frames(K.volumes(rows), rows.where(F.col("path").contains("/annotation_v1/")))


@query(D + f", {LEFT} SELECT v.path, v.frame_id, max(q.path) AS peak_path FROM v JOIN k q ON q.frame_id = v.frame_id AND q.path LIKE '%.npy' GROUP BY ALL")
def pair_peaks(spark, d):
    rows = paths(spark, d)
    return K.pair_peaks(K.volumes(rows), rows.where(F.col("path").endswith("_peak.npy"))).select("path", "frame_id", "peak_path")


@query(D + r", v AS (SELECT *, CAST(regexp_extract(path, '/annotation_v(\d+)/', 1) AS int) AS version FROM k WHERE path LIKE '%/annotation_v%') SELECT scene_id, hist_id, frame_id, max(version) AS version, arg_max(path, version) AS path FROM v GROUP BY ALL")
def latest_annotation(spark, d):
    return K.latest_annotation(paths(spark, d)).select("scene_id", "hist_id", "frame_id", "version", "path")


@query(D + f", {LEFT}, q AS (" + PREDICTIONS.format(f="f") + r"""), n AS (SELECT prediction_path, regexp_extract(prediction_path, '/(scene\d+)_(hist\d+)_(.+)_prediction_voxel\.b2$', 1) AS scene_id, regexp_extract(prediction_path, '/(scene\d+)_(hist\d+)_(.+)_prediction_voxel\.b2$', 2) AS hist_id,
 regexp_extract(prediction_path, '/(scene\d+)_(hist\d+)_(.+)_prediction_voxel\.b2$', 3) AS frame_id FROM q) SELECT n.prediction_path, v.path, CASE WHEN n.scene_id = '' THEN 'bad name' WHEN v.path IS NULL THEN 'no source' ELSE 'ok' END AS status FROM n LEFT JOIN v USING (scene_id, hist_id, frame_id)""")
def resolve_predictions(spark, d):
    predictions = spark.sql(PREDICTIONS.format(f="{f}"), f=frames(spark, d))
    return K.resolve_predictions(predictions, K.volumes(paths(spark, d))).select("prediction_path", "path", "status")


@query(D + f", {LEFT}, q AS (" + PREDICTIONS.format(f="f") + r"""), n AS (SELECT q.prediction_path, v.path FROM q LEFT JOIN v ON q.prediction_path = concat('/p/', v.scene_id, '_', v.hist_id, '_', v.frame_id, '_prediction_voxel.b2'))
SELECT CASE WHEN path IS NOT NULL THEN 'ok' WHEN prediction_path LIKE '/p/odd%' THEN 'bad name' ELSE 'no source' END AS status, count(*) AS frames FROM n GROUP BY 1""")
def frame_status(spark, d):
    return K.status(resolve_predictions(spark, d))


@query("WITH f AS (" + FRAMES.format(lineitem="lineitem") + "), c AS (" + CLOUDS.format(f="f") + ") SELECT regexp_replace(regexp_replace(g.path, '^.*/', ''), '_gt.pcd$', '') AS stem, g.path AS gt_path, c.path FROM c g JOIN c ON replace(g.path, '_gt.pcd', '.pcd') = c.path WHERE g.path LIKE '%_gt.pcd'")
def pair_clouds(spark, d):
    return K.pair_clouds(spark.sql(CLOUDS.format(f="{f}"), f=frames(spark, d)))


@query("WITH f AS (" + FRAMES.format(lineitem="lineitem") + "), c AS (" + CLOUDS.format(f="f") + "), s AS (SELECT regexp_replace(regexp_replace(path, '^.*/', ''), '(_gt)?.pcd$', '') AS stem, path LIKE '%_gt.pcd' AS gt FROM c), g AS (SELECT stem, bool_or(gt) AS has_gt, bool_or(NOT gt) AS has_pred FROM s GROUP BY stem) SELECT CASE WHEN has_gt AND has_pred THEN 'paired' WHEN has_gt THEN 'truth only' ELSE 'prediction only' END AS status, count(*) AS clouds FROM g GROUP BY 1")
def cloud_status(spark, d):
    return K.cloud_status(spark.sql(CLOUDS.format(f="{f}"), f=frames(spark, d)))


@query("""WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('scene', CAST(c_custkey AS string), '_hist001_x.pcd') WHEN 1 THEN concat(c_mktsegment, '_run_7_gt.pcd') WHEN 2 THEN c_mktsegment ELSE concat('-', c_mktsegment, '_a.pcd') END AS name FROM customer)
SELECT c_custkey, name, CASE c_custkey % 4 WHEN 0 THEN concat('scene', CAST(c_custkey AS string)) WHEN 1 THEN regexp_replace(name, '_7_gt.pcd$', '') WHEN 2 THEN name ELSE regexp_replace(name, '.pcd$', '') END AS scene FROM n""")
def scene_name(spark, d):
    k, n = F.col("c_custkey"), F.col("c_mktsegment")
    name = F.when(k % 4 == 0, F.concat(F.lit("scene"), k.cast("string"), F.lit("_hist001_x.pcd"))).when(k % 4 == 1, F.concat(n, F.lit("_run_7_gt.pcd"))).when(k % 4 == 2, n).otherwise(F.concat(F.lit("-"), n, F.lit("_a.pcd")))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", name.alias("name")).withColumn("scene", K.scene_name(F.col("name")))


@query("WITH f AS (" + FRAMES.format(lineitem="lineitem") + ") SELECT * FROM f WHERE n % 6 <> 2")
def exclude_frames(spark, d):
    rows = frames(spark, d)
    return K.exclude(rows, rows.where("n % 6 = 2")).select("n", "scene_id", "hist_id", "frame_id")


# --- samples and splits ---------------------------------------------------------------------------------------------


PLAN = "WITH f AS (" + FRAMES.format(lineitem="lineitem") + "), i AS (SELECT frame_id, row_number() OVER (ORDER BY md5(concat_ws('-', '0', frame_id)), frame_id) AS r, count(*) OVER () AS c FROM (SELECT DISTINCT frame_id FROM f)) "


@query(PLAN + "SELECT f.* FROM f JOIN i USING (frame_id) WHERE r <= c // 3")
def sample_frames(spark, d):
    return S.sample_frames(frames(spark, d), 3)


@query(PLAN + "SELECT f.*, CASE WHEN r <= floor(c * 0.8::double) THEN 'train' ELSE 'valid' END AS split FROM f JOIN i USING (frame_id)")
def split_frames(spark, d):
    return S.split_frames(frames(spark, d))


@query("WITH f AS (" + FRAMES.format(lineitem="lineitem") + """), s AS (SELECT DISTINCT scene_id, hist_id, CASE WHEN hist_id = 'hist001' AND scene_id = 'scene002' THEN 'test' WHEN hist_id < 'hist007' THEN 'train' ELSE 'valid' END AS split FROM f)
SELECT f.*, s.split FROM f JOIN s USING (scene_id, hist_id) WHERE s.split = 'test' OR scene_id NOT IN (SELECT scene_id FROM s WHERE split = 'test')""")
def scene_split(spark, d):
    rows = frames(spark, d)
    split = F.when((F.col("hist_id") == "hist001") & (F.col("scene_id") == "scene002"), "test").when(F.col("hist_id") < "hist007", "train").otherwise("valid")
    return S.scene_split(rows, rows.select("scene_id", "hist_id").distinct().withColumn("split", split)).select("n", "scene_id", "hist_id", "frame_id", "split")


@query(X.SQL + """, fine AS (SELECT frame_id, x, y FROM (SELECT frame_id, x, y, ann AS v, ann, pred FROM v_cells UNION ALL SELECT frame_id, x, y, pred, ann, pred FROM v_cells) GROUP BY ALL HAVING count(DISTINCT v) >= 2 AND bool_or(ann <> 0 OR pred <> 0)),
pick AS (SELECT frame_id, x, y, row_number() OVER (PARTITION BY frame_id ORDER BY md5(concat_ws('-', '0', frame_id, x, y)), x, y) AS r FROM fine),
mid AS (SELECT frame_id, CAST(floor((max(x) + 1) / 2) AS int) AS mx, CAST(floor((max(y) + 1) / 2) AS int) AS my FROM v_cells GROUP BY frame_id)
SELECT mid.frame_id, coalesce(p.x, mx) AS x, coalesce(p.y, my) AS y FROM mid LEFT JOIN pick p ON p.frame_id = mid.frame_id AND p.r = 1""")
def random_pixel(spark, d):
    return S.random_pixel(X.cells(spark, d).select("frame_id", "x", "y", "ann", "pred"))


@query(X.SQL + X.peaks_sql("h >= mx * 0.1", 3) + ", pick AS (SELECT frame_id, x, y, bin, row_number() OVER (PARTITION BY frame_id ORDER BY md5(concat_ws('-', '0', frame_id, x, y, bin)), x, y, bin) AS r FROM peaks_wide) SELECT frame_id, x, y, bin FROM pick WHERE r = 1")
def random_peak(spark, d):
    return S.random_peak(P.relative_peaks(X.waveforms(spark, d)))


@query(X.SQL + "SELECT frame_id, x, y, bin, ann AS label FROM v_cells WHERE ann <> 0 ORDER BY md5(concat_ws('-', '0', frame_id, x, y, bin)), frame_id, x, y, bin LIMIT 500")
def cap_rows(spark, d):
    return S.cap_rows(X.labels(spark, d), 500, ["frame_id", "x", "y", "bin"])


# --- sinks and sources ----------------------------------------------------------------------------------------------


@query(X.SQL + "SELECT concat('scene', lpad(CAST(frame_id % 3 AS string), 3, '0')) AS scene_id, CAST(frame_id AS bigint) AS frame_id, x, y, bin, pred AS label FROM v_cells WHERE pred <> 0")
def write_predictions(spark, d):
    rows = X.labels(spark, d, "pred").withColumns({"scene_id": X.scene(), "hist_id": F.lit("hist000")})
    path = new_folder(spark)
    for part in (rows.where("frame_id % 2 = 0"), rows.where("frame_id % 2 = 1")):  # what one call wrote stays when another writes other frames
        V.write_predictions(part, path)
    return spark.read.parquet(path).select("scene_id", F.col("frame_id").cast("bigint").alias("frame_id"), "x", "y", "bin", "label")


@query("SELECT concat('scene00', CAST(vec_id % 3 AS string), '_', CAST(vec_id % 2 AS string)) AS cloud_id, 'gt' AS role, vec_id AS point_id, CAST(embedding[1] AS double) AS pos_x, CAST(embedding[2] AS double) AS pos_y, CAST(embedding[3] AS double) AS pos_z, CAST(label % 4 AS int) AS label FROM embeddings")
def write_points(spark, d):
    path = new_folder(spark)
    V.write_points(clouds(spark, d), path)
    return V.read_points(spark, path).select("cloud_id", "role", "point_id", "pos_x", "pos_y", "pos_z", "label")


@query("SELECT concat('scene00', CAST(vec_id % 3 AS string), '_', CAST(vec_id % 2 AS string)) AS cloud_id, count(*) AS points FROM embeddings GROUP BY 1")
def read_points(spark, d):
    path = new_folder(spark)
    V.write_points(clouds(spark, d), path)
    return V.read_points(spark, path).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("points"))


@query(X.SQL + "SELECT concat('scene_id=scene', lpad(CAST(frame_id % 3 AS string), 3, '0')) AS scene_id, concat('frame=', frame_id) AS frame, CAST(1 AS bigint) AS files FROM px GROUP BY ALL")
def list_frame_files(spark, d):
    """Files of frames written by scene and frame, listed by name."""
    path = new_folder(spark)
    rows = X.waveforms(spark, d).select("*", X.scene().alias("scene_id"), F.col("frame_id").alias("frame"))
    V.write_partitioned(rows, path, ["scene_id", "frame"], ["x", "y"])
    found = K.keys(K.list_files(spark, [path], "*.parquet", True))
    return found.groupBy("scene_id", F.element_at(F.split("path", "/"), -2).alias("frame")).agg(F.count(F.lit(1)).alias("files"))


@query(X.SQL + "SELECT frame_id, count(*) AS pixels, CAST(min(len(hist)) AS int) AS least_bins, CAST(max(len(hist)) AS int) AS most_bins FROM (SELECT frame_id, CASE WHEN frame_id % 3 = 0 AND x = 0 THEN hist[1:60] ELSE hist END AS hist FROM w WHERE NOT (frame_id % 4 = 2 AND y = 0)) GROUP BY frame_id HAVING count(*) <> 64 OR min(len(hist)) <> 64")
def validate_frames(spark, d):
    """Frames of 64 pixels and bins; some are made to lack a line of pixels or the last bins of a column."""
    short = F.when((F.col("frame_id") % 3 == 0) & (F.col("x") == 0), F.slice("hist", 1, 60)).otherwise(F.col("hist"))
    rows = X.waveforms(spark, d).where("NOT (frame_id % 4 = 2 AND y = 0)").withColumn("hist", short)
    return V.validate(rows, 64, 64)


def packed_frames(spark, d):
    """Each frame's volume as the bytes of an array file; every ninth one is broken."""

    def pack(parts):
        for part in parts:
            out = []
            for frame, pixels in zip(part["frame_id"], part["pixels"], strict=True):
                volume = np.zeros((8, 8, X.BINS), np.int64)
                for p in pixels:
                    volume[p["x"], p["y"]] = p["hist"]
                buffer = io.BytesIO()
                np.save(buffer, volume)
                out.append(buffer.getvalue()[: 40 if frame % 9 == 8 else None])
            yield pd.DataFrame({"path": part["frame_id"].astype(str), "content": out})

    frames_ = X.waveforms(spark, d).groupBy("frame_id").agg(F.collect_list(F.struct("x", "y", "hist")).alias("pixels"))  # a frame has a fixed number of pixels
    return frames_.mapInPandas(pack, "path string, content binary")


@query(X.SQL + "SELECT f.frame_id, CAST(i.v AS int) AS x, CAST(j.v AS int) AS y, coalesce(w.hist[4:64], [0 FOR q IN range(61)]) AS hist FROM (SELECT DISTINCT frame_id FROM d WHERE frame_id % 9 <> 8) f CROSS JOIN range(8) i(v) CROSS JOIN range(8) j(v) LEFT JOIN w ON w.frame_id = f.frame_id AND w.x = i.v AND w.y = j.v")
def volume_to_waveforms(spark, d):
    rows = V.unpack(packed_frames(spark, d), 3)
    return rows.where("error IS NULL").select(F.col("path").cast("int").alias("frame_id"), "x", "y", "hist")


@query(X.SQL + "SELECT CASE WHEN frame_id % 9 = 8 THEN 'failed' ELSE 'ok' END AS status, count(*) AS frames FROM (SELECT DISTINCT frame_id FROM d) GROUP BY 1")
def volume_status(spark, d):
    return K.status(V.outcomes(V.unpack(packed_frames(spark, d), 3)))


def packed_tables(spark, d):
    """Each frame's waveforms as the bytes of an archive with pixel_x, pixel_y and hist_data; every seventh one lacks an array."""

    def pack(parts):
        for part in parts:
            out = []
            for frame, pixels in zip(part["frame_id"], part["pixels"], strict=True):
                pixels = sorted(pixels, key=lambda p: (p["x"], p["y"]))
                arrays = {"pixel_x": np.array([p["x"] for p in pixels]), "pixel_y": np.array([p["y"] for p in pixels]), "hist_data": np.array([p["hist"] for p in pixels], np.int64)}
                if frame % 7 == 3:
                    del arrays["pixel_y"]
                if frame % 2:  # counts as text
                    arrays["hist_data"] = np.array([str(list(map(int, p["hist"]))).replace(",", "") for p in pixels])
                buffer = io.BytesIO()
                np.savez(buffer, **arrays)
                out.append(buffer.getvalue())
            yield pd.DataFrame({"path": part["frame_id"].astype(str), "content": out})

    frames_ = X.waveforms(spark, d).groupBy("frame_id").agg(F.collect_list(F.struct("x", "y", "hist")).alias("pixels"))  # a frame has a fixed number of pixels
    return frames_.mapInPandas(pack, "path string, content binary")


@query(X.SQL + "SELECT frame_id, x, y, hist[3:64] AS hist FROM w WHERE frame_id % 7 <> 3")
def pixel_table_to_waveforms(spark, d):
    rows = V.unpack(packed_tables(spark, d), 2)
    return rows.where("error IS NULL").select(F.col("path").cast("int").alias("frame_id"), "x", "y", "hist")


@query(X.SQL + X.peaks_sql("h >= mx * 0.1", 1.5) + "SELECT frame_id, x, y, CAST(row_number() OVER (PARTITION BY frame_id, x, y ORDER BY bin) - 1 AS int) AS k, bin::double AS position, height, round(width, 6) + 0.0 AS width FROM peaks_wide")
def peak_list_source(spark, d):
    """Peak lists written as Parquet by scene and frame, and read again."""
    from echograin.plans.tiles import peak_lists

    path = new_folder(spark)
    V.write_peak_lists(peak_lists(spark, d).withColumn("scene_id", X.scene()), path)
    rows = V.read_peak_lists(spark, path).select("frame_id", "x", "y", F.posexplode("peaks").alias("k", "p"))
    return rounded(rows.select("frame_id", "x", "y", "k", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("position", "height", "width"))]))


@query(X.SQL + "SELECT f.frame_id, CAST(i.v AS int) AS x, CAST(j.v AS int) AS y, coalesce(w.hist[4:64], [0 FOR q IN range(61)]) AS hist FROM (SELECT DISTINCT frame_id FROM d) f CROSS JOIN range(8) i(v) CROSS JOIN range(8) j(v) LEFT JOIN w ON w.frame_id = f.frame_id AND w.x = i.v AND w.y = j.v")
def volume_slabs(spark, d):
    """Each frame's volume written as an array file, and read by byte ranges, in several tasks a file."""
    path = new_folder(spark)
    N.write_volumes(X.waveforms(spark, d), path, (8, 8, X.BINS)).count()
    rows = N.read_slabs(spark, path, 3, 10_000)
    return rows.where("error IS NULL").select(F.regexp_extract("path", r"(\d+)\.npy$", 1).cast("int").alias("frame_id"), "x", "y", "hist")


@query(X.SQL + "SELECT f.frame_id, CAST(i.v AS int) AS x, CAST(j.v AS int) AS y, coalesce(w.hist[4:64], [0 FOR q IN range(61)]) AS hist FROM (SELECT DISTINCT frame_id FROM d) f CROSS JOIN range(8) i(v) CROSS JOIN range(8) j(v) LEFT JOIN w ON w.frame_id = f.frame_id AND w.x = i.v AND w.y = j.v")
def volume_files(spark, d):
    """Each frame's volume written as an array file, and read where tasks can map files into memory."""
    path = new_folder(spark)
    N.write_volumes(X.waveforms(spark, d), path, (8, 8, X.BINS)).count()
    rows = V.read_volumes(spark, path, 3, mounted=True)
    return rows.where("error IS NULL").select(F.regexp_extract("path", r"(\d+)\.npy$", 1).cast("int").alias("frame_id"), "x", "y", "hist")


WRITTEN = D + ", v AS (SELECT * FROM k WHERE path LIKE '%/data/%'), l AS (SELECT n, scene_id, hist_id, CASE WHEN n % 7 = 3 THEN concat(frame_id, 'x') ELSE frame_id END AS frame_id FROM f) "


@query(WRITTEN + "SELECT l.scene_id, l.hist_id, l.frame_id, v.path, CASE WHEN v.path IS NULL THEN 'no source' ELSE 'ok' END AS status, CAST(1 + n % 3 AS bigint) AS labels FROM l LEFT JOIN v USING (scene_id, hist_id, frame_id)")
def resolve_written_predictions(spark, d):
    """Predictions written by frame, found again by their folders' names, joined with their data files, and read."""
    path, rows = new_folder(spark), frames(spark, d)
    name = F.when(F.col("n") % 7 == 3, F.concat("frame_id", F.lit("x"))).otherwise(F.col("frame_id"))
    labels = rows.select("scene_id", "hist_id", name.alias("frame_id"), F.explode(F.sequence(F.lit(0), F.col("n") % 3)).alias("x"), F.lit(0).alias("y"), F.lit(5).alias("bin"), F.lit(1).alias("label"))
    V.write_predictions(labels, path)
    found = K.resolve_written(K.written_predictions(spark, path), K.volumes(paths(spark, d))).drop("prediction_path")
    counts = spark.read.parquet(path).groupBy("frame_id").agg(F.count(F.lit(1)).alias("labels"))
    return found.join(counts, "frame_id").select("scene_id", "hist_id", "frame_id", "path", "status", "labels")
