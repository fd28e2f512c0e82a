"""Queries of geometry, colours, radius joins and ghost removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from echograin import fixtures as X
from echograin.operators import metrics as M
from echograin.operators import peaks as P
from echograin.operators import points as G
from echograin.operators import radius as N
from echograin.plans.base import new_folder, query, rounded
from echograin.plans.waveforms import B_POINT, MPB, PEAK_RANGE
from echograin.sources import catalog

RADIUS = 0.05
#: DuckDB: embeddings as points of six clouds, their truth and a prediction that lost points and moved others.
PTS = """WITH pts AS (SELECT vec_id AS point_id, CAST(embedding[1] AS double) AS pos_x, CAST(embedding[2] AS double) AS pos_y, CAST(embedding[3] AS double) AS pos_z, CAST(label % 4 AS int) AS label,
 concat('scene00', CAST(vec_id % 3 AS string), '_', CAST(vec_id % 2 AS string)) AS cloud_id FROM embeddings),
prd AS (SELECT point_id, cloud_id, pos_x + CASE WHEN point_id % 3 = 0 THEN 0.0 ELSE 0.0005 END AS pos_x, pos_y, pos_z, label FROM pts WHERE point_id % 5 <> 0 AND NOT (label = 3 AND point_id % 2 = 0)) """


def clouds(spark, d, role: str = "gt"):
    at = lambda k: F.element_at("embedding", k).cast("double")
    name = F.concat(F.lit("scene00"), (F.col("vec_id") % 3).cast("string"), F.lit("_"), (F.col("vec_id") % 2).cast("string"))
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("point_id"), at(1).alias("pos_x"), at(2).alias("pos_y"), at(3).alias("pos_z"), (F.col("label") % 4).cast("int").alias("label"), name.alias("cloud_id"))
    if role == "pred":
        rows = rows.where("point_id % 5 <> 0 AND NOT (label = 3 AND point_id % 2 = 0)")
        rows = rows.withColumn("pos_x", F.col("pos_x") + F.when(F.col("point_id") % 3 == 0, 0.0).otherwise(0.0005))
    return rows.withColumn("role", F.lit(role))


def ranged(spark, d):
    return G.ranged(P.relative_peaks(X.waveforms(spark, d), ranged=True)).select("frame_id", "x", "y", "bin", "distance_m")


A_POINT = "round(dm * cos(radians(x * 0.1)) * cos(radians(25.6 - y * 0.05)), 6) + 0.0 AS pos_x, round(dm * sin(radians(x * 0.1)) * cos(radians(25.6 - y * 0.05)), 6) + 0.0 AS pos_y, round(-dm * sin(radians(25.6 - y * 0.05)), 6) + 0.0 AS pos_z"
S_POINT = "round(dm * cos(radians((x * 47 - 4512) / 100.0)) * cos(radians((y * 47 - 1316) / 100.0)), 6) + 0.0 AS pos_x, round(-1 * dm * sin(radians((x * 47 - 4512) / 100.0)) * cos(radians((y * 47 - 1316) / 100.0)), 6) + 0.0 AS pos_y, round(-dm * sin(radians((y * 47 - 1316) / 100.0)), 6) + 0.0 AS pos_z"


@query(PEAK_RANGE + f" SELECT frame_id, x, y, bin, round(dm, 6) + 0.0 AS distance_m, {A_POINT} FROM fw")
def spd_points_a(spark, d):
    return rounded(G.spd_points_a(ranged(spark, d)))


@query(PEAK_RANGE + f" SELECT frame_id, x, y, bin, round(dm, 6) + 0.0 AS distance_m, {B_POINT} FROM fw")
def spd_points_b(spark, d):
    return rounded(G.spd_points_b(ranged(spark, d)))


@query(PEAK_RANGE + f", so AS (SELECT frame_id, x, y, bin, dm + 3 * {MPB} AS dm FROM fw) SELECT frame_id, x, y, bin, round(dm, 6) + 0.0 AS distance_m, {S_POINT} FROM so")
def srl_points_offset(spark, d):
    found = G.ranged(P.relative_peaks(X.waveforms(spark, d), ranged=True), bin_offset=3).select("frame_id", "x", "y", "bin", "distance_m")
    return rounded(G.srl_points(found))


@query(PEAK_RANGE + f" SELECT frame_id, x, y, bin, round(dm, 6) + 0.0 AS distance_m, {S_POINT} FROM fw")
def srl_points(spark, d):
    return rounded(G.srl_points(ranged(spark, d)))


@query(f"WITH f AS (SELECT vec_id, vec_id % 400 AS x, vec_id * 7 % 512 AS y, CAST(label AS double) + 0.5 AS dm FROM embeddings) SELECT vec_id, x, y, dm AS depth, {B_POINT} FROM f")
def depth_points(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", (F.col("vec_id") % 400).alias("x"), (F.col("vec_id") * 7 % 512).alias("y"), (F.col("label").cast("double") + 0.5).alias("Depth"))
    return rounded(G.depth_points(rows, 12).withColumnRenamed("Depth", "depth"))


RGB = "CASE label WHEN 0 THEN [0.5, 0.5, 0.5] WHEN 1 THEN [0.0, 1.0, 0.0] WHEN 2 THEN [0.0, 0.0, 1.0] WHEN 3 THEN [1.0, 0.0, 0.0] WHEN -1 THEN [1.0, 1.0, 1.0] ELSE [0.0, 0.0, 0.0] END"


@query(f"WITH c AS (SELECT vec_id, CAST(label - 1 AS int) AS label FROM embeddings) SELECT vec_id, label, CAST(({RGB})[1] AS double) AS r, CAST(({RGB})[2] AS double) AS g, CAST(({RGB})[3] AS double) AS b FROM c")
def label_colors(spark, d):
    return G.coloured(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", (F.col("label") - 1).cast("int").alias("label")))


@query("""SELECT vec_id, CASE label - 1 WHEN 1 THEN '#1f77b4' WHEN 2 THEN '#ff7f0e' WHEN 3 THEN '#2ca02c' ELSE '#808080' END AS chart, CASE label - 1 WHEN 1 THEN '#00a65a' WHEN 2 THEN '#1f77b4' WHEN 3 THEN '#d62728' ELSE '#808080' END AS viewer FROM embeddings""")
def label_hex_colors(spark, d):
    label = F.col("label") - 1
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", G.hex_colour(label).alias("chart"), G.hex_colour(label, G.VIEWER).alias("viewer"))


@query("""WITH c AS (SELECT vec_id, CAST((vec_id * 3 % 11) / 10.0 AS double) AS r, CAST((vec_id * 5 % 11) / 10.0 AS double) AS g, CAST((vec_id * 7 % 11) / 10.0 AS double) AS b FROM embeddings)
SELECT vec_id, r, g, b, CAST(CASE WHEN r < 0.1 AND g > 0.9 AND b < 0.1 THEN 1 WHEN r < 0.1 AND g < 0.1 AND b > 0.9 THEN 2 WHEN r > 0.9 AND g < 0.1 AND b < 0.1 THEN 3
 WHEN r BETWEEN 0.4 AND 0.6 AND g BETWEEN 0.4 AND 0.6 AND b BETWEEN 0.4 AND 0.6 THEN 0 END AS int) AS colour_label FROM c""")
def color_classes(spark, d):
    part = lambda k: ((F.col("vec_id") * k % 11) / 10.0).cast("double")
    return G.colour_class(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", part(3).alias("r"), part(5).alias("g"), part(7).alias("b")))


@query(PTS + ", s AS (SELECT *, ln(1 + sqrt(pos_x * pos_x + pos_y * pos_y + pos_z * pos_z)) AS f FROM pts) SELECT cloud_id, point_id, round(CASE WHEN max(f) OVER c > min(f) OVER c THEN (f - min(f) OVER c) / (max(f) OVER c - min(f) OVER c) ELSE 0 END, 6) + 0.0 AS scale FROM s WINDOW c AS (PARTITION BY cloud_id)")
def distance_scale(spark, d):
    return rounded(G.distance_scale(clouds(spark, d)).select("cloud_id", "point_id", "scale"))


@query(X.SQL + X.peaks_sql("h >= mx * 0.1", 3) + "SELECT k.frame_id, k.x, k.y, k.bin, d.ann AS label FROM peaks_wide k JOIN d USING (frame_id, x, y, bin)")
def label_peaks(spark, d):
    return G.labelled(P.relative_peaks(X.waveforms(spark, d)), X.labels(spark, d)).select("frame_id", "x", "y", "bin", "label")


@query(PTS + "SELECT p.point_id, p.cloud_id, p.label FROM pts p SEMI JOIN prd r ON r.cloud_id = p.cloud_id AND r.pos_x = p.pos_x AND r.pos_y = p.pos_y AND r.pos_z = p.pos_z")
def match_exact(spark, d):
    return G.within(clouds(spark, d), clouds(spark, d, "pred"), 0, ["cloud_id"]).select("point_id", "cloud_id", "label")


NEAR = "(p.pos_x - r.pos_x) ** 2 + (p.pos_y - r.pos_y) ** 2 + (p.pos_z - r.pos_z) ** 2 <= {r} * {r}"


@query(PTS + f"SELECT p.point_id, p.cloud_id, p.label FROM pts p WHERE EXISTS (SELECT 1 FROM prd r WHERE r.cloud_id = p.cloud_id AND {NEAR.format(r='0.05::double')})")
def match_radius(spark, d):
    return G.within(clouds(spark, d), clouds(spark, d, "pred"), RADIUS, ["cloud_id"]).select("point_id", "cloud_id", "label")


@query(PTS + f"SELECT p.point_id, p.cloud_id, p.label FROM pts p WHERE NOT EXISTS (SELECT 1 FROM pts r WHERE r.label = 3 AND r.cloud_id = p.cloud_id AND {NEAR.format(r='0.1::double')})")
def remove_ghost_neighbors(spark, d):
    return G.without_ghost_neighbours(clouds(spark, d), 0.1, ["cloud_id"]).select("point_id", "cloud_id", "label")


@query(PTS + f"SELECT p.point_id, p.cloud_id, p.label FROM pts p WHERE EXISTS (SELECT 1 FROM prd r WHERE r.cloud_id = p.cloud_id AND {NEAR.format(r='0.3::double')})")
def match_radius_refined(spark, d):
    """A wide radius, in whose cells many points meet: cells are cut until few are compared."""
    return N.within_refined(clouds(spark, d), clouds(spark, d, "pred"), 0.3, ["cloud_id"], new_folder(spark)).select("point_id", "cloud_id", "label")


@query(PTS + f"SELECT p.point_id, p.cloud_id, p.label FROM pts p WHERE NOT EXISTS (SELECT 1 FROM pts r WHERE r.label = 3 AND r.cloud_id = p.cloud_id AND {NEAR.format(r='0.1::double')})")
def remove_ghost_neighbors_refined(spark, d):
    return N.without_ghost_neighbours_refined(clouds(spark, d), 0.1, ["cloud_id"], new_folder(spark)).select("point_id", "cloud_id", "label")


@query("SELECT vec_id, CAST(label - 1 AS int) AS label FROM embeddings WHERE label - 1 NOT IN (0, -1)")
def visible_points(spark, d):
    return G.visible(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", (F.col("label") - 1).cast("int").alias("label")))


@query(PTS + "SELECT point_id, label FROM pts WHERE label <> 3")
def skip_ghosts(spark, d):
    return G.visible(clouds(spark, d), noise=True, undefined=True, skip_ghosts=True).select("point_id", "label")


@query(PTS + "SELECT cloud_id, count(*) AS ghosts FROM pts WHERE label = 3 GROUP BY cloud_id")
def ghost_points(spark, d):
    return clouds(spark, d).where("label = 3").groupBy("cloud_id").agg(F.count(F.lit(1)).alias("ghosts"))


@query(PTS + "SELECT cloud_id, count(*) FILTER (label = 0) AS noise, count(*) FILTER (label = 1) AS object, count(*) FILTER (label = 2) AS glass, count(*) FILTER (label = 3) AS ghost FROM pts GROUP BY cloud_id")
def point_counts(spark, d):
    names = ("noise", "object", "glass", "ghost")
    return clouds(spark, d).groupBy("cloud_id").agg(*[F.count_if(F.col("label") == k).alias(n) for k, n in enumerate(names)])


@query(PEAK_RANGE + f""", pt AS (SELECT f.frame_id, f.x, f.y, f.bin, d.ann AS label, f.dm AS distance_m, {A_POINT.replace('round(', '(').replace(', 6) + 0.0', ')')} FROM fw f JOIN d USING (frame_id, x, y, bin) WHERE d.ann <> 0)
SELECT frame_id, x, y, bin, label, round(distance_m, 6) + 0.0 AS distance_m, round(pos_x, 6) + 0.0 AS pos_x, round(pos_y, 6) + 0.0 AS pos_y, round(pos_z, 6) + 0.0 AS pos_z, {RGB.replace('label', 'p.label')}[1]::double AS r, {RGB.replace('label', 'p.label')}[2]::double AS g, {RGB.replace('label', 'p.label')}[3]::double AS b
FROM pt p WHERE NOT EXISTS (SELECT 1 FROM pt r WHERE r.label = 3 AND r.frame_id = p.frame_id AND {NEAR.format(r='0.3::double')})""".replace("CASE p.label", "(CASE p.label").replace("END[", "END)["))
def peaks_to_points(spark, d):
    points = G.peaks_to_points(X.waveforms(spark, d), X.labels(spark, d), ghost_radius=0.3)
    return rounded(G.coloured(points).select("frame_id", "x", "y", "bin", "label", "distance_m", "pos_x", "pos_y", "pos_z", "r", "g", "b"))


GR = PTS + """, k AS (SELECT p.*, EXISTS (SELECT 1 FROM prd r WHERE r.cloud_id = p.cloud_id AND """ + NEAR.format(r="0.001::double") + """) AS stays FROM pts p),
c AS (SELECT cloud_id, count(*) FILTER (label = 3) AS num_gt_ghost, count(*) FILTER (label = 3 AND stays) AS num_remaining_ghost, count(*) FILTER (label = 1) AS num_gt_object, count(*) FILTER (label = 1 AND stays) AS num_remaining_object,
 count(*) FILTER (label = 2) AS num_gt_glass, count(*) FILTER (label = 2 AND stays) AS num_remaining_glass FROM k GROUP BY cloud_id),
gr AS (SELECT *, num_gt_ghost - num_remaining_ghost AS num_removed_ghost, num_gt_object + num_gt_glass AS num_gt_object_glass, num_remaining_object + num_remaining_glass AS num_remaining_object_glass,
 coalesce((num_gt_ghost - num_remaining_ghost) / nullif(num_gt_ghost, 0), 0) AS removal_rate, coalesce(num_remaining_object / nullif(num_gt_object, 0), 0) AS object_residual_rate,
 coalesce(num_remaining_glass / nullif(num_gt_glass, 0), 0) AS glass_residual_rate, coalesce((num_remaining_object + num_remaining_glass) / nullif(num_gt_object + num_gt_glass, 0), 0) AS object_glass_residual_rate FROM c),
bs AS (SELECT regexp_extract(cloud_id, '^(scene\\d+)', 1) AS scene, count(*) AS files, {means}, {sums} FROM gr GROUP BY 1) """.replace(
    "{means}", ", ".join(f"avg({c}) AS {c}" for c in M.RATES)).replace("{sums}", ", ".join(f"CAST(sum({c}) AS bigint) AS {c}" for c in M.COUNTS))
R_RATES = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in M.RATES)


def removal(spark, d):
    return M.ghost_removal(clouds(spark, d).unionByName(clouds(spark, d, "pred")), 0.001)


@query(GR + f"SELECT * EXCLUDE ({', '.join(M.RATES)}), {R_RATES} FROM gr")
def ghost_removal(spark, d):
    return rounded(removal(spark, d))


def by_scene(spark, d):
    return M.removal_by_scene(removal(spark, d).withColumn("scene", catalog.scene_name(F.col("cloud_id"))))


@query(GR + f"SELECT * EXCLUDE ({', '.join(M.RATES)}), {R_RATES} FROM bs")
def removal_by_scene(spark, d):
    return rounded(by_scene(spark, d))


@query(GR + "SELECT count(*) AS scenes, CAST(sum(files) AS bigint) AS files, " + ", ".join(f"round(avg({c}), 6) + 0.0 AS {c}" for c in M.RATES) + ", " + ", ".join(f"CAST(sum({c}) AS bigint) AS {c}" for c in M.COUNTS) + " FROM bs")
def removal_overall(spark, d):
    return rounded(M.removal_overall(by_scene(spark, d)))


