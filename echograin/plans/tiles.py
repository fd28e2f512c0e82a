"""Queries of tiles, patches, peak tensors and the estimate pipeline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from echograin import fixtures as X
from echograin.operators import estimation as E
from echograin.operators import peaks as P
from echograin.operators import tiles as T
from echograin.plans.base import new_folder, query, rounded
from echograin.plans.waveforms import pick_sql
from echograin.sources import npy as N

V = X.SQL
PATCHES = V + """, pv AS (SELECT frame_id, CAST(((bin // 16) * 2 + y // 4) * 2 + x // 4 AS int) AS patch_id, (bin % 16) * 16 + (y % 4) * 4 + x % 4 AS s, h, x, y, bin FROM d),
 pa AS (SELECT p.frame_id, p.patch_id, list(coalesce(pv.h, 0) ORDER BY i) AS values FROM (SELECT DISTINCT frame_id, patch_id FROM pv) p CROSS JOIN range(256) r(i) LEFT JOIN pv ON pv.frame_id = p.frame_id AND pv.patch_id = p.patch_id AND pv.s = i GROUP BY ALL) """
SHAPE, PATCH = (64, 8, 8), (16, 4, 4)


def patches(spark, d):
    return T.patchify(X.waveforms(spark, d), SHAPE, PATCH)


def masked(spark, d):
    return patches(spark, d).withColumn("masked", (F.col("patch_id") + F.col("frame_id")) % 3 != 0)


@query(PATCHES + "SELECT frame_id, patch_id, values FROM pa")
def patchify(spark, d):
    return patches(spark, d)


@query(V + "SELECT f.frame_id, CAST(b.i AS int) AS bin, CAST(yy.i AS int) AS y, CAST(xx.i AS int) AS x, coalesce(d.h, 0) AS value FROM (SELECT DISTINCT frame_id FROM d) f CROSS JOIN range(64) b(i) CROSS JOIN range(8) yy(i) CROSS JOIN range(8) xx(i) LEFT JOIN d ON d.frame_id = f.frame_id AND d.bin = b.i AND d.y = yy.i AND d.x = xx.i")
def unpatchify(spark, d):
    return T.unpatchify(patches(spark, d), SHAPE, PATCH)


@query(V + "SELECT f.frame_id, CAST(b.i AS int) AS bin, CAST(yy.i AS int) AS y, CAST(xx.i AS int) AS x, CASE WHEN (((b.i // 16) * 2 + yy.i // 4) * 2 + xx.i // 4 + f.frame_id) % 3 <> 0 THEN coalesce(d.h, 0) ELSE 0 END AS value FROM (SELECT DISTINCT frame_id FROM d) f CROSS JOIN range(64) b(i) CROSS JOIN range(8) yy(i) CROSS JOIN range(8) xx(i) LEFT JOIN d ON d.frame_id = f.frame_id AND d.bin = b.i AND d.y = yy.i AND d.x = xx.i")
def unpatchify_masked(spark, d):
    return T.unpatchify(masked(spark, d), SHAPE, PATCH, True)


@query(PATCHES + "SELECT frame_id, patch_id, row_number() OVER (PARTITION BY frame_id ORDER BY md5(concat_ws('-', '0', frame_id, patch_id)), patch_id) <= 11 AS masked FROM pa")
def patch_mask(spark, d):
    return T.patch_mask(patches(spark, d).select("frame_id", "patch_id"), 0.7, 16)


@query(PATCHES + "SELECT frame_id, patch_id, values FROM pa WHERE (patch_id + frame_id) % 3 <> 0")
def masked_patches(spark, d):
    return masked(spark, d).where("masked").drop("masked")


# --- peak tensors ---------------------------------------------------------------------------------------------------

LISTS = V + X.peaks_sql("h >= mx * 0.1", 1.5) + ", pl AS (SELECT frame_id, x, y, CAST(row_number() OVER (PARTITION BY frame_id, x, y ORDER BY bin) - 1 AS int) AS k, bin::double AS position, height, width, (bin + x) % 5 <> 0 AS fields FROM peaks_wide), pt AS (SELECT frame_id, x, y, k, position, height, width FROM pl WHERE k < 4 AND fields AND x < 7) "


def peak_lists(spark, d):
    """Lists of [position, height, width, prominence]; some peaks lack the last field."""
    found = P.relative_peaks(X.waveforms(spark, d), width=1.5)
    some = F.array(F.col("bin").cast("double"), "height", "width")
    one = F.when((F.col("bin") + F.col("x")) % 5 != 0, F.concat(some, F.array("prominence"))).otherwise(some)
    sorted_ = F.array_sort(F.collect_list(F.struct("bin", one.alias("p"))))
    return found.groupBy("frame_id", "x", "y").agg(sorted_.alias("_l")).select("frame_id", "x", "y", F.col("_l.p").alias("peaks"))


@query(LISTS + "SELECT frame_id, x, y, k, position, height, round(width, 6) + 0.0 AS width FROM pl")
def peak_list_explode(spark, d):
    rows = peak_lists(spark, d).select("frame_id", "x", "y", F.posexplode("peaks").alias("k", "p"))
    return rounded(rows.select("frame_id", "x", "y", "k", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("position", "height", "width"))]))


@query(LISTS + "SELECT frame_id, x, y, k, position, height, round(width, 6) + 0.0 AS width FROM pt")
def peak_tensors(spark, d):
    return rounded(T.peak_tensors(peak_lists(spark, d), (7, 8, 64)))


@query(LISTS + "SELECT frame_id, x - 2 AS x, y - 1 AS y, k, position, height, round(width, 6) + 0.0 AS width FROM pt WHERE x >= 2 AND x < 6 AND y >= 1 AND y < 5")
def crop_peak_tensors(spark, d):
    return rounded(T.crop_peak_tensors(T.peak_tensors(peak_lists(spark, d), (7, 8, 64)), (2, 6), (1, 5)))


@query(LISTS + "SELECT frame_id, x - 2 AS x, y - 1 AS y, k, round((position - 4) * (22 / 55::double), 6) + 0.0 AS position, height, round(width, 6) + 0.0 AS width FROM pt WHERE x >= 2 AND x < 6 AND y >= 1 AND y < 5 AND position >= 4 AND position < 60")
def crop_peak_tensors_moved(spark, d):
    return rounded(T.crop_peak_tensors(T.peak_tensors(peak_lists(spark, d), (7, 8, 64)), (2, 6), (1, 5), (4, 60), (56, 23)))


@query(LISTS + "SELECT frame_id, CAST((y // 4) * 2 + x // 4 AS int) AS patch_id, k, round(sum(position) / 16.0, 6) + 0.0 AS position, round(sum(height) / 16.0, 6) + 0.0 AS height, round(sum(width) / 16.0, 6) + 0.0 AS width FROM pt GROUP BY ALL")
def patch_peak_mean(spark, d):
    return rounded(T.patch_peak_mean(T.peak_tensors(peak_lists(spark, d), (7, 8, 64)), (4, 4), 2))


# --- tiles ----------------------------------------------------------------------------------------------------------

TILES = V + ", tl AS (SELECT CAST(row_number() OVER (ORDER BY a.v, b.v) - 1 AS int) AS tile_id, a.v AS x0, b.v AS y0 FROM (VALUES (0), (3), (5)) a(v), (VALUES (0), (4)) b(v)) "


@query(TILES + "SELECT frame_id, tile_id, x0, y0 FROM (SELECT DISTINCT frame_id FROM d) f, tl")
def tile_positions(spark, d):
    return X.waveforms(spark, d).select("frame_id").distinct().select("frame_id", F.inline(T.tile_list(8, 8, (3, 4))))


@query(TILES + ", s AS (SELECT f.frame_id, tl.*, CAST(i.v AS int) AS dx, CAST(j.v AS int) AS dy FROM (SELECT DISTINCT frame_id FROM d) f, tl, range(3) i(v), range(4) j(v)) SELECT s.frame_id, s.tile_id, s.x0, s.y0, s.dx, s.dy, coalesce(w.hist, [0 FOR q IN range(64)]) AS hist FROM s LEFT JOIN w ON w.frame_id = s.frame_id AND w.x = s.x0 + s.dx AND w.y = s.y0 + s.dy")
def extract_tiles(spark, d):
    return T.extract_tiles(X.waveforms(spark, d), 8, 8, (3, 4))


@query(TILES + ", s AS (SELECT d.frame_id, d.x, d.y, d.bin, max_by((d.bin + tl.tile_id) % 4, tl.tile_id) AS label FROM d JOIN tl ON d.x >= x0 AND d.x < x0 + 3 AND d.y >= y0 AND d.y < y0 + 4 GROUP BY ALL) SELECT frame_id, x, y, bin, CAST(label AS int) AS label FROM s")
def stitch_tiles(spark, d):
    rows = X.waveforms(spark, d).select("frame_id", "x", "y", F.inline(T.tile_list(8, 8, (3, 4))), "hist")
    rows = rows.withColumns({"dx": F.col("x") - F.col("x0"), "dy": F.col("y") - F.col("y0")}).where("dx >= 0 AND dx < 3 AND dy >= 0 AND dy < 4")
    rows = rows.select("frame_id", "tile_id", "x0", "y0", "dx", "dy", F.posexplode("hist").alias("bin", "_h"))
    return T.stitch(rows.withColumn("label", ((F.col("bin") + F.col("tile_id")) % 4).cast("int")))


def stub_model():
    """A user's model in a few lines: the rule of tiles.stub_label in Python."""
    return lambda part: pd.Series([[int((v + i) % 4) if v else 0 for i, v in enumerate(h)] for h in part["hist"]], index=part.index)


@query(TILES + ", s AS (SELECT f.frame_id, tl.*, CAST(i.v AS int) AS dx, CAST(j.v AS int) AS dy FROM (SELECT DISTINCT frame_id FROM d) f, tl, range(3) i(v), range(4) j(v)) SELECT s.frame_id, s.tile_id, s.dx, s.dy, [CASE WHEN h = 0 THEN 0 ELSE (h + i - 1) % 4 END FOR h, i IN coalesce(w.hist, [0 FOR q IN range(64)])] AS labels FROM s LEFT JOIN w ON w.frame_id = s.frame_id AND w.x = s.x0 + s.dx AND w.y = s.y0 + s.dy")
def score_tiles(spark, d):
    return T.score_tiles(T.extract_tiles(X.waveforms(spark, d), 8, 8, (3, 4)), stub_model, ["frame_id", "tile_id", "dx", "dy"])


@query(V + f""", c AS (SELECT frame_id, x, y - 1 AS y, [hist[({pick_sql('i', '60', 23)}) + 5] FOR i IN range(23)] AS hist FROM w WHERE y BETWEEN 1 AND 6),
l AS (SELECT frame_id, x, y, CAST(i AS int) AS b, CAST(CASE WHEN hist[i + 1] = 0 THEN 0 ELSE (hist[i + 1] + i) % 4 END AS int) AS label FROM c, range(23) r(i))
SELECT frame_id, x, y, CAST({pick_sql('b', '60', 23)} AS int) AS bin, label FROM l WHERE label <> 0""")
def estimate(spark, d):
    return T.estimate(X.waveforms(spark, d), 8, 8, (3, 4), (1, 1, 4), 64, 23)


@query(V + f""", c AS (SELECT frame_id, x, y - 1 AS y, [hist[({pick_sql('i', '60', 23)}) + 5] FOR i IN range(23)] AS hist FROM w WHERE y BETWEEN 1 AND 6),
tl AS (SELECT CAST(row_number() OVER (ORDER BY a.v, b.v) - 1 AS int) AS tile_id, a.v AS x0, b.v AS y0 FROM (VALUES (0), (3), (5)) a(v), (VALUES (0), (2)) b(v)),
l AS (SELECT c.frame_id, c.x, c.y, CAST(i AS int) AS b, tl.tile_id, CAST((hist[i + 1] + tl.tile_id) % 4 AS int) AS label FROM c JOIN tl ON c.x >= x0 AND c.x < x0 + 3 AND c.y >= y0 AND c.y < y0 + 4, range(23) r(i)),
m AS (SELECT frame_id, x, y, b, max_by(label, tile_id) AS label FROM l GROUP BY ALL)
SELECT frame_id, x, y, CAST({pick_sql('b', '60', 23)} AS int) AS bin, label FROM m WHERE label <> 0""")
def estimate_by_tile(spark, d):
    """A rule that differs from tile to tile: where tiles overlap, noise of the later one counts."""
    rule = lambda hist, tile: F.transform(hist, lambda v: ((v + tile) % 4).cast("int"))
    rows = X.waveforms(spark, d)
    pixels = rows.select("frame_id", "x", (F.col("y") - 1).alias("y"))
    return T.estimate(rows, 8, 8, (3, 4), (1, 1, 4), 64, 23, rule).join(pixels, ["frame_id", "x", "y"], "left_semi")


# --- models of whole tiles ------------------------------------------------------------------------------------------


def box_model():
    """A user's model that reads neighbours: the sum of 3 by 3 pixels of the window, by fours."""

    def run(volume, tile):
        nx, ny, _ = volume.shape
        padded = np.pad(volume, ((1, 1), (1, 1), (0, 0)))
        return sum(padded[i : i + nx, j : j + ny] for i in range(3) for j in range(3)) % 4

    return run


def failing_model():
    """box_model(), which fails on windows whose counts sum to a multiple of 13."""
    box = box_model()

    def run(volume, tile):
        if volume.sum() % 13 == 0:
            raise ArithmeticError("an unlucky window")
        return box(volume, tile)

    return run


def boxed_sql(cells: str, bins: int) -> str:
    """DuckDB: from `cells` (frame_id, x, y, bin, h) and windows tl of 3 by 4 pixels, the label of every place by box_model()."""
    return f"""bx AS (SELECT f.frame_id, tl.*, CAST(i.v AS int) AS dx, CAST(j.v AS int) AS dy, CAST(b.v AS int) AS bin FROM (SELECT DISTINCT frame_id FROM {cells}) f, tl, range(3) i(v), range(4) j(v), range({bins}) b(v)),
bs AS (SELECT bx.frame_id, tile_id, x0, y0, dx, dy, bx.bin, CAST(coalesce(sum(n.h), 0) % 4 AS int) AS label FROM bx LEFT JOIN {cells} n ON n.frame_id = bx.frame_id AND n.bin = bx.bin
  AND n.x BETWEEN greatest(x0, x0 + dx - 1) AND least(x0 + 2, x0 + dx + 1) AND n.y BETWEEN greatest(y0, y0 + dy - 1) AND least(y0 + 3, y0 + dy + 1) GROUP BY ALL)"""


@query(TILES + ", " + boxed_sql("d", 64) + " SELECT frame_id, tile_id, dx, dy, list(label ORDER BY bin) AS labels FROM bs GROUP BY ALL")
def score_tiles_whole(spark, d):
    return T.score_whole_tiles(X.waveforms(spark, d), 8, 8, (3, 4), box_model).select("frame_id", "tile_id", "dx", "dy", "labels")


ESTIMATED = V + f""", c AS (SELECT frame_id, x, y - 1 AS y, [hist[({pick_sql('i', '60', 23)}) + 5] FOR i IN range(23)] AS hist FROM w WHERE y BETWEEN 1 AND 6),
cu AS (SELECT frame_id, x, y, CAST(i AS int) AS bin, hist[i + 1] AS h FROM c, range(23) r(i)),
tl AS (SELECT CAST(row_number() OVER (ORDER BY a.v, b.v) - 1 AS int) AS tile_id, a.v AS x0, b.v AS y0 FROM (VALUES (0), (3), (5)) a(v), (VALUES (0), (2)) b(v)),
""" + boxed_sql("cu", 23) + f""",
bad AS (SELECT DISTINCT frame_id FROM (SELECT u.frame_id, tile_id FROM cu u JOIN tl ON x BETWEEN x0 AND x0 + 2 AND y BETWEEN y0 AND y0 + 3 GROUP BY ALL HAVING sum(h) % 13 = 0)),
mb AS (SELECT frame_id, x0 + dx AS x, y0 + dy AS y, bin AS b, max_by(label, tile_id) AS label FROM bs WHERE frame_id NOT IN (SELECT frame_id FROM bad) GROUP BY ALL),
lb AS (SELECT frame_id, x, y, CAST({pick_sql('b', '60', 23)} AS int) AS bin, label FROM mb WHERE label <> 0)
"""


def estimated(spark, d):
    """An estimate that is interrupted after its first group of frames and then goes on; its folder."""
    rows, to = X.waveforms(spark, d), new_folder(spark)
    frames = rows.select("frame_id").distinct().select(X.scene().alias("scene_id"), F.lit("hist000").alias("hist_id"), "frame_id")

    def stop(number):
        raise InterruptedError

    options = ((3, 4), (1, 1, 4), 64, 23, failing_model)
    try:
        E.estimate_written(rows, frames, to, 8, 8, *options, frames_each=16, after_each=stop)
    except InterruptedError:
        pass
    E.estimate_written(rows, frames, to, 8, 8, *options, frames_each=16)
    return to


@query(ESTIMATED + "SELECT concat('scene', lpad(CAST(frame_id % 3 AS string), 3, '0')) AS scene_id, frame_id, x, y, bin, label FROM lb")
def estimate_written(spark, d):
    """From waveforms to written predictions by a model of whole windows, resumed."""
    return E.predictions(spark, estimated(spark, d)).select("scene_id", "frame_id", "x", "y", "bin", "label")


@query(ESTIMATED + "SELECT frame_id, x, y, bin, label FROM lb")
def estimate_from_files(spark, d):
    """From array files, read by byte ranges, to written predictions."""
    files, to = new_folder(spark), new_folder(spark)
    N.write_volumes(X.waveforms(spark, d), files, (8, 8, X.BINS)).count()
    E.estimate_files(spark, files, to, 8, 8, (3, 4), (1, 1, 4), 64, 23, failing_model, 10_000, frames_each=16)
    return E.predictions(spark, to, "string").select(F.col("frame_id").cast("int").alias("frame_id"), "x", "y", "bin", "label")


@query(ESTIMATED + "SELECT concat('scene', lpad(CAST(f.frame_id % 3 AS string), 3, '0')) AS scene_id, f.frame_id, CASE WHEN f.frame_id IN (SELECT frame_id FROM bad) THEN 'failed' ELSE 'ok' END AS status, count(lb.bin) AS labels, CASE WHEN f.frame_id IN (SELECT frame_id FROM bad) THEN 'ArithmeticError: an unlucky window' END AS error FROM (SELECT DISTINCT frame_id FROM d) f LEFT JOIN lb ON lb.frame_id = f.frame_id GROUP BY ALL")
def estimate_ledger(spark, d):
    """Every frame of the estimate with its outcome."""
    return E.ledger(spark, estimated(spark, d)).select("scene_id", "frame_id", "status", "labels", "error")
