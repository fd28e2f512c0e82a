"""Queries of peak evaluation, reports and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from echograin import constants as C
from echograin import fixtures as X
from echograin.operators import metrics as M
from echograin.operators import peaks as P
from echograin.operators import points as G
from echograin.operators import tiles as T
from echograin.plans.base import EVALUATED, evaluated, new_folder, query, rounded
from echograin.sources import bucketed as B

NAMES = "CASE class WHEN 0 THEN 'noise' WHEN 1 THEN 'object' WHEN 2 THEN 'glass' WHEN 3 THEN 'ghost' END"


@query(EVALUATED + "SELECT frame_id, x, y, bin, ann, pred, scene_id FROM ev WHERE ann <> 0")
def peak_eval_rows(spark, d):
    return evaluated(spark, d).where("ann <> 0").select("frame_id", "x", "y", "bin", "ann", "pred", "scene_id")


@query(EVALUATED + "SELECT frame_id, x, y, bin, ann, pred FROM ev")
def label_peaks_bucketed(spark, d):
    """Peaks, labels and predictions kept in buckets of voxels, joined in place."""
    path = new_folder(spark)
    tables = (P.relative_peaks(X.waveforms(spark, d)).select(*B.VOXEL), X.labels(spark, d), X.labels(spark, d, "pred"))
    found, truth, guess = (B.write_bucketed(rows, f"{path}/{k}", 8) for k, rows in enumerate(tables))
    return G.labelled(G.labelled(found, truth, "ann"), guess, "pred")


@query(EVALUATED + "SELECT scene_id, ann, pred, n FROM cm")
def confusion(spark, d):
    return M.confusion(evaluated(spark, d), ["scene_id"])


@query(EVALUATED + """SELECT scene_id, ann, pred, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY scene_id, ann), 0), 0), 6) + 0.0 AS by_true,
 round(coalesce(n / nullif(sum(n) OVER (PARTITION BY scene_id, pred), 0), 0), 6) + 0.0 AS by_pred, round(n / sum(n) OVER (PARTITION BY scene_id), 6) + 0.0 AS by_all FROM cm""")
def confusion_norm(spark, d):
    return rounded(M.normalised(M.confusion(evaluated(spark, d), ["scene_id"]), ["scene_id"]))


@query(EVALUATED + "SELECT scene_id, class, tp, fp, fn, support, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1 FROM prf")
def class_prf(spark, d):
    return rounded(M.scene_prf(evaluated(spark, d)))


@query(EVALUATED + "SELECT scene_id, round(avg(precision), 6) + 0.0 AS macro_precision, round(avg(recall), 6) + 0.0 AS macro_recall, round(avg(f1), 6) + 0.0 AS macro_f1 FROM prf WHERE class <> 0 GROUP BY scene_id")
def macro_prf(spark, d):
    return rounded(M.macro(M.scene_prf(evaluated(spark, d)), ["scene_id"], (0,)))


@query(EVALUATED + "SELECT scene_id, count(*) AS total, count(*) FILTER (ann = pred) AS correct, round(avg(CAST(ann = pred AS int)), 6) + 0.0 AS accuracy FROM ev GROUP BY scene_id")
def peak_accuracy(spark, d):
    return rounded(M.accuracy(evaluated(spark, d), ["scene_id"]))


@query(EVALUATED + "SELECT scene_id, c AS class, count(*) FILTER (ann = c) AS gt, count(*) FILTER (pred = c) AS predicted FROM ev, cl GROUP BY scene_id, c")
def class_distribution(spark, d):
    return M.distribution(evaluated(spark, d), ["scene_id"])


ROLLUP = EVALUATED.replace("cl AS (", "ev2 AS (SELECT * FROM ev UNION ALL SELECT frame_id, x, y, bin, ann, pred, 'all' FROM ev), cl AS (").replace("FROM (SELECT DISTINCT scene_id FROM ev) s", "FROM (SELECT DISTINCT scene_id FROM ev2) s").replace("FROM ev WHERE ev.scene_id = s.scene_id AND ev.ann = a.c AND ev.pred = p.c", "FROM ev2 WHERE ev2.scene_id = s.scene_id AND ev2.ann = a.c AND ev2.pred = p.c")


@query(ROLLUP + """SELECT e.scene_id, count(*) AS total, count(*) FILTER (ann = pred) AS correct, round(avg(CAST(ann = pred AS int)), 6) + 0.0 AS accuracy, round(any_value(p), 6) + 0.0 AS macro_precision,
 round(any_value(r), 6) + 0.0 AS macro_recall, round(any_value(f), 6) + 0.0 AS macro_f1 FROM ev2 e JOIN mac USING (scene_id) GROUP BY e.scene_id""")
def scene_rollup(spark, d):
    return rounded(M.scene_rollup(evaluated(spark, d)))


@query(EVALUATED + """, m AS (SELECT class, avg(precision) AS p, avg(recall) AS r FROM prf GROUP BY class UNION ALL SELECT NULL, avg(p), avg(r) FROM mac)
SELECT class, round(p, 6) + 0.0 AS precision, round(r, 6) + 0.0 AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) + 0.0 AS f1 FROM m""")
def scene_macro(spark, d):
    return rounded(M.scene_macro(evaluated(spark, d)))


@query(EVALUATED + f"""SELECT scene_id, {NAMES} AS name, tp, fp, fn, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1 FROM prf
UNION ALL SELECT scene_id, 'macro', NULL, NULL, NULL, round(p, 6) + 0.0, round(r, 6) + 0.0, round(f, 6) + 0.0 FROM mac""")
def report_table(spark, d):
    return M.report(evaluated(spark, d))


@query(EVALUATED + """, l AS (SELECT 'test_scene_' || scene_id || '_peak_precision_class_' || class AS metric, precision AS value FROM prf UNION ALL SELECT 'test_scene_' || scene_id || '_peak_recall_class_' || class, recall FROM prf
 UNION ALL SELECT 'test_scene_' || scene_id || '_peak_f1_class_' || class, f1 FROM prf UNION ALL SELECT 'test_scene_' || scene_id || '_peak_accuracy', avg(CAST(ann = pred AS int)) FROM ev GROUP BY scene_id)
SELECT metric, round(value, 6) + 0.0 AS value FROM l""")
def metrics_long(spark, d):
    return rounded(M.metrics_long(evaluated(spark, d)))


def voxels(spark, d):
    return X.cells(spark, d).select("frame_id", "x", "y", "bin", "ann", "pred")


@query(X.SQL + ", i AS (SELECT CAST(c AS int) AS class, coalesce(count(*) FILTER (ann = c AND pred = c) / nullif(count(*) FILTER (ann = c OR pred = c), 0), 1.0) AS iou FROM v_cells, range(1, 4) r(c) GROUP BY c) SELECT class, round(iou, 6) + 0.0 AS iou FROM i UNION ALL SELECT NULL, round(avg(iou), 6) + 0.0 FROM i")
def iou(spark, d):
    return rounded(M.iou(voxels(spark, d), ignored=(0,)))


@query(X.SQL + "SELECT count(*) AS total, count(*) FILTER (ann = pred) AS correct, round(avg(CAST(ann = pred AS int)), 6) + 0.0 AS accuracy FROM v_cells")
def voxel_accuracy(spark, d):
    return rounded(M.accuracy(voxels(spark, d), []))


@query(X.SQL + """, v AS (SELECT * FROM v_cells WHERE ann <> 0), c AS (SELECT DISTINCT ann AS class FROM v UNION SELECT DISTINCT pred FROM v),
r AS (SELECT class, count(*) FILTER (ann = class) AS support, coalesce(count(*) FILTER (ann = class AND pred = class) / nullif(count(*) FILTER (pred = class), 0), 1.0) AS p, coalesce(count(*) FILTER (ann = class AND pred = class) / nullif(count(*) FILTER (ann = class), 0), 1.0) AS r FROM v, c GROUP BY class)
SELECT class, support, round(p, 6) + 0.0 AS precision, round(r, 6) + 0.0 AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) + 0.0 AS f1 FROM r""")
def masked_report(spark, d):
    return rounded(M.masked_report(voxels(spark, d)).withColumn("support", F.col("support").cast("bigint")))


MASKED = X.SQL + ", v AS (SELECT * FROM v_cells WHERE ann <> 0), c AS (SELECT DISTINCT ann AS class FROM v UNION SELECT DISTINCT pred FROM v)"


@query(MASKED + " SELECT a.class AS ann, p.class AS pred, (SELECT count(*) FROM v WHERE v.ann = a.class AND v.pred = p.class) AS n FROM c a, c p")
def masked_matrix(spark, d):
    return M.masked_matrix(voxels(spark, d))


@query(MASKED + """, r AS (SELECT class, coalesce(count(*) FILTER (ann = class AND pred = class) / nullif(count(*) FILTER (pred = class), 0), 1.0) AS p, coalesce(count(*) FILTER (ann = class AND pred = class) / nullif(count(*) FILTER (ann = class), 0), 1.0) AS r FROM v, c GROUP BY class),
t AS (SELECT count(*) AS total, count(*) FILTER (ann = pred) AS correct FROM v)
SELECT any_value(total) AS total, any_value(correct) AS correct, round(any_value(correct) / any_value(total), 6) + 0.0 AS accuracy, round(avg(p), 6) + 0.0 AS macro_precision, round(avg(r), 6) + 0.0 AS macro_recall, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 6) + 0.0 AS macro_f1 FROM r, t""")
def masked_summary(spark, d):
    return rounded(M.masked_summary(voxels(spark, d)))


@query(X.SQL + """, t AS (SELECT count(*) AS v FROM d), s AS (SELECT pred AS class, count(*) AS n FROM d WHERE pred <> 0 GROUP BY pred UNION ALL SELECT 0, count(*) FROM d WHERE pred = 0)
SELECT class, n, round(100.0::double * n / v, 2) AS percent FROM s, t""")
def label_stats(spark, d):
    return M.label_stats(X.waveforms(spark, d), X.labels(spark, d, "pred"))


@query(X.SQL + "SELECT frame_id, count(*) FILTER (ann = 1) AS object, count(*) FILTER (ann = 2) AS glass, count(*) FILTER (ann = 3) AS ghost FROM v_cells WHERE ann <> 0 GROUP BY frame_id")
def annotation_counts(spark, d):
    return X.labels(spark, d).groupBy("frame_id").agg(*[F.count_if(F.col("label") == k).alias(C.LABELS[k]) for k in (1, 2, 3)])


LOGITS = "WITH e AS (SELECT vec_id, CAST(label % 4 AS int) AS t, [embedding[1]::double, embedding[2]::double, embedding[3]::double, embedding[4]::double] AS z FROM embeddings), ce AS (SELECT *, list_max(z) AS m, ln(list_sum([exp(v - list_max(z)) FOR v IN z])) AS ls FROM e) "


def logits(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", (F.col("label") % 4).cast("int").alias("target"), F.slice("embedding", 1, 4).cast("array<double>").alias("z"))


@query(LOGITS + ", f AS (SELECT CASE WHEN t = 0 THEN 0.0 ELSE 0.25 * (1 - exp(-(m + ls - z[t + 1]))) ** 2 * (m + ls - z[t + 1]) END AS l FROM ce) SELECT count(*) AS n, round(sum(l), 6) + 0.0 AS loss_sum, round(avg(l), 6) + 0.0 AS loss_mean FROM f")
def focal_loss(spark, d):
    return rounded(M.focal_loss(logits(spark, d), "z", "target", ignored=0))


@query(LOGITS + ", p AS (SELECT vec_id, [CASE WHEN i = 1 THEN -1e9 ELSE z[i] END FOR i IN range(1, 5)] AS u FROM e), q AS (SELECT vec_id, u, 1 / list_sum([exp(v - list_max(u)) FOR v IN u]) AS c FROM p) SELECT vec_id, CAST(CASE WHEN c < 0.36 THEN -1 ELSE list_position(u, list_max(u)) - 1 END AS int) AS label, round(c, 6) + 0.0 AS confidence FROM q")
def logits_to_label(spark, d):
    return rounded(T.frame_labels(logits(spark, d), "z", 0.36, -1, (0,)).select("vec_id", "label", "confidence"))


def patches(spark, d):
    """Embeddings as patches: 32 values and 32 predictions."""
    half = lambda k: F.slice("embedding", k, 32).cast("array<double>")
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", (F.col("vec_id") % 3 == 0).alias("masked"), half(1).alias("values"), half(33).alias("predicted"))


@query("WITH v AS (SELECT abs(embedding[i]::double - embedding[i + 32]::double) AS a FROM embeddings, range(1, 33) t(i) WHERE vec_id % 3 = 0) SELECT round(avg(a * a), 6) + 0.0 AS mse, round(avg(a), 6) + 0.0 AS l1, round(avg(CASE WHEN a < 1 THEN 0.5 * a * a ELSE a - 0.5 END), 6) + 0.0 AS smooth_l1 FROM v")
def recon_loss(spark, d):
    rows = patches(spark, d)
    kinds = [M.recon_loss(rows, k).select(F.lit(k).alias("kind"), "loss") for k in ("mse", "l1", "smooth_l1")]
    both = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return rounded(both.agg(*[F.max(F.when(F.col("kind") == k, F.col("loss"))).alias(k) for k in ("mse", "l1", "smooth_l1")]))


@query("""WITH v AS (SELECT abs(embedding[1]::double - embedding[4]::double) AS p, abs(embedding[2]::double - embedding[5]::double) AS h, abs(embedding[3]::double - embedding[6]::double) AS w FROM embeddings WHERE vec_id % 2 = 0),
l AS (SELECT avg(CASE WHEN p < 1 THEN 0.5 * p * p ELSE p - 0.5 END) AS p, avg(CASE WHEN h < 1 THEN 0.5 * h * h ELSE h - 0.5 END) AS h, avg(CASE WHEN w < 1 THEN 0.5 * w * w ELSE w - 0.5 END) AS w FROM v)
SELECT round(p, 6) + 0.0 AS position_loss, round(h, 6) + 0.0 AS height_loss, round(w, 6) + 0.0 AS width_loss, round(p + 0.5 * h + 0.25 * w, 6) + 0.0 AS total FROM l""")
def peak_losses(spark, d):
    at = lambda k: F.element_at("embedding", k).cast("double")
    names = ("position", "height", "width")
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") % 2 == 0).alias("masked"), *[at(k + 1).alias(f"pred_{n}") for k, n in enumerate(names)], *[at(k + 4).alias(n) for k, n in enumerate(names)])
    return rounded(M.peak_losses(rows, "smooth_l1", (1.0, 0.5, 0.25)))


