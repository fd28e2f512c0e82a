"""Confusion counts and what follows from them; losses; ghost-removal rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echograin import constants as C

from . import points as P


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, group: list[str], classes: int = C.CLASSES) -> DataFrame:
    """group, ann, pred, n for every pair of classes, 0 where none; labels outside the classes do not count."""
    counts = rows.where(F.col("ann").between(0, classes - 1) & F.col("pred").between(0, classes - 1)).groupBy(*group, "ann", "pred").agg(F.count(F.lit(1)).alias("n"))
    number = lambda n: F.explode(F.array(*[F.lit(k) for k in range(classes)])).alias(n)
    groups = rows.select(*group).distinct() if group else rows.sparkSession.range(1).select()
    grid = groups.select("*", number("ann")).select("*", number("pred"))
    return grid.join(counts, [*group, "ann", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def normalised(matrix: DataFrame, group: list[str]) -> DataFrame:
    """matrix with by_true, by_pred (0 where a row or column is empty) and by_all (null where all is)."""
    from pyspark.sql import Window

    over = lambda *c: F.sum("n").over(Window.partitionBy(*group, *c))
    return matrix.withColumns({"by_true": safe_div(F.col("n"), over("ann")), "by_pred": safe_div(F.col("n"), over("pred")), "by_all": F.try_divide(F.col("n").cast("double"), over().cast("double"))})


def class_prf(matrix: DataFrame, group: list[str], undefined: float = 0.0) -> DataFrame:
    """group, class, tp, fp, fn, support, precision, recall, f1 from confusion counts; undefined ratios are `undefined`."""
    side = lambda c: F.sum(F.when(F.col(c) == F.col("class"), F.col("n")).otherwise(0))
    both = matrix.withColumn("class", F.explode(F.array_distinct(F.array("ann", "pred"))))
    tp = F.sum(F.when((F.col("ann") == F.col("class")) & (F.col("pred") == F.col("class")), F.col("n")).otherwise(0))
    sums = both.groupBy(*group, "class").agg(tp.alias("tp"), side("ann").alias("support"), side("pred").alias("_predicted"))
    sums = sums.withColumns({"fp": F.col("_predicted") - F.col("tp"), "fn": F.col("support") - F.col("tp")})
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(undefined))
    found = sums.withColumns({"precision": ratio(F.col("tp"), F.col("_predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    f1 = safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return found.withColumn("f1", f1).select(*group, "class", "tp", "fp", "fn", "support", "precision", "recall", "f1")


def macro(prf: DataFrame, group: list[str], ignored: tuple[int, ...] = ()) -> DataFrame:
    """Means over the classes that are not ignored; the F1 is the mean of the classes' F1s."""
    kept = prf.where(~F.col("class").isin(*ignored)) if ignored else prf
    return kept.groupBy(*group).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def accuracy(rows: DataFrame, group: list[str]) -> DataFrame:
    """total (predictions outside the classes included), correct and accuracy."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("ann") == F.col("pred")).alias("correct"), F.avg((F.col("ann") == F.col("pred")).cast("double")).alias("accuracy"))


def distribution(rows: DataFrame, group: list[str], classes: int = C.CLASSES) -> DataFrame:
    """group, class, gt and predicted counts of every class."""
    counts = [F.struct(F.lit(k).alias("class"), F.count_if(F.col("ann") == k).alias("gt"), F.count_if(F.col("pred") == k).alias("predicted")) for k in range(classes)]
    return rows.groupBy(*group).agg(F.array(*counts).alias("_c")).select(*group, F.inline("_c"))


def scene_rollup(rows: DataFrame, classes: int = C.CLASSES, ignored: tuple[int, ...] = ()) -> DataFrame:
    """Per scene, and over all under the name "all": total, correct, accuracy and macro precision, recall and F1.

    Peaks are counted once, by scene and pair of labels; everything else works on those counts.
    """
    counts = rows.groupBy("scene_id", "ann", "pred").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("scene_id", F.explode(F.array("scene_id", F.lit("all")))).groupBy("scene_id", "ann", "pred").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("scene_id").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("ann") == F.col("pred"), F.col("n")).otherwise(0)).alias("correct"))
    totals = totals.withColumn("accuracy", safe_div(F.col("correct"), F.col("total")))
    return totals.join(macro(class_prf(full(counts, classes), ["scene_id"]), ["scene_id"], ignored), "scene_id")


def full(counts: DataFrame, classes: int = C.CLASSES) -> DataFrame:
    """Counts by scene with a row for every pair of classes."""
    number = lambda n: F.explode(F.array(*[F.lit(k) for k in range(classes)])).alias(n)
    grid = counts.select("scene_id").distinct().select("scene_id", number("ann")).select("*", number("pred"))
    return grid.join(counts, ["scene_id", "ann", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def scene_prf(rows: DataFrame, classes: int = C.CLASSES) -> DataFrame:
    """class_prf per scene."""
    return class_prf(full(rows.groupBy("scene_id", "ann", "pred").agg(F.count(F.lit(1)).alias("n")), classes), ["scene_id"])


def scene_macro(rows: DataFrame, classes: int = C.CLASSES) -> DataFrame:
    """Means over scenes, per class and for the macro average (class null): precision and recall are averaged, F1 is the harmonic mean of these averages."""
    prf = scene_prf(rows, classes)
    per_class = prf.groupBy("class").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    over_all = macro(prf, ["scene_id"]).agg(F.avg("macro_precision").alias("precision"), F.avg("macro_recall").alias("recall")).withColumn("class", F.lit(None).cast("int"))
    both = per_class.unionByName(over_all.select("class", "precision", "recall"))
    return both.withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def report(rows: DataFrame, classes: int = C.CLASSES) -> DataFrame:
    """Per scene and class name the rounded figures, with a row "macro" whose counts are null."""
    prf = scene_prf(rows, classes)
    name = F.element_at(F.create_map(*[F.lit(v) for item in C.LABELS.items() for v in item]), F.col("class"))
    r = lambda c: F.round(c, 6).alias(c.removeprefix("macro_"))
    lines = prf.select("scene_id", name.alias("name"), "tp", "fp", "fn", r("precision"), r("recall"), r("f1"))
    none = [F.lit(None).cast("bigint").alias(c) for c in ("tp", "fp", "fn")]
    return lines.unionByName(macro(prf, ["scene_id"]).select("scene_id", F.lit("macro").alias("name"), *none, r("macro_precision"), r("macro_recall"), r("macro_f1")))


def metrics_long(rows: DataFrame, classes: int = C.CLASSES) -> DataFrame:
    """metric, value: a name for each figure of each scene. The names of the metrics."""
    prf = scene_prf(rows, classes)
    name = lambda figure: F.concat(F.lit("test_scene_"), "scene_id", F.lit("_peak_"), F.lit(figure))
    each = prf.select("scene_id", "class", F.expr("stack(3, 'precision', precision, 'recall', recall, 'f1', f1) AS (figure, value)"))
    each = each.select(F.concat(F.lit("test_scene_"), "scene_id", F.lit("_peak_"), "figure", F.lit("_class_"), F.col("class").cast("string")).alias("metric"), "value")
    acc = rows.groupBy("scene_id").agg(F.avg((F.col("ann") == F.col("pred")).cast("double")).alias("value")).select(name("accuracy").alias("metric"), "value")
    return each.unionByName(acc)


def iou(rows: DataFrame, classes: int = C.CLASSES, ignored: tuple[int, ...] = ()) -> DataFrame:
    """class, iou; class null is the mean. An empty union gives 1."""
    used = [k for k in range(classes) if k not in ignored]
    hit = lambda k: F.count_if((F.col("ann") == k) & (F.col("pred") == k))
    any_ = lambda k: F.count_if((F.col("ann") == k) | (F.col("pred") == k))
    each = rows.agg(F.array(*[F.struct(F.lit(k).alias("class"), F.coalesce(F.try_divide(hit(k).cast("double"), any_(k).cast("double")), F.lit(1.0)).alias("iou")) for k in used]).alias("_a")).select(F.inline("_a"))
    return each.unionByName(each.agg(F.avg("iou").alias("iou")).select(F.lit(None).cast("int").alias("class"), "iou"))


def masked_report(rows: DataFrame) -> DataFrame:
    """class, support, precision, recall, f1 over voxels whose truth is not noise, for all labels present on either side; undefined ratios are 1."""
    kept = rows.where(F.col("ann") != C.NOISE)
    matrix = kept.groupBy("ann", "pred").agg(F.count(F.lit(1)).alias("n"))
    prf = class_prf(matrix, [], undefined=1.0)
    return prf.select("class", "support", "precision", "recall", "f1")


def masked_matrix(rows: DataFrame) -> DataFrame:
    """ann, pred, n over voxels whose truth is not noise, for every pair of the labels present on either side."""
    counts = rows.where(F.col("ann") != C.NOISE).groupBy("ann", "pred").agg(F.count(F.lit(1)).alias("n"))
    present = counts.agg(F.array_distinct(F.flatten(F.collect_list(F.array("ann", "pred")))).alias("_k"))  # a few labels
    grid = present.select(F.explode("_k").alias("ann"), "_k").select("ann", F.explode("_k").alias("pred"))
    return grid.join(counts, ["ann", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def masked_summary(rows: DataFrame) -> DataFrame:
    """total, correct, accuracy and macro precision, recall and F1 over voxels whose truth is not noise; undefined ratios are 1."""
    prf = class_prf(masked_matrix(rows), [], undefined=1.0)
    means = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    sums = prf.agg(F.sum("support").alias("total"), F.sum("tp").alias("correct"), *means)
    return sums.withColumn("accuracy", safe_div(F.col("correct"), F.col("total")))


def label_stats(waveforms: DataFrame, labels: DataFrame, classes: int = C.CLASSES) -> DataFrame:
    """class, n, percent (2 decimals): noise is what is left of all voxels; undefined labels are a row of their own."""
    counts = labels.groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("n")).where(F.col("class").between(-1, classes - 1) & (F.col("class") != C.NOISE))
    voxels = waveforms.agg(F.lit(None).cast("int").alias("class"), F.coalesce(F.sum(F.size("hist")), F.lit(0)).cast("bigint").alias("n"))
    whole = F.max(F.when(F.col("class").isNull(), F.col("n")))
    marked = F.coalesce(F.sum(F.when(F.col("class").isNotNull(), F.col("n"))), F.lit(0))
    each = F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", "n")))  # a row per class
    one = counts.unionByName(voxels).agg(whole.alias("_v"), F.concat(each, F.array(F.struct(F.lit(C.NOISE).alias("class"), (whole - marked).alias("n")))).alias("_c"))
    return one.select("_v", F.inline("_c")).select("class", "n", F.round(100.0 * F.col("n") / F.col("_v"), 2).alias("percent"))


# --- losses ---------------------------------------------------------------------------------------------------------


def focal_loss(rows: DataFrame, logits: str, target: str, alpha: float = 0.25, gamma: float = 2.0, ignored: int | None = None) -> DataFrame:
    """n, loss_sum, loss_mean; rows of the ignored target add 0 and count in the mean."""
    most = F.array_max(logits)
    log_sum = most + F.log(F.aggregate(F.transform(F.col(logits), lambda v: F.exp(v - most)), F.lit(0.0), lambda a, v: a + v))
    cross = log_sum - F.get(logits, F.col(target))
    loss = F.lit(alpha) * F.pow(1 - F.exp(-cross), F.lit(gamma)) * cross
    if ignored is not None:
        loss = F.when(F.col(target) == ignored, 0.0).otherwise(loss)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(loss).alias("loss_sum"), F.avg(loss).alias("loss_mean"))


def element_loss(kind: str, a: Column, b: Column) -> Column:
    """mse, l1 or smooth_l1 of two numbers."""
    d = F.abs(a - b)
    if kind == "mse":
        return d * d
    if kind == "l1":
        return d
    if kind == "smooth_l1":
        return F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)
    raise ValueError(f"unknown loss: {kind}")


def recon_loss(patches: DataFrame, kind: str = "mse") -> DataFrame:
    """Mean loss over all values of masked patches (masked, values, predicted); null if none is masked."""
    total = F.aggregate(F.zip_with("values", "predicted", lambda a, b: element_loss(kind, a.cast("double"), b.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    sums = patches.where("masked").agg(F.sum(total).alias("_s"), F.sum(F.size("values")).alias("_n"))
    return sums.select(F.try_divide(F.col("_s"), F.col("_n").cast("double")).alias("loss"))


def peak_losses(rows: DataFrame, kind: str = "smooth_l1", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """position_loss, height_loss, width_loss and their weighted total over masked rows (masked, and position, height, width with pred_ partners); 0 without rows."""
    mean = lambda c: F.coalesce(F.avg(element_loss(kind, F.col(f"pred_{c}"), F.col(c))), F.lit(0.0)).alias(f"{c}_loss")
    found = rows.where("masked").agg(*[mean(c) for c in ("position", "height", "width")])
    return found.withColumn("total", sum((F.col(f"{c}_loss") * w for c, w in zip(("position", "height", "width"), weights, strict=True)), F.lit(0.0)))


# --- ghost removal --------------------------------------------------------------------------------------------------


def ghost_removal(points: DataFrame, radius: float) -> DataFrame:
    """Per cloud with both roles: counts of ghosts, objects and glass in the truth, how many remain in the other cloud, and rates; 0 where a class is empty."""
    truth, other = points.where("role = 'gt'"), points.where("role = 'pred'").select("cloud_id", "pos_x", "pos_y", "pos_z")
    stay = P.within(truth.select("cloud_id", "point_id", "pos_x", "pos_y", "pos_z", "label"), other, radius, ["cloud_id"])
    count = lambda k, n: F.count_if(F.col("label") == k).alias(n)
    names = {C.GHOST: "ghost", C.OBJECT: "object", C.GLASS: "glass"}
    had = truth.join(other.select("cloud_id").distinct(), "cloud_id", "left_semi").groupBy("cloud_id").agg(*[count(k, f"num_gt_{n}") for k, n in names.items()])
    kept = stay.groupBy("cloud_id").agg(*[count(k, f"num_remaining_{n}") for k, n in names.items()])
    both = had.join(kept, "cloud_id", "left").fillna(0, [f"num_remaining_{n}" for n in names.values()])
    both = both.withColumn("num_removed_ghost", F.col("num_gt_ghost") - F.col("num_remaining_ghost"))
    both = both.withColumns({f"num_{s}_object_glass": F.col(f"num_{s}_object") + F.col(f"num_{s}_glass") for s in ("gt", "remaining")})
    rates = {"removal_rate": safe_div(F.col("num_removed_ghost"), F.col("num_gt_ghost"))}
    rates |= {f"{n}_residual_rate": safe_div(F.col(f"num_remaining_{n}"), F.col(f"num_gt_{n}")) for n in ("object", "glass", "object_glass")}
    return both.withColumns(rates)


RATES = ("removal_rate", "object_residual_rate", "glass_residual_rate", "object_glass_residual_rate")
COUNTS = ("num_gt_ghost", "num_removed_ghost", "num_remaining_ghost", "num_gt_object", "num_remaining_object", "num_gt_glass", "num_remaining_glass")


def removal_by_scene(removal: DataFrame) -> DataFrame:
    """Per scene (column scene): files, mean rates and summed counts."""
    return removal.groupBy("scene").agg(F.count(F.lit(1)).alias("files"), *[F.avg(c).alias(c) for c in RATES], *[F.sum(c).alias(c) for c in COUNTS])


def removal_overall(by_scene: DataFrame) -> DataFrame:
    """Unweighted means of the scenes' rates, and totals of their counts."""
    return by_scene.agg(F.count(F.lit(1)).alias("scenes"), F.sum("files").alias("files"), *[F.avg(c).alias(c) for c in RATES], *[F.sum(c).alias(c) for c in COUNTS])
