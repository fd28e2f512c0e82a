"""Queries of crops, resampling, waveform functions and peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from echograin import fixtures as X
from echograin.functions import table
from echograin.functions import waveform as W
from echograin.operators import outcomes
from echograin.operators import peaks as P
from echograin.operators import points as G
from echograin.operators import resample as R
from echograin.operators import sampling as S
from echograin.plans.base import new_folder, query, r6, rounded

V = X.SQL


def pick_sql(i: str, n: str, m: int) -> str:
    return f"CASE WHEN {i} = {m} - 1 THEN {n} - 1 ELSE CAST(floor({i} * (CAST({n} - 1 AS double) / {m - 1}.0::double)) AS int) END"


@query(V + "SELECT frame_id, x, y, hist FROM w")
def densify_waveforms(spark, d):
    return X.waveforms(spark, d)


@query("SELECT vec_id, [CAST(vec_id % 7 AS bigint), CAST(vec_id AS bigint), CAST(label AS bigint)] AS hist FROM embeddings")
def parse_hist_string(spark, d):
    text = F.concat(F.lit(" ["), (F.col("vec_id") % 7).cast("string"), F.lit("  "), F.col("vec_id").cast("string"), F.lit(" "), F.col("label").cast("string"), F.lit("] "))
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", W.parse_hist(text).alias("hist"))


@query(V + "SELECT frame_id, x, y - 2 AS y, hist FROM w WHERE y BETWEEN 2 AND 6")
def crop_y(spark, d):
    return R.crop_y(X.waveforms(spark, d), 2, 1, 8)


@query(V + "SELECT frame_id, x, y, hist[6:60] AS hist FROM w")
def crop_z(spark, d):
    return R.crop_z(X.waveforms(spark, d), 5, 4)


@query(V + "SELECT frame_id, x - 1 AS x, y - 0 AS y, hist[11:64] AS hist FROM w WHERE x >= 1 AND x < 6 AND y < 8")
def crop_box(spark, d):
    return R.crop_box(X.waveforms(spark, d), (1, 6), (-3, None), (10, 200), (8, 8, 64))


@query(V + "SELECT frame_id, x, y, hist FROM w WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 4")
def crop_xy(spark, d):
    return R.crop_xy(X.waveforms(spark, d), (2, 5), (1, 4))


@query(V + "SELECT frame_id, x - 2 AS x, y - 1 AS y, bin - 3 AS bin, ann AS label FROM v_cells WHERE ann <> 0 AND x >= 2 AND x < 5 AND y >= 1 AND y < 8 AND bin >= 3")
def crop_annotation(spark, d):
    return R.crop_labels(X.labels(spark, d), (2, 5), (1, 90), (8, 8), 3)


CROP_STARTS = ", st AS (SELECT frame_id, " + ", ".join(f"('0x' || substr(md5(concat_ws('-', '0', frame_id, '{a}')), 1, 12))::BIGINT % {n} AS {a}0" for a, n in (("x", 5), ("y", 5), ("z", 33))) + " FROM (SELECT DISTINCT frame_id FROM w) f) "


@query(V + CROP_STARTS + "SELECT w.frame_id, CAST(x - x0 AS int) AS x, CAST(y - y0 AS int) AS y, hist[z0 + 1:z0 + 32] AS hist FROM w JOIN st USING (frame_id) WHERE x >= x0 AND x < x0 + 4 AND y >= y0 AND y < y0 + 4")
def random_crop(spark, d):
    rows = X.waveforms(spark, d)
    return R.random_crop(rows, R.random_starts(rows, (8, 8, 64), (4, 4, 32)), (4, 4, 32))


@query(V + f"SELECT frame_id, x, y, [hist[{pick_sql('i', '64', 23)} + 1] FOR i IN range(23)] AS hist FROM w")
def downsample_bins(spark, d):
    return R.downsample(X.waveforms(spark, d), 23)


@query(V + f"SELECT c.frame_id, c.x, c.y, CAST(t.i AS int) AS bin, c.ann AS label FROM v_cells c JOIN (SELECT range AS i, {pick_sql('range', '64', 23)} AS b FROM range(23)) t ON t.b = c.bin WHERE c.ann <> 0")
def downsample_labels(spark, d):
    return R.downsample_labels(X.labels(spark, d), 64, 23)


@query(V + f"SELECT frame_id, x, y, CAST({pick_sql('bin', '175', 64)} AS int) AS bin, ann AS label FROM v_cells WHERE ann <> 0")
def upsample_zero_pad(spark, d):
    return R.upsample_zero(X.labels(spark, d), 64, 175)


@query(V + """SELECT frame_id, x, y, [CASE WHEN j = 99 THEN hist[64] ELSE CAST(trunc(hist[least(CAST(floor(j * (63.0::double / 99.0)) AS int), 62) + 1]
 + (hist[least(CAST(floor(j * (63.0::double / 99.0)) AS int), 62) + 2] - hist[least(CAST(floor(j * (63.0::double / 99.0)) AS int), 62) + 1])::double * (j * (63.0::double / 99.0) - least(CAST(floor(j * (63.0::double / 99.0)) AS int), 62))) AS bigint) END FOR j IN range(100)] AS hist FROM w""")
def upsample_linear(spark, d):
    return R.upsample_linear(X.waveforms(spark, d), 100)


@query(V + "SELECT frame_id, x + 1 AS x, y + 2 AS y, bin, ann AS label FROM d WHERE ann <> 0 AND x + 1 <= 7 AND y + 2 <= 7")
def sparsify_labels(spark, d):
    dense = R.densify(X.cells(spark, d).select("frame_id", "x", "y", "bin", F.col("ann").cast("bigint").alias("cnt")), 64)
    return R.sparsify(dense, (8, 8), 1, label_height=4)


@query(V + X.peaks_sql("h >= mx * 0.1", 3) + "SELECT c.frame_id, c.x, c.y, c.bin, c.ann AS label FROM v_cells c SEMI JOIN peaks_wide k USING (frame_id, x, y, bin) WHERE c.ann <> 0")
def peak_only_voxels(spark, d):
    found = P.relative_peaks(X.waveforms(spark, d))
    return X.labels(spark, d).join(found, ["frame_id", "x", "y", "bin"], "left_semi")


@query(V + X.peaks_sql("h >= mx * 0.1", 3) + "SELECT d.bin, d.h AS cnt, d.ann, d.pred, k.bin IS NOT NULL AS is_peak FROM d LEFT JOIN peaks_wide k USING (frame_id, x, y, bin) WHERE frame_id = 0 AND x = 3 AND y = 4")
def pixel_series(spark, d):
    rows = X.waveforms(spark, d)
    return S.pixel_series(rows, X.labels(spark, d), X.labels(spark, d, "pred"), P.relative_peaks(rows.where("frame_id = 0 AND x = 3 AND y = 4")), (0, 3, 4))


@query(V + "SELECT frame_id, x, y, hist FROM w WHERE frame_id = 1")
def find_frame(spark, d):
    return X.waveforms(spark, d).where("frame_id = 1")


# --- peaks ----------------------------------------------------------------------------------------------------------


@query(V + X.peaks_sql("h >= 5") + "SELECT frame_id, x, y, bin, height, prominence, round(width, 6) + 0.0 AS width FROM peaks WHERE prominence >= 4 AND width >= 1")
def find_peaks(spark, d):
    return rounded(P.find_peaks(X.waveforms(spark, d), height=5, prominence=4, width=1))


@query(V + X.peaks_sql("h >= mx * 0.1", 3) + "SELECT frame_id, x, y, bin, height, prominence, round(width, 6) + 0.0 AS width FROM peaks_wide")
def peaks_rel10_w3(spark, d):
    return rounded(P.relative_peaks(X.waveforms(spark, d)))


@query(V + X.peaks_sql("h >= mx * 0.2") + "SELECT frame_id, x, y, bin, height, prominence, round(width, 6) + 0.0 AS width FROM peaks")
def peaks_rel20(spark, d):
    return rounded(P.relative_peaks(X.waveforms(spark, d), 0.2, None))


@query(V + X.peaks_sql("h >= 5") + "SELECT frame_id, x, y, bin, height, prominence, round(width, 6) + 0.0 AS width FROM peaks WHERE prominence >= 4 AND width >= 1")
def find_peaks_sql(spark, d):
    """find_peaks() as a table function of SQL."""
    table.register(spark)
    found = spark.sql("SELECT * FROM find_peaks(TABLE({w}) PARTITION BY frame_id, height => 5, prominence => 4, width => 1)", w=X.waveforms(spark, d))
    return rounded(found)


def greedy_sql(source: str, distance: int, name: str = "gr") -> str:
    """DuckDB: those of `source` (frame_id, x, y, bin, height) that stay when, highest first, each drops neighbours nearer than the distance."""
    return f""", {name}_l AS (SELECT frame_id, x, y, list([bin] ORDER BY height DESC, bin) AS bs FROM {source} GROUP BY ALL),
{name} AS (SELECT frame_id, x, y, unnest(list_reduce(bs, lambda kept, b: CASE WHEN len(list_filter(kept, lambda q: abs(q - b[1]) < {distance})) > 0 THEN kept ELSE list_append(kept, b[1]) END)) AS bin FROM {name}_l)"""


@query(V + X.peaks_sql("h >= mx * 0.2") + greedy_sql("peaks", 7) + " SELECT frame_id, x, y, bin, height, prominence, round(width, 6) + 0.0 AS width FROM peaks SEMI JOIN gr USING (frame_id, x, y, bin) WHERE width >= 1")
def peaks_rel20_distance(spark, d):
    return rounded(P.relative_peaks(X.waveforms(spark, d), 0.2, 1, 7))


BROKEN = V + X.peaks_sql("h >= mx * 0.1", 3) + ", bad AS (SELECT DISTINCT frame_id FROM px WHERE frame_id % 5 = 3 AND x = 2 AND y = 3) "


def some_broken(spark, d):
    """Peaks of waveforms of which some have a null count, written once; and the frames."""
    rows = X.waveforms(spark, d)
    broken = F.when(F.expr("frame_id % 5 = 3 AND x = 2 AND y = 3"), F.transform("hist", lambda v, i: F.when(i != 10, v))).otherwise(F.col("hist"))
    path = new_folder(spark)
    P.relative_peaks(rows.withColumn("hist", broken), errors=True).write.parquet(path)
    return outcomes.split(spark.read.parquet(path), rows.select("frame_id").distinct())


@query(BROKEN + "SELECT frame_id, x, y, bin, height, prominence, round(width, 6) + 0.0 AS width FROM peaks_wide WHERE frame_id NOT IN (SELECT frame_id FROM bad)")
def peaks_of_whole_frames(spark, d):
    """Peaks of the frames in which no waveform fails."""
    return rounded(some_broken(spark, d)[0].drop("error"))


@query(BROKEN + "SELECT frame_id, CASE WHEN frame_id IN (SELECT frame_id FROM bad) THEN 'failed' ELSE 'ok' END AS status, CASE WHEN frame_id IN (SELECT frame_id FROM bad) THEN 'ValueError: a waveform has null counts' END AS error FROM (SELECT DISTINCT frame_id FROM px)")
def peak_status(spark, d):
    """Every frame with the outcome of its peak search."""
    return some_broken(spark, d)[1]


RANKED = V + X.peaks_sql("h >= med") + ", rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY frame_id, x, y ORDER BY height DESC, bin) AS int) AS rank FROM peaks) "


@query(RANKED + "SELECT frame_id, x, y, bin, height, CAST(rank = 1 AS int) AS label FROM rk")
def all_peaks_labeled(spark, d):
    return P.peaks_above_median(X.waveforms(spark, d)).drop("rank")


@query(RANKED + "SELECT frame_id, x, y, bin, height, rank FROM rk WHERE rank <= 3")
def top_k_peaks(spark, d):
    return P.peaks_above_median(X.waveforms(spark, d)).where("rank <= 3").drop("label")


# Smoothing with the kernel's weights in the kernel's order, so that equal sums are equal in both engines.
_AT = lambda o: f"hist[CASE WHEN i + {o} < 0 THEN -1 - (i + {o}) WHEN i + {o} > 63 THEN 127 - (i + {o}) ELSE i + {o} END + 1]::double"
_SUM = "0.0"
for _k, _w in enumerate(P.gaussian_weights()):
    _SUM = f"({_SUM} + {float(_w)!r}::double * {_AT(_k - 4)})"
BASELINE = (
    V
    + f""", s0 AS (SELECT frame_id, x, y, hist, [{_SUM} FOR i IN range(64)] AS s FROM w),
s1 AS (SELECT *, [list_sort(([0.0::double FOR q IN range(25)] || s || [0.0::double FOR q IN range(25)])[i + 1:i + 51])[26] FOR i IN range(64)] AS b FROM s0),
s2 AS (SELECT *, [greatest(s[i + 1] - b[i + 1], 0.0) FOR i IN range(64)] AS r FROM s1),
s3 AS (SELECT *, list_sort(r) AS o FROM s2), s4 AS (SELECT *, list_sort([abs(v - (o[32] + o[33]) / 2) FOR v IN r]) AS a FROM s3),
s5 AS (SELECT frame_id, x, y, r, (a[32] + a[33]) / 2 AS mad FROM s4 WHERE list_sum(hist) <> 0),
s6 AS (SELECT * FROM s5 WHERE mad <> 0),
bp AS (SELECT * FROM (WITH d AS (SELECT frame_id, x, y, CAST(i AS int) AS bin, r[i + 1] AS h FROM s6, range(64) q(i))"""
    + X.peaks_sql("h > 0", None, "bk")
    + """ SELECT * FROM bk)),
bh AS (SELECT bp.*, s6.mad FROM bp JOIN s6 USING (frame_id, x, y) WHERE height >= 1.5 * mad)"""
    + greedy_sql("bh", 5)
)


@query(BASELINE + " SELECT frame_id, x, y, bin, round(height, 6) + 0.0 AS height, round(prominence, 6) + 0.0 AS prominence, round(width, 6) + 0.0 AS width, round(mad, 6) + 0.0 AS mad FROM bh SEMI JOIN gr USING (frame_id, x, y, bin) WHERE prominence >= 3 * mad AND width >= 1")
def baseline_peaks(spark, d):
    return rounded(P.baseline_peaks(X.waveforms(spark, d)))


# Weights of the smoothing, and mirrored and zero-padded neighbours, by plain joins.
SMOOTHED = V + """, k AS (SELECT CAST(o AS int) AS o, exp(-0.5 * o * o) / (SELECT sum(exp(-0.5 * i * i)) FROM range(-4, 5) t(i)) AS wt FROM range(-4, 5) r(o)),
sm AS (SELECT a.frame_id, a.x, a.y, a.bin, sum(k.wt * b.h) AS s FROM d a, k JOIN d b
       ON b.frame_id = a.frame_id AND b.x = a.x AND b.y = a.y AND b.bin = CASE WHEN a.bin + k.o < 0 THEN -1 - (a.bin + k.o) WHEN a.bin + k.o > 63 THEN 127 - (a.bin + k.o) ELSE a.bin + k.o END GROUP BY ALL),
pad AS (SELECT frame_id, x, y, bin, s FROM sm UNION ALL SELECT px.frame_id, px.x, px.y, CAST(i AS int), 0.0 FROM px, (SELECT i FROM range(-25, 0) t(i) UNION ALL SELECT i FROM range(64, 89) t(i)) q),
bl AS (SELECT frame_id, x, y, bin, s, median(s) OVER (PARTITION BY frame_id, x, y ORDER BY bin ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS b FROM pad),
rs AS (SELECT frame_id, x, y, bin, s, b, greatest(s - b, 0.0) AS r FROM bl WHERE bin BETWEEN 0 AND 63),
dv AS (SELECT *, abs(r - median(r) OVER (PARTITION BY frame_id, x, y)) AS v FROM rs),
md AS (SELECT frame_id, x, y, median(v) AS mad FROM dv GROUP BY ALL)
"""


@query(SMOOTHED + "SELECT frame_id, x, y, bin, round(s, 6) + 0.0 AS smoothed FROM rs")
def smooth_gaussian(spark, d):
    return P.filtered(X.waveforms(spark, d)).select("frame_id", "x", "y", F.posexplode("smoothed").alias("bin", "s")).select("frame_id", "x", "y", "bin", r6("s").alias("smoothed"))


@query(SMOOTHED + "SELECT frame_id, x, y, bin, round(b, 6) + 0.0 AS baseline FROM rs")
def median_filter(spark, d):
    return P.filtered(X.waveforms(spark, d)).select("frame_id", "x", "y", F.posexplode("baseline").alias("bin", "b")).select("frame_id", "x", "y", "bin", r6("b").alias("baseline"))


@query(SMOOTHED + "SELECT frame_id, x, y, round(mad, 6) + 0.0 AS mad FROM md")
def mad(spark, d):
    return P.filtered(X.waveforms(spark, d)).select("frame_id", "x", "y", r6("mad").alias("mad"))


@query(V + "SELECT frame_id, x, y, CAST(list_position(hist, list_max(hist)) - 1 AS int) AS bin FROM w")
def strongest_bin(spark, d):
    return X.waveforms(spark, d).select("frame_id", "x", "y", W.strongest_bin(F.col("hist")).alias("bin"))


@query(V + "SELECT frame_id, x, y, CAST(floor(sum(bin * h) / nullif(sum(h), 0)) AS int) AS bin FROM d GROUP BY ALL")
def centroid_bin(spark, d):
    return X.waveforms(spark, d).select("frame_id", "x", "y", W.centroid_bin(F.col("hist")).alias("bin"))


@query(V + "SELECT frame_id, x, y, CAST(floor(avg(bin) FILTER (h > 0)) AS int) AS bin FROM d GROUP BY ALL")
def average_bin(spark, d):
    return X.waveforms(spark, d).select("frame_id", "x", "y", W.average_bin(F.col("hist")).alias("bin"))


FIRST = V + X.peaks_sql("h >= 3") + """, r3 AS (SELECT *, row_number() OVER (PARTITION BY frame_id, x, y ORDER BY height DESC, bin) AS rank FROM peaks),
f3 AS (SELECT frame_id, x, y, min(bin) AS b FROM r3 WHERE rank <= 2 GROUP BY ALL),
fb AS (SELECT w.frame_id, w.x, w.y, coalesce(f3.b, CAST(list_position(hist, list_max(hist)) - 1 AS int)) AS bin, hist FROM w LEFT JOIN f3 USING (frame_id, x, y)) """


@query(FIRST + "SELECT frame_id, x, y, bin FROM fb")
def first_peak_bin(spark, d):
    return P.first_peak_bin(X.waveforms(spark, d)).drop("hist")


# --- ranging --------------------------------------------------------------------------------------------------------

MPB = "(10e-10 * 299792458 / 2)"


def fwhm_sql(source: str, name: str = "fw") -> str:
    """DuckDB: from `source` (frame_id, x, y, bin) the range of each of its peaks; all_pk are the waveform's peaks of any height."""
    return f""", {name}_h AS (SELECT s.frame_id, s.x, s.y, s.bin AS pb, any_value(p.h) / 2.0::double AS half, max(d.bin) FILTER (d.bin < s.bin AND d.h <= p.h / 2.0::double) AS l, min(d.bin) FILTER (d.bin > s.bin AND d.h <= p.h / 2.0::double) AS r
 FROM {source} s JOIN d p ON p.frame_id = s.frame_id AND p.x = s.x AND p.y = s.y AND p.bin = s.bin JOIN d ON d.frame_id = s.frame_id AND d.x = s.x AND d.y = s.y GROUP BY s.frame_id, s.x, s.y, s.bin),
{name}_e AS (SELECT f.*, l0.h l0, l1.h l1, r0.h r0, r1.h r1, (SELECT count(*) FROM all_pk a WHERE a.frame_id = f.frame_id AND a.x = f.x AND a.y = f.y AND a.height >= f.half) AS above
 FROM {name}_h f LEFT JOIN d l0 ON l0.frame_id = f.frame_id AND l0.x = f.x AND l0.y = f.y AND l0.bin = f.l LEFT JOIN d l1 ON l1.frame_id = f.frame_id AND l1.x = f.x AND l1.y = f.y AND l1.bin = f.l + 1
 LEFT JOIN d r0 ON r0.frame_id = f.frame_id AND r0.x = f.x AND r0.y = f.y AND r0.bin = f.r LEFT JOIN d r1 ON r1.frame_id = f.frame_id AND r1.x = f.x AND r1.y = f.y AND r1.bin = f.r - 1),
{name}_b AS (SELECT frame_id, x, y, pb AS bin, l, r, above, CASE WHEN l IS NULL THEN pb WHEN l1 = l0 THEN l ELSE l + (half - l0) / (l1 - l0) END::double AS sb, CASE WHEN r IS NULL THEN pb WHEN r1 = r0 THEN r ELSE r - (half - r0) / (r1 - r0) END::double AS eb, l1 = l0 AS lf, r1 = r0 AS rf FROM {name}_e),
{name} AS (SELECT frame_id, x, y, bin, sb, eb, (sb + eb) / 2 * {MPB} - 1.2 AS dm, list_filter([CASE WHEN l IS NULL THEN 'no half maximum on the left' END, CASE WHEN lf THEN 'flat on the left' END,
 CASE WHEN r IS NULL THEN 'no half maximum on the right' END, CASE WHEN rf THEN 'flat on the right' END, CASE WHEN above > 1 THEN 'several peaks above half maximum' END, CASE WHEN (sb + eb) / 2 * {MPB} - 1.2 < 0 THEN 'negative distance' END], lambda v: v IS NOT NULL) AS notes FROM {name}_b)"""


PEAK_RANGE = V + X.peaks_sql("h >= mx * 0.1", 3) + X.peaks_sql("true", None, "all_pk") + fwhm_sql("peaks_wide")


@query(PEAK_RANGE + " SELECT frame_id, x, y, bin, round(dm, 6) + 0.0 AS distance_m, round(sb, 6) + 0.0 AS start_fwhm_bin, round(eb, 6) + 0.0 AS end_fwhm_bin, array_to_string(notes, '; ') AS notes FROM fw")
def fwhm_range(spark, d):
    found = G.ranged(P.relative_peaks(X.waveforms(spark, d), ranged=True)).withColumn("notes", F.concat_ws("; ", "notes"))
    return rounded(found.select("frame_id", "x", "y", "bin", "distance_m", "start_fwhm_bin", "end_fwhm_bin", "notes"))


@query(V + f"SELECT frame_id, x, y, round((CAST(list_position(hist, list_max(hist)) - 1 AS int) - 3) * {MPB}, 6) + 0.0 AS range_m, 0.0::double AS other_mode FROM w")
def simple_range(spark, d):
    bin_ = W.strongest_bin(F.col("hist"))
    return X.waveforms(spark, d).select("frame_id", "x", "y", r6(W.simple_range(bin_, 3)).alias("range_m"), W.simple_range(bin_, 3, 12).alias("other_mode"))


@query("SELECT vec_id, CASE WHEN (vec_id * 3 % 560 + 4) // 64 < 8 THEN [8.0, 8.0, 4.0, 1.6, 1.0, 4.0, 8.0, 8.0][(vec_id * 3 % 560 + 4) // 64 + 1]::double ELSE 1.0::double END AS gain FROM embeddings")
def block_gain(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", W.block_gain(F.col("vec_id") * 3 % 560).alias("gain"))


@query(V + """, t AS (SELECT frame_id, x, y, hist, CAST(list_position(hist, list_max(hist)) AS int) AS p, list_max(hist) AS v FROM w),
q AS (SELECT *, coalesce(list_min([i FOR i IN range(p + 1, 65) IF hist[i] <> v]), 65) - 1 - p + p - 1 - coalesce(list_max([i FOR i IN range(1, p) IF hist[i] <> v]), 0) AS run FROM t),
i AS (SELECT *, least((v * 8.0::double + run * 2.0::double) / 3.0::double, 255.0) AS i FROM q)
SELECT frame_id, x, y, CAST(floor(i) AS int) AS raw, round(i / max(i) OVER (PARTITION BY frame_id), 6) + 0.0 AS normalised FROM i""")
def intensity(spark, d):
    rows = X.waveforms(spark, d).withColumn("bin", W.strongest_bin(F.col("hist")))
    return rounded(G.intensity(rows, 2.0, 3).drop("hist", "bin"))


@query(V + "SELECT frame_id, x, y, [round(h * 8.0 / 288.0, 6) FOR h IN hist] AS hist FROM w")
def normalize_hist(spark, d):
    scaled = W.normalise(F.col("hist"), W.block_gain(F.col("y")), 2)
    return X.waveforms(spark, d).select("frame_id", "x", "y", F.transform(scaled, lambda v: F.round(v, 6)).alias("hist"))


@query(V + "SELECT frame_id, x, y, CAST(list_sum(hist) AS bigint) AS total FROM w")
def intensity_map(spark, d):
    return X.waveforms(spark, d).select("frame_id", "x", "y", W.total(F.col("hist")).alias("total"))


@query(V + """, o AS (SELECT * FROM px WHERE (x + y) % 3 <> 0), g AS (SELECT frame_id, max(x) mx, max(y) my FROM o GROUP BY frame_id)
SELECT g.frame_id, CAST(i AS int) AS x, CAST(j AS int) AS y, CAST(coalesce(s.t, 0) AS bigint) AS total FROM g, range(8) a(i), range(8) b(j)
LEFT JOIN (SELECT frame_id, x, y, list_sum(hist) AS t FROM w SEMI JOIN o USING (frame_id, x, y)) s ON s.frame_id = g.frame_id AND s.x = i AND s.y = j WHERE i <= mx AND j <= my""")
def raster_image(spark, d):
    rows = X.waveforms(spark, d).where("(x + y) % 3 <> 0").withColumn("total", W.total(F.col("hist")))
    return G.raster(rows, "total")


B_POINT = "round(dm * cos(radians(x * 0.1)) * cos(radians(y * 0.05)), 6) + 0.0 AS pos_x, round(-1 * dm * sin(radians(x * 0.1)) * cos(radians(y * 0.05)), 6) + 0.0 AS pos_y, round(-dm * sin(radians(y * 0.05)), 6) + 0.0 AS pos_z"


@query(FIRST + X.peaks_sql("true", None, "all_pk") + """, mb AS (SELECT frame_id, x, y, CAST(list_position(hist, list_max(hist)) - 1 AS int) AS bin, 'strongest' AS method FROM w UNION ALL
 SELECT frame_id, x, y, CAST(floor(sum(bin * h) / nullif(sum(h), 0)) AS int), 'centroid' FROM d GROUP BY frame_id, x, y UNION ALL SELECT frame_id, x, y, CAST(floor(avg(bin) FILTER (h > 0)) AS int), 'average' FROM d GROUP BY frame_id, x, y UNION ALL
 SELECT frame_id, x, y, bin, 'first_peak' FROM fb), mb1 AS (SELECT DISTINCT frame_id, x, y, bin FROM mb)""" + fwhm_sql("mb1") + """
SELECT m.method, m.frame_id, m.x, m.y, m.bin, p.distance_m, p.pos_x, p.pos_y, p.pos_z FROM mb m JOIN (SELECT frame_id, x, y, bin, round(dm, 6) + 0.0 AS distance_m, """ + B_POINT + " FROM fw) p ON p.frame_id = m.frame_id AND p.x = m.x AND p.y = m.y AND p.bin = m.bin")
def range_by_method(spark, d):
    found = G.range_by_methods(X.waveforms(spark, d))
    return rounded(found.select("method", "frame_id", "x", "y", "bin", "distance_m", "pos_x", "pos_y", "pos_z"))
