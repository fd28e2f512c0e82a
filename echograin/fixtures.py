"""LiDAR tables derived from the order tables: frames of 8 by 8 pixels and 64 bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograin.operators import resample

BINS = 64

RETURNS = """
SELECT CAST(floor(l_orderkey / 4000) AS int) AS frame_id, CAST(l_partkey % 8 AS int) AS x, CAST(l_suppkey % 8 AS int) AS y,
       CAST((l_partkey * 7 + l_linenumber * 3 + CAST(floor(l_quantity) AS bigint)) % 64 AS int) AS bin,
       CAST(floor(l_quantity) AS bigint) AS cnt, l_linenumber AS ln, l_suppkey AS sk
FROM {lineitem}"""
CELLS = """
SELECT frame_id, x, y, bin, CAST(sum(cnt) AS bigint) AS cnt, CAST(sum(ln) % 4 AS int) AS ann,
       CAST(CASE WHEN sum(sk) % 17 = 0 THEN -1 WHEN sum(sk) % 5 = 0 THEN (sum(ln) + 1) % 4 ELSE sum(ln) % 4 END AS int) AS pred
FROM {returns} GROUP BY frame_id, x, y, bin"""


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RETURNS.format(lineitem="{lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per occupied voxel with its count, true label and predicted label."""
    return spark.sql(CELLS.format(returns="{returns}"), returns=returns(spark, sf_dir))


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.densify(cells(spark, sf_dir), BINS)


def labels(spark: SparkSession, sf_dir: str, column: str = "ann") -> DataFrame:
    """Sparse labels: rows whose label is not noise."""
    return cells(spark, sf_dir).where(F.col(column) != 0).select("frame_id", "x", "y", "bin", F.col(column).alias("label"))


def scene(frame: str = "frame_id"):
    return F.concat(F.lit("scene"), F.lpad((F.col(frame) % 3).cast("string"), 3, "0"))


#: DuckDB: the views above, dense voxels d and dense waveforms w.
SQL = (
    "WITH v_returns AS (" + RETURNS.format(lineitem="lineitem") + "), v_cells AS (" + CELLS.format(returns="v_returns") + """),
px AS (SELECT DISTINCT frame_id, x, y FROM v_cells),
d AS (SELECT px.frame_id, px.x, px.y, b.bin, coalesce(c.cnt, 0) AS h, coalesce(c.ann, 0) AS ann, coalesce(c.pred, 0) AS pred
      FROM px CROSS JOIN (SELECT CAST(range AS int) AS bin FROM range(64)) b
      LEFT JOIN v_cells c ON c.frame_id = px.frame_id AND c.x = px.x AND c.y = px.y AND c.bin = b.bin),
w AS (SELECT frame_id, x, y, list(h ORDER BY bin) AS hist FROM d GROUP BY frame_id, x, y)"""
)


def peaks_sql(height: str, min_width: float | None = None, name: str = "peaks") -> str:
    """DuckDB: further views that end in `name` (frame_id, x, y, bin, height, prominence, width); `height` is a
    threshold over h (the peak), mx and med (the waveform's maximum and median). The definition is that of the public
    documentation of find_peaks, by set operations."""
    p = name
    return f""",
{p}_g AS (SELECT *, lag(h) OVER o AS ph, lead(h) OVER o AS nh, max(h) OVER k AS mx, median(h) OVER k AS med FROM d WINDOW k AS (PARTITION BY frame_id, x, y), o AS (PARTITION BY frame_id, x, y ORDER BY bin)),
{p}_r AS (SELECT *, sum(CASE WHEN ph IS NULL OR ph <> h THEN 1 ELSE 0 END) OVER (PARTITION BY frame_id, x, y ORDER BY bin) AS rid FROM {p}_g),
{p}_i AS (SELECT frame_id, x, y, rid, min(bin) lo, max(bin) hi, any_value(h) h, any_value(mx) mx, any_value(med) med, arg_min(ph, bin) ph, arg_max(nh, bin) nh FROM {p}_r GROUP BY ALL),
{p}_k AS (SELECT frame_id, x, y, (lo + hi) // 2 AS p, h FROM {p}_i WHERE ph < h AND nh < h AND ({height})),
{p}_s AS (SELECT k.frame_id, k.x, k.y, k.p, k.h, coalesce(max(d.bin) FILTER (d.bin < k.p AND d.h > k.h), -1) ls, coalesce(min(d.bin) FILTER (d.bin > k.p AND d.h > k.h), 64) rs FROM {p}_k k JOIN d USING (frame_id, x, y) GROUP BY ALL),
{p}_m AS (SELECT s.frame_id, s.x, s.y, s.p, any_value(s.h) h, any_value(ls) ls, any_value(rs) rs, min(d.h) FILTER (d.bin > ls AND d.bin <= p) lm, min(d.h) FILTER (d.bin < rs AND d.bin >= p) rm FROM {p}_s s JOIN d USING (frame_id, x, y) GROUP BY s.frame_id, s.x, s.y, s.p),
{p}_b AS (SELECT m.frame_id, m.x, m.y, m.p, any_value(m.h) h, any_value(m.h - greatest(lm, rm)) prom, max(d.bin) FILTER (d.bin > ls AND d.bin <= p AND d.h = lm) lb, min(d.bin) FILTER (d.bin < rs AND d.bin >= p AND d.h = rm) rb FROM {p}_m m JOIN d USING (frame_id, x, y) GROUP BY m.frame_id, m.x, m.y, m.p),
{p}_x AS (SELECT b.frame_id, b.x, b.y, b.p, any_value(b.h) h, any_value(prom) prom, any_value(b.h - prom * 0.5::double) wh, coalesce(max(d.bin) FILTER (d.bin >= lb AND d.bin <= p AND d.h <= b.h - prom * 0.5::double), any_value(lb)) li, coalesce(min(d.bin) FILTER (d.bin <= rb AND d.bin >= p AND d.h <= b.h - prom * 0.5::double), any_value(rb)) ri FROM {p}_b b JOIN d USING (frame_id, x, y) GROUP BY b.frame_id, b.x, b.y, b.p),
{p} AS (SELECT i.frame_id, i.x, i.y, CAST(i.p AS int) AS bin, CAST(i.h AS double) AS height, CAST(i.prom AS double) AS prominence,
   (i.ri - CASE WHEN r0.h < wh THEN (wh - r0.h) / (r1.h - r0.h) ELSE 0 END) - (i.li + CASE WHEN l0.h < wh THEN (wh - l0.h) / (l1.h - l0.h) ELSE 0 END) AS width
   FROM {p}_x i JOIN d l0 ON l0.frame_id = i.frame_id AND l0.x = i.x AND l0.y = i.y AND l0.bin = i.li LEFT JOIN d l1 ON l1.frame_id = i.frame_id AND l1.x = i.x AND l1.y = i.y AND l1.bin = i.li + 1
   JOIN d r0 ON r0.frame_id = i.frame_id AND r0.x = i.x AND r0.y = i.y AND r0.bin = i.ri LEFT JOIN d r1 ON r1.frame_id = i.frame_id AND r1.x = i.x AND r1.y = i.y AND r1.bin = i.ri - 1)""" + (
        f", {p}_wide AS (SELECT * FROM {p} WHERE width >= {min_width})" if min_width is not None else f", {p}_wide AS (SELECT * FROM {p})"
    )
