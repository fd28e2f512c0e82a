"""Registration of queries and the tables they share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echograin import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its DuckDB equivalent."""

    def add(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six decimals, and no negative zero: sums of doubles depend on their order."""
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def new_folder(spark) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir, or on a local master a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(folder or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/echograin-{uuid.uuid4().hex}"


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks with true and predicted labels and their scene."""
    from echograin.operators import peaks as P
    from echograin.operators import points as G

    found = P.relative_peaks(X.waveforms(spark, sf_dir))
    truth, guess = X.labels(spark, sf_dir), X.labels(spark, sf_dir, "pred")
    rows = G.labelled(G.labelled(found, truth, "ann"), guess, "pred")
    return rows.withColumn("scene_id", X.scene())


#: DuckDB: peaks with both labels and their scene.
EVALUATED = X.SQL + X.peaks_sql("h >= mx * 0.1", 3) + """,
ev AS (SELECT k.frame_id, k.x, k.y, k.bin, d.ann, d.pred, concat('scene', lpad(CAST(k.frame_id % 3 AS string), 3, '0')) AS scene_id
       FROM peaks_wide k JOIN d ON d.frame_id = k.frame_id AND d.x = k.x AND d.y = k.y AND d.bin = k.bin),
cl AS (SELECT CAST(range AS int) AS c FROM range(4)),
cm AS (SELECT s.scene_id, a.c AS ann, p.c AS pred, (SELECT count(*) FROM ev WHERE ev.scene_id = s.scene_id AND ev.ann = a.c AND ev.pred = p.c) AS n
       FROM (SELECT DISTINCT scene_id FROM ev) s, cl a, cl p),
prf0 AS (SELECT scene_id, c AS class, CAST(sum(CASE WHEN ann = c AND pred = c THEN n ELSE 0 END) AS bigint) AS tp,
                CAST(sum(CASE WHEN pred = c AND ann <> c THEN n ELSE 0 END) AS bigint) AS fp, CAST(sum(CASE WHEN ann = c AND pred <> c THEN n ELSE 0 END) AS bigint) AS fn
         FROM cm, cl GROUP BY scene_id, c),
prf1 AS (SELECT *, tp + fn AS support, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM prf0),
prf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM prf1),
mac AS (SELECT scene_id, avg(precision) AS p, avg(recall) AS r, avg(f1) AS f FROM prf GROUP BY scene_id)
"""
