"""Centroid clustering of whole-number vectors in JVM expressions: distances to literal centroids, the nearest by the least of structs, centroids by column sums.

Vectors are cut to whole numbers once and written; every round reads them, names each one's nearest centroid and sums up
components by cluster. Sums are combined inside each task, so a round moves one row per task and cluster, however many vectors
a cluster has. Only centroids (k times the number of components) come to the driver, and they go out as literals of the next round's plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

CLUSTERS = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
SEED = 1
#: Whole components lie within this bound, so that squared distances of up to 128 components fit a long.
BOUND = 1 << 27
MOST_DIMS = 128
#: Numbers in all literal centroids at most: what a plan can hold.
MOST_LITERALS = 1 << 17
LARGEST = (1 << 63) - 1


def whole(vectors: DataFrame, vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """Rows whose vector has exactly dims components, none of them null or non-finite, with v: the whole components floor(scale * x) as longs, within BOUND."""
    taken = shared.without(vectors, "v") if vector_col != "v" else vectors
    x = shared.column_of(taken, vector_col).cast("array<double>")
    fine = (F.size(x) == dims) & ~F.exists(x, lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    return taken.where(fine).withColumn("v", F.transform(x, lambda a: F.floor(F.greatest(F.least(a * scale, F.lit(float(BOUND))), F.lit(float(-BOUND)))).cast("long")))


def literal(centroid: Iterable[int]) -> Column:
    return F.expr("array(" + ",".join(f"{int(x)}L" for x in centroid) + ")")


def distance(v: Column, centroid: Iterable[int]) -> Column:
    """Squared Euclidean distance of whole-number arrays, as a long."""
    return F.aggregate(F.zip_with(v, literal(centroid), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda total, d: total + d)


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid, of equally near ones that with the smallest number."""
    return F.array_min(F.array(*[F.struct(distance(v, c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]))


def first_centroids(vectors: DataFrame, id_col: str, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose "seed:id" hashes lowest, in that order; of rows of one id the smaller vector comes first."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(shared.column_of(vectors, id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["v"]) for r in vectors.select(drawn.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: of each cluster with vectors the componentwise floor(sum / count); the others stay."""
    dims = len(centroids[0])
    placed = vectors.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster"))
    sums = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(dims)])
    after = list(centroids)
    for r in sums.collect():  # one row per cluster
        after[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(dims)]
    return after


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """The id of every kept vector with cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 (of the final centroid's components, joined by commas).

    Each of `rounds` rounds assigns all vectors and moves the centroids; then vectors are assigned once more. Python sees
    centroids only, and no row is shuffled.

    Defined results: vectors that are null, of another number of components, or hold a null or non-finite component have no
    row; components beyond BOUND count as that bound; a null id draws as an empty one and is kept; rows of one id are
    vectors for themselves; with fewer vectors than k there are fewer clusters, empty clusters stay where they are; inertia ends at the
    largest long; other columns are left out, whatever their names; an empty table gives an empty table.
    """
    if not (1 <= dims <= MOST_DIMS and k >= 1 and k * dims <= MOST_LITERALS):
        raise ValueError(f"k {k}, dims {dims}: at most {MOST_DIMS} components, {MOST_LITERALS} numbers in all centroids")
    given = vectors.select(shared.column_of(vectors, id_col).alias("id"), shared.column_of(vectors, vector_col).alias("vector"))
    kept = shared.written(whole(given, "vector", dims, scale).select("id", "v"), "cluster-vectors")
    centroids = first_centroids(kept, "id", k, seed)
    out = "id, cluster, distance, cluster_inertia, inertia, centroid_sha256".split(", ")
    if not centroids:
        empty = kept.select("id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in out[2:5]], F.lit("").alias(out[5]))
        return empty.withColumnRenamed("id", id_col)
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    best = kept.select("id", nearest(F.col("v"), centroids).alias("b")).select("id", F.col("b.cluster").alias("cluster"), F.col("b.distance").alias("distance"))
    placed = shared.written(best, "cluster-places", kept)
    inertia = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row per cluster
    rows = [(c, min(s, LARGEST), min(sum(inertia.values()), LARGEST), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in inertia.items()]
    about = kept.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select(*out).withColumnRenamed("id", id_col)


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    """cluster() of the whole embeddings table; edge cases as defined there."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(number: int) -> str:
    """CTEs of one round: a<number> assigns by c<number>, c<number + 1> holds the moved centroids."""
    return f"""
     a{number} AS MATERIALIZED (
       SELECT r, any_value(vec_id) AS vec_id, any_value(q.v) AS v, arg_min(c.c, (d, c.c)) AS c, min(d) AS d
       FROM q, c{number} AS c, LATERAL (SELECT list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d) GROUP BY r),
     c{number + 1} AS MATERIALIZED (
       SELECT o.c, coalesce(m.v, o.v) AS v
       FROM c{number} AS o LEFT JOIN (
         SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v
         FROM (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{number}) GROUP BY c, j) GROUP BY c) AS m ON o.c = m.c)"""


OP13_SQL = f"""
WITH q AS MATERIALIZED (
       SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
       FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
     c0 AS MATERIALIZED (
       SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM q QUALIFY c < 16),{','.join(_round_sql(k) for k in range(4))}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (c)
"""
