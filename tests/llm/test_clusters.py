"""Centroid clustering against a plain loop."""

import hashlib
import math
import random
import struct

import pytest

from echograin.llm import clusters
from tests import oracle

SCHEMA = "vec_id long, embedding array<float>, v string, cluster string, id string"


def single(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def brute(rows, k=16, rounds=3, dims=64):
    kept = []
    for ident, values, *_ in rows:
        if values is not None and len(values) == dims and all(x is not None and math.isfinite(x) for x in values):
            kept.append((ident, [max(-clusters.BOUND, min(clusters.BOUND, math.floor(64 * single(x)))) for x in values]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(assign(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[n]) for x in zip(*members[n], strict=True)] if n in members else c for n, c in enumerate(centroids)]
    found = [(ident, *assign(v)) for ident, v in kept]
    by = {}
    for _, d, n in found:
        by[n] = by.get(n, 0) + d
    return sorted(((i, n, d, min(by[n], clusters.LARGEST), min(sum(by.values()), clusters.LARGEST), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found), key=str)


def run(spark, rows, **options):
    df = clusters.cluster(spark.createDataFrame(rows, SCHEMA), **options)
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def vector(dims=64, scale=0.3):
    return [single(random.gauss(0, scale)) for _ in range(dims)]


def test_matches_brute_force(spark):
    random.seed(13)
    rows = [(k, vector(), "", "", "") for k in range(150)] + [(k, [0.25] * 64, "", "", "") for k in range(500, 560)]
    rows += [(7, vector(), "", "", ""), (None, vector(), "", "", ""), (7, rows[7][1], "", "", "")]
    rows += [(901, None, "", "", ""), (902, vector(63), "", "", ""), (903, vector(65), "", "", ""), (904, [None, *vector(63)], "", "", ""), (905, [float("nan"), *vector(63)], "", "", ""), (906, [float("-inf"), *vector(63)], "", "", ""), (907, [], "", "", "")]
    assert run(spark, rows) == brute(rows)


def test_ties_fewer_vectors_and_empty_clusters(spark):
    rows = [(k, [float(k // 3)] * 2, "", "", "") for k in range(9)]
    for k in (2, 5, 16):
        assert run(spark, rows, k=k, dims=2) == brute(rows, k=k, dims=2)
    assert run(spark, rows, k=4, dims=2, rounds=0) == brute(rows, k=4, dims=2, rounds=0)


def test_large_components_stay_exact(spark):
    random.seed(2)
    rows = [(k, [random.choice([3e38, -3e38, 2e6, -1.5e6, 1.0]) for _ in range(64)], "", "", "") for k in range(40)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], "", "", "")]) == []


def test_parameters(spark):
    with pytest.raises(ValueError):
        run(spark, [], dims=1000)


def test_sql_with_nulls_and_repeats(spark):
    random.seed(4)
    rows = [(random.choice([None, k, k % 7]), random.choice([vector(), [0.5] * 64, None, [1.0], [None] * 64]), "", "", "") for k in range(120)]
    con = oracle.duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [list(r[:2]) for r in rows])
    assert oracle.assert_equal(clusters.cluster(spark.createDataFrame(rows, SCHEMA)), con, clusters.OP13_SQL)


def test_no_python_in_the_plan(spark):
    df = clusters.whole(spark.createDataFrame([(1, vector(), "", "", "")], SCHEMA))
    plan = df.select(clusters.nearest(df["v"], [[0] * 64, [1] * 64]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
