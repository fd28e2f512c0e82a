"""Exact top-k against brute force."""

import math
import random
import struct

import pytest

from echograin.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, row string"


def brute(rows, k):
    fine = []
    for vec, values, *_ in rows:
        if vec is None or values is None or any(v is None or not math.isfinite(v) for v in values):
            continue
        fine.append((vec, [math.floor(64 * struct.unpack("f", struct.pack("f", v))[0]) for v in values]))
    out = []
    for n, (q, a) in enumerate(fine):
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), v) for m, (v, b) in enumerate(fine) if m != n)
            out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, **options):
    found = topk.top_k(topk.quantised(spark.createDataFrame(rows, SCHEMA)), "vec_id % 20 = 0", **options).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_matches_brute_force(spark, monkeypatch, lists):
    monkeypatch.setattr(topk, "CHUNK_ROWS", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 9)
    random.seed(lists)
    rows = [(k, [random.choice([-0.5, 0.25, random.gauss(0, 0.2)]) for _ in range(8)], "", "") for k in range(300)]
    rows += [(300 + k, [0.5] * 8, "", "") for k in range(90)]  # ties
    rows += [(1000, None, "", ""), (1020, [1.0, None], "", ""), (1040, [float("nan")] * 8, "", ""), (1060, [float("inf")] * 8, "", ""), (None, [1.0] * 8, "", ""), (1080, [1.0, 2.0], "", ""), (1100, [], "", ""), (20, [0.125] * 8, "", ""), (21, [0.125] * 8, "", ""), (21, [-0.125] * 8, "", "")]
    assert run(spark, rows, k=20, lists=lists, depth=5 * lists) == brute(rows, 20)


def test_all_negative(spark):
    rows = [(k, [(-1) ** (k % 20 == 0) * (0.5 + k / 100), (-1) ** (k % 20 == 0) * 0.25], "", "") for k in range(100)]
    assert run(spark, rows, k=3) == brute(rows, 3)


def test_rows_of_one_id_are_candidates(spark):
    rows = [(0, [1.0], "", ""), (1, [2.0], "", ""), (1, [3.0], "", ""), (20, [1.0], "", ""), (20, [5.0], "", "")]
    assert run(spark, rows) == brute(rows, 20)


def test_few_rows_and_large_values(spark):
    rows = [(0, [1e6, -3e7], "", ""), (20, [2e7, 5.0], "", ""), (1, [3.5e7, 1e7], "", "")]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, [(0, [1.0], "", "")]) == []
    assert run(spark, []) == []


def test_scores_few_pairs_in_full(spark):
    vectors = topk.quantised(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    n = vectors.count()
    rows = topk.top_k(vectors, "vec_id % 20 = 0").collect()
    queries = {r.query_id for r in rows}
    assert len(rows) == 20 * len(queries) == 20 * n / 20
    most = {}
    for r in rows:
        most[r.query_id] = max(most.get(r.query_id, 0), r.resolved)
    assert sum(most.values()) < 0.2 * n * len(queries)
