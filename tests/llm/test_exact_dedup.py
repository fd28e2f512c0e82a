"""Exact deduplication against brute force, and with a hash that collides."""

import hashlib
import random

from pyspark.sql import functions as F

from echograin.llm import exact_dedup, shared

SCHEMA = "doc_id long, text string, lang string, keep_id string"


def brute(rows):
    groups = {}
    for k, (doc, text, *_) in enumerate(rows):
        groups.setdefault(text or "", []).append((doc is not None, doc or 0, k))
    out, taken = [], set()
    for doc, text, *_ in rows:
        _, _, best = max(groups[text or ""])
        keep = rows[best][0]
        kept = doc == keep and (text or "") not in taken  # one row of each class
        if kept:
            taken.add(text or "")
        out.append((doc, keep, len(groups[text or ""]), kept, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **options):
    df = exact_dedup.mark_duplicates(spark.createDataFrame(rows, SCHEMA), **options)
    got = sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    assert got == brute(rows)


def test_matches_brute_force(spark):
    random.seed(3)
    texts = [f"text {k % 40}" for k in range(100)] + ["", None, "a" * 200_000, "é", "é"] * 3
    rows = [(k, random.choice(texts), "en", "clash") for k in range(300)]
    check(spark, rows)


def test_collisions_stay_apart(spark):
    rows = [(k, f"t{k % 30}", None, None) for k in range(200)]
    check(spark, rows, hash_of=lambda text: F.unhex(F.substring(F.md5(text), 1, 2)))


def test_hot_group_nulls_and_repeated_rows(spark):
    check(spark, [(k, "same", "en", None) for k in range(3000)] + [(k, f"u{k}", "en", None) for k in range(5000, 5500)] + [(7000, "twice", "en", None)] * 2 + [(None, "only null ids", "en", None)])


def test_empty(spark):
    check(spark, [])


def test_drop_keeps_columns(spark):
    rows = [(1, "a", "en", "x"), (2, "a", "de", "y"), (3, None, "fr", "z")]
    kept = exact_dedup.drop_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_clashing_names_stay(spark):
    rows = [(1, "a", "u", "v", "w", 1), (2, "a", "u2", "v2", "w2", 2), (3, "b", "u3", "v3", "w3", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash string, _copied string, _Row string, _part int")
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [rows[1], rows[2]]


def test_smallest_id_and_large_groups_in_slots(spark, monkeypatch):
    monkeypatch.setattr(shared, "GROUP_ROWS", 7)
    monkeypatch.setattr(shared, "HOT_SHARE", 0.5)
    rows = [(k, f"t{k % 40 if k % 3 else 0}", None, None) for k in range(900)]
    kept = exact_dedup.drop_duplicates(spark.createDataFrame(rows, SCHEMA), keep="min")
    first = {}
    for k, text, *_ in rows:
        first.setdefault(text, k)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.drop_duplicates(spark.createDataFrame([(k, f"t{k}", "", "") for k in range(50)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
