"""Pipeline stages one after another, each against what its operator says by brute force."""

import os

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from echograin.llm import langid, near_copies, packing, queries, shared, toxicity
from tests.llm.test_langid_fusion import brute as fused

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def components(texts):
    """Of a list of texts, the number of the first one that each is linked to."""
    sets = [near_copies.shingles(t) for t in texts]
    root, before = list(range(len(texts))), None
    near = [[j for j in range(len(texts)) if near_copies.similarity(sets[i], sets[j]) >= 0.8] for i in range(len(texts))]
    while root != before:
        before, root = root, [min(root[j] for j in near[i]) for i in range(len(texts))]
    return root


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        model = langid.model_of(docs) if name == "language_id" else None
        lexicon = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").where(~toxicity.held_out())) if name == "toxicity" else None
        docs = shared.written(stage(spark, docs, SF), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        after = docs.collect()
        kept = {r.doc_id for r in after}
        assert set(after) <= set(before) and len(after) == len(kept)
        if name == "language_id":
            found = fused([(r.doc_id, "d", r.text, None, r.source) for r in before], model)
            assert kept == {d for (d, _), (_, _, accepted) in found.items() if accepted}
        if name == "toxicity":
            assert kept == {r.doc_id for r in before if lexicon.score(r.text) < 0.5}
        if name == "exact_dedup":
            best = {}
            for r in before:
                best[r.text] = max(r.doc_id, best.get(r.text, -1))
            assert kept == set(best.values())
        if name == "simhash_near_dedup":
            before = sorted(before, key=lambda r: r.doc_id)
            root = components([r.text for r in before])
            assert kept == {before[k].doc_id for k in set(root)} and len(kept) < len(before)
        before = after
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = STAGES["best_fit_packing"](spark, docs, SF).collect()
    tokens = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in before}
    got, rooms = dict.fromkeys(tokens, 0), {}
    for r in packed:
        got[r.doc_id] += r.length
        rooms.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == tokens
    for spots in rooms.values():
        spots.sort()
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))] and sum(n for _, n in spots) <= packing.CAPACITY
    assert len(rooms) <= -(-sum(tokens.values()) // packing.CAPACITY) + 1
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_rows_decide_for_themselves(spark):
    good = "the of and that thing with this is the end of it"
    rows = [(1, good, "en", "s", 5), (1, good, "en", "s", 5), (None, good, None, None, None), (None, "another the of and that one", None, None, None), (2, None, "en", "s", None), (2, f"{good} and more than that", "en", "s", 1), (3, "", "en", "s", 0), (4, "1234 !!", "en", "s", 0), (5, "the long of and that " * 60_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"_row": shared.F.lit("x"), "_node": shared.F.lit(1)})
    kept = STAGES["language_id"](spark, docs, SF)
    assert sorted((r.doc_id or 0, len(r.text)) for r in kept.collect()) == sorted((d or 0, len(t)) for d, t, *_ in rows if t and t != "1234 !!")
    for name in ("toxicity", "exact_dedup", "simhash_near_dedup"):
        kept = STAGES[name](spark, kept, SF)
        assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert sorted((r.doc_id or 0, len(r.text)) for r in kept.collect()) == sorted([(1, len(good)), (0, 27), (2, len(good) + 19), (5, len(rows[-1][1]))])


def test_run_leaves_only_what_the_result_reads(spark):
    with shared.Scope(spark) as scope:
        found = corpus_pipeline.run(spark, SF)
        assert scope.made and not any(x in p for p in scope.made for x in ("near-", "lang-", "star-", "exact-", "crowd-"))
        assert found.count() > 0
        left = list(scope.made)
    assert left and not any(os.path.exists(p) for p in left)


def test_batches_for_python_workers_are_small(spark):
    """Of whole tables of long texts, with each stage's result still to be computed; a user's own setting stays."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('of the and ', id, ' '), 1000) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    for name, stage in corpus_pipeline.STAGES[:2]:
        spark.conf.unset(shared.BATCH_SETTING)
        found = stage(spark, docs, SF)
        seen = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in seen) == 3000 and max(r.size for r in seen) < 2 * shared.BATCH_BYTES < sum(r.size for r in seen) / 4, name
        assert found.columns == list(corpus_pipeline.COLUMNS)
    spark.conf.set(shared.BATCH_SETTING, "1000")
    for name, stage in corpus_pipeline.STAGES:
        found = shared.written(stage(spark, spark.read.parquet(f"{SF}/documents.parquet") if name == "language_id" else found, SF), name)
        assert spark.conf.get(shared.BATCH_SETTING) == "1000"
    small = sorted(map(tuple, found.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    spark.conf.unset(shared.BATCH_SETTING)
    assert small == sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_registered():
    found = queries.queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in found)] == []
    assert set(queries.oracle_sql()) <= set(found)
