"""Near copies of the pipeline: planted ones at 0.8 to 0.95, and brute force on their shingles."""

import random

import corpus_pipeline
from echograin.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    return sorted((r.doc_id is None, r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())


def changed(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.randrange(10**9)}"
    return words


def jaccard(a, b):
    return near_copies.similarity(near_copies.shingles(a), near_copies.shingles(b))


def test_planted_copies(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for k in range(300):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((100, 200, 400)))]
        text = " ".join(words)
        copy = " ".join(changed(rng, words, rng.randrange(1, 1 + len(words) // 25)))
        rows += [(2 * k, text), (2 * k + 1, copy)]
        want |= {2 * k} | (set() if jaccard(text, copy) >= 0.8 else {2 * k + 1})
    assert 100 < 600 - len(want) < 300
    assert {r[1] for r in kept(spark, rows)} == want


def test_crowded_group(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(changed(rng, base, rng.randrange(2, 9)))) for k in range(150)]
    root = {d: d for d, _ in rows}
    while True:
        least = {d: min(root[e] for e, u in rows if e == d or jaccard(t, u) >= 0.8) for d, t in rows}
        if least == root:
            break
        root = least
    want = {d for d in root if root[d] == d}
    assert {r[1] for r in kept(spark, rows)} == want
    monkeypatch.setattr(near_copies, "MAX_MEMBERS", 40)
    assert {r[1] for r in kept(spark, rows)} == want


def test_rows_decide_for_themselves(spark):
    one, other = (" ".join(f"{c}{k}" for k in range(100)) for c in "ab")
    near = one.replace("a50", "x")
    rows = [(1, one), (2, near), (2, other), (None, near), (None, "only this one"), (7, "same  words"), (7, "same words")]
    got = kept(spark, rows)
    assert [r[1] for r in got] == [1, 2, 7, None] and got[1][2] == other and got[3][2] == "only this one"


def test_documents_against_brute_force(spark):
    docs = corpus_pipeline.drop_copies(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "")
    rows = {r.doc_id: near_copies.shingles(r.text) for r in docs.collect()}
    root, before = {d: d for d in rows}, None
    near = {d: [e for e in rows if near_copies.similarity(rows[d], rows[e]) >= 0.8] for d in rows}
    while root != before:
        before, root = root, {d: min(root[e] for e in near[d]) for d in rows}
    want = {d for d in root if root[d] == d}
    assert len(want) < len(rows)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want


def test_words_cut_by_ranges_are_compared_again(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(changed(rng, base, 3))) for k in range(120)] + [(1000 + k, " ".join(f"u{k}x{j}" for j in range(30))) for k in range(60)]
    docs = spark.createDataFrame(rows, "c1 long, c2 string")
    nodes = near_copies._sketched(docs, "c2").selectExpr("c1 AS node", "_words AS words", "_sketch AS sketch")
    placed = near_copies._placed(nodes).collect()
    found = near_copies._candidates(near_copies._placed(nodes), True).collect()
    heads = {(r.edge, r.word) for r in found if r.edge is not None and r.edge >= 0}
    assert len(placed) == 25 * len(rows) and heads and all(r.a is not None for r in found)
    want = {d for d, _ in rows if d >= 1000} | {0}
    assert {r[1] for r in kept(spark, rows)} >= want


def distinct_groups(sets):
    """Number of connected groups, by all pairs."""
    near = near_copies.shared_pairs(sets, sets)
    left, groups = set(range(len(sets))), 0
    while left:
        groups += 1
        todo = [left.pop()]
        while todo:
            fresh = left.intersection(near[todo.pop()].nonzero()[0].tolist())
            left -= fresh
            todo += fresh
    return groups


def test_products_equal_similarities():
    rng = random.Random(3)
    base = [f"w{k}" for k in range(80)]
    sets = [near_copies.shingles(" ".join(changed(rng, base, rng.randrange(5)))) for _ in range(40)]
    for columns in (7, 1 << 13):
        near_copies.COLUMNS, before = columns, near_copies.COLUMNS
        got = near_copies.shared_pairs(sets[:15], sets[15:])
        near_copies.COLUMNS = before
        assert got.tolist() == [[near_copies.similarity(a, b) >= 0.8 for b in sets[15:]] for a in sets[:15]]


def test_large_crowd_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 200)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(changed(rng, base, rng.randrange(3, 16)))) for k in range(3000)]
    want = distinct_groups([near_copies.shingles(t) for _, t in rows])
    assert 1500 < want < 2900
    assert len(kept(spark, rows)) == want


def test_crowds_without_a_largest_group(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 9)
    rng = random.Random(18)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(changed(rng, base, rng.choice([1, 2, 4])))) for k in range(200)]
    assert len(kept(spark, rows)) == distinct_groups([near_copies.shingles(t) for _, t in rows])


def test_ball_hashing_finds_copies_without_minhash(spark, monkeypatch):
    """SimHash's own part: pairs within the ball are linked if they are similar, and no others, also where fingerprints are equal."""
    monkeypatch.setattr(near_copies, "_pairs_of", lambda node, sketches: [])
    rng = random.Random(21)
    rows, near, alike = [], set(), set()
    for k in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        copy = " ".join(changed(rng, words, rng.choice((1, 2, 4, 60))))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, copy)]
        if jaccard(rows[-2][1], copy) >= 0.8:
            alike.add(2 * k + 1)
            bits = simhash.fingerprint(rows[-2][1], near_copies.WIDTH) ^ simhash.fingerprint(copy, near_copies.WIDTH)
            near |= {2 * k + 1} if bits.bit_count() <= simhash.RADIUS else set()
    often = "go " * 3000
    tails = [" ".join(f"{c}{k}" for k in range(100)) for c in "ab"]
    equal = [(1000, often + tails[0]), (1001, often + tails[0].replace("a50", "x")), (1002, often + tails[1])]
    assert len({simhash.fingerprint(t, near_copies.WIDTH) for _, t in equal}) == 1 and jaccard(equal[0][1], equal[1][1]) >= 0.8
    gone = {d for d, _ in rows + equal} - {r[1] for r in kept(spark, rows + equal)}
    assert len(near) > 20 and near | {1001} <= gone <= alike | {1001}
