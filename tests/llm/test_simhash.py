"""SimHash groups against brute force, on both ways through crowded words."""

import random

import pytest
import xxhash

from echograin.llm import components, simhash


def plain_fingerprint(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, p - (1 << 64) if p >> 63 else p, least.get(find(i))) for i, ((d, *_), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def texts(n):
    random.seed(5)
    words = [f"w{k}" for k in range(300)]
    made = [" ".join(random.choices(words, k=random.choice([0, 1, 3, 4, 60, 200]))) for _ in range(n)]
    for base in range(0, n, 7):  # near copies, in chains
        for k in range(1, 4):
            w = made[base].split() or ["x"]
            w[random.randrange(len(w))] = random.choice(words)
            made[(base + k) % n] = " ".join(w)
    return made


@pytest.mark.parametrize("options", [{}, {"blocks": 1}, {"max_pairwise": 2}])
def test_matches_brute_force(spark, options):
    rows = [(k * 3 % 251, t, "clash") for k, t in enumerate(texts(150))]
    rows += [(900, None, ""), (901, "", ""), (902, "A\tB  c\x0bD É", ""), (902, "a b c d É", ""), (None, "a b c d É", ""), (None, "alone " * 9, "")]
    rows += [(7, " ".join(f"p{k}" for k in range(50)), ""), (7, " ".join(f"q{k}" for k in range(50)), ""), (3, " ".join(f"p{k}" for k in range(50)), ""), (9999, "word " * 400_000, "")]  # one id, two texts; a long text
    df = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string"), **options)
    assert sorted((tuple(r) for r in df.select("doc_id", "fp", "component_id").collect()), key=str) == brute(rows)


def test_ball_sizes_and_cover():
    assert len(simhash.ball(4, 1)) == 2081
    assert len(simhash.ball(4, 3)) == 131
    masks = [(m & (1 << 64) - 1, f & (1 << 64) - 1) for m, f in simhash.ball(4, 3)]
    random.seed(1)
    for _ in range(200):
        a = random.getrandbits(64)
        b = a
        for bit in random.sample(range(64), random.randrange(5)):
            b ^= 1 << bit
        assert {(a & m) ^ f for m, f in masks} & {(b & m) ^ f for m, f in masks}


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_one_id_with_two_texts_joins_no_groups(spark):
    one, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(5, one), (5, other), (2, one), (3, other)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(2, 2), (3, 3), (5, 2), (5, 3)]


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = simhash.op3_simhash(spark, folder).collect()
    want = [(d, f"{p & (1 << 64) - 1:016x}", c) for d, p, c in brute(rows)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_components(spark):
    random.seed(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(random.randrange(400, 500), random.randrange(400, 500)) for _ in range(60)] + [(3, 3)]
    random.shuffle(edges)
    graph = {}
    for a, b in edges:
        if a != b:
            graph.setdefault(a, set()).add(b)
            graph.setdefault(b, set()).add(a)
    want, seen = {}, set()
    for node in sorted(graph):
        if node not in seen:
            todo = [node]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    want[x] = node
                    todo += graph[x]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_fingerprint_of_more_shingles_than_one_part():
    """Counts go on from part to part: against one plain count over all shingles."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(3000)}" for _ in range(140_000)]
    votes = [0] * 64
    for k in range(len(words) - 3):
        h = xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42)
        for bit in range(64):
            votes[bit] += h >> bit & 1
    want = sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(words) - 3)
    assert simhash.fingerprint(" ".join(words)) == want
