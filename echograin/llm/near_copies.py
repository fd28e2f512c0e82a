"""Near copies by resemblance: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

This is the SimHash operator's mode for a similarity on shingles. Each text has the SimHash fingerprint of its five-word shingles;
fingerprints whose balls meet (see simhash) are candidates, verified on their shingles, and what passes is linked.

At a similarity of 0.8 two fingerprints differ in 9.7 of 64 bits on average and in 16 and more in the tail; a ball of half that radius
has 5 * 10**9 words, so ball hashing finds the closer pairs only. Those that it cannot reach come from MinHash: BANDS words of ROWS minima
each, of which two texts of similarity s share one with probability 1 - (1 - s**ROWS)**BANDS (0.99995 at 0.8). All
candidates are verified on their shingles, so no text below MIN_SIMILARITY is linked.

Texts that share a word are paired where they are few. Where they are many, they are taken in overlapping parts in the
order of their sketches, and each is paired with the members of largest estimated similarity and along a maximum spanning forest
of the estimates: two texts of similarity s are connected in it by steps of at least s, but for the estimate's error, and pairs grow with the members
only. Each is paired with the part's leader, too, the member that most others are like. First one pair of each text is verified, that
with a leader before those of SimHash's radius before others, then the pairs, of the ball and of MinHash, between texts that are not connected yet.

What the estimates miss in a crowd is made good exactly: where the members of a crowded word are still in several
groups, all of them that can reach the similarity at all are compared on their shingles, block by block, but for pairs inside the crowd's
largest group, which are connected already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, shared, simhash

SEED = 42
WIDTH = 5
MIN_SIMILARITY = 0.8
#: Bits in which fingerprints whose balls meet may differ for a pair to be verified: 9.7 expected at 0.8, 6.6 at 0.9.
REACH = 12
BANDS, ROWS = 25, 5
#: Permutations; a sketch has two bits of each minimum.
HASHES = 128
SKETCH = HASHES // 4
#: Equal places of two sketches (108.8 expected at 0.8, standard deviation 4.0) under which a pair is not verified; similarity 0.6 is expected there.
MIN_ALIKE = 90
#: Equal places from which a member follows a leader.
LEAD_ALIKE = 109
#: Members of a word that are all paired; likeliest members that each is paired with otherwise; members compared at once, in the order of their sketches.
ALL_PAIRS = 8
NEIGHBOURS = 3
MAX_MEMBERS = 2048
#: Pairs of one text that are verified in one task.
TASK_PAIRS = 1 << 12
#: Members, and shingles, of a block of a crowd, about; shared shingles that are counted at once.
BLOCK = 1 << 10
BLOCK_SHINGLES = 1 << 21
COLUMNS = 1 << 13
_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 1 << 64, HASHES, dtype=np.uint64)[:, None]
_FACTOR = (_rng.integers(0, 1 << 64, HASHES, dtype=np.uint64) | np.uint64(1))[:, None]
_EVEN = np.uint64(0x5555555555555555)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of all words where they are fewer; none of a text without words."""
    return np.unique(simhash.shingle_hashes(text, width))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of HASHES permutations."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[None, at : at + 1024] ^ _FLIP) * _FACTOR).min(axis=1), out=least)
    return least


def sketch(least: np.ndarray) -> bytes:
    """Two bits of each minimum, side by side."""
    codes = (least >> np.uint64(40)).astype(np.uint8)
    return np.packbits(np.stack([codes & 1, codes >> 1 & 1], axis=1).ravel(), bitorder="little").tobytes()


def alike(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Places in which a sketch, as four words, equals each of others."""
    x = one ^ others
    return HASHES - np.bitwise_count((x | x >> np.uint64(1)) & _EVEN).sum(axis=-1, dtype=np.int64)


def _sketched(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with _hash (SHA-256 of the text's words, which tells equal texts), _words (one per band; none without shingles), _sketch and _fp (SimHash of the shingles, repeats included)."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, words, sketches, prints = [], [], [], []
            for text in batch.column(at):
                plain = text.as_py()
                every = simhash.shingle_hashes(plain, WIDTH)
                found = np.unique(every)
                least = minima(found)
                hashes.append(hashlib.sha256(b" ".join((plain or "").encode().lower().split())).digest())
                words.append(np.array([xxhash.xxh64_intdigest(least[k * ROWS : k * ROWS + ROWS].tobytes(), k) for k in range(BANDS)] if len(found) else [], np.uint64).view(np.int64))
                sketches.append(sketch(least))
                prints.append(simhash.majority(every))
            arrays = [pa.array(hashes, pa.binary()), pa.array(words, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*names, "_hash", "_words", "_sketch", "_fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, _hash binary, _words array<long>, _sketch binary, _fp long")


def _close(nodes: DataFrame) -> DataFrame:
    """a, b, bits: pairs of nodes to verify whose fingerprints are near, by ball hashing, and the bits in which these differ. A fingerprint's first node stands for it; nodes of one fingerprint are all paired where they are few, else each with the first."""
    some = nodes.where(F.size("words") > 0).select("fp", "node")
    prints = shared.written(some.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "near-prints")
    pairs = shared.written(simhash.links(prints, reach=REACH), "near-balls")
    for end in ("a", "b"):
        ends = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")).join(prints.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}")), end)
        pairs = shared.join_groups(pairs, shared.written(ends, "near-ends"), [end], "n", "inner")
    several = prints.where("n > 1").withColumn("many", F.col("n") > ALL_PAIRS)
    same = shared.written(shared.join_groups(some, several, ["fp"], "n", "inner"), "near-same")
    few = same.where("NOT many").select("fp", F.col("node").alias("a"))
    few = few.join(few.select("fp", F.col("a").alias("b")), "fp").where("a < b").select("a", "b", F.lit(0).alias("bits"))
    many = same.where("many AND node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"), F.lit(0).alias("bits"))
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("bits")
    both = pairs.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"), bits).where(F.col("bits") <= REACH)
    return shared.written(both.unionByName(few).unionByName(many), "near-close")


def _placed(nodes: DataFrame) -> DataFrame:
    """word, node, sketch (turned, so that each band has an order of its own) of each band, in ranges of word and sketch: a word with many members lies in several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1).to_pylist()
            some = np.flatnonzero([len(w) > 0 for w in words])
            if not len(some):
                continue
            node, sketches = batch.column(0).to_numpy(zero_copy_only=False)[some], batch.column(2).to_pylist()
            word = np.array([words[k] for k in some], np.int64)
            for band in range(BANDS):
                turned = [sketches[k][band:] + sketches[k][:band] for k in some]
                yield pa.record_batch([pa.array(word[:, band]), pa.array(node), pa.array(turned, pa.binary())], names=["word", "node", "sketch"])

    placed = nodes.select("node", "words", "sketch").mapInArrow(run, "word long, node long, sketch binary")
    return placed.repartitionByRange("word", "sketch").sortWithinPartitions("word", "sketch")


def _pairs_of(node: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The pairs of a word's members to verify: the smaller and the larger node, their alikeness, and which of them leads (1 or 2, else 0)."""
    n = len(node)
    found = []
    if n <= ALL_PAIRS:
        for k in range(n - 1):
            same = alike(sketches[k], sketches[k + 1 :])
            found += [(node[k], node[k + 1 + j], same[j], 0) for j in np.flatnonzero(same >= MIN_ALIKE)]
    else:
        best, via, out, followers = np.full(n, -1), np.zeros(n, int), np.ones(n, bool), np.zeros(n, int)
        k = 0
        for _ in range(n):  # Prim: k joins the tree
            if best[k] >= MIN_ALIKE:
                found.append((node[via[k]], node[k], best[k], 0))
            out[k] = False
            same = alike(sketches[k], sketches)
            same[k] = -1
            followers[k] = (same >= LEAD_ALIKE).sum()
            near = np.argpartition(same, n - NEIGHBOURS)[n - NEIGHBOURS :]
            found += [(node[k], node[j], same[j], 0) for j in near if same[j] >= MIN_ALIKE]
            closer = out & (same > best)
            best[closer], via[closer] = same[closer], k
            if not out.any():
                break
            k = int(np.where(out, best, -2).argmax())
        k = int(followers.argmax())
        same = alike(sketches[k], sketches)
        found += [(node[k], node[j], same[j], 1) for j in np.flatnonzero(same >= LEAD_ALIKE)]
    return [(x, y, s, lead) if x < y else (y, x, s, 2 * lead) for x, y, s, lead in found if x != y]


CROWD = -1
_FOUND = "a long, b long, alike long, lead long, word long, sketch binary, edge long"


def _candidates(rows: DataFrame, edges: bool) -> DataFrame:
    """a, b, alike, lead: pairs of nodes to verify, of rows (word, node, sketch) in the order of their words and sketches.

    With edges, the members of the words with which a task begins and ends, half of MAX_MEMBERS at most, come out too
    (as a, word, sketch and the number of the edge between two tasks): a word may go on in the next one. Members of crowded
    words come out as a and word with CROWD for an edge.
    """
    half = MAX_MEMBERS // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        word: int | None = None
        held_node, held = np.empty(0, np.int64), np.empty((0, SKETCH // 8), np.uint64)
        first_word, head = None, 0
        crowds: list[tuple[int, np.ndarray]] = []
        names = [c.split()[0] for c in _FOUND.split(", ")]

        def pairs_batch(found: list) -> pa.RecordBatch:
            pairs = np.unique(np.array(found, np.int64).reshape(-1, 4), axis=0)
            n = len(pairs)
            return pa.record_batch([*[pa.array(pairs[:, k]) for k in range(4)], pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=names)

        def paired(word: int, node: np.ndarray, sketches: np.ndarray) -> list:
            if len(node) > ALL_PAIRS:
                crowds.append((word, node))
            return _pairs_of(node, sketches)

        def crowd_batch() -> pa.RecordBatch:
            node = np.concatenate([n for _, n in crowds])
            word = np.repeat([w for w, _ in crowds], [len(n) for _, n in crowds])
            crowds.clear()
            return pa.record_batch([pa.array(node), *[pa.nulls(len(node), pa.int64())] * 3, pa.array(word), pa.nulls(len(node), pa.binary()), pa.array(np.full(len(node), CROWD))], names=names)

        def edge_batch(word: int, node: np.ndarray, sketches: np.ndarray, edge: int) -> pa.RecordBatch:
            n = len(node)
            return pa.record_batch([pa.array(node), *[pa.nulls(n, pa.int64())] * 3, pa.array(np.full(n, word)), pa.array([s.tobytes() for s in sketches], pa.binary()), pa.array(np.full(n, edge))], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            words, nodes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            sketches = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, SKETCH // 8)
            found: list[tuple[int, int, int, int]] = []
            starts = np.concatenate([[0], np.flatnonzero(words[1:] != words[:-1]) + 1])
            ends = np.append(starts[1:], len(words))
            if first_word is None:
                first_word = words[0]
            if edges and words[0] == first_word and head < half:
                some = min(int(ends[0]), half - head)
                yield edge_batch(first_word, nodes[:some], sketches[:some], part)
                head += some
            if word is not None and words[0] != word:
                found += paired(word, held_node, held)
                held_node, held = held_node[:0], held[:0]
            last = len(starts) - 1
            for k in [0, *(np.flatnonzero((ends - starts)[1:last] > 1) + 1), *([last] if last else [])]:
                node, own = nodes[starts[k] : ends[k]], sketches[starts[k] : ends[k]]
                if k == 0:
                    node, own = np.concatenate([held_node, node]), np.concatenate([held, own])
                while len(node) > MAX_MEMBERS:  # the last half is compared with what follows, too
                    found += paired(words[starts[k]], node[:MAX_MEMBERS], own[:MAX_MEMBERS])
                    node, own = node[half:], own[half:]
                if k < last:
                    found += paired(words[starts[k]], node, own)
                    node, own = node[:0], own[:0]
                held_node, held = node.copy(), own.copy()
            word = words[-1]
            if found:
                yield pairs_batch(found)
            if crowds:
                yield crowd_batch()
        yield pairs_batch(paired(word, held_node, held))
        if crowds:
            yield crowd_batch()
        if edges and word is not None:
            yield edge_batch(word, held_node[-half:], held[-half:], part + 1)

    return rows.mapInArrow(run, _FOUND)


def _sets(wanted: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """node, n, set: the shingles of each wanted node (node, n, _row of a row that has its text), cut once; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shingles(t.as_py()).view(np.int64) for t in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64()))], names=["node", "n", "set"])

    rows = shared.sieve(rows.select("_row", F.col(text_col).alias("text")), shared.written(wanted.select("_row"), "near-wanted"), "_row", "_wanted").where("_wanted")
    return shared.written(rows.join(wanted, "_row").select("node", "n", "text").mapInArrow(run, "node long, n long, set array<long>"), "near-sets")


def _members(column: pa.ListArray) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in column]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose shingles have MIN_SIMILARITY. Pairs of one text are dealt to tasks of TASK_PAIRS."""
    for side in ("a", "b"):
        pairs = shared.join_groups(pairs, sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}"), "n"), [side], "n", "inner", most_rows=TASK_PAIRS, small=False)
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.where(both / (F.size("set_a") + F.size("set_b") - both) >= MIN_SIMILARITY).select("a", "b")


def _merged(roots: DataFrame, joined: DataFrame) -> DataFrame:
    """node, root after links between roots (joined: node, root); a written table."""
    known = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    return shared.written(known.unionByName(joined.join(roots.select("node"), "node", "left_anti").select("node", "root")), "near-roots")


def shared_pairs(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Whether each set of one and each of other have MIN_SIMILARITY, by products over the shingles that several sets have."""
    sets = [*one, *other]
    sizes = np.array([len(x) for x in sets])
    found, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    number = np.cumsum(times > 1) - 1  # of the shingles that occur twice or more
    some = times[at] > 1
    row, at = row[some], number[at[some]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((len(one), len(other)))
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        a, b = np.searchsorted(at, (low, low + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[a:b], at[a:b] - low] = 1
        both += held[: len(one)] @ held[len(one) :].T
    return both / (sizes[: len(one), None] + sizes[None, len(one) :] - both) >= MIN_SIMILARITY


def _crowd_links(crowds: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame | None:
    """a, b: roots that a pair of texts in a crowd (word, node; a written table) connects; None where all crowds are connected.

    A text of which over a fifth of the shingles occur in no other text of the crowd cannot be as similar to any, so it is left out. Blocks
    of the others meet in pairs, those outside the crowd's largest group with all, so work is their number times the crowd's.
    """
    placed = crowds.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = shared.written(placed.groupBy("word").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("low <> high"), "crowd-open")
    if open_.isEmpty():
        return None
    star = shared.join_groups(crowds, open_.select("word", "first", "n"), ["word"], "n", "inner").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    members = components.connected(shared.written(star, "crowd-stars")).withColumnRenamed("root", "crowd")
    members = members.join(roots, "node", "left").select("node", "crowd", F.coalesce("root", "node").alias("root")).join(sets.select("node", "set"), "node")
    members = shared.written(members, "crowd-members")
    alone = members.select("node", "crowd", F.explode("set").alias("x")).groupBy("crowd", "x").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    able = members.join(alone, "node", "left").where((F.size("set") - F.coalesce("own", F.lit(0))) / F.size("set") >= MIN_SIMILARITY).drop("own")
    able = shared.written(able, "crowd-able", members)
    groups = able.groupBy("crowd", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("set")).alias("x"))
    blocks = lambda n, x: F.greatest(F.ceil(n / BLOCK), F.ceil(x / BLOCK_SHINGLES))
    sizes = groups.groupBy("crowd").agg(F.max_by(F.struct("root", "n", "x"), F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.sum("x").alias("x")).where("n > top.n")
    sizes = sizes.select("crowd", "n", F.col("top.root").alias("main"), blocks(F.col("n") - F.col("top.n"), F.col("x") - F.col("top.x")).alias("rest"), blocks(F.col("top.n"), F.col("top.x")).alias("mains"))
    dealt = shared.join_groups(able, shared.written(sizes, "crowd-sizes"), ["crowd"], "n", "inner")
    in_main = F.col("root") == F.col("main")
    block = F.when(in_main, F.col("rest") + F.pmod(F.xxhash64("node"), "mains")).otherwise(F.pmod(F.xxhash64("node"), "rest"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest") + F.when(in_main, 0).otherwise(F.col("mains")) - 1))
    dealt = dealt.select("crowd", block.alias("block"), others.alias("other"), "root", "set")
    dealt = dealt.select("crowd", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "root", "set")

    def run(table: pa.Table) -> pa.Table:
        block, root = (table.column(c).to_numpy() for c in ("block", "root"))
        sets, low, high = _members(table.column("set").combine_chunks()), table.column("low")[0].as_py(), table.column("high")[0].as_py()
        one, other = np.flatnonzero(block == low), np.flatnonzero(block == high)
        if not len(one) or not len(other):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        x, y = np.nonzero(shared_pairs([sets[k] for k in one], [sets[k] for k in other]) & (root[one][:, None] != root[other][None, :]))
        found = np.unique(np.sort(np.stack([root[one][x], root[other][y]]), axis=0), axis=1)
        return pa.table({"a": pa.array(found[0]), "b": pa.array(found[1])})

    return shared.written(dealt.groupBy("crowd", "low", "high").applyInArrow(run, "a long, b long").distinct(), "crowd-links")


def _linked(nodes: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """node, root of all nodes that a verified pair connects."""
    close = _close(nodes)
    begun = shared.written(_candidates(_placed(nodes), True), "near-found")
    across = begun.where(F.col("edge") >= 0).select(F.xxhash64("edge", "word").alias("key"), F.col("a").alias("node"), "sketch", "word")
    across = across.select(F.col("word"), "node", "sketch", "key").repartition("key").sortWithinPartitions("word", "sketch").select("word", "node", "sketch")
    more = shared.written(_candidates(across, False), "near-across")
    found = begun.where("edge IS NULL OR edge < 0").unionByName(more)
    pairs = found.where("b IS NOT NULL").select("a", "b", "alike", "lead", F.lit(None).cast("int").alias("bits"))
    pairs = pairs.unionByName(close.select("a", "b", F.lit(0).cast("long").alias("alike"), F.lit(0).cast("long").alias("lead"), "bits")).groupBy("a", "b")
    pairs = shared.written(pairs.agg(F.max("alike").alias("alike"), F.max(F.col("lead") == 1).alias("lead_a"), F.max(F.col("lead") == 2).alias("lead_b"), F.min("bits").alias("bits")), "near-pairs")
    crowds = shared.written(found.where("b IS NULL").select("word", F.col("a").alias("node")).distinct(), "near-crowds", begun, more)
    sides = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).alias("one")).unionByName(crowds.select("node", F.lit(0).alias("one"))).groupBy("node").agg(F.sum("one").alias("n"))
    sets = _sets(shared.written(sides.join(nodes.select("node", F.col("row").alias("_row")), "node"), "near-sides"), rows, text_col)

    def side(node: str, other: str) -> DataFrame:
        lead, near = F.col(f"lead_{other}"), F.coalesce(F.col("bits") <= simhash.RADIUS, F.lit(False))
        by = F.when(lead, F.col(other)).when(near, F.col("bits")).otherwise(-F.col("alike"))
        rank = F.struct(F.when(lead, 0).when(near, 1).otherwise(2).alias("kind"), by.alias("by"), F.col(other).alias("other"))
        return pairs.select(F.col(node).alias("node"), rank.alias("rank"))

    best = side("a", "b").unionByName(side("b", "a")).groupBy("node").agg(F.min("rank").alias("rank")).select("node", F.col("rank.other").alias("other"))
    first = shared.written(best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "near-first")
    roots = shared.written(components.connected(shared.written(_verified(first, sets), "near-links")), "near-roots")
    rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    apart = shared.written(rest.where("root_a <> root_b"), "near-apart")
    if not apart.isEmpty():
        links = _verified(apart.select("a", "b"), sets).join(apart, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        roots = _merged(roots, shared.written(components.connected(shared.written(links, "near-links")), "near-joined"))
    links = _crowd_links(crowds, roots, sets)
    return roots if links is None else _merged(roots, shared.written(components.connected(links), "near-joined"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of rows of docs that are linked, the one with the smallest id; of several rows with it, or of rows without an id only, one.

    Defined results: each row is decided for itself, whatever its id; rows with an id go before those without;
    texts of equal words are copies, and so are texts without words; columns of any name are kept;
    an empty table gives an empty table.
    """
    columns = docs.columns
    plain = docs.select(*[shared.column_of(docs, c).alias(f"c{k}") for k, c in enumerate(columns)])
    text, ident = (f"c{columns.index(c)}" for c in (text_col, id_col))
    with shared.Scope(docs.sparkSession) as scope:
        rows = shared.written(_sketched(plain, text).withColumn("_row", F.monotonically_increasing_id()), "near-rows")
        nodes = rows.groupBy(F.col("_hash").alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("row"), F.min("_words").alias("words"), F.min("_sketch").alias("sketch"), F.min("_fp").alias("fp"))
        nodes = shared.written(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
        roots = _linked(nodes, rows, text)
        classes = nodes.select("node", "hash", "n").join(roots, "node", "left").where("n > 1 OR root IS NOT NULL")
        classes = shared.written(classes.select(F.col("hash").alias("_hash"), F.coalesce("root", "node").alias("root"), "n"), "near-classes")
        members = rows.select("_hash", "_row", F.struct(F.col(ident).isNull().alias("none"), F.col(ident).alias("id"), "_row").alias("rank"))
        members = shared.written(shared.join_groups(members, classes, ["_hash"], "n", "inner"), "near-members")
        firsts = shared.written(members.groupBy("root").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")), "near-firsts")
        gone = shared.join_groups(members, firsts, ["root"], "n", "inner").where(F.col("_row") != F.col("first._row")).select("_row")
        gone = shared.written(gone, "near-gone")
        scope.keep(rows, gone)
    kept = shared.drop_rows(rows.drop("_hash", "_words", "_sketch", "_fp"), gone, "_row")
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])
