"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two 64-bit words at most r bits apart have a common word within r / 2 bits of both. So every fingerprint emits all
words within half the radius; fingerprints that share one are found by a shuffle on these words.

The plain ball for a radius of 4 has 2,081 words. With `blocks` = 3 the 64 bits are cut into three blocks: the two
blocks that differ least hold at most two thirds of the differing bits, so at most 2, and the ball of radius 1 around
those two blocks has 43 or 44 words: 131 rows per fingerprint in all, still exact because colliding pairs are verified on all 64 bits.
Where more fingerprints than `max_pairwise` share a word, they are not compared in pairs: they take the plain ball,
in which any two that share a word are certain to be linked, so a star of links per word is enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, shared

SEED = 42
WIDTH = 4
RADIUS = 4
BLOCKS = 3
MAX_PAIRWISE = 2048


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of all words where they are fewer; none of a text without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z, and space with \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([digest(join(s), SEED) for s in zip(*(words[k:] for k in range(width)), strict=False)] or [digest(join(words), SEED)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 without hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 for a text without words."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball(radius: int, blocks: int) -> list[tuple[int, int]]:
    """(mask, flip) of each emitted word: (fingerprint & mask) ^ flip. With blocks, the bits of the block left out hold its number."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    keep = blocks if blocks == 1 else blocks - 1
    half = radius * keep // blocks
    if half % 2:
        raise ValueError(f"radius {radius} leaves the odd radius {half} with {blocks} blocks")
    found = []
    for number, taken in enumerate(combinations(range(blocks), keep)):
        bits = [b for k in taken for b in range(cuts[k], cuts[k + 1])]
        mask = sum(1 << b for b in bits)
        free = next((cuts[k] for k in range(blocks) if k not in taken), 0)
        tag = number << free if blocks > 1 else 0
        for n in range(half // 2 + 1):
            found += [(_signed(mask), _signed(tag | sum(1 << b for b in flip))) for flip in combinations(bits, n)]
    return found


def _variants(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """word, fp: a row for each word of the ball around each fingerprint, in the words' order inside each partition."""
    words = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(f).cast("long").alias("f")) for m, f in ball(radius, blocks)])
    rows = fps.select("fp", F.explode(words).alias("w"))
    return rows.select(F.col("fp").bitwiseAND(F.col("w.m")).bitwiseXOR(F.col("w.f")).alias("word"), "fp").repartition("word").sortWithinPartitions("word")


def _links_of(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the verified pairs of one word connect: each fingerprint to the first of its class."""
    bits = fp.view(np.uint64)
    if len(fp) == 2:
        good = int(np.bitwise_count(bits[0] ^ bits[1])) <= radius
        return fp[:1][: int(good)], fp[1:][: int(good)]
    n = len(fp)
    root = np.arange(n)
    while True:
        before = root.copy()
        for at in range(0, n, 256):
            near = np.bitwise_count(bits[at : at + 256, None] ^ bits[None, :]) <= radius
            root[at : at + 256] = np.where(near, root[None, :], n).min(axis=1)
        root = root[root]
        if np.array_equal(root, before):
            break
    moved = np.flatnonzero(root != np.arange(n))
    return fp[root[moved]], fp[moved]


def _edges(rows: DataFrame, radius: int, most: int, star: bool) -> DataFrame:
    """a, b: links between fingerprints; a row with a = b marks one of a word that more than `most` fingerprints share.

    rows come in the order of their words. With star, all that share a word are linked to its first, and only that one is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word: int | None = None  # of the run which the batch before ended in
        held, wide = np.empty(0, np.int64), False

        def close(a: list, b: list) -> None:
            nonlocal held, wide
            if len(held) > 1 and not star and not wide:
                x, y = _links_of(held, radius)
                a.append(x)
                b.append(y)
            held, wide = held[:0], False

        def take(fp: np.ndarray, a: list, b: list) -> None:
            nonlocal held, wide
            if star:
                if not len(held):
                    held = fp[:1].copy()
                a.append(np.full(len(fp), held[0]))
                b.append(fp)
                return
            if not wide:
                held = np.concatenate([held, fp])
                if len(held) <= most:
                    return
                fp, wide, held = held, True, held[:0]
            a.append(fp)
            b.append(fp)

        for batch in batches:
            if not batch.num_rows:
                continue
            words, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            starts = np.concatenate([[0], np.flatnonzero(words[1:] != words[:-1]) + 1])
            ends = np.append(starts[1:], len(words))
            last = len(starts) - 1
            if word is not None and words[0] != word:
                close(a, b)
            for k in [0, *(np.flatnonzero((ends - starts)[1:last] > 1) + 1), *([last] if last else [])]:
                take(fps[starts[k] : ends[k]], a, b)
                if k < last:
                    close(a, b)
            word = words[-1]
            if a:
                x, y = np.concatenate(a), np.concatenate(b)
                pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                if star:
                    pairs = pairs[:, pairs[0] != pairs[1]]
                yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
        a, b = [], []
        close(a, b)
        if a:
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, max_pairwise: int = MAX_PAIRWISE, reach: int = 0) -> DataFrame:
    """a, b: links that connect the fingerprints (column fp, distinct, a written table) at most `radius` bits apart.

    With a larger `reach`, those whose balls meet are linked up to that many bits apart, for a check by the caller.
    """
    edges = shared.written(_edges(_variants(fps, radius, blocks), max(radius, reach), max_pairwise, False), "simhash-links")
    dense = edges.where("a = b").select(F.col("a").alias("fp"))
    found = edges.where("a <> b")
    if not dense.isEmpty():
        crowded = fps.join(dense, "fp", "left_semi")
        found = found.unionByName(_edges(_variants(crowded, radius, 1), radius, max_pairwise, True))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, blocks: int = BLOCKS, max_pairwise: int = MAX_PAIRWISE) -> DataFrame:
    """doc_id, fp, component_id for every row of docs; component_id is the smallest id reachable by links.

    Fingerprints are linked when they differ in at most `radius` bits. The graph's nodes are distinct fingerprints, so
    copies cost nothing and ids may repeat; no pairs of documents are made, only links that connect fingerprints.

    Defined results: a null text counts as empty; texts without words have fingerprint 0 and link like any other; each
    row is placed by its own text, so rows of one id may lie in several components; rows without an id link like any
    other, and a component of such rows only has a null component_id; repeated rows give repeated result rows;
    other columns are ignored; an empty table gives an empty table.
    """
    with shared.Scope(docs.sparkSession) as scope:
        found = shared.written(fingerprints(docs, id_col, text_col, width), "simhash-fps")
        fps = shared.written(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
        roots = components.connected(links(fps, radius, blocks, max_pairwise)).withColumnRenamed("node", "fp")
        placed = shared.written(fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-placed")
        least = shared.written(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")), "simhash-least")
        classes = shared.join_groups(placed.select("fp", "root", "n"), least, ["root"], "size").select("fp", "component_id", "n")
        classes = shared.written(classes, "simhash-classes")
        scope.keep(found, classes)
    return shared.join_groups(found, classes, ["fp"], "n").select("doc_id", "fp", "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """near_duplicates() of the whole documents table; null and repeated rows as defined there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
