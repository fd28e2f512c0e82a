"""Exact top-k search by inner product: the three-phase uniform threshold method on dimension blocks.

A score is the sum of m partial scores, one per block of dimensions; so each block is a list of partial scores, and a
list's rows lie in chunks. Lists, chunks and blocks of queries are dealt to tasks.

1. Every chunk of every list gathers its own best entries for each query; it sees its own dimensions only. The best k
   of each whole list are scored in full: a few rows per query, the k-th best of which is a safe cutoff.
2. The cutoff c goes out with the queries. A row that reaches c reaches c / m in some list, so these entries are
   sufficient. What phase 1 gathered has them all where its last entry is below c / m; only other chunks look deeper.
3. The full scores of sufficient entries, and of no other pairs, are computed; those that reach c are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

K = 20
EVERY = 20
SCALE = 64
#: Rows of a chunk and queries of a block at most; the least rows of a chunk when there are more cores than full chunks.
CHUNK_ROWS = 1 << 14
QUERY_BLOCK = 1 << 13
LEAST_ROWS = 1 << 10
LISTS = 2
#: Queries whose partial scores with a chunk are held at once.
SLICE = 256
#: Whole numbers up to here are exact in a double.
EXACT = 1 << 53
LOWEST = -(1 << 63)
_UNIT = ["block", "chunk"]


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v: whole components floor(scale * x), as longs. Vectors that are null, without an id, or hold a null or non-finite component are left out; rows of one id stay apart."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def _dealt(rows: DataFrame, size: int, number: str, prefix: str, least: int = 1) -> tuple[DataFrame, int]:
    """rows (row, vec_id, v) in groups of about `size`, at least about `least` groups: number, and their keys, ids and vectors; and how many groups there are."""
    count = max(1, math.ceil(rows.count() / size), least)
    grouped = rows.groupBy(F.pmod(F.xxhash64("row"), F.lit(count)).alias(number)).agg(F.sort_array(F.collect_list(F.struct("row", "vec_id", "v"))).alias("_r"))
    return grouped.select(number, F.col("_r.row").alias(f"{prefix}rows"), F.col("_r.vec_id").alias(f"{prefix}ids"), F.col("_r.v").alias(f"{prefix}data")), count


def _matrix(vectors: pa.ListScalar, dims: int = 0) -> np.ndarray:
    """Vectors as rows; components that shorter ones lack are zero."""
    lists = vectors.values
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    data = np.zeros((len(lengths), max(dims, int(lengths.max(initial=0)))), np.int64)
    data[np.arange(data.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return data


def _ints(value: pa.ListScalar) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False)


def _exact_kind(rows: np.ndarray, queries: np.ndarray) -> type:
    """Doubles where all products and sums are exact in them, else longs."""
    bound = rows.shape[1] * max(1, int(np.abs(rows).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0)))
    return np.float64 if bound < EXACT else np.int64


def _partial(queries: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Partial scores of SLICE queries at a time with all rows: number of the first query, and the matrix."""
    dims = min(queries.shape[1], rows.shape[1])
    queries, rows = queries[:, :dims], rows[:, :dims]
    kind = _exact_kind(rows, queries)
    turned = np.ascontiguousarray(rows.astype(kind).T)
    for at in range(0, len(queries), SLICE):
        yield at, queries[at : at + SLICE].astype(kind) @ turned


def _gather(depth: int):
    """Phase 1 of a list's chunk: for each query its best `depth` rows, their partial scores, and the last one of them (LOWEST if no row is left out)."""
    names = [*_UNIT, "list", "q_row", "rows", "parts", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, chunk, number = (batch.column(c)[k].as_py() for c in range(3))
                q_rows, rows = _ints(batch.column(3)[k]), _ints(batch.column(5)[k])
                for at, part in _partial(_matrix(batch.column(4)[k]), _matrix(batch.column(6)[k])):
                    most = min(depth, part.shape[1])
                    best = np.argpartition(-part, most - 1, axis=1)[:, :most]
                    value = np.take_along_axis(part, best, axis=1).astype(np.int64)
                    last = value.min(axis=1) if most < part.shape[1] else np.full(len(part), LOWEST)
                    ends = pa.array(np.arange(len(part) + 1) * most, pa.int32())
                    n = len(part)
                    yield pa.record_batch([
                        pa.array([block] * n, pa.int64()), pa.array([chunk] * n, pa.int64()), pa.array([number] * n, pa.int32()), pa.array(q_rows[at : at + n]),
                        pa.ListArray.from_arrays(ends, pa.array(rows[best].ravel())), pa.ListArray.from_arrays(ends, pa.array(value.ravel())), pa.array(last),
                    ], names=names)

    return run


_GATHERED = "block long, chunk long, list int, q_row long, rows array<long>, parts array<long>, last long"


def _resolve(k: int, lists: int, deeper: bool):
    """Full scores of listed pairs of a unit; `deeper` first adds the pairs of lists which phase 1 did not gather to the cutoff.

    Columns of the unit: query keys, ids and vectors, row keys, ids and vectors, and the asked: structs of q_row,
    list, rows, need (least partial score), cutoff and open (whether to look deeper). resolved counts the pairs scored for the query here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in range(batch.num_rows):
                q_rows, q_ids, q_data, rows, ids, data, asked = (batch.column(c)[unit] for c in range(7))
                q_rows, q_ids, rows, ids = _ints(q_rows), _ints(q_ids), _ints(rows), _ints(ids)
                queries, vectors = _matrix(q_data), _matrix(data)
                asked = asked.values
                of = {n: asked.field(n) for n in ("q_row", "list", "rows", "need", "cutoff", "open")}
                q_at = np.searchsorted(q_rows, of["q_row"].to_numpy(zero_copy_only=False))
                counts = of["rows"].value_lengths().to_numpy(zero_copy_only=False)
                pairs = [np.repeat(q_at, counts) * len(rows) + np.searchsorted(rows, of["rows"].flatten().to_numpy(zero_copy_only=False))]
                cutoff = np.full(len(q_rows), LOWEST)
                cutoff[q_at] = of["cutoff"].to_numpy(zero_copy_only=False)
                dims = min(queries.shape[1], vectors.shape[1])
                if deeper:
                    number, need, still = (of[n].to_numpy(zero_copy_only=False) for n in ("list", "need", "open"))
                    for j in range(lists):
                        some = np.flatnonzero(still.astype(bool) & (number == j))
                        low, high = dims * j // lists, dims * (j + 1) // lists
                        for at, part in _partial(queries[q_at[some], low:high], vectors[:, low:high]):
                            q, r = np.nonzero(part >= need[some][at : at + len(part), None])
                            pairs.append(q_at[some][at + q] * len(rows) + r)
                q, r = np.divmod(np.unique(np.concatenate(pairs)), len(rows))
                keep = q_rows[q] != rows[r]
                q, r = q[keep], r[keep]
                kind = _exact_kind(vectors[:, :dims], queries[:, :dims])
                full_queries, full_rows = queries[:, :dims].astype(kind), vectors[:, :dims].astype(kind)
                score = np.empty(len(q), np.int64)
                for at in range(0, len(q), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    score[part] = np.einsum("ij,ij->i", full_queries[q[part]], full_rows[r[part]])
                resolved = np.bincount(q, minlength=len(q_rows))
                good = score >= cutoff[q]
                q, r, score = q[good], r[good], score[good]
                order = np.lexsort((ids[r], -score, q))
                q, r, score = q[order], r[order], score[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                q, r, score = q[best], r[best], score[best]
                yield pa.record_batch([pa.array(q_rows[q]), pa.array(q_ids[q]), pa.array(ids[r]), pa.array(score), pa.array(resolved[q])], names=["q_row", "query_id", "vec_id", "score", "resolved"])

    return run


_RESOLVED = "q_row long, query_id long, vec_id long, score long, resolved long"


def _ranked(entries: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, asks: str, k: int = K, lists: int = LISTS, depth: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of `vectors` (vec_id, v as from quantised) for each row of it that fulfils `asks`, and resolved, the pairs scored in full where the row was found.

    A query's own row is no candidate; other rows of its id are, and each row of a repeated query id is a query of its
    own. Ties go to the smaller vec_id. Fewer candidates than k give fewer rows; empty tables give none; components that
    one of two vectors lacks count as zero. Scores are whole numbers and must fit 64 bits. depth: entries that a chunk of a list gathers at first.

    All pairs of a query and a row are looked at, list by list. A unit of work holds at most about CHUNK_ROWS rows and
    QUERY_BLOCK queries; rows are copied once per query block and queries once per chunk, so shuffled data is the work over the size of a unit.
    """
    spark = vectors.sparkSession
    vectors = shared.written(vectors.select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    cores = spark.sparkContext.defaultParallelism
    n = vectors.count()
    chunks, n_chunks = _dealt(vectors, CHUNK_ROWS, "chunk", "", min(2 * cores, n // LEAST_ROWS))
    blocks, n_blocks = _dealt(vectors.where(asks), QUERY_BLOCK, "block", "q_")
    chunks, blocks = shared.written(chunks, "topk-chunks"), shared.written(blocks, "topk-queries")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    width = chunks.select(F.max(F.array_max(F.transform("data", lambda v: F.size(v)))).alias("w")).first()["w"] or 0

    def of_list(j: int, data: str):
        low, high = width * j // lists, width * (j + 1) // lists
        return F.transform(data, lambda v: F.slice(v, low + 1, F.lit(high - low)))

    def lists_of(df: DataFrame, kept: list[str], data: str) -> DataFrame:
        numbered = F.explode(F.array(*[F.struct(F.lit(j).alias("list"), of_list(j, data).alias(data)) for j in range(lists)])).alias("_l")
        return df.select(*kept, numbered).select(*kept, "_l.*")

    left = lists_of(blocks, ["block", "q_rows"], "q_data").withColumn("chunk", each(n_chunks))
    right = lists_of(chunks, ["chunk", "rows"], "data").withColumn("block", each(n_blocks))
    units = left.join(right.hint("shuffle_hash"), [*_UNIT, "list"]).select(*_UNIT, "list", "q_rows", "q_data", "rows", "data")
    gathered = shared.written(units.mapInArrow(_gather(depth or 2 * k), _GATHERED), "topk-gathered")

    entries = gathered.select(*_UNIT, "list", "q_row", F.explode(F.arrays_zip("rows", "parts")).alias("_e")).select(*_UNIT, "list", "q_row", "_e.rows", "_e.parts")
    order = Window.partitionBy("q_row", "list").orderBy(F.desc("parts"), "rows")
    firsts = entries.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).groupBy(*_UNIT, "q_row", "list").agg(F.collect_list("rows").alias("rows"))
    firsts = firsts.withColumns({"need": F.lit(LOWEST), "cutoff": F.lit(LOWEST), "open": F.lit(False)})

    def scored(asked: DataFrame, deeper: bool) -> DataFrame:
        asked = asked.groupBy(*_UNIT).agg(F.collect_list(F.struct("q_row", "list", "rows", "need", "cutoff", "open")).alias("asked"))
        both = asked.join(blocks.withColumn("chunk", each(n_chunks)).hint("shuffle_hash"), _UNIT).join(chunks.withColumn("block", each(n_blocks)).hint("shuffle_hash"), _UNIT)
        return both.select("q_rows", "q_ids", "q_data", "rows", "ids", "data", "asked").mapInArrow(_resolve(k, lists, deeper), _RESOLVED)

    cutoffs = _ranked(scored(firsts, False), k).groupBy("q_row").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("cutoff"))
    cutoffs = shared.written(cutoffs.where("cutoff IS NOT NULL"), "topk-cutoffs")
    known = gathered.join(cutoffs, "q_row", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(LOWEST)))
    share = F.expr(f"cutoff div {lists} + IF(cutoff > 0 AND cutoff % {lists} <> 0, 1, 0)")  # rounded up
    low = F.when(F.col("cutoff") == F.lit(LOWEST), F.col("cutoff")).otherwise(share)
    known = known.withColumn("need", low).withColumn("open", (F.col("last") >= F.col("need")) & (F.col("last") != F.lit(LOWEST)))
    known = known.withColumn("rows", F.transform(F.filter(F.arrays_zip("rows", "parts"), lambda e: e["parts"] >= F.col("need")), lambda e: e["rows"]))
    found = scored(known.where(F.col("open") | (F.size("rows") > 0)), True)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score", "resolved")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    """The K best of all other rows for every row of embeddings whose id is divisible by EVERY; edge cases as in quantised() and top_k()."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, f"vec_id % {EVERY} = 0").select("query_id", "rank", "vec_id", "score")


OP9_SQL = """
WITH v AS (
    SELECT vec_id, row_number() OVER () AS row, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains([x IS NULL OR NOT isfinite(x) FOR x IN embedding], true)
), s AS (
    SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
