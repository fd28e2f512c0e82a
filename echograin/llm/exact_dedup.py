"""Exact document deduplication by content hash and byte comparison, in DataFrame functions only.

Hashes and ids alone are shuffled to count hashes. A bitmap of the hashes seen twice or more, of bounded size, then
goes to all tasks; rows that it does not hold are unique and stay where they are. Only the others bring their text, are
grouped by hash and bytes, and learn the class that they belong to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256.

    Rows are grouped by a 128-bit hash and, inside it, by the text's bytes, so that texts whose hashes collide stay
    apart. keep="max" keeps the row with the largest id, "min" the smallest. Copies are combined before the shuffle,
    and rows learn their class by broadcast where it is large.

    Defined results: a null text counts as empty and empty texts are equal; exactly one row of each class stays, of
    several rows of one id or of rows without an id only one of them; a null id is never chosen while another id is
    there; all rows count in group_size; input columns named like a result column are replaced; an empty table gives an empty table.
    """
    if keep not in ("max", "min"):
        raise ValueError(f"keep: {keep}")
    docs = shared.without(docs, *RESULT)
    hashed, row, seen = shared.own(docs, "_hash"), shared.own(docs, "_row"), shared.own(docs, "_seen")
    ident, text = shared.column_of(docs, id_col), F.coalesce(shared.column_of(docs, text_col), F.lit(""))
    repeated = docs.select(hash_of(text).alias(hashed)).groupBy(hashed).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(hashed)
    rows = shared.sieve(docs.withColumn(hashed, hash_of(text)), shared.written(repeated, "exact-repeated"), hashed, seen)
    unique = rows.where(~F.col(seen)).drop(seen, hashed)
    unique = unique.withColumns({"keep_id": ident, "group_size": F.lit(1).cast("long"), "kept": F.lit(True), "text_sha256": F.sha2(text, 256)})

    others = shared.written(rows.where(F.col(seen)).drop(seen).withColumn(row, F.monotonically_increasing_id()), "exact-rows")
    rank = F.struct((ident.isNotNull() if keep == "max" else ident.isNull()).alias("a"), ident.alias("id"), F.col(row).alias("row"))
    classes = others.groupBy(hashed, text.alias("_text")).agg((F.max if keep == "max" else F.min)(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    classes = shared.written(classes.withColumn("sha", F.sha2("_text", 256)), "exact-classes")
    by_hash = classes.groupBy(hashed).agg(F.count(F.lit(1)).alias("texts"), F.first("best").alias("best"), F.first("n").alias("n"), F.first("sha").alias("sha"), F.sum("n").alias("size"))
    by_hash = shared.written(by_hash.select(hashed, "texts", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"), F.col("sha").alias("text_sha256"), "size"), "exact-hashes")
    placed = shared.join_groups(others, by_hash.where("texts = 1").drop("texts"), [hashed], "size", "inner")
    split = by_hash.where("texts > 1").select(hashed)
    if not split.isEmpty():  # hashes that collide: their rows find their class by the bytes
        apart = classes.join(split, hashed, "left_semi").select(hashed, "_text", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"), F.col("sha").alias("text_sha256"), F.col("n").alias("size"))
        placed = placed.unionByName(shared.join_groups(others.withColumn("_text", text), shared.written(apart, "exact-apart"), [hashed, "_text"], "size", "inner", small=False).drop("_text"))
    placed = placed.withColumn("kept", F.col(row) == F.col("keep_row")).drop(hashed, row, "keep_row")
    return unique.unionByName(placed)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row of docs of each class of equal texts, with their own columns (those named like a result column excepted)."""
    marked = mark_duplicates(docs, id_col, text_col, keep)
    return marked.where("kept").select(*[shared.column_of(docs, c) for c in shared.without(docs, *RESULT).columns])


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """mark_duplicates() of the whole documents table, the largest doc_id of equal texts staying; edge cases as defined there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mark_duplicates(docs.select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
