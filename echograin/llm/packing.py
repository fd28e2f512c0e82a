"""Packing of tokenised documents into sequences: bound-certified best-fit decreasing, partition by partition."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import shared

CAPACITY = 1024
END_ID = 2
#: Words whose ids a task keeps at most.
CACHE_WORDS = 200_000
#: Pieces of a packing partition, about. Waste is about a bin per partition, so partitions are large; a piece's place takes about 60 bytes of a task's memory.
PARTITION_PIECES = 50_000


# --- tokens ---------------------------------------------------------------------------------------------------------


def byte_ranks(model: dict) -> dict[bytes, int]:
    """Bytes of each token of a byte-level BPE model, with its id. In the file, a byte that is no visible Latin-1 character stands as the next free character from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
    return {bytes(map(byte_of.__getitem__, token)): number for token, number in model["vocab"].items() if all(c in byte_of for c in token)}


class WordIds(dict):
    """Ids of a space and the word as little-endian unsigned 32-bit bytes, made when first asked for; empties itself when full."""

    def __init__(self, encode: Callable[[str], bytes], most: int = CACHE_WORDS):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[word] = ids = self.encode(" " + word)
        return ids


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Callable[[str], bytes]:
    """text -> ids as bytes, equal to those that the tokenizers library gives for the file at `path`, a byte-level BPE.

    Merging is by token rank, which gives the same ids for such a file and costs a third. No pre-token crosses a space
    between two other characters, so words are remembered; a text with other runs of white space is encoded at once,
    and one that holds a special token's string by the tokenizers library itself. Python workers keep the encoder from
    task to task.
    """
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    special = [t["content"] for t in stored["added_tokens"]]
    ranks = {t: n for t, n in byte_ranks(stored["model"]).items() if t not in {s.encode() for s in special}}
    del stored
    plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    irregular = re.compile(r" \s|\s ").search

    def whole(text: str) -> bytes:
        return array("I", plain(text)).tobytes()

    words = WordIds(whole)

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return np.array(_library(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if irregular(text):
            return whole(text)
        first, *rest = text.split(" ")
        return whole(first) + b"".join(map(words.__getitem__, rest))

    return encode


@lru_cache(maxsize=2)
def _library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens; all but the first have the full length."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with ids, the piece's token ids, for every row of docs.

    A document's tokens are its ids and then end_id; documents over `capacity` are cut into pieces of that length of
    which the first may be shorter. A null text counts as empty and gives the one token end_id; a null id stays null.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(tokens) // 4, capacity)):
                    part = tokens[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if ids else None), strict=True):
                        column.append(value)
                held += len(tokens)
                if held > 8 << 20:
                    yield batch_of(out)
                    out, held = [[], [], [], [], [], []], 0
            yield batch_of(out)

    def batch_of(out: list[list]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        return pa.record_batch([pa.array(c, t) for c, t in list(zip(out, types, strict=True))[: 5 + ids]], names=names[: 5 + ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


# --- bins -----------------------------------------------------------------------------------------------------------


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: (bin, offset) of each item and the number of bins.

    Lengths are small whole numbers, so open bins stand in lists by free room, and a bitfield tells which rooms occur:
    the tightest bin that holds an item is the lowest bit at or above its length.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, used = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = present >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            into = by_room[room].pop()
            if not by_room[room]:
                present &= ~(1 << room)
        else:
            room, into, used = capacity, used, used + 1
        bins[i], offsets[i] = into, capacity - room
        left = room - n
        if left:
            by_room[left].append(into)
            present |= 1 << left
    return bins, offsets, used


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """bound_of() items one by one."""
    return bound_of(lengths, np.ones(len(lengths), np.int64), capacity)


def bound_of(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The best bound on the number of bins, for so many items of each length, from a family of dual feasible functions.

    For a threshold t up to half the capacity: items over capacity - t count as a whole bin, those under t as nothing,
    the others by length; t = 0 is the total length. For k: u(x) = x when (k + 1) x is whole, else floor((k + 1) x) / k.
    Sums are of whole numbers.
    """
    if not len(lengths):
        return 0
    count = np.zeros(capacity + 1, np.int64)
    np.add.at(count, lengths, counts)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    for t in range(1, capacity // 2 + 1):
        weight = np.where(size > capacity - t, capacity, np.where(size >= t, size, 0))
        best = max(best, -(-int((count * weight).sum()) // capacity))
    for k in range(1, 32):
        whole = (k + 1) * size % capacity == 0
        weight = np.where(whole, k * size, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((count * weight).sum()) // (k * capacity)))
    return best


def _packed(rows: DataFrame, capacity: int, names: dict[str, str]) -> DataFrame:
    """rows with bin, offset, part, open (whether the bin may still be emptied), and bins and bound: the partition's number of bins and the least that it could have. `names` are these columns' names.

    A partition whose bin count equals its lower bound is certified, and of it only the emptiest bin is open, which
    may be spread over others' room; in a partition with a gap, all bins that are not full are open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        lengths = table.column("length").to_numpy()
        bins, offsets, used = best_fit(lengths, capacity)
        fill = np.bincount(bins, lengths, used)
        opened = fill < capacity
        bound = lower_bound(lengths, capacity)
        if used == bound:
            opened &= np.arange(used) == fill.argmin()
        for name, values in (("bin", bins), ("offset", offsets), ("open", opened[bins]), ("bins", np.full(len(bins), used)), ("bound", np.full(len(bins), bound))):
            table = table.append_column(names[name], pa.array(values))
        yield from table.combine_chunks().to_batches(max_chunksize=20_000)

    rows = rows.withColumn(names["part"], F.spark_partition_id().cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, schema + "".join(f", `{names[c]}` {kind}" for c, kind in (("bin", "long"), ("offset", "long"), ("open", "boolean"), ("bins", "long"), ("bound", "long"))))


def pack(rows: DataFrame, key: list[str], capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """rows (with a column length, 1 to capacity) with sequence_id and a gapless offset in it; all columns are carried.

    partition_bins and partition_bound tell how many bins the partition had in which the item was placed for good, and the
    least that it could have: where they are equal it is certified, else the difference is its gap. See summary() for the whole.

    Items are dealt by a hash of `key` and of their place in the table, so that items of one key are spread, to partitions of about
    partition_pieces items and packed by best-fit decreasing. Dual feasible functions bound each partition's bins from below: where the count equals the bound it is
    certified and final but for its emptiest bin. The items of open bins are exchanged across partitions and packed
    anew, round after round, until they fit one partition or a round no longer needs fewer bins for them: then they stay as they were.

    rows is read more than once and should be a written table. Columns named like a result column are replaced.
    Repeated rows are items of their own; an empty table gives an empty table.
    """
    rows = shared.without(rows, "sequence_id", "offset", "partition_bins", "partition_bound")
    columns, names = rows.columns, {c: shared.own(rows, f"_{c}") for c in ("bin", "offset", "open", "bins", "bound", "part", "deal", "round")}
    done, number, before = None, 0, None  # before: the arrangement of the open items, and its bins
    while True:
        parts = max(1, round(rows.count() / partition_pieces))
        deal = F.xxhash64(F.lit(number), *key, F.monotonically_increasing_id())
        dealt = rows.withColumn(names["deal"], deal).repartition(parts, names["deal"]).drop(names["deal"])
        packed = shared.written(_packed(dealt, capacity, names), "packed").withColumn(names["round"], F.lit(number).cast("long"))
        used, opened = _bins(packed, names)
        if before is not None and used >= before[1]:
            final = before[0]
        else:
            final = packed if parts == 1 or not opened else packed.where(~F.col(names["open"]))
        done = final if done is None else done.unionByName(final)
        if parts == 1 or not opened or (before is not None and used >= before[1]):
            break
        before = packed.where(names["open"]), opened
        rows, number = before[0].select(*columns), number + 1
    sequence = F.col(names["round"]) * F.lit(1 << 52) + F.col(names["part"]) * F.lit(1 << 24) + F.col(names["bin"])
    return done.select(*columns, sequence.alias("sequence_id"), F.col(names["offset"]).alias("offset"), F.col(names["bins"]).alias("partition_bins"), F.col(names["bound"]).alias("partition_bound"))


def _bins(packed: DataFrame, names: dict[str, str]) -> tuple[int, int]:
    """Bins of all partitions, and how many of them are open. A bin's first item stands for it."""
    first = packed.where(F.col(names["offset"]) == 0)
    found = first.agg(F.count(F.lit(1)).alias("used"), F.count_if(names["open"]).alias("opened")).first()
    return found["used"], found["opened"]


def summary(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences used, and the least number that all items together need by the dual feasible functions."""
    used = packed.select("sequence_id").distinct().count()
    counts = packed.groupBy("length").count().collect()  # capacity rows at most
    return used, bound_of(np.array([r["length"] for r in counts], np.int64), np.array([r["count"] for r in counts], np.int64), capacity)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of the whole documents table in sequences of CAPACITY tokens; null texts and repeated rows as in pieces() and pack()."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = shared.written(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, ids=False), "pieces")
    return pack(found, ["doc_id", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "partition_bins", "partition_bound")
