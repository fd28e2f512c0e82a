"""Packing: token ids, cuts, gapless sequences and bounds."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from echograin.llm import packing, shared

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "one", " lead", "two  blanks", "tail ", "line\n next\tx", "<|endoftext|> in text", "don't 123 été 日本 😀", "a b", "x" * 3000, "word " * 3000, "\n \n", "it's  'tis \r\n"]


def test_ids_equal_the_library():
    encode, library = packing.encoder(PATH, public_tokenizers.PATTERN), Tokenizer.from_file(PATH)
    random.seed(4)
    alphabet = ["the", " ", "  ", "\n", "é", "9", "'s", ".", "\t", "ing", "Zz", "_", " "]
    for text in TEXTS + ["".join(random.choices(alphabet, k=random.randrange(30))) for _ in range(1500)]:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_is_whole(spark):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS * 3)] + [(None, None, "")], "doc_id long, text string, offset string")
    found = shared.written(packing.pieces(docs, PATH, public_tokenizers.PATTERN), "pieces")
    rows = packing.pack(found, ["doc_id", "piece"], partition_pieces=20).collect()
    library = Tokenizer.from_file(PATH)
    want = {k: [*library.encode(t, add_special_tokens=False).ids, 2] for k, t in enumerate(TEXTS * 3)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, ids in want.items():
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [i for r in parts for i in r.ids] == ids
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert all(r.length == 1024 for r in parts[1:])
    assert [r.ids for r in by_doc[None]] == [[2]]
    for spots in by_sequence.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(by_sequence) == packing.lower_bound(np.array([r.length for r in rows]), 1024)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_and_bounds(seed):
    random.seed(seed)
    lengths = np.array([random.choice([3, 4, 5, 6, 7, 10]) for _ in range(12)])
    bins, offsets, used = packing.best_fit(lengths, 10)
    assert np.bincount(bins, lengths).max() <= 10

    def fits(rest, room):  # exact search
        if not rest:
            return True
        return any(room[k] >= rest[0] and room[k] not in room[:k] and fits(rest[1:], room[:k] + [room[k] - rest[0]] + room[k + 1 :]) for k in range(len(room)))

    best = next(n for n in range(1, 13) if fits(sorted(lengths.tolist(), reverse=True), [10] * n))
    assert packing.lower_bound(lengths, 10) <= best <= used <= best * 11 // 9 + 1
    assert packing.lower_bound(np.array([6] * 5), 10) == 5


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, piece int, length long"
    assert packing.pack(spark.createDataFrame([], schema), ["doc_id", "piece"]).count() == 0
    rows = packing.pack(spark.createDataFrame([(1, 0, 600)] * 3, schema), ["doc_id", "piece"]).collect()
    assert len({r.sequence_id for r in rows}) == 3 and all(r.offset == 0 for r in rows)


def check_rooms(rows, capacity=1024):
    rooms = {}
    for r in rows:
        rooms.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in rooms.values():
        spots.sort()
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))] and sum(n for _, n in spots) <= capacity
    return len(rooms)


def test_rows_of_one_key_are_spread(spark):
    rows = shared.written(spark.range(400_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "0 AS piece", "1 + id % 97 AS length"), "pieces")
    packed = packing.pack(rows, ["doc_id", "piece"]).select("length", "sequence_id", "offset")
    got = packed.collect()
    assert len(got) == 400_000 and {r.sequence_id >> 52 for r in got} <= {0, 1}
    parts = {}
    for r in got:
        if r.sequence_id >> 52 == 0:
            parts[r.sequence_id >> 24] = parts.get(r.sequence_id >> 24, 0) + 1
    assert len(parts) == 8 and max(parts.values()) < 60_000
    assert check_rooms(got) == packing.summary(packed)[1]


def test_rounds_go_on_until_no_gap_closes(spark):
    random.seed(7)
    rows = shared.written(spark.createDataFrame([(k, 0, random.choice([341, 342, 343, 500, 510, 530])) for k in range(3000)], "doc_id long, piece int, length long"), "pieces")
    packed = packing.pack(rows, ["doc_id", "piece"], partition_pieces=60)
    got = packed.collect()
    used, bound = packing.summary(packed)
    assert sorted(r.doc_id for r in got) == list(range(3000)) and check_rooms(got) == used
    alone = packing.best_fit(np.array([r.length for r in got]), 1024)[2]
    assert bound <= used <= alone * 1.02 + 2


def test_columns_of_any_name_are_carried(spark):
    names = "doc_id, piece, length, open, bin, part, _round, _deal, _open, offset"
    rows = shared.written(spark.createDataFrame([(k, 0, 300, "o", "b", "p", "r", "d", "x", "gone") for k in range(50)], ", ".join(f"{n} {'long' if i < 3 else 'string'}" for i, n in enumerate(names.split(", ")))), "pieces")
    got = packing.pack(rows, ["doc_id"], partition_pieces=10)
    assert got.columns == ["doc_id", "piece", "length", "open", "bin", "part", "_round", "_deal", "_open", "sequence_id", "offset", "partition_bins", "partition_bound"]
    assert {(r.open, r.bin, r.part, r._round, r._deal, r._open) for r in got.collect()} == {("o", "b", "p", "r", "d", "x")}
