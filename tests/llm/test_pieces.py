"""SentencePiece encoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers

from echograin.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "a  b", " a", "a ", "a\nb", "<s>x</s>", "▁a", "▁▁ ▁b", "日本😀\x00z", "ﬁ x\tq", " " * 100 + "b", "▁" * 37, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "the thing, in the end.\nAnd ال"]


def test_equals_library():
    encoder = pieces.PieceEncoder(PATH)
    random.seed(6)
    alphabets = ["ab c", "▁ \n\t<s>x", "日本😀é ñ'", "0123 -=_/.", "the tion ing er"]
    made = ["".join(random.choices(random.choice(alphabets) + random.choice(alphabets), k=random.randrange(40))) for _ in range(3000)]
    for text in TEXTS + made:
        want = encoder.library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, repr(text)


def test_caches_may_empty(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 3)
    encoder = pieces.PieceEncoder(PATH)
    encoder.words.most = encoder.parts.most = 2
    text = "several words that go through small memories, again: several words"
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.library.encode(text, add_bos=True, add_eos=True)


def test_rows(spark):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, None, ""), (1, "again", "")], "doc_id long, text string, n_tokens string")
    library = pieces.PieceEncoder(PATH).library
    got = sorted((tuple(r) for r in pieces.encode_texts(docs, PATH, derive=pieces.digests, schema="n_tokens long, ids_sha256 string, decoded_sha256 string").collect()), key=str)
    want = []
    for doc, text, _ in docs.collect():
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    plain = pieces.encode_texts(docs.where("doc_id = 3"), PATH).first()
    assert plain.ids == library.encode("a  b", add_bos=True, add_eos=True) and plain.decoded == "a  b"


def test_empty(spark):
    assert pieces.encode_texts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_very_long_texts():
    encoder = pieces.PieceEncoder(PATH)
    random.seed(8)
    for text in ("the thing in the end. " * 50_000, "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=60_000)), "a" * 60_000, "日本語" * 20_000, "x1-_" * 20_000):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.library.encode(text, add_bos=True, add_eos=True)
