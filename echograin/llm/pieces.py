"""SentencePiece encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words and pairs of pieces that a task remembers at most.
CACHE_WORDS = 500_000
CACHE_PAIRS = 600_000
#: Characters of a word that is remembered, at most.
CACHE_LENGTH = 64


def _spans(begins: list[int], end: int) -> Iterator[tuple[int, int]]:
    return zip(begins, [*begins[1:], end], strict=True)


class Words(dict):
    """What `make` gives for a word that is `whole`, made when first asked for and remembered; empties itself when full. Other words are made each time."""

    def __init__(self, make: Callable[[str], bytes], whole: Callable[[str], bool], most: int = CACHE_WORDS):
        super().__init__()
        self.make, self.whole, self.most = make, whole, most

    def __missing__(self, word: str) -> bytes:
        found = self.make(word)
        if self.whole(word):
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


class PieceEncoder:
    """Ids of a text under a BPE model with byte fallback, equal to the sentencepiece library's.

    Merging glues, again and again, the two neighbours whose joint piece has the best score, the leftmost at a tie.
    A sequence of pieces is what merging gives for their text exactly if each two neighbours are what merging gives
    for the two alone. So the encoder goes left to right by longest match, checks each piece against the one before
    by merging their joint text anew (remembered by pair), and steps back to a shorter match where they do not fit;
    places that cannot be passed are noted in a bitfield. No piece goes on after a character that a space mark
    follows, and none holds two neighbours which no piece has side by side; so words, cut at such places, are
    encoded apart and remembered.
    """

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        number = self.library
        kinds = [(i, number.id_to_piece(i)) for i in range(number.get_piece_size())]
        self.ids = {p: i for i, p in kinds if not (number.is_control(i) or number.is_unknown(i) or number.is_byte(i) or number.is_unused(i))}
        self.scores = {p: number.get_score(i) for p, i in self.ids.items()}
        self.bytes = [number.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece of the model goes on after a word's end")
        self.matches = ahocorasick.Automaton()
        for piece in self.ids:
            self.matches.add_word(piece, (len(piece), self.ids[piece]))
        self.matches.make_automaton()
        self.inside = {pair for piece in self.ids for pair in zip(piece, piece[1:], strict=False)}
        self.texts = {i: p for p, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.parts = Words(self.part, lambda w: len(w) <= CACHE_LENGTH, CACHE_WORDS // 4)
        #: Whether lines can be encoded apart.
        self.breaks = not any("\n" in p and p != "\n" for p in self.ids)
        self.words = Words(self.closed, lambda w: len(w) <= CACHE_LENGTH and w.isalpha())  # with other characters, forms are too many
        self.begin, self.end = (struct.pack("<I", k) for k in (number.bos_id(), number.eos_id()))

    def merge(self, text: str) -> list[str]:
        """The pieces that merging from single characters gives, for the short text of two pieces."""
        pieces, score = list(text), self.scores.get
        while True:
            best, place = None, -1
            for k in range(len(pieces) - 1):
                found = score(pieces[k] + pieces[k + 1])
                if found is not None and (best is None or found > best):
                    best, place = found, k
            if best is None:
                return pieces
            pieces[place : place + 2] = [pieces[place] + pieces[place + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether two pieces, given by their ids, stay as they are when their joint text is merged; remembered."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        pair = [self.texts[left], self.texts[right]]
        found = self.pairs[left << 20 | right] = self.merge(pair[0] + pair[1]) == pair
        return found

    def part(self, word: str) -> bytes:
        """Ids of one word; a character outside the vocabulary stands alone and becomes its bytes."""
        greedy = [match for _, match in self.matches.iter_long(word)]
        if sum([size for size, _ in greedy]) == len(word):  # longest matches without a gap: right if all neighbours fit
            known, fits = self.pairs, self.fits
            ids = [number for _, number in greedy]
            last = ids[0]
            for number in ids[1:]:
                good = known.get(last << 20 | number)
                if not (good or good is None and fits(last, number)):
                    break
                last = number
            else:
                return struct.pack(f"<{len(ids)}I", *ids)
        return self.backtrack(word)

    def backtrack(self, word: str) -> bytes:
        """Ids of one word by longest matches from the left, stepping back where two neighbours do not fit."""
        n = len(word)
        matches: list[list[tuple[int, int]]] = [[(1, self.ids.get(c, -1))] for c in word]  # size and id, at each place, ascending
        for end, match in self.matches.iter(word):
            if match[0] > 1:
                matches[end + 1 - match[0]].append(match)
        failed = 0
        path: list[int] = []  # places where the pieces so far begin
        ids = [-1]
        at, rest = 0, matches[0]
        known, fits = self.pairs, self.fits
        while at < n:
            while rest:
                size, number = rest.pop()
                if not failed >> (at + size) & 1:
                    last = ids[-1]
                    good = True
                    if last >= 0 and number >= 0:
                        good = known.get(last << 20 | number)
                        if good is None:
                            good = fits(last, number)
                    if good:
                        path.append(at)
                        ids.append(number)
                        at += size
                        rest = matches[at] if at < n else []
                        break
            else:
                failed |= 1 << at
                at = path.pop()
                ids.pop()
                rest = matches[at]
        if -1 in ids[1:]:
            out: list[int] = []
            for place, number in zip(path, ids[1:], strict=True):
                out += [number] if number >= 0 else [self.bytes[b] for b in word[place].encode()]
            return struct.pack(f"<{len(out)}I", *out)
        return struct.pack(f"<{n and len(path)}I", *ids[1:])

    def word(self, word: str) -> bytes:
        """Ids of a word, cut where no piece has the two neighbours side by side."""
        inside = self.inside
        cuts = [k for k, pair in enumerate(zip(word, word[1:], strict=False), 1) if pair not in inside]
        if not cuts:
            return self.part(word)
        letters = next((k for k in cuts if not word[k].isalpha()), 0)
        if letters > 1 and word[0] == SPACE and word[1:letters].isalpha():  # letters, then something else: the letters may be known
            return self.words[word[1:letters]] + b"".join([self.parts[word[a:b]] for a, b in _spans([k for k in cuts if k >= letters], len(word))])
        return b"".join([self.parts[word[a:b]] for a, b in _spans([0, *cuts], len(word))])

    def closed(self, word: str) -> bytes:
        """Ids of a space mark and the word: letters with one sign behind them by the letters, if no piece joins the two."""
        if len(word) > 1 and not word[-1].isalpha() and word[:-1].isalpha() and (word[-2], word[-1]) not in self.inside:
            return self.words[word[:-1]] + self.parts[word[-1]]
        return self.word(SPACE + word)

    def encode(self, text: str, begin: bool = True, end: bool = True) -> bytes:
        """The ids as little-endian unsigned 32-bit bytes."""
        found: list[bytes] = []
        if text and (SPACE in text or "  " in text or text[0] == " " or not self.breaks):
            found = [self.word(w) for w in re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", SPACE + text.replace(" ", SPACE))]
        elif text:
            word, part = self.words.__getitem__, self.parts.__getitem__
            for number, line in enumerate(text.split("\n")):
                first, *rest = line.split(" ")
                if number:
                    found.append(part("\n"))
                    if first:
                        found.append(part(first))
                else:
                    found.append(word(first))
                found += map(word, rest)
        return self.begin * begin + b"".join(found) + self.end * end


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """The encoder of a model file; Python workers keep it, with what it remembers, from task to task."""
    return PieceEncoder(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", derive: Callable[[str | None, bytes, sentencepiece.SentencePieceProcessor], tuple] | None = None, schema: str = "ids array<int>, decoded string") -> DataFrame:
    """doc_id with the ids and the decoded text of every row of docs.

    With `derive`, a function of (text, ids as bytes, library) that gives a tuple for `schema`, its values instead,
    for instance digests, so that long arrays need not leave the task. A null text counts as empty; an id may be null or repeat;
    other columns are ignored; an empty table gives an empty table.
    """
    out = "doc_id long, " + schema

    def both(_: str | None, ids: bytes, library: sentencepiece.SentencePieceProcessor) -> tuple:
        numbers = np.frombuffer(ids, "<u4").tolist()
        return numbers, library.decode(numbers)

    names = [c.split()[0] for c in out.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[c.split()[1]] for c in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, make = encoder(path), derive or both
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [(d, *make(t.as_py(), kept.encode(t.as_py() or ""), kept.library)) for d, t in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out)


def digests(_: str | None, ids: bytes, library: sentencepiece.SentencePieceProcessor) -> tuple[int, str, str]:
    decoded = library.decode(np.frombuffer(ids, "<u4").tolist())
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of the whole documents table; null texts, ids and repeated rows as in encode_texts()."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), derive=digests, schema="n_tokens long, ids_sha256 string, decoded_sha256 string")
