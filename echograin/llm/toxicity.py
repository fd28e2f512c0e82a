"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases.

The lexicon's entries are whole words and beginnings of words of the folded text. Their weights are log odds, learned
from labelled documents by grouped counts; two numbers that turn a document's sum into a probability are fitted to the same documents.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import shared

# Characters that are read as a letter.
FOLDED = str.maketrans({
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t",
    "а": "a", "е": "e", "і": "i", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "ν": "v", "η": "n",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
})
# Signs that are read as a letter between letters.
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "*": ""}
# Insults which count before anything is learned; a learned weight replaces theirs.
SEED = ("idiot", "moron", "stupid", "scum", "loser", "trash", "worthless", "pathetic", "disgusting", "imbecile", "dimwit", "vermin")
# Phrases in which a word of the lexicon does not count.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "useful idiot", "idiot proof", "sore loser rule", "not stupid", "no idiot")

#: Labelled documents that are learned from at most, those with the smallest hash of the id.
MAX_TRAINING = 20_000
#: Entries at most; toxic documents that an entry must occur in, and share of them; log odds that it must reach.
MAX_ENTRIES = 2_000
MIN_DOCUMENTS = 3
MIN_SHARE = 0.005
MIN_LOG_ODDS = 2.0
#: Letters of the beginnings of words that may be entries.
STEMS = (4, 5, 6, 7)
SEED_WEIGHT = 3.0
#: So many entries tell of a document before further ones count as coincidence.
DEPTH = 3
TOKEN = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case with look-alikes, digits for letters and invisible characters undone; full-width forms become plain."""
    text = text.lower()
    if not text.isascii():
        text = re.sub("[！-～]", lambda m: chr(ord(m[0]) - 0xFEE0), text).lower()
    text = re.sub(r"(?<=[^\W\d_])[@$!|*](?=[^\W\d_])", lambda m: SIGNS[m[0]], text)
    return text.translate(FOLDED)


@dataclass
class Lexicon:
    """Entries with weights ("word" for a beginning, "word " for a whole word) and the two fitted numbers."""

    weights: dict[str, float]
    slope: float = 1.0
    offset: float = -2.0
    exceptions: tuple[str, ...] = EXCEPTIONS
    _automaton: object = field(default=None, repr=False)

    def automaton(self) -> object:
        if self._automaton is None:
            built = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                built.add_word(" " + entry, (len(entry.rstrip()), weight))
            for phrase in self.exceptions:
                built.add_word(f" {phrase} ", (len(phrase), None))
            built.make_automaton()
            self._automaton = built
        return self._automaton

    def raw(self, text: str | None) -> float:
        """Sum of matched weights over the logarithm of length; a word counts once, by its longest entry."""
        words = TOKEN.findall(fold(text or ""))
        if not words or not (self.weights or self.exceptions):
            return 0.0
        flat = f" {' '.join(words)} "
        at_word: dict[int, tuple[int, float]] = {}
        free: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton().iter(flat):
            whole = flat[end] == " "
            start = end - size - whole + 1
            if weight is None:
                free.append((start, end))
            elif size > at_word.get(start, (0, 0.0))[0] or whole:
                at_word[start] = (size + whole, weight)
        free.sort()
        begins = [a for a, _ in free]
        reach = list(accumulate((b for _, b in free), max))

        def counts(place: int) -> bool:
            k = bisect_right(begins, place)
            return not k or place >= reach[k - 1]

        total = sum(w for s, (_, w) in at_word.items() if counts(s))
        return total / math.log2(2 + len(words) / 64)

    def score(self, text: str | None) -> float:
        x = self.slope * self.raw(text) + self.offset
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def terms_of(text: str | None) -> set[str]:
    """Each distinct word of a folded text, with a space behind it, and each beginning of one."""
    words = set(TOKEN.findall(fold(text or "")))
    return {w[:n] for w in words for n in STEMS if len(w) >= n} | {w + " " for w in words}


def _counts(rows: DataFrame) -> DataFrame:
    """term, a, b: toxic and clean documents that have the term; counted inside each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                by_label = (Counter(), Counter())
                for text, label in zip(batch.column(0)[at : at + 1000], batch.column(1)[at : at + 1000].to_pylist(), strict=True):
                    by_label[label].update(terms_of(text.as_py()))
                clean, toxic = by_label
                terms = list(clean | toxic)
                yield pa.record_batch([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], names=["term", "a", "b"])

    return rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _having(rows: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """found: the numbers of the terms that each document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[numbers[t] for t in terms_of(text.as_py()) & numbers.keys()] for text in batch.column(0)]
            yield pa.record_batch([pa.array(found, pa.list_(pa.int32()))], names=["found"])

    return rows.select("text").mapInArrow(run, "found array<int>")


def chosen(kept: list, documents: list[list[int]], least: int) -> list[int]:
    """Entries that each tell of at least `least` documents of which fewer than DEPTH of the ones before tell.

    kept: rows of (term, a, w), the most telling first. Of a term and a longer one that begins with it and occurs in as
    many documents, but for a twentieth, the longer one is taken.
    """
    having: dict[int, set[int]] = {}
    for d, found in enumerate(documents):
        for number in found:
            having.setdefault(number, set()).add(d)
    by_term = {r["term"]: k for k, r in enumerate(kept)}
    general = set()
    for term, k in by_term.items():
        for n in range(min(STEMS), len(term)):
            shorter = by_term.get(term[:n])
            if shorter is not None and kept[k]["a"] >= 0.95 * kept[shorter]["a"]:
                general.add(shorter)
    told: Counter = Counter()
    taken = []
    for k in range(len(kept)):
        new = [d for d in having.get(k, ()) if told[d] < DEPTH]
        if k not in general and len(new) >= least:
            taken.append(k)
            told.update(new)
    return taken


def learn(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> Lexicon:
    """A lexicon from docs (doc_id, text) with labels (doc_id, toxic); of several labels of a document the largest counts.

    At most max_training labelled documents are used, those whose ids hash lowest; they find their texts by broadcast.
    Entries are terms of at least MIN_DOCUMENTS and MIN_SHARE of the toxic ones and at least MIN_LOG_ODDS (smoothed
    log odds less their standard error, of toxic against clean documents), the most telling first, that tell of as many documents which few
    of the entries before tell of. Copies of a text count once. Without documents of both kinds only the seed words count.
    """
    picked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_training)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = shared.written(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-rows")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, clean = totals.get(1, 0), totals.get(0, 0)
    weights = {w: SEED_WEIGHT for w in SEED}
    if not (bad and clean):
        return Lexicon(weights)
    least = max(MIN_DOCUMENTS, math.ceil(MIN_SHARE * bad))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    odds = -error + F.log((F.col("a") + 0.5) / (bad - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (clean - F.col("b") + 0.5))
    kept = _counts(rows).where(F.col("a") >= least).withColumn("w", odds).where(F.col("w") >= MIN_LOG_ODDS)
    kept = kept.orderBy(F.desc(F.col("w") * F.sqrt("a")), "term").limit(MAX_ENTRIES).collect()
    toxic = rows.where("toxic = 1")
    documents = [r["found"] for r in _having(toxic, {r["term"]: k for k, r in enumerate(kept)}).collect()]  # of max_training rows at most
    for k in chosen(kept, documents, least):
        term = kept[k]["term"]
        weights[term.rstrip() if term.rstrip() in SEED else term] = kept[k]["w"]
    lexicon = Lexicon(weights)
    data = np.array(_raw(rows, lexicon).collect(), float)  # at most max_training rows of two numbers
    lexicon.slope, lexicon.offset = fit_line(data[:, 0], data[:, 1])
    lexicon._automaton = None
    return lexicon


def fit_line(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 60) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic regression on one number, by Newton steps with a small ridge."""
    a, c = 0.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
        g = np.array([((p - y) * x).sum() + decay * a, (p - y).sum() + decay * c])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + decay, (w * x).sum()], [(w * x).sum(), w.sum() + decay]])
        step = np.linalg.solve(h, g)
        a, c = a - step[0], c - step[1]
        if abs(step).max() < 1e-9:
            break
    return max(float(a), 0.0), float(c)


def _raw(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [lexicon.raw(t.as_py()) for t in batch.column(0)]
            yield pa.record_batch([pa.array(values, pa.float64()), batch.column(1).cast(pa.float64())], names=["raw", "toxic"])

    return rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, "raw double, toxic double")


def score_texts(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """docs with the column score (0 to 1); a text that is null or has no words gets the score of no match.

    A column named score is replaced. Repeated rows and extra columns are kept; an empty table gives an empty table.
    """
    docs = shared.without(docs, "score")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([lexicon.score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "score"])

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is never learned from; false for a row without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lexicon_of(spark, sf_dir: str) -> Lexicon:
    """What the labelled rows teach, held-out ones excepted."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return learn(docs, labels)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of the whole documents table. Rows without an id are scored like any other, held_out false and never learned from; other edge cases as in learn() and score_texts()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_texts(docs, lexicon_of(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
