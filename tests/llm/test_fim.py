"""Fill-in-middle cuts against a loop over code points, and the words' arithmetic byte by byte."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograin.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, N string, output string, _h0 string"


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(spark, rows, batch=None):
    df = fim.fill_in_middle(spark.createDataFrame(rows, SCHEMA)).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = df.collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted((brute(*r[:2]) for r in rows), key=str)
    assert all(r.back == (r.text or "") for r in got)
    return df


def test_matches_brute_force(spark):
    random.seed(11)
    signs = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x08", "\x0e", "\x1f", "\x7f", "\x85", "\xa0", "é", "ß", "€", "日", "😀", " ", "a", "B", "<", "P", ">", "S", "M", "\0"]
    rows = [(k, "".join(random.choice(signs) for _ in range(random.randrange(60))), "", "", "") for k in range(1500)]
    rows += [(k, "".join(random.choice("ab  \n") for _ in range(random.randrange(40))), "", "", "") for k in range(2000, 3000)]
    df = check(spark, rows)
    assert df.columns == ["doc_id", "text", "_h0", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    assert {r.form for r in df.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_edges(spark, monkeypatch):
    rows = [(k, t, None, None, None) for k in range(40) for t in (None, "", " ", "\n \t", "word", " word", "word ", "x" * 70_000 + " y", "<P", "a<P>b", "a<S", "<S>", "b <M> c")]
    rows += [(None, "no id at all", "", "", ""), (None, "no id at all", "", "", ""), (-7, "less than zero", "", "", "")]
    check(spark, rows)


def test_long_texts_and_small_steps(spark, monkeypatch):
    monkeypatch.setattr(fim, "STEP", 100)
    random.seed(5)
    rows = [(k, " ".join("é" * random.randrange(9) for _ in range(random.choice([3, 50, 5000]))), "", "", "") for k in range(60)]
    check(spark, rows)


def test_empty(spark):
    check(spark, [])


def test_no_shuffle(spark):
    df = fim.fill_in_middle(spark.createDataFrame([(1, "a b", "", "", "")], SCHEMA))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_marks_of_every_byte():
    data = np.arange(256, dtype=np.uint8)
    white = fim.white_bytes(data.view("<u8")).view(np.uint8) >> 7
    assert [k for k in range(256) if white[k]] == [9, 10, 11, 12, 13, 32]
    assert [k for k in range(256) if fim.continuing_bytes(data.view("<u8")).view(np.uint8)[k]] == list(range(0x80, 0xC0))


@pytest.mark.parametrize("share", [0.02, 0.5, 1.0])
def test_rank_and_select(share):
    bits = np.random.default_rng(1).random(800) < share
    marks = fim.Marks((bits.astype(np.uint8) << 7).view("<u8"))
    places = np.flatnonzero(bits)
    assert np.array_equal(marks.select(np.arange(1, len(places) + 1)), places)
    assert np.array_equal(marks.rank(np.arange(801)), np.concatenate([[0], np.cumsum(bits)]))
