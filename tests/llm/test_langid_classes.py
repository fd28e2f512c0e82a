"""Language identification with many languages and with one that is rare."""

import random

import numpy as np

from echograin.llm import langid
from tests.llm.test_langid_fusion import brute

SCHEMA = "id long, text string, lang string"


def spoken(rng, letters, n=30):
    return " ".join("".join(rng.choices(letters, k=rng.randrange(3, 8))) for _ in range(n))


def test_more_than_64_languages(spark):
    rng = random.Random(1)
    letters = {f"{a}{b}": "".join(chr(0x4E00 + 20 * (10 * i + j) + k) for k in range(8)) for i, a in enumerate("abcdefgh") for j, b in enumerate("klmnopqrst")}
    rows = [(k, spoken(rng, letters[lang]), lang) for k, lang in enumerate(list(letters) * 3)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert model.languages == sorted(letters)
    asked = [(k, f'<html lang="{lang}">' + spoken(rng, letters[lang]), None, None) for k, lang in enumerate(letters)]
    got = {r.id: (r.lang, r.declared) for r in langid.identify(spark.createDataFrame(asked, "id long, text string, url string, host string"), model).collect()}
    assert got == {k: (lang, lang) for k, lang in enumerate(letters)}


def test_rare_language_among_many_rows(spark):
    rng = random.Random(2)
    rows = [(k, spoken(rng, "abcdefg", 3), "en") for k in range(3000)] + [(5000, spoken(rng, "xyzuvw"), "qq"), (5001, spoken(rng, "xyzuvw"), "qq")]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA), max_training=50)
    assert model.languages == ["en", "qq"]
    scores, _ = model.scores(spoken(rng, "xyzuvw"))
    assert scores[1] > scores[0]


def test_sample_is_bounded_and_even():
    assert langid.quota([3, 1000, 10**6], 103) == 50
    assert langid.quota([5, 7], 100) == 7
    assert langid.quota([10] * 50, 20) == 1
    assert langid.cells_for(4) == 1 << 16 and langid.cells_for(1000) * 1000 <= langid.MAX_TABLE


def test_two_thousand_languages(spark):
    """Plans do not grow with the number of languages, and the fusion is that of the plain version."""
    rng = random.Random(3)
    names = [f"l{k:04d}" for k in range(2000)]
    names[7] = "o'b\\c"
    counts = np.random.default_rng(1).poisson(2.0, (1 << 10, 2000)).astype(float)
    model = langid.TextModel(names, counts)
    model.table[:, 3] += 0.5
    rows = [(k, f'<html lang="{rng.choice(names[:5])}">' * (k % 3 == 0) + spoken(rng, "abcdefghij"), f"http://h{k % 5}.example.com/", None) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, url string, host string")
    found = langid.identify(df, model)
    got = {r.id: (r.lang, round(r.probability, 6), r.accepted) for r in found.collect()}
    want = brute([(k, "p", text, url, host) for k, text, url, host in rows], model)
    assert all(got[k][0] == lang and abs(got[k][1] - p) <= 2e-6 and got[k][2] == a for (k, _), (lang, p, a) in want.items())


def test_sampling_takes_no_rows_through_python_workers(spark, monkeypatch):
    def refused(*args, **named):
        raise AssertionError("rows from the driver's Python pass a set of Python workers of their own")

    rng = random.Random(6)
    rows = spark.createDataFrame([(k, spoken(rng, "abcdef" if k % 2 else "uvwxyz"), "en" if k % 2 else "de") for k in range(40)], SCHEMA)
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert langid.fit(rows, 10).languages == ["de", "en"]
