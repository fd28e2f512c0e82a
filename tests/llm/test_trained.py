"""Toxicity, language identification and license scans: held-out accuracy and edge cases."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograin.llm import langid, licenses, toxicity

SF = "/root/testdata/sf0.01"


def words(rng, n, letters):
    return " ".join("".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(n))


# --- toxicity -------------------------------------------------------------------------------------------------------


def test_folding():
    assert toxicity.fold("1D10T") == "idiot"
    assert toxicity.fold("ідiоt") == toxicity.fold("i") + "дiot"
    assert toxicity.fold("ｓｃｕｍ m0r​on") == "scum moron"
    assert toxicity.fold("id!ot idiot! 5$5") == "idiot idiot! s$s"


def test_exceptions_and_whole_words():
    lexicon = toxicity.Lexicon({"trash": 3.0, "clown ": 3.0}, 1.0, -2.0)
    assert lexicon.raw("nothing here") == 0 == lexicon.raw(None) == lexicon.raw("")
    assert lexicon.raw("you trash") > 0 < lexicon.raw("trashy")
    assert lexicon.raw("the trash can") == 0
    assert lexicon.raw("clownish") == 0 < lexicon.raw("a clown, yes")
    assert 0 < lexicon.raw("trash " + "fine " * 5000) < lexicon.raw("trash")
    assert lexicon.score("") < 0.5 < lexicon.score("trash clown trash")


def plain_raw(lexicon, text):
    """Lexicon.raw() by looking at every word for every entry."""
    found = toxicity.TOKEN.findall(toxicity.fold(text or ""))
    total = 0.0
    for k, word in enumerate(found):
        if any(found[k - at : k - at + len(p.split())] == p.split() for p in lexicon.exceptions for at in range(len(p.split())) if k >= at):
            continue
        stems = [e for e in lexicon.weights if e[-1] != " " and word.startswith(e)]
        best = word + " " if word + " " in lexicon.weights else max(stems, key=len, default=None)
        total += lexicon.weights[best] if best else 0.0
    return total / np.log2(2 + len(found) / 64) if found else 0.0


def test_matcher_equals_plain_search():
    rng = random.Random(3)
    lexicon = toxicity.Lexicon({"trash": 3.0, "trashy ": 1.5, "idiot": 2.0, "idiotic": 2.5, "proof ": 0.5, "can ": 0.25, "fish": 1.0}, exceptions=("trash can", "useful idiot", "idiot proof", "clown fish"))
    bag = ["trash", "trashy", "can", "useful", "idiot", "idiotic", "proof", "clown", "fish", "fishing", "1diot", "ok", "tra5h", "!", "—"]
    for _ in range(500):
        text = " ".join(rng.choices(bag, k=rng.randrange(30)))
        assert abs(lexicon.raw(text) - plain_raw(lexicon, text)) < 1e-9, text


def test_exceptions_take_linear_time():
    lexicon = toxicity.Lexicon({"trash": 3.0, "idiot": 2.0})
    began = time.process_time()
    assert lexicon.raw("trash can idiot " * 60_000) > 0
    assert time.process_time() - began < 3


def test_held_out_is_never_null(spark):
    rows = spark.createDataFrame([(None,), (3,)], "doc_id long").select(toxicity.held_out().alias("h")).collect()
    assert all(r.h is not None for r in rows)


def test_learns_words_and_stems(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for k in range(600):
        text = words(rng, 60, "abcdefgh")
        toxic = int(k % 6 == 0)
        if toxic:
            text += f" zork{''.join(rng.choices('abc', k=3))} " if k % 4 else " blarg "
        docs.append((k, text, 0.5))
        labels.append((k, toxic))
    docs += [(1000, None, 0.0), (1001, "", 0.0), (None, "x", 0.0)]
    labels += [(1000, 0), (1001, None), (None, 1), (5, 0)]
    df, lb = spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn(df, lb.where("doc_id % 3 <> 0 OR doc_id IS NULL OR doc_id % 2 = 0"))
    assert any(w.startswith("zork") for w in lexicon.weights) and any(w.startswith("blar") for w in lexicon.weights)
    scored = toxicity.score_texts(df, lexicon)
    assert scored.columns == ["doc_id", "text", "score"] and scored.count() == len(docs)
    wrong = sum((r.score >= 0.5) != (r.doc_id % 6 == 0) for r in scored.where("doc_id < 600").collect())
    assert wrong <= 6
    assert toxicity.score_texts(df.limit(0), lexicon).count() == 0


def test_without_labels_the_seed_counts(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "hello")], "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert set(lexicon.weights) == set(toxicity.SEED)
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs, lexicon).collect()}
    assert got[1] > got[2]


def test_held_out_accuracy(spark):
    rows = toxicity.op7_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.93 * len(rows)


# --- language -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    return langid.model_of(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 5 <> 0"))


def test_held_out_languages(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 5 = 0")
    found = langid.of_documents(docs, model).join(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("true_lang"), "text"), "id").collect()
    assert sum(r.lang == r.true_lang for r in found) >= 0.98 * len(found)
    assert all(r.accepted for r in found if len(r.text) > 40)




def test_cells_follow_letters():
    assert len(langid.cells("ab")) == 2  # " ab" and "ab "
    assert len(langid.cells("123 !")) == 0
    assert np.array_equal(langid.cells("A--b"), langid.cells("a b"))


def test_edge_cases(spark, model):
    rows = [(1, None, None, None, "x"), (2, "", "http://h.example.org/a", None, "x"), (3, "12345 !!!", None, "host", "x"), (4, '<html lang="fr"><body>the of and that the</body></html>', "https://u@www.Ex.fr:80/x", None, "x"), (4, "the of and", "no address", "", "x"), (None, "der die und das", None, None, "x"), (6, "日本語の文章です" * 5, None, None, "x")]
    got = langid.identify(spark.createDataFrame(rows, "id long, text string, url string, host string, lang string"), model).collect()
    assert len(got) == len(rows)
    by = {(r.id, r.host): r for r in got}
    assert not any(by[k].accepted for k in [(1, None), (2, "h.example.org"), (3, "host"), (6, None)])
    assert by[4, "www.ex.fr"].declared == "fr" and by[4, "www.ex.fr"].suffix == "fr"
    assert by[None, None].lang == "de" and by[None, None].accepted
    empty = langid.identify(spark.createDataFrame([], "id long, text string, url string, host string"), model)
    assert empty.count() == 0 and "accepted" in empty.columns


def test_host_prior_decides_when_text_cannot(spark, model):
    rows = [(k, "der die und das ist nicht einheit schlich", "http://a.de/", None) for k in range(60)] + [(k, "the of and that this with", "http://b.uk/", None) for k in range(60, 120)]
    rows += [(500, "o", "http://a.de/", None), (501, "o", "http://b.uk/", None)]
    got = {r.id: r.lang for r in langid.identify(spark.createDataFrame(rows, "id long, text string, url string, host string"), model).where("id >= 500").collect()}
    assert got == {500: "de", 501: "en"}


def test_no_labels(spark):
    none = langid.fit(spark.createDataFrame([], "id long, text string, lang string"))
    got = langid.identify(spark.createDataFrame([(1, "a", None, None)], "id long, text string, url string, host string"), none).collect()
    assert [(r.lang, r.accepted) for r in got] == [(None, False)]


# --- licences -------------------------------------------------------------------------------------------------------

NOTICES = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "proprietary"}


@pytest.fixture(scope="module")
def classifier(spark):
    return licenses.classifier_of(spark.read.parquet(f"{SF}/documents.parquet"))


def test_finds_every_notice_and_nothing_else(spark, classifier):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r.doc_id, r.paragraph, r.family) for r in licenses.scan(docs, classifier).where("confirmed").collect()}
    want = {(r.doc_id, n, NOTICES[line]) for r in docs.collect() for n, line in enumerate(r.text.split("\n")) if line in NOTICES}
    assert got == want


def test_variants_and_unknowns(classifier):
    assert classifier.find("Copyright 2023 Jane Roe. All rights reserved.")[0] == "proprietary"
    assert classifier.find("Released under the BSD license")[0] == "bsd"
    assert classifier.find("Licensed under CC BY-SA 4.0")[0] == "cc-by-sa"
    assert classifier.find("the weather was fine and they went home") is None
    assert classifier.find("my driving license was lost on the way to town") is None or classifier.find("my driving license was lost on the way to town")[3] < licenses.MIN_SIMILARITY
    long = "word " * 3000 + "Released under the MIT License. " + "word " * 3000
    assert classifier.find(long)[0] == "mit"


def test_license_edge_cases(spark, classifier):
    rows = [(1, None, "x"), (2, "", "x"), (None, "Released under the MIT License.", "x"), (3, "a\n\nAll rights reserved.", "x"), (3, "a\n\nAll rights reserved.", "x")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, family string"), classifier).collect()
    assert sorted(((r.doc_id, r.paragraph, r.family) for r in got), key=str) == sorted([(None, 0, "mit"), (3, 2, "proprietary"), (3, 2, "proprietary")], key=str)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string"), classifier).count() == 0
