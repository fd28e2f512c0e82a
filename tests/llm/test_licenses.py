"""License scans: several notices in one paragraph, other wordings, and hard-wrapped notices."""

import pytest

from echograin.llm import licenses


@pytest.fixture(scope="module")
def classifier(spark):
    return licenses.classifier_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def confirmed(classifier, text):
    return {(n + f[0], n + f[1], f[2]) for n, lines in licenses.paragraphs(text) for f in classifier.find_all(lines) if f[5] >= licenses.MIN_SIMILARITY}


def test_every_notice_of_a_long_line(classifier):
    filler = "thond erean whst inganea " * 100
    text = f"Released under the MIT License. {filler} This work is licensed under the GNU General Public License, version 3. {filler} All rights reserved."
    assert confirmed(classifier, text) == {(0, 0, "mit"), (0, 0, "gpl"), (0, 0, "proprietary")}


def test_wordings_without_a_telling_word(classifier):
    assert classifier.find("Released under the MIT licence")[0] == "mit"
    assert classifier.find("GNU General Public Licence v3")[0] == "gpl"


def test_hard_wrapped_notices(classifier):
    gpl = "intro\n\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated files, to deal"
    assert confirmed(classifier, gpl) == {(2, 3, "gpl")}
    assert confirmed(classifier, bsd) == {(0, 1, "bsd")}
    assert confirmed(classifier, mit) == {(0, 1, "mit")}


def test_two_notices_in_one_line(classifier):
    assert confirmed(classifier, "Released under the MIT License. Licensed under the Apache License, Version 2.0.") == {(0, 0, "mit"), (0, 0, "apache")}
    assert [f[2] for f in classifier.find_all(["All rights reserved. All rights reserved."])] == ["proprietary"] * 2


def test_wrapped_and_bare_names(classifier):
    assert confirmed(classifier, "This work is licensed under the GNU General Public\nLicense, version 3.") == {(0, 1, "gpl")}
    for text, family in {"License: MIT": "mit", "distributed under GPL v3": "gpl", "GPL v2 only": "gpl", "GNU Lesser General Public License, version 2.1": "lgpl", "Apache License 2.0": "apache"}.items():
        assert confirmed(classifier, text) == {(0, 0, family)}


def test_whole_licence_text_is_one_notice(classifier):
    text = "\n".join(licenses.TEMPLATES["mit"][7][k : k + 70] for k in range(0, 420, 70))
    assert {f[2] for f in classifier.find_all(text.split("\n"))} == {"mit"}


def test_calibration_is_measured(classifier):
    assert 0 <= classifier.calibration_error < 0.05 and 0.1 < classifier.temperature < 10


def test_windows_without_ngrams_are_unknown(classifier):
    import numpy as np

    assert classifier.probabilities(classifier.bias).argmax() == classifier.unknown
    words = "thond erean whst".split()
    assert all(len(x) == 0 for x in classifier.evidence(words)) and classifier.segments(words) == []
    words = licenses.words_of("so it was released under the mit license and that was all")
    one_at, one, two_at, two = classifier.evidence(words)
    want = sum(classifier.weights[classifier.vocabulary[g]] for g in [*words, *zip(words, words[1:])] if g in classifier.vocabulary and not (isinstance(g, str) and g.isdigit()))
    assert np.allclose(classifier.weights[one].sum(axis=0) + classifier.weights[two].sum(axis=0), want)


def test_hostile_text_takes_linear_time(classifier):
    import time

    began = time.process_time()
    found = classifier.find_all(["All rights reserved. Released under the MIT License. " * 4000])
    assert len(found) == 8000 and time.process_time() - began < 60


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = licenses.op4_license_scan(spark, folder).collect()
    want = {(r.doc_id, n) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() for n, line in enumerate(r.text.split("\n")) if line in ("All rights reserved.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.")}
    assert {(r.doc_id, r.paragraph) for r in rows if r.confirmed} == want


def test_repeated_notices_are_all_found(classifier):
    for n in (500, 1000, 4000):
        assert len(classifier.find_all(["Released under the MIT License. " * n])) == n


def test_a_word_said_over_and_over_tells_nothing(classifier):
    for junk in ("Edes " * 3000 + "only " * 50, "no " * 2000, "Ha " * 500 + "only only only", "permitted " * 900, "license " * 40):
        assert not [f for f in classifier.find_all([junk]) if f[3] > 0.9], junk[:40]


def test_windows_count_each_ngram_once(classifier):
    """Logits of all windows by a plain loop, inside gaps, against running sums less what is there again."""
    import numpy as np

    rng = np.random.default_rng(3)
    pool = ["license", "the", "mit", "under", "released", "version", "only", "thond", "no", "gnu"]
    words = [pool[k] for k in rng.integers(0, len(pool), 150)]
    at_one, one, at_two, two = classifier.evidence(words)
    starts = np.union1d(at_one, at_two - 1)
    gaps = np.array([[0, 70], [75, 150]])
    for size in licenses.WINDOWS:
        again = classifier._again(at_one, one, 0, classifier.weights[one], starts, gaps, size) + classifier._again(at_two, two, 1, classifier.weights[two], starts, gaps, size)
        for k, b in enumerate(starts):
            if 70 <= b < 75:
                continue
            e = min(b + size, 70 if b < 70 else 150)
            plain = [(g, classifier.weights[g]) for a, g in zip(at_one, one) if b <= a < e] + [((g, 2), classifier.weights[g]) for a, g in zip(at_two, two) if b < a < e]
            assert np.allclose(sum((w for _, w in plain), np.zeros(len(classifier.classes))) - again[k], sum(dict(plain).values(), np.zeros(len(classifier.classes))))
