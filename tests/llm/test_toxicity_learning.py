"""What the lexicon learns, against dictionaries: counts, log odds, choice of entries, and the fitted line."""

import math
import random

import numpy as np

from echograin.llm import toxicity


def brute(rows):
    """Weights of the lexicon for distinct texts with labels, by plain counts."""
    bad, clean = sum(t for _, t in rows), sum(1 - t for _, t in rows)
    terms = [toxicity.terms_of(text) for text, _ in rows]
    counts = {}
    for found, (_, toxic) in zip(terms, rows):
        for term in found:
            counts.setdefault(term, [0, 0])[1 - toxic] += 1
    least = max(toxicity.MIN_DOCUMENTS, math.ceil(toxicity.MIN_SHARE * bad))
    kept = []
    for term, (a, b) in counts.items():
        w = math.log((a + 0.5) / (bad - a + 0.5)) - math.log((b + 0.5) / (clean - b + 0.5)) - math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if a >= least and w >= toxicity.MIN_LOG_ODDS:
            kept.append((-w * math.sqrt(a), term, a, w))
    kept.sort()
    general = {s for _, s, a, _ in kept for _, t, b, _ in kept if t != s and t.startswith(s) and b >= 0.95 * a and len(s) in toxicity.STEMS}
    weights, told = {w: toxicity.SEED_WEIGHT for w in toxicity.SEED}, [0] * len(rows)
    for _, term, _, w in kept:
        new = [d for d, (found, (_, toxic)) in enumerate(zip(terms, rows)) if toxic and term in found and told[d] < toxicity.DEPTH]
        if term not in general and len(new) >= least:
            weights[term.rstrip() if term.rstrip() in toxicity.SEED else term] = w
            for d in new:
                told[d] += 1
    return weights


def corpus():
    rng = random.Random(4)
    plain = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ala", "eno", "iru", "osi")]
    insults = ["grubnik", "zorkel", "vexmoot", "zorkelish", "trash", "pfui" * 8]
    rows = {}
    for k in range(400):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 40))]
        toxic = int(k % 3 == 0)
        for _ in range(rng.randrange(1, 4) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows[" ".join(words)] = toxic
    return list(rows.items())


def test_learning_equals_dictionaries(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    lexicon, want = toxicity.learn(docs, labels), brute(rows)
    assert lexicon.weights.keys() == want.keys()
    assert all(abs(lexicon.weights[t] - w) < 1e-9 for t, w in want.items())
    assert {t for t in want if t.strip() in ("grubnik", "vexmoot")}
    raw = np.array([lexicon.raw(t) for t, _ in rows])
    y = np.array([y for _, y in rows])
    p = 1 / (1 + np.exp(-(lexicon.slope * raw + lexicon.offset)))
    assert abs(((p - y) * raw).sum() + 1e-3 * lexicon.slope) < 1e-3 and abs((p - y).sum() + 1e-3 * lexicon.offset) < 1e-3  # the loss is flat there
    assert ((p >= 0.5) == y).mean() > 0.95


def test_words_of_any_length_are_terms():
    long = "grumpf" * 20
    assert long + " " in toxicity.terms_of(f"you {long}!") and long[:7] in toxicity.terms_of(long)
