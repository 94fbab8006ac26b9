"""Held-out accuracy of the trained models, and their building blocks."""

import numpy as np

from tallyforge.llm import langid, toxicity
from tests.llm.helpers import docs

SYLLABLES = {"en": ["the", "ing", "tion", "wh", "sh"], "de": ["sch", "ung", "lich", "ö", "ei"], "fr": ["eau", "ç", "ment", "é", "oi"]}


def rows(n=600):
    r = np.random.default_rng(2)
    out = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        words = ["".join(r.choice(SYLLABLES[lang], r.integers(1, 4))) for _ in range(r.integers(5, 120))]
        toxic = int(r.random() < 0.2)
        for _ in range(toxic * 3):
            words.insert(int(r.integers(0, len(words))), str(r.choice(["idiot", "moron", "scum"])))
        out.append((i, " ".join(words), lang, toxic))
    return out


def test_language_held_out(spark):
    data = rows()
    want = {i: lang for i, _, lang, _ in data}
    got = langid.language(docs(spark, [(i, t, lang) for i, t, lang, _ in data] + [(900, "12 34"), (901, None)])).collect()
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.98
    assert {r.lang_pred for r in got if r.doc_id >= 900} == {"und"}


def test_toxicity_held_out(spark):
    data = rows()
    labels = spark.createDataFrame([(i, 1, t) for i, _, _, t in data], "doc_id long, quality int, toxic int")
    want = {i: t for i, _, _, t in data}
    got = toxicity.toxicity(docs(spark, [(i, t) for i, t, _, _ in data]), labels).collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_no_labels(spark):
    d = docs(spark, [(1, "a b"), (2, "c")])
    assert {r.score for r in toxicity.toxicity(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()} == {0.0}


def test_gradient_of_the_network():
    net = langid.ByteCNN(3)
    r = np.random.default_rng(0)
    x, y = r.integers(0, 256, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: -np.log(net.probabilities(x)[np.arange(4), y]).mean()
    slopes = net._slopes(x, y)
    for name, at in (("out", (3, 1)), ("bias", (5,)), ("kernel", (0, 2, 7)), ("embed", (int(x[0, 5]), 3))):
        was = net.p[name][at]
        net.p[name][at] = was + 1e-5
        up = loss()
        net.p[name][at] = was - 1e-5
        down = loss()
        net.p[name][at] = was
        assert abs((up - down) / 2e-5 - slopes[name][at]) < 1e-5
