import math
import re
from collections import Counter, defaultdict

import numpy as np

from tallyforge.llm import ngram
from tests.llm.helpers import crc, docs


def brute(rows):
    """The same model with dictionaries of words."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for i, t in rows}
    train = [words[i] for i, _ in rows if crc(i) % 10]
    uni, bi = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([None, *t[:-1]], t))
    total, v = sum(uni.values()), len(uni)
    ds = lambda c: ngram._discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])
    d = ds(bi)
    second, context = Counter(b for _, b in bi), defaultdict(Counter)
    for (a, b), n in bi.items():
        context[a][b] = n
    e = ds(second)
    spare = sum(e[min(n, 3)] for n in second.values()) / max(1, len(bi)) if bi else 1
    low = lambda w: max(second[w] - e[min(second[w], 3)], 0) / len(bi) + spare / (v + 1) if bi else 1.0
    out = {}
    for i, t in words.items():
        base = sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (v + 1))) for w in t)
        s = 0.0
        for a, w in zip([None, *t[:-1]], t):
            n = sum(context[a].values())
            own = max(bi[a, w] - d[min(bi[a, w], 3)], 0) / n if n else 0
            s += math.log10(own + (sum(d[min(x, 3)] for x in context[a].values()) / n if n else 1) * low(w))
        out[i] = (len(t), sum(uni[w] > 0 for w in t), base, s)
    return out, total, low, uni


def test_matches_dictionaries(spark):
    r = np.random.default_rng(1)
    vocab = [f"w{k}" for k in range(60)] + ["Ä", "the", "The", "x.y"]
    rows = [(i, " ".join(r.choice(vocab, r.integers(0, 80), p=None))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "the " * 3000), (203, " \t\n "), (204, "unseen words only-here")]
    want, total, low, uni = brute(rows)
    got = ngram.perplexity(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for row in got:
        n, known, base, s = want[row.doc_id]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (n, known, total)
        assert row.held_out == (crc(row.doc_id) % 10 == 0)
        assert math.isclose(row.base_score, base, rel_tol=1e-9)
        assert math.isclose(row.score, s, rel_tol=1e-5)


def test_lower_order_sums_to_one():
    rows = [(i, "a b c a b d e f a a") for i in range(5)] + [(9, "z y x w a b")]
    _, _, low, uni = brute(rows)
    assert math.isclose(sum(low(w) for w in uni) + low("never"), 1, rel_tol=1e-9)


def test_empty_and_repeated(spark):
    assert ngram.perplexity(docs(spark, [])).collect() == []
    got = ngram.perplexity(docs(spark, [(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert len(got) == 3


def test_unmix_inverts_mix():
    h = np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert (ngram.unmix(ngram.mix(h)) == h).all()
