"""Spaced seeds: the masks miss no overlap, and the matches are those of a comparison of all places."""

import itertools
import re

import numpy as np
import pytest

from tallyforge.llm import decontaminate
from tests.llm.helpers import docs


def allowed(n):
    """How many words of an overlap of n may differ."""
    return next(e for e in range(n, -1, -1) if n - e >= 0.8 * n)


@pytest.mark.parametrize("n", range(5, 21))
def test_masks_are_lossless(n):
    masks = decontaminate.MASKS[max(k for k in decontaminate.MASKS if k <= n)]
    looks = [sum(1 << (i + at) for i, c in enumerate(m) if c == "1") for m in masks for at in range(n - len(m) + 1)]
    for places in itertools.combinations(range(n), allowed(n)):
        changed = sum(1 << p for p in places)
        assert any(not look & changed for look in looks), places


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(rows, items):
    out = {}
    for (d, text), (i, item) in itertools.product(rows, items):
        h, g = words(text), words(item)
        n = min(20, len(g))
        if len(g) < 5:
            continue
        best = max((sum(x == y for x, y in zip(h[a : a + n], g[b : b + n])) for a in range(len(h) - n + 1) for b in range(len(g) - n + 1)), default=0)
        if best >= 0.8 * n:
            out[d, i] = (n, best)
    return out


def planted():
    r = np.random.default_rng(12)
    say = lambda n: [f"w{x}" for x in r.integers(0, 400, n)]
    items = [(n, " ".join(say(n))) for n in [*range(4, 26), 40, 120]]
    rows = []
    for i, item in items:
        g = item.split()
        for k in range(14):  # as many changes as an overlap may have, one more, and runs cut out of long items
            n = min(20, len(g))
            at = int(r.integers(0, len(g) - n + 1))
            run = g[at : at + n]
            for p in r.choice(n, min(n, allowed(n) + (k % 7 == 0)), replace=False):
                run[p] = f"x{r.integers(0, 10**6)}"
            rows.append((len(rows), " ".join([*say(int(r.integers(0, 9))), *run, *say(int(r.integers(0, 9)))]).upper() if k % 2 else " ".join(run)))
    return rows, items


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 60_000])
def test_matches_are_those_of_all_places(spark, block_bytes):
    rows, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.overlap, r.agreeing) for r in decontaminate.matches(docs(spark, rows), bench, block_bytes).collect()}
    want = brute(rows, items)
    assert len(want) > 200 and got == want


def test_ties_repeats_and_long_texts(spark):
    item = " ".join(f"t{k}" for k in range(30))
    half = " ".join(item.split()[:20])
    far = "filler " * 60_000 + item
    rows = [(1, half + " gap " + half), (1, half), (None, item), (None, item), (2, far), (3, item[:20])]
    bench = spark.createDataFrame([(7, item), (7, item), (8, item)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.overlap, r.agreeing) for r in decontaminate.matches(docs(spark, rows), bench).collect())
    assert got == [(d, i, 20, 20) for d in (0, 1, 2) for i in (7, 8)]
    left = decontaminate.clean(docs(spark, rows).withColumnRenamed("source", "__key").withColumnRenamed("lang", "row"), bench)
    assert [r.doc_id for r in left.collect()] == [3] and left.columns == ["doc_id", "text", "row", "__key", "n_chars"]
