"""What the operators' methods promise, held against plain computations."""

import itertools

import numpy as np
import pytest

from tallyforge.llm import langid, packing, repair, toxicity
from tests.llm.helpers import docs


def risk(z, positive, prior):
    """The non-negative positive-unlabelled risk, term by term."""
    pos, unl = z[positive], z[~positive]
    lost = lambda v: np.log1p(np.exp(-v))
    return prior * lost(pos).mean() + max(0.0, lost(-unl).mean() - prior * lost(-pos).mean())


def test_nnpu_lowers_its_risk_to_about_the_least():
    r = np.random.default_rng(3)
    n, prior = 600, 0.2
    positive = np.arange(n) < 120
    toxic = positive | (r.random(n) < prior)
    rows = [np.unique(np.concatenate([r.integers(0, 200, 8), (1000 + r.integers(0, 10, 3)) if t else r.integers(200, 400, 3)])) for t in toxic]
    words, counts = np.concatenate(rows).astype(np.int32), np.array([len(x) for x in rows])
    weights, bias = toxicity.fit(words, counts, positive, prior, shrink=0.0)
    z = np.array([weights[x].sum() + bias for x in rows])
    chosen = np.flatnonzero(weights)
    assert set(chosen) <= set(range(1000, 1010)) and len(chosen) >= 8
    at_start = np.full(n, np.log(prior / (1 - prior)))
    assert risk(z, positive, prior) < 0.6 * risk(at_start, positive, prior)
    for k in chosen:  # no small step in a single weight lowers it by much
        for step in (-0.3, 0.3):
            moved = z + np.array([step if k in x else 0.0 for x in rows])
            assert risk(moved, positive, prior) > risk(z, positive, prior) - 0.01
    assert ((z >= 0) == toxic).mean() > 0.95


@pytest.mark.parametrize("k", [2, 3, 5])
def test_differencing_is_near_the_best_partition(k):
    r = np.random.default_rng(k)
    for _ in range(20):
        sizes = r.integers(1, 100, 8)
        at = packing.differencing(sizes, k)
        sums = np.bincount(at, sizes, k)
        best = min(max(np.bincount(p, sizes, k)) for p in itertools.product(range(k), repeat=7) for p in [np.array([0, *p])]) if k < 4 else sizes.sum() / k
        assert sums.sum() == sizes.sum() and sums.max() <= 1.35 * max(best, sizes.max())


def test_windows_rise_until_all_fit():
    sizes = np.full(7, 600)
    at = packing.windows(sizes, 1000)
    assert np.bincount(at, sizes).max() <= 1000 and at.max() == 6
    assert len(packing.windows(np.zeros(0, np.int64), 10)) == 0


def test_repeated_rows_and_full_windows(spark):
    row = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    rows = [(None, 0, 7, 5, 7, None)] * 9000 + [(k, 0, 2048, 1, 2048, None) for k in range(50)]
    got = packing.pack(spark.createDataFrame(rows, row)).toPandas()
    assert len(got) == 9050 and got.groupby("sequence_id").length.sum().max() <= 2048
    ends = got.sort_values(["sequence_id", "offset"])
    assert (ends.offset == ends.groupby("sequence_id").length.cumsum() - ends.length).all()
    assert got[got.length < 2048].sequence_id.nunique() <= 9000 * 7 // 2048 + 6


def test_grammar_of_wide_ids_and_null_documents():
    r = np.random.default_rng(9)
    ids = r.choice(np.array([70_000, 5, 2**31, 7], np.uint32), 5000)
    ids[499::500] = 2
    block = repair.Block(repair.write_block([None, 4, *range(8)], np.full(10, 500), ids, 2))
    assert (block.all() == ids).all() and len(block._seq) < len(ids) and block.nulls.tolist() == [True] + [False] * 9
    assert (block.document(3) == ids[1500:2000]).all()


def test_samples_are_bounded_without_ids(spark):
    from pyspark.sql import functions as F

    rows = [(None, f"text number {k} is here", "en") for k in range(6000)] + [(7, "the same row", "en")] * 6000
    d = docs(spark, rows)
    drawn = d.where(langid.drawn(12_000, 1200)).select("doc_id", "text").distinct().count()
    assert 400 < drawn < 900
    names, net = langid.train(d, F.lit(True))
    assert names == ["en"] and net is not None
    labels = spark.createDataFrame([(7, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.train(d, labels, F.lit(True)) is not None
