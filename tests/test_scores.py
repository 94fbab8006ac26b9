import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions.scores import band, discrimination_factor, half_up_1, normalized, relevance, sample_confidence
from tallyforge.operators.scoring import coverage, score_counts, snapshots, source_metrics, weights

CASES = [
    (None, 10.0, None, "empty_value"), ("  ", None, None, "empty_value"), ("A-", None, 87.0, "letter:A-"), (" b+ ", None, 83.0, "letter:B+"),
    ("F+", None, None, "unknown_letter"), ("8/10", None, 80.0, "fraction:8/10"), ("12/10", None, 100.0, "fraction:12/10"),
    ("4/0", None, None, "unparseable_fraction"), ("1.2.3/5", None, None, "unparseable_fraction"), ("7.5", 10.0, 75.0, "scale_10"),
    ("4", 5.0, 80.0, "scale_5"), ("3", 4.0, 75.0, "scale_4_star"), ("12", 20.0, 60.0, "scale_custom"), ("120", 100.0, 100.0, "scale_100"),
    ("-3", 100.0, 0.0, "scale_100"), ("85", None, None, "no_scale_info"), ("85", 0.0, None, "no_scale_info"), ("abc", 100.0, None, "unparseable_value"),
    ("8d", 100.0, None, "unparseable_value"), ("1_0", 100.0, None, "unparseable_value"),
]


def test_rules(spark):
    rows = spark.createDataFrame([(i, v, s) for i, (v, s, _, _) in enumerate(CASES)], "i int, v string, s double")
    got = rows.select("i", normalized(F.col("v"), F.col("s")).alias("r")).orderBy("i").collect()
    for (_, _, score, rule), r in zip(CASES, got):
        assert r.r.rule == rule and (r.r.score is None if score is None else r.r.score == pytest.approx(score))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_factors(spark):
    assert [round(one(spark, sample_confidence(F.lit(n))), 6) for n in (0, 5000, 10**6)] == [0.6, 1.1, 1.1]
    assert [one(spark, discrimination_factor(F.lit(d).cast("double"))) for d in (None, 0.0, 1.0)] == [0.9, 0.7, 1.0]
    assert [round(one(spark, relevance(F.lit(c).cast("long"), F.lit(10), 0.4, 1.2)), 6) for c in (10, 0, None)] == [1.2, 0.8, 1.0]
    assert one(spark, half_up_1(F.lit(0.35))) == 0.4 and one(spark, band(F.lit(89.9))) == "great"


@pytest.mark.parametrize("n", [1, 2, 7, 19, 20, 39, 40, 101])
def test_middle_scores(spark, n):
    """Median, trimmed mean and deviation from counts, against the whole lists."""
    r = np.random.default_rng(n)
    rows = [(g, int(r.integers(3)), float(x)) for g in range(4) for x in r.integers(0, 5 if g % 2 else 100, n)] + [(0, 1, None)]
    reviews = spark.createDataFrame(rows, "game_id int, source_id int, score double")
    games = spark.createDataFrame([(g, ["a"], None) for g in range(5)], "game_id int, genres array<string>, platforms array<string>")
    counts = score_counts(reviews)
    metrics = source_metrics(counts, games)
    got = {x.game_id: x for x in snapshots(counts, games, metrics, weights(metrics, coverage(counts, games, "genres", "platforms"))).collect()}
    for g in range(4):
        own = sorted(x for k, _, x in rows if k == g and x is not None)
        cut = int(n * 0.05) if n >= 20 else 0
        want = (n, np.mean(own), np.median(own), np.mean(own[cut : n - cut]), np.std(own))
        assert (got[g].sample_count, got[g].raw_average, got[g].median_score, got[g].trimmed_mean, got[g].score_std) == pytest.approx(want, abs=1e-4)
    assert len(got) == 4


def test_no_reviews_and_equal_scores(spark):
    games = spark.createDataFrame([(1, ["a"], ["p"])], "game_id int, genres array<string>, platforms array<string>")
    reviews = spark.createDataFrame([(1, 1, 73.3)] * 3, "game_id int, source_id int, score double")
    for rows, want in ((reviews.limit(0), []), (reviews, [(3, 73.3, 0.0)])):
        counts = score_counts(rows)
        metrics = source_metrics(counts, games)
        out = snapshots(counts, games, metrics, weights(metrics, coverage(counts, games, "genres", "platforms")))
        assert [(r.sample_count, r.weighted_score, r.score_std) for r in out.collect()] == want


def test_scores_kept_up_to_date(spark, tmp_path):
    """After each batch the stored counts give what a run over all reviews so far gives; few buckets are rewritten."""
    from tallyforge.operators.incremental import ScoreState
    from tallyforge.sources import testbed as T

    sf = "/root/testdata/sf0.001"
    reviews, games = T.reviews(spark, sf), T.games(spark, sf)
    state = ScoreState.at(str(tmp_path / "s"), reviews, 16)
    part = [reviews.where(c) for c in ("game_id % 3 = 0", "game_id % 3 <> 0 and game_id <> 5", "game_id = 5")]
    touched, so_far = [], reviews.limit(0)
    for k, batch in enumerate(part):
        touched.append(state.apply(batch, note=("b", k)))
        so_far = so_far.unionByName(batch)
        counts = score_counts(so_far)
        metrics = source_metrics(counts, games)
        want = snapshots(counts, games, metrics, weights(metrics, coverage(counts, games, "genres", "platforms")))
        assert sorted(map(tuple, state.snapshots(games).collect())) == sorted(map(tuple, want.collect()))
    assert len(touched[-1]) == 1
    state.apply(removed=reviews.where("game_id <> 5"))
    assert {r.game_id for r in state.snapshots(games).collect()} == {5}
    assert state.apply() == [] and state.apply(reviews.limit(0)) == []


def test_one_decimal_is_exact(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from tallyforge.functions.scores import score_text, signed_text

    r = np.random.default_rng(1)
    values = [0.25, 66.25, 66.35, 66.75, 0.05, 0.95, 99.95, 100.0, 0.0, -0.04, -66.25, -66.35, *(round(float(x), 2) for x in r.uniform(-100, 100, 500)), *(float(x) for x in r.uniform(0, 100, 200))]
    want = [str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in values]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate([*values, None])], "k int, v double").orderBy("k").select(score_text(F.col("v")).alias("t"), signed_text(F.col("v")).alias("s")).collect()
    assert [x.t for x in rows] == [*want, "N/A"] and [x.s for x in rows[:-1]] == [w if w.startswith("-") else "+" + w for w in want]
