"""What one task holds doesn't grow with the tables, and small files don't keep costly work in one task."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import runtime
from tallyforge.operators import targets as G
from tallyforge.operators.scoring import coverage, of_items, score_counts, snapshots, source_metrics, weights
from tallyforge.plans import load
from tallyforge.sources import testbed as T

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(runtime, "PART_BYTES", 4096)


def test_more_tasks_for_larger_tables(spark, small_parts):
    """Reviews are dealt before they are counted, over more tasks than a shuffle has if the table is larger (F18-F26)."""
    parts = runtime.stored_parts(T.reviews(spark, SF))
    counts = score_counts(T.reviews(spark, SF))
    assert plan(counts).count("Exchange") == 1
    assert parts > 8 and counts.rdd.getNumPartitions() == parts


def test_scoring_broadcasts_no_items(spark):
    """Items grow with the input: they aren't sent whole to every task (F11, F13)."""
    games, counts = T.games(spark, SF), score_counts(T.reviews(spark, SF))
    for frame in (coverage(counts, games, "genres", "platforms"), of_items(counts, games)):
        assert "BroadcastHashJoin" not in plan(frame)


def test_counts_with_items_score_alike(spark):
    """Metrics, coverage and scores from counts that have met the items: repeated and unknown items, null lists and sources."""
    rows = [(g, s, float(x)) for g in (1, 2, 3, None) for s in (1, 2, None) for x in (10, 20, 20, 90)]
    counts = score_counts(spark.createDataFrame(rows, "game_id int, source_id int, score double"))
    games = spark.createDataFrame([(1, ["a", "b", None, ""], ["p"]), (1, ["c"], None), (2, None, ["q"]), (4, ["a"], ["p"])], "game_id int, genres array<string>, platforms array<string>")
    met = of_items(counts, games)
    found = [lambda c: source_metrics(c, games), lambda c: coverage(c, games, "genres", "platforms")]
    for of in found:
        assert sorted(map(str, of(met).collect())) == sorted(map(str, of(counts).collect()))
    metrics, cover = (of(met) for of in found)
    got = {r.game_id: r for r in snapshots(met, games, metrics, weights(metrics, cover)).collect()}
    assert set(got) == {1, 2} and (got[1].sample_count, got[1].source_count, got[2].sample_count, got[2].source_count) == (24, 2, 12, 2)
    assert {(r.source_id, r.kind, r.value, r.n) for r in cover.collect() if r.source_id == 1} == {(1, "genres", v, 4) for v in "abc"} | {(1, "platforms", v, 4) for v in "pq"}


def test_titles_are_read_by_many_tasks(spark):
    """Slugs and tags of titles are made where the rows of a small file have been dealt (F15, F27, F28)."""
    from tallyforge.plans import targets as P

    slugs = load().QUERIES["q_slug_candidates"](spark, SF)
    assert slugs.rdd.getNumPartitions() == 8
    assert P._tagged_titles(spark, SF).rdd.getNumPartitions() == 8
    wanted, products = P._wanted(spark, SF)
    text = plan(G.accepted_products(wanted, products))
    assert "REPARTITION_BY_NUM" in text and "BroadcastHashJoin" not in text


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path, small_parts):
    """A large change of few buckets is dealt over more tasks than there are buckets (F9, F12)."""
    from tallyforge.operators.store import BucketTable

    rows = T.table(spark, SF, "lineitem").select(F.col("l_orderkey").alias("k"))
    table = BucketTable(spark, str(tmp_path / "t"), rows.schema, ["k"], 2)
    table.replace(rows)
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, rows.collect()))
    assert len(table.read().inputFiles()) > 4


def test_changes_are_stored_once(spark, tmp_path, monkeypatch):
    """Publication checkpoints the documents that changed, and the table's change doesn't do so again (F9)."""
    from tallyforge.operators import publish, store

    def again(frame):
        raise AssertionError("stored twice")

    monkeypatch.setattr(store, "checkpointed", again)
    docs, table = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, json string"), publish.published(spark, str(tmp_path / "p"), 2)
    assert publish.publish(docs, table) == {"written": 2, "removed": 0} and publish.publish(docs, table) == {"written": 0, "removed": 0}
    assert sorted((r.key, r.json) for r in table.read().collect()) == [("a", "1"), ("b", "2")]


def test_documents_are_written_and_shuffled_once(spark, tmp_path):
    """Publication shuffles documents once and writes them once, in the table's folder; those it rewrites leave nothing behind (F2)."""
    from pathlib import Path

    from tallyforge.operators import publish

    rows = lambda *keys: spark.createDataFrame([(f"{k}", f"v{k}" * 100) for k in keys], "key string, json string")
    files = lambda where: {str(f) for f in Path(where).rglob("*.parquet")} | {str(f) for f in Path(where).rglob("rdd-*")}
    table, shared = publish.published(spark, str(tmp_path / "p"), 4), runtime.checkpoint_dir(spark).removeprefix("file:")
    assert plan(publish.document_changes(rows(*range(50)), table)).count("Exchange") == 1
    before = files(shared)
    assert publish.publish(rows(*range(50)), table) == {"written": 50, "removed": 0}
    assert files(shared) == before and files(tmp_path) == {f.removeprefix("file://") for f in table.read().inputFiles()}
    first = files(tmp_path)
    assert publish.publish(rows(*range(50)), table) == {"written": 0, "removed": 0} and files(tmp_path) == first
    assert publish.publish(rows(*range(1, 60)), table) == {"written": 10, "removed": 1}
    assert files(tmp_path) - first <= {f.removeprefix("file://") for f in table.read().inputFiles()}
    assert sorted(r.key for r in table.read().collect()) == sorted(f"{k}" for k in range(1, 60))


def test_a_few_new_buckets_beside_old_ones(spark, tmp_path):
    """Buckets without rows take what is staged, others are merged, and removals empty a bucket (F2)."""
    from tallyforge.operators import publish

    rows = lambda *keys: spark.createDataFrame([(f"{k}", f"v{k}") for k in keys], "key string, json string")
    table, held = publish.published(spark, str(tmp_path / "p"), 16), set()
    for keys in (range(3), range(2, 9), range(40), range(5, 7), ()):
        assert publish.publish(rows(*keys), table) == {"written": len(set(keys) - held), "removed": len(held - set(keys))}
        assert sorted((r.key, r.json) for r in table.read().collect()) == sorted((f"{k}", f"v{k}") for k in keys)
        held = set(keys)


def test_all_reviews_meet_items_where_they_are_counted(spark):
    """Coverage of unscored reviews too deals them by item once, then by source (F2)."""
    from tallyforge.operators.scoring import review_counts

    text = plan(coverage(review_counts(T.reviews(spark, SF)), T.games(spark, SF), "genres"))
    assert text.count("Exchange") == 3  # reviews and items by item, counts by source
