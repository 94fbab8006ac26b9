"""Runs of steps, versions, and options that exclude one another."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyforge import pipeline as P
from tallyforge import steps as S
from tallyforge.operators import provider as V
from tallyforge.params import BackfillOptions, RepairOptions, RunOptions, ScoringParams
from tallyforge.plans.scoring import snapshots_of
from tallyforge.sources import testbed as T

SF = "/root/testdata/sf0.001"


def tables(spark):
    return {"games": T.games(spark, SF), "reviews": T.reviews(spark, SF)}


def test_scoring_steps_give_what_the_query_gives(spark, tmp_path):
    run = P.Pipeline(S.SCORING, str(tmp_path / "run"))
    out = run.run(spark, tables(spark))
    assert run.done == ["counts", "metrics", "weights", "scores"]
    got = {r.game_id: tuple(r) for r in P.of_version(out["score_snapshots"], "v1").collect()}
    assert got == {r.game_id: tuple(r) for r in snapshots_of(spark, SF).collect()}
    # another version stands beside it, the same one takes its place
    again = P.Pipeline(S.SCORING, str(tmp_path / "again")).run(spark, out, RunOptions(scoring=ScoringParams(version="v2", least_per_source=10**9)))
    assert {r.version: r["count"] for r in again["score_snapshots"].groupBy("version").count().collect()} == {"v1": len(got), "v2": len(got)}
    assert again["source_metrics"].where("version = 'v2'").count() == 0
    with pytest.raises(ValueError, match="not a version"):
        P.with_version(None, out["games"], "a/b")


def test_optional_steps_and_rebuild(spark, tmp_path):
    seen = []
    steps = [P.Step("a", lambda t, o: seen.append(t["reviews"].count()) or {}), P.Step("b", lambda t, o: {"games": t["games"].limit(1)}, optional=True)]
    run = P.Pipeline(steps, str(tmp_path))
    assert run.run(spark, {}, RunOptions(rebuild=True))["games"].count() == 0 and run.done == ["a"] and seen == [0]
    assert run.run(spark, tables(spark), RunOptions(include=frozenset({"b"})))["games"].count() == 1 and run.done == ["a", "b"]
    with pytest.raises(ValueError, match="no such steps"):
        run.run(spark, {}, RunOptions(include=frozenset({"c"})))
    with pytest.raises(ValueError, match="exclude"):
        BackfillOptions(target_samples=frozenset({50}), missing_only=True)


def test_writes_on_empty_tables_and_null_keys(spark):
    empty = P.create_tables(spark)
    games = spark.createDataFrame([("1", "A", 2000), (None, "B", None)], "game_id string, title string, release_year int")
    batch = spark.createDataFrame([("1", "9", "A!", 1999, 5, 80.0, "s", "u", None), ("2", "8", "C", None, None, None, None, None, None)], "game_id string, external_id string, title string, release_year int, listed long, listed_score double, slug string, url string, identity_suffix string").withColumn("collected_at", F.timestamp_seconds(F.lit(1)))
    reviews = spark.createDataFrame([("1", "IGN", "r1", 7.0, None), ("1", "IGN", "r2", None, None)], "game_id string, outlet string, external_review_id string, score double, review_date date")
    t = V.write_games({**empty, "games": games}, batch, reviews, "web")
    assert sorted((r.game_id or "", r.title, r.release_year) for r in t["games"].collect()) == [("", "B", None), ("1", "A", 1999), ("2", "C", None)]
    assert (t["game_identity"].count(), t["external_baseline"].count(), t["reviews"].count()) == (2, 2, 1)
    assert V.replace_reviews(t["reviews"], t["reviews"].limit(0), ("web",)).count() == 1
    assert {k: f.count() for k, f in V.purge({**t, "games": t["games"]}, "web").items()} == {"reviews": 0, "external_baseline": 0, "game_identity": 0, "games": 1}


RAW = "ID int, Game string, Website string, Review string, Score string"


def raw(spark):
    """Raw reviews of a few items, two of them the same under another name."""
    rows = [(k, g, w, f"text {k}", s) for k, (g, w, s) in enumerate([
        ("Prey", "IGN.com", "80"), ("Prey", "https://www.gamespot/", " 90 "), ("Prey (PS4)", "ign", "70"), ("Prey (2017)", "Own", "60"), ("Halo & Co", "IGN", "tbd"), ("Halo & Co", "IGN", "50"), (None, "IGN", "1"),
    ])]
    dates = spark.createDataFrame([("Prey", "2006-07-11")], "Game string, release_date string")
    catalog = spark.createDataFrame([(1, None, "Halo and Co", None, None, "about", ["Maker"], [], ["RPG"], ["PC", "Xbox"])],
        "line_no long, slug string, name string, released string, metacritic_url string, description_raw string, developers array<string>, publishers array<string>, genres array<string>, parent_platforms array<string>")
    return {"raw_reviews": spark.createDataFrame(rows, RAW), "raw_dates": dates, "catalog": catalog}


def test_a_whole_run(spark, tmp_path):
    run = P.Pipeline(S.WHOLE, str(tmp_path))
    out = run.run(spark, raw(spark), RunOptions(rebuild=True, include=frozenset({"catalog"})))
    games = {r.title: r for r in out["games"].collect()}
    assert set(games) == {"Prey", "Prey (2017)", "Halo & Co"}  # the plain and the tagged one are of different years
    halo = games["Halo & Co"]
    assert (halo.developer, halo.genres, halo.platforms, halo.description) == ("Maker", ["RPG"], ["PC", "Xbox"], "about")
    assert {(r.review_id, r.platform) for r in out["reviews"].collect()} == {("mc-rev-0", None), ("mc-rev-1", None), ("mc-rev-2", None), ("mc-rev-3", None), ("mc-rev-5", "PC|Xbox")}
    scores = {r.game_id: (r.sample_count, r.raw_average) for r in P.of_version(out["score_snapshots"], "v1").collect()}
    assert scores == {games["Prey"].game_id: (3, 80.0), games["Prey (2017)"].game_id: (1, 60.0), halo.game_id: (1, 50.0)}
    assert {r.name for r in out["sources"].collect()} == {"IGN", "GameSpot", "Own"}
    assert out["item_documents"].count() == 3 and out["source_documents"].count() == 3
    # the next run reads what this one left, and changes nothing
    again = run.run(spark, {**run.current(spark), **raw(spark)}, RunOptions(include=frozenset({"catalog"})))
    rows = lambda f: sorted(map(str, f.collect()))
    for name in ("games", "reviews", "sources", "game_identity", "external_baseline", "score_snapshots", "item_documents"):
        assert rows(again[name]) == rows(out[name]), name
    assert "item_documents" not in P.Pipeline(S.WHOLE, str(tmp_path / "b")).run(spark, raw(spark), RunOptions(rebuild=True, publish=False))


def counted(spark):
    """A column function that gives texts back and counts its calls."""
    calls = spark.sparkContext.accumulator(0)
    said = F.udf(lambda t: calls.add(1) or t).asNondeterministic()
    return calls, lambda t: said(t)


def test_raw_rows_are_read_once(spark, tmp_path):
    """The import reads its input once for all five tables, and each outlet's name once for the sources (F10)."""
    calls, of = counted(spark)
    given = raw(spark)["raw_reviews"]
    seen = given.withColumn("Website", of("Website"))
    out = S.imported({**P.create_tables(spark), "raw_reviews": seen}, RunOptions(rebuild=True))
    plain = S.imported({**P.create_tables(spark), "raw_reviews": given}, RunOptions(rebuild=True))
    for name in out:
        assert sorted(map(str, out[name].collect())) == sorted(map(str, plain[name].collect())), name
    assert 0 < calls.value <= given.count()


def test_duplicates_are_found_once(spark, monkeypatch):
    """Keys of titles, and with them groups, are computed once for the four tables that follow (F10)."""
    calls, of = counted(spark)
    real = S.X.title_canonical
    t = S.imported({**P.create_tables(spark), **raw(spark)}, RunOptions(rebuild=True))
    plain = S.without_duplicates(t, RunOptions())
    monkeypatch.setattr(S.X, "title_canonical", lambda c: of(real(c)))
    out = S.without_duplicates(t, RunOptions())
    for name in out:
        assert sorted(map(str, out[name].collect())) == sorted(map(str, plain[name].collect())), name
    assert calls.value == 2 * t["games"].count()  # the whole title, and the one without its year


def test_tables_that_a_step_leaves_alone_are_not_written(spark):
    """Reviews without made-up rows, or of items without platforms, aren't written again (F10)."""
    review = "review_id string, game_id string, source_id string, platform string, data_source string"
    games = spark.createDataFrame([("g", [], "A"), ("h", None, "B")], "game_id string, platforms array<string>, title string")
    reviews = spark.createDataFrame([("1", "g", "s", None, "archive"), ("2", "h", "s", None, None)], review)
    sources = spark.createDataFrame([("s",), ("t",)], "source_id string")
    base = spark.createDataFrame([("b", "archive")], "baseline_id string, data_source string")
    t = {"games": games, "reviews": reviews, "sources": sources, "external_baseline": base}
    assert S.with_platforms(t, RunOptions()) == {}
    out = S.without_mock(t, RunOptions())
    assert set(out) == {"sources"} and [r.source_id for r in out["sources"].collect()] == ["s"]
    made_up = reviews.unionByName(spark.createDataFrame([("3", "g", "t", None, "web-mock")], review))
    out = S.without_mock({**t, "reviews": made_up}, RunOptions())
    assert set(out) == {"reviews", "sources"} and sorted(r.review_id for r in out["reviews"].collect()) == ["1", "2"]
    assert [r.source_id for r in out["sources"].collect()] == ["s"]


def test_outlets_without_odd_characters_skip_patterns(spark):
    """Names that need no pattern get what the patterns would give (F10)."""
    names = ["IGN", " ign", "ign ", "Game  Spot", "game\tspot", "game\nspot", "\vOwn\fName\r", "https://www.ign.com/", "www.ign.com", "/IGN/", "a/b", " ", "", None, "A &amp; B", "Own\u00a0Name", "PLAY! Zine"]
    X = S.X
    table = {n: known for known, all_ in X.OUTLETS.items() for n in all_}

    def plain(name):
        clean = re.sub(r"^ | $", "", re.sub(r"[ \t\n\v\f\r]+", " ", name or ""))
        key = re.sub(r"^/+|/+$", "", re.sub(r"https?://(www\.)?", "", clean.lower().replace("&amp;", "&"))).replace("www.", "")
        return "Unknown Source" if clean == "" else table.get(key, clean)

    got = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").select("k", X.outlet(F.col("n")).alias("o"))
    assert {r.k: r.o for r in got.collect()} == {k: plain(n) for k, n in enumerate(names)}


def test_a_run_goes_on_after_a_failure(spark, tmp_path):
    calls, broken = [], [True]

    def step(name, fail=False):
        def run(t, o):
            calls.append(name)
            if fail and broken:
                raise RuntimeError("lost")
            return {name: t["start"].withColumn("by", F.lit(name))}

        return P.Step(name, run, ("start",), (name,))

    start = {"start": spark.range(3)}
    run = P.Pipeline([step("a"), step("b", fail=True), step("c")], str(tmp_path))
    with pytest.raises(RuntimeError, match="lost"):
        run.run(spark, start, run_id="r1")
    assert run.current(spark) == {}  # half a run is none
    broken.clear()
    out = run.run(spark, start, run_id="r1")
    assert calls == ["a", "b", "b", "c"] and run.done == ["b", "c"] and out["a"].count() == 3
    assert set(run.current(spark)) == {"a", "b", "c"}
    with pytest.raises(ValueError, match="other steps or options"):
        run.run(spark, start, RunOptions(publish=False), run_id="r1")
    with pytest.raises(ValueError, match="lacks"):
        run.run(spark, {})
    with pytest.raises(ValueError, match="declare"):
        P.Pipeline([P.Step("x", lambda t, o: {"y": t["start"]}, ("start",), ("z",))], str(tmp_path / "x")).run(spark, start)


def test_backfill_and_repair_obey_their_options(spark, tmp_path):
    before = P.Pipeline(S.WHOLE, str(tmp_path)).run(spark, raw(spark), RunOptions(rebuild=True))
    ids = {r.title: r.game_id for r in before["games"].collect()}
    at = F.timestamp_seconds(F.lit(9))
    listings = spark.createDataFrame([(1, "e1", "Prey", 2006, 40, 81.0, "prey", "u1"), (2, "e2", "Halo & Co", 2001, 30, 70.0, "halo", "u2"), (3, "e3", "Unknown", 2006, 90, 1.0, "x", "u3")],
        "row_id long, external_id string, title string, release_year int, listed long, listed_score double, slug string, url string").withColumn("collected_at", at)
    reviews = spark.createDataFrame([("e1", "Edge", "q1", 55.0, None), ("e2", "Edge", "q2", 66.0, None), ("e2", "Edge", "q3", None, None)], "external_id string, outlet string, external_review_id string, score double, review_date date")
    products = spark.createDataFrame([("prey", "p1", "Prey", 2007, 60, 82.0, "u")], "slug string, external_id string, product_title string, product_year int, listed long, listed_score double, url string").withColumn("collected_at", at)
    own = spark.createDataFrame([("prey", f"O{k}", f"z{k}", 77.0, None) for k in range(5)], "slug string, outlet string, external_review_id string, score double, review_date date")
    tables = {**before, "listings": listings, "listing_reviews": reviews, "products": products, "product_reviews": own}

    def backfill(**options):
        out = S.backfilled(tables, RunOptions(backfill=BackfillOptions(**{"least_listed": 5, **options})))
        return {r.row_id: r.reason for r in out["backfill_reasons"].collect()}, {r.review_id for r in out["reviews"].where("data_source = 'web'").collect()} if "reviews" in out else None

    assert backfill() == ({1: "selected", 2: "selected", 3: "unmatched"}, None)
    assert backfill(write=True, list_only=True)[1] is None
    said, written = backfill(write=True, years=(2006,))
    assert said == {1: "selected", 3: "unmatched"} and len(written) == 1
    assert backfill(most_items=1)[0] == {2: "selected", 3: "unmatched"}
    assert backfill(most_existing=2)[0] == {1: "existing_above_cap", 2: "selected", 3: "unmatched"}
    assert backfill(target_samples=frozenset({3}))[0] == {1: "selected", 2: "not_target_sample", 3: "unmatched"}
    assert backfill(missing_only=True, write=True)[0] == {1: "selected", 2: "selected", 3: "unmatched"}

    def repair(**options):
        return S.repaired(tables, RunOptions(repair=RepairOptions(**{"sample_counts": frozenset(), **options})))

    assert {r.slug: r.reason for r in repair()["repair_verdicts"].where("accepted").collect()} == {"prey": "title_year"}
    assert repair(year_tolerance=0)["repair_verdicts"].where("accepted").count() == 0 and set(repair(write=True, list_only=True)) == {"repair_verdicts"}
    out = repair(write=True)["reviews"]
    assert {r.data_source: r.n for r in out.where(F.col("game_id") == ids["Prey"]).groupBy("data_source").agg(F.count("*").alias("n")).collect()} == {"web": 5}
    assert repair(write=True, least_listed=61)["reviews"].where("data_source = 'web'").count() == 0
    assert "reviews" not in repair(write=True, metadata=True)


def test_a_run_keeps_its_last_tables_alone(spark, tmp_path):
    """Tables that a later step replaced, and those that only a step needs, go when it is finished, also where the run was broken off (F2)."""
    from tallyforge.operators import runtime

    freed, passed, broken = [], [], [True]

    def first(t, o):
        freed.append(spark.conf.get(runtime._FREE_SHUFFLES, None))
        kept = runtime.materialised(t["start"], "kept")
        passed.extend(kept.inputFiles())
        return {"a": kept.withColumn("n", F.lit(1)), "b": kept}

    def third(t, o):
        if broken:
            raise RuntimeError("lost")
        return {"c": t["a"]}

    steps = [P.Step("x", first, ("start",), ("a", "b")), P.Step("y", lambda t, o: {"a": t["a"].withColumn("n", F.col("n") + 1)}, ("a",), ("a",)), P.Step("z", third, ("a",), ("c",))]
    run, before = P.Pipeline(steps, str(tmp_path)), spark.conf.get(runtime._FREE_SHUFFLES, None)
    with pytest.raises(RuntimeError, match="lost"):
        run.run(spark, {"start": spark.range(3)}, run_id="r")
    broken.clear()
    out = run.run(spark, {"start": spark.range(3)}, run_id="r")
    assert run.done == ["z"] and {n: sorted(map(tuple, out[n].collect())) for n in "abc"} == {"a": [(0, 2), (1, 2), (2, 2)], "b": [(0,), (1,), (2,)], "c": [(0, 2), (1, 2), (2, 2)]}
    assert sorted(f.name for f in tmp_path.glob("runs/r/tables/*/*")) == ["a", "b", "c"]
    assert freed == ["true"] and spark.conf.get(runtime._FREE_SHUFFLES, None) == before
    assert passed and not any(Path(f.removeprefix("file:")).exists() for f in passed)
