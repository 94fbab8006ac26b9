import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators import browse as B
from tallyforge.operators import resolve as R
from tallyforge.operators import tables as K
from tallyforge.params import CustomScoreConfig


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_titles(spark):
    assert values(spark, X.title_canonical, "Final Fantasy VII Remake", "Ratchet & Clank (PS4)", "Mega Man X", None) == ["final fantasy 7 remake", "ratchet and clank", "mega man 10", ""]
    assert values(spark, lambda t: X.year_tag(t)[1], "Prey (2017)", "Prey") == [2017, None]
    assert values(spark, X.listed, '["a"," b"]', "a|b", "") == [["a", "b"], ["a", "b"], []]
    assert len(values(spark, lambda t: X.cut_off(t, 2000), "x" * 2001)[0]) == 2000
    assert len(values(spark, lambda t: X.cut_off(t, 2000, dots=True), "x" * 2001)[0]) == 2002
    assert values(spark, X.numeral_variants, "civ iii 4", "plain") == [["civ 3 4", "civ iii iv"], []]
    assert values(spark, X.slug, "Don't & Go+ No!", "É A") == ["dont-and-go-plus-no", "e-a"]
    assert values(spark, X.outlet, "  IGN.com ", "https://www.gamespot/", "", "Own  Name") == ["IGN", "GameSpot", "Unknown Source", "Own Name"]
    assert values(spark, X.slug_candidates, "Prey (2017)", "Tom: the game+") == [["prey-2017", "prey"], ["tom-the-game-plus", "tom-the-game", "tom"]]


def test_indel_ratio_against_a_table():
    def lcs(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    assert X._ratio("abcd", "abed") == 0.75
    r = np.random.default_rng(0)
    for _ in range(200):
        a, b = ("".join(r.choice(list("abcd"), r.integers(0, 12))) for _ in "ab")
        want = 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert X._ratio(a, b) == want


def test_groups_are_transitive(spark):
    edges = spark.createDataFrame([(1, 2), (3, 4), (2, 3), (8, 9), (9, 8), (20, 21), (21, 22), (22, 23), (23, 24)], "a long, b long")
    assert {r.id: r.root for r in R.groups(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}


def test_groups_of_long_chains_and_hubs(spark, monkeypatch):
    """A chain takes a number of rounds that grows with the logarithm of its length."""
    rounds = []
    whole = R.checkpointed
    monkeypatch.setattr(R, "checkpointed", lambda f: rounds.append(1) or whole(f))
    chain = [(i, i + 1) for i in range(1000, 1300)]
    hub = [(1, 5000 + i) for i in range(400)] + [(7, 7), (None, 3)]
    got = {r.id: r.root for r in R.groups(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert got == {**{i: 1000 for i in range(1000, 1301)}, 1: 1, **{5000 + i: 1 for i in range(400)}, 7: 7} and len(rounds) <= 14
    assert R.groups(spark.createDataFrame([], "a long, b long")).count() == 0


def greedy(pairs):
    free, want = {r for _, r, _ in pairs}, {}
    for left in sorted({p[0] for p in pairs}):
        mine = sorted((-j, r) for x, r, j in pairs if x == left and r in free)
        if mine:
            want[left] = mine[0][1]
            free.remove(mine[0][1])
    return want


def test_one_to_one_of_chains(spark):
    """A chain of wishes is settled in one step; larger components than one step takes, in rounds, come to the same."""
    chain = [(k, k, 0.8) for k in range(60)] + [(k, k - 1, 0.9) for k in range(1, 60)] + [(100, 200, 0.7), (100, 200, 0.9), (101, 200, 1.0)]
    frame = spark.createDataFrame(chain, "l long, r long, jaccard double")
    assert {x.l: x.r for x in R.one_to_one(frame).collect()} == greedy(chain)
    short = [p for p in chain if p[0] < 6 or p[0] >= 100]
    assert {x.l: x.r for x in R.one_to_one(spark.createDataFrame(short, "l long, r long, jaccard double"), 2).collect()} == greedy(short)
    assert R.one_to_one(frame.limit(0)).count() == 0


def test_two_passes_of_a_catalog(spark):
    r = np.random.default_rng(3)
    words = [f"w{k}" for k in range(12)]
    title = lambda: " ".join(r.choice(words, r.integers(2, 6), replace=False))
    games, rows = [(i, title()) for i in range(25)], [(100 + i, i, title()) for i in range(60)]
    g = spark.createDataFrame(games, "game_id long, title string").withColumn("release_year", F.lit(None).cast("int"))
    c = spark.createDataFrame(rows, "row_id long, line_no long, name string")
    none = F.lit(None).cast("string")
    keys = R.catalog_keys(F.col("name"), none, none, none)
    got = R.two_passes(c, keys, g, R.catalog_index(g), F.split("name", " "), F.split("title", " "))
    index, first, taken = {t: i for i, t in games}, {}, set()
    for row, _, name in rows:
        if name in index and index[name] not in taken:
            first[row] = index[name]
            taken.add(index[name])
    pairs = []
    for row, line, name in rows:
        for i, t in games:
            a, b = set(name.split()), set(t.split())
            if row not in first and i not in taken and min(len(a), len(b)) >= 0.7 * max(len(a), len(b)) and len(a & b) / len(a | b) >= 0.7:
                pairs.append((row, i, len(a & b) / len(a | b)))
    second = greedy(pairs)
    assert {x.row_id: (x.game_id, x.method == "words") for x in got.collect()} == {**{k: (v, False) for k, v in first.items()}, **{k: (v, True) for k, v in second.items()}} and second
    every = g.where(F.col("game_id").isin(list(taken)))
    assert {x.row_id for x in R.two_passes(c, keys, every, R.catalog_index(every), F.split("name", " "), F.split("title", " ")).collect()} == set(first)


def test_one_to_one_is_the_greedy_choice(spark):
    r = np.random.default_rng(4)
    pairs = sorted({(int(a), int(b)): float(r.integers(70, 100)) / 100 for a, b in r.integers(0, 25, (160, 2))}.items())
    free, want = {b for (_, b), _ in pairs}, {}
    for left in sorted({a for (a, _), _ in pairs}):
        mine = sorted((-j, b) for (a, b), j in pairs if a == left and b in free)
        if mine:
            want[left] = mine[0][1]
            free.remove(mine[0][1])
    frame = spark.createDataFrame([(a, b, j) for (a, b), j in pairs], "l long, r long, jaccard double")
    assert {x.l: x.r for x in R.one_to_one(frame).collect()} == want


def test_lookup_first_wins(spark):
    rows = spark.createDataFrame([(1, 1, "g"), (2, 2, "g"), (3, 3, "h")], "row_id long, line_no long, k string")
    index = spark.createDataFrame([("t", "g", 7), ("t", "h", 8)], "kind string, key string, game_id long")
    keys = F.array(F.struct(F.lit(1).alias("tier"), F.lit("t").alias("kind"), F.col("k").alias("key"), F.lit("m").alias("method")))
    assert sorted((r.row_id, r.game_id) for r in R.ordered_lookup(rows, keys, index).collect()) == [(1, 7), (3, 8)]


def test_band(spark):
    rows = spark.createDataFrame([(1, 1, 90.0, "a", "x"), (1, 1, 90.5, "b", "y"), (1, 1, 90.51, "b", "z"), (1, 1, 90.52, "b", "w"), (2, 1, 90.0, "b", "v")], "game_id int, source_id int, score double, data_source string, review_id string")
    assert {r.review_id for r in R.band_duplicates(rows, "a", "b").collect()} == {"x", "z", "w", "v"}


def test_ranking_and_custom_scores(spark):
    items = spark.createDataFrame([(1, "a", 60.0, 80), (2, "b", 99.0, 3), (3, "c", None, 90)], "game_id int, title string, weighted_score double, review_count int")
    for descending in (True, False):
        assert items.orderBy(*B.ranking_order("weighted_score", descending)).first().game_id == 1
    reviews = spark.createDataFrame([(1, float(s), "en", "PC|PS", "S", 1.0) for s in (60, 70, 80, 90)] + [(2, float(s), "en", "PC", "S", None) for s in (1, 90, 90, 91, 92)] + [(3, 50.0, "en", "PC", "T", 0.0)], "game_id int, score double, language string, platform string, source_name string, weight double")
    got = {r.game_id: (r.score, r["count"]) for r in B.custom_scores(reviews, CustomScoreConfig(platform="PC", exclude_outliers=True, disabled_sources=frozenset("T"), boost_indie=True)).collect()}
    assert got == {1: (75.0, 4), 2: (90.8, 4)}
    h = {r.bucket: r.n for r in B.histogram(spark.createDataFrame([(100.0,), (90.0,), (89.9,), (101.0,)], "score double")).collect()}
    assert (h[9], h[8], sum(h.values())) == (2, 1, 3)


def test_merges(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 2000), (2, "", None)], "id int, name string, release_year int")
    new = spark.createDataFrame([(1, "b", 1999, 1), (1, "c", 1998, 2), (3, "d", 5, 3)], "id int, name string, release_year int, line_no int")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(K.upsert(old, new, ["id"], "line_no")) == [(1, "c", 1998), (2, "", None), (3, "d", 5)]
    assert rows(K.insert_ignore(old, new, ["id"], "line_no")) == [(1, "a", 2000), (2, "", None), (3, "d", 5)]
    assert rows(K.merge(old, new.where("line_no <> 2").drop("line_no"), ["id"], K.earlier_year())) == [(1, "a", 1999), (2, "", None), (3, "d", 5)]
    assert rows(K.replace_scope(old, old.where("false"), F.col("id") == 1)) == rows(old)
    K.write_scope(old.withColumn("v", F.lit("v1")), str(tmp_path / "t"), "v")
    K.write_scope(old.withColumn("v", F.lit("v2")), str(tmp_path / "t"), "v")
    K.write_scope(old.limit(1).withColumn("v", F.lit("v1")), str(tmp_path / "t"), "v")
    assert {r.v: r["count"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy("v").count().collect()} == {"v1": 1, "v2": 2}


def plain_match(a, b):
    """{a_id: (b_id, confidence, method)}: rows (id, key, year, developer, publisher, platforms), pair by pair."""
    low = lambda t: (t or "").strip().lower()

    def tier(x, y):
        if not x[1] or not y[1]:
            return None
        like, year = X._ratio(x[1], y[1]), x[2] is not None and x[2] == y[2]
        dev, pub = (bool(low(x[k])) and low(x[k]) == low(y[k]) for k in (3, 4))
        both = bool(set(map(low, x[5] or [])) & set(map(low, y[5] or [])) - {""})
        if x[1] == y[1] and (year or dev):
            return (1.0, "exact_title_year") if year else (0.95, "exact_title_dev")
        if like > 0.9 and year:
            return 0.85, "fuzzy_title_year"
        if like > 0.85 and both:
            return 0.75, "fuzzy_title_platform"
        return (0.7, "fuzzy_title_dev") if like > 0.8 and (dev or pub) else None

    want = {}
    for x in a:
        same = [y for y in b if y[1] == x[1] and tier(x, y)]
        found = [(tier(x, y), y[0]) for y in (same or b) if tier(x, y)]
        if found:
            (sure, how), y = min(found, key=lambda f: (-f[0][0], f[1]))
            want[x[0]] = (y, sure, how)
    return want


MATCHED = "id long, key string, release_year int, developer string, publisher string, platforms array<string>"


def matched(spark, a, b):
    got = R.match_providers(spark.createDataFrame(a, MATCHED), spark.createDataFrame(b, MATCHED), X.indel_ratio)
    return {m.a_id: (m.b_id, m.confidence, m.method) for m in got.collect()}


def test_match_providers_against_plain_python(spark):
    r = np.random.default_rng(6)
    one = lambda *of: of[int(r.integers(len(of)))]
    word = lambda: one("alpha", "beta", "gamma", "delta", "omega", "sigma", "éa")
    make = lambda i: (
        i, " ".join(word() for _ in range(r.integers(1, 4))) + one("", "s", " x"), one(None, 2000, 2001, 2002), one("d1", "D1 ", "d2", "", None), one("p1", "d1", "d2", None, ""), one(["p"], ["q", "P"], [], None, [""]),
    )
    a, b = [make(i) for i in range(60)] + [(90, "", 2000, "d1", None, ["p"]), (91, None, 2000, "d1", None, ["p"])], [make(100 + i) for i in range(60)] + [(190, "", 2000, "d1", None, ["p"])]
    want = plain_match(a, b)
    assert matched(spark, a, b) == want and len(set(w[1:] for w in want.values())) >= 5


def test_match_providers_names(spark):
    """A developer is no publisher; a publisher counts in the last tier alone, for equal titles too."""
    a = [(1, "halo", 2001, "bungie", "microsoft", ["pc"]), (2, "doom", None, "id", "zenimax", ["pc"]), (3, "fable", None, "lionhead", "ea", []), (4, "prey", 2006, None, None, ["x"]), (5, "portal", 2007, "valve", None, ["x"])]
    b = [(11, "halo", 2003, "other", "Microsoft", ["pc"]), (12, "doom", None, "bethesda", "zenimax", []), (13, "fable", None, "ea", "lionhead", []), (14, "prey", 2006, None, None, None), (15, "portals", 2007, "valve", None, None)]
    want = {1: (11, 0.75, "fuzzy_title_platform"), 2: (12, 0.7, "fuzzy_title_dev"), 4: (14, 1.0, "exact_title_year"), 5: (15, 0.85, "fuzzy_title_year")}
    assert plain_match(a, b) == want == matched(spark, a, b)


def test_near_titles_lose_no_pair(spark):
    """Texts of few letters, so that many are alike: every pair above the similarity meets."""
    r = np.random.default_rng(8)
    make = lambda n: sorted({"".join(r.choice(list("abc"), r.integers(1, 16))) for _ in range(n)})
    left, right = make(150), make(150)
    right += ["".join(c for c in t if r.random() > 0.1) for t in left if len(t) > 6] + [t[:3] + "q" + t[3:] + "zz" for t in left]
    x = spark.createDataFrame([(t, len(t or "") % 2) for t in [*left, "", None]], "x string, s int")
    y = spark.createDataFrame([(t, len(t) % 2) for t in right], "y string, s int")
    for above in (0.9, 0.85, 0.8):
        want = {(p, q) for p in left for q in right if p != q and len(p) % 2 == len(q) % 2 and X._ratio(p, q) > above}
        got = {(t.x, t.y) for t in R.near_titles(x, y, above, "s").collect()}
        assert want and want <= got and len(got) < 0.4 * len(left) * len(right)


def test_match_awards_against_plain_python(spark):
    r = np.random.default_rng(2)
    words = "the elder scrolls skyrim hades big of it x special pack two".split()
    title = lambda: " ".join(r.choice(words, r.integers(1, 7)))
    awards, games = [(i, title()) for i in range(80)] + [(90, ""), (91, None), (92, "of it")], [(i, title()) for i in range(80)] + [(90, ""), (91, None), (92, "it of")]
    awards += [(93, "hades"), (94, "the elder scrolls skyrim special anniversary pack")]
    games += [(95, "the big hades collection story"), (96, "scrolls elder")]

    def best(n):
        games_ = [(i, g) for i, g in games if g]
        three = lambda t: [w for w in t.split(" ") if len(w) >= 3]
        rules = (
            lambda g: g == n, lambda g: g.startswith(n) and len(g) <= 2 * len(n), lambda g: n.startswith(g) and len(n) <= 2 * len(g),
            lambda g: bool(three(n)) and bool(three(g)) and sum(w in three(n) for w in three(g)) / len(three(g)) >= 0.8,
        )
        return next(((i, k + 1) for k, rule in enumerate(rules) for i, g in sorted(games_) if rule(g)), None) if n else None

    want = {i: best(n) for i, n in awards if best(n)}
    got = B.match_awards(spark.createDataFrame(awards, "award_id int, key string"), spark.createDataFrame(games, "game_id int, key string"))
    assert {m.award_id: (m.game_id, m.tier) for m in got.collect()} == want
    assert {t for _, t in want.values()} == {1, 2, 3, 4} and want[94][1] == 4


def test_titles_of_enrichment(spark):
    odd = ("Ōkami & Ⅱ 大神", "a_b  C d", None)
    assert values(spark, X.title_enrich, *odd) == ["okami and", "ab c d", ""]
    assert values(spark, lambda t: X.title_enrich(t, False), *odd) == ["okami", "ab c d", ""]


def test_q_match_reads_every_item(spark):
    from tallyforge.plans import load

    ids = {r.a_id for r in load().QUERIES["q_match"](spark, "/root/testdata/sf0.01").select("a_id").collect()}
    assert max(ids) > 400


@pytest.mark.parametrize("what", ["words", "keys", "titles", "left", "duplicates"])
def test_nothing_that_grows_is_broadcast(spark, capsys, what):
    """Small estimates don't send a side of a join through the driver."""
    few = spark.range(20).select("id", F.array(F.col("id").cast("string")).alias("tokens"), F.col("id").cast("string").alias("t"))
    rows = few.select(F.col("id").alias("row_id"), F.col("id").alias("line_no"), "t")
    games = few.select(F.col("id").alias("game_id"), F.col("t").alias("key"), F.lit(2000).alias("release_year"))
    plan = {
        "words": lambda: R.token_jaccard(few, few),
        "keys": lambda: R.ordered_lookup(rows, F.array(R._key(1, "title", F.col("t"), "title")), R.last_index(games, "title", F.col("key"))),
        "titles": lambda: R.near_titles(few.select(F.col("t").alias("x"), F.lit(1).alias("s")), few.select(F.col("t").alias("y"), F.lit(1).alias("s")), 0.8, "s"),
        "left": lambda: K.orphans(games, "game_id", games),
        "duplicates": lambda: R.duplicate_edges(games),
    }[what]()
    plan.explain()
    assert "Broadcast" not in capsys.readouterr().out


HALF = [(29, 3.0), (29, 3.0), (26, 1.0), (23, 3.0), (25, 1.0), (34, 1.0), (23, 1.0), (29, 3.0)]


def test_custom_scores_whatever_the_order_of_rows(spark):
    """A mean at a half, whose last bits follow the order of its sum."""
    held = [(q / 50 * 100, w) for q, w in HALF]
    rows = [[(1, s, w, "N", "O", "x") for s, w in order] for order in (held, held[::-1], sorted(held), sorted(held)[::-1])]
    frames = [spark.createDataFrame(x, "game_id int, score double, weight double, language string, platform string, source_name string").coalesce(1) for x in rows]
    total = weight = 0.0
    for s, w in sorted(held):
        total, weight = total + s * w, weight + w
    want = np.floor(total / weight * 10 + 0.5) / 10
    for fence in (False, True):
        assert [B.custom_scores(f, CustomScoreConfig(exclude_outliers=fence)).first().score for f in frames] == [want] * 4
