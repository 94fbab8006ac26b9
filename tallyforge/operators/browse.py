"""Interactive queries: facets, search, sorting and paging, rankings, histogram, custom scores, awards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.scores import half_up_1
from tallyforge.params import CustomScoreConfig

#: Reviews from which an item is ranked.
LEAST_REVIEWS = 75


def eligible(least: int = LEAST_REVIEWS) -> Column:
    return F.col("weighted_score").isNotNull() & (F.coalesce("review_count", F.lit(0)) >= least)


def ranking_order(field: str, descending: bool = True, least: int = LEAST_REVIEWS) -> list[Column]:
    """Ranked items first whichever way; the others by reviews before score; a missing score is -1."""
    turn = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    return [
        eligible(least).desc(), turn(F.when(eligible(least), 0).otherwise(F.coalesce("review_count", F.lit(0)))),
        turn(F.coalesce(field, F.lit(-1.0))), F.asc("title"), F.asc("game_id"),
    ]


def rank_all(items: DataFrame, most: int = 30, least: int = LEAST_REVIEWS) -> DataFrame:
    """The first items of all time by weighted score, numbered from 1; ties get numbers of their own."""
    first = items.where(eligible(least) & F.col("release_year").isNotNull()).orderBy(F.desc("weighted_score"), "game_id").limit(most)
    return first.withColumn("position", F.row_number().over(W.orderBy(F.desc("weighted_score"), "game_id")))  # at most ``most`` rows


def rank_years(items: DataFrame, most: int = 10, least: int = LEAST_REVIEWS) -> DataFrame:
    """The first items of each release year."""
    place = F.row_number().over(W.partitionBy("release_year").orderBy(F.desc("weighted_score"), "game_id"))
    return items.where(eligible(least) & F.col("release_year").isNotNull()).withColumn("position", place).where(F.col("position") <= most)


def browse(items: DataFrame, search: str | None = None, year: int | None = None, genre: str | None = None, platform: str | None = None) -> DataFrame:
    """Items whose title contains ``search`` in any case, of a year, and with a genre and a platform in their lists."""
    out = items
    if search:
        out = out.where(F.lower("title").contains(search.lower()))
    if year is not None:
        out = out.where(F.col("release_year") == year)
    if genre:
        out = out.where(F.array_contains("genres", genre))
    if platform:
        out = out.where(F.array_contains("platforms", platform))
    return out


def page(items: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    return items.orderBy(*order).offset(number * size).limit(size)


def page_count(items: DataFrame, size: int = 50) -> DataFrame:
    """(rows, pages): how many rows there are, and pages of them."""
    return items.agg(F.count("*").alias("rows")).select("rows", F.ceil(F.col("rows") / size).alias("pages"))


def by_locale(column: str, descending: bool = False) -> list[Column]:
    """Text in the order of Unicode's collation, whatever the case and accents; missing text is empty."""
    key = F.collate(F.coalesce(column, F.lit("")), "UNICODE")
    return [key.desc() if descending else key.asc(), F.asc("game_id")]


def by_column(column: str, descending: bool = False) -> list[Column]:
    """Any number column; a missing one is -1."""
    key = F.coalesce(F.col(column).cast("double"), F.lit(-1.0))
    return [key.desc() if descending else key.asc(), F.asc("game_id")]


def in_award_years(items: DataFrame, awards: DataFrame) -> DataFrame:
    """Scored items from the first to the last year that has awards, or without a year."""
    span = awards.agg(F.min("year").alias("__lo"), F.max("year").alias("__hi"))  # one row
    near = F.col("release_year").isNull() | F.col("release_year").between(F.col("__lo"), F.col("__hi"))
    return items.where("weighted_score is not null").join(F.broadcast(span)).where(near).drop("__lo", "__hi")


def with_awards(top: DataFrame, matched: DataFrame, awards: DataFrame) -> DataFrame:
    """Adds the shows that chose an item, in order; none is an empty list."""
    won = matched.join(awards.select("award_id", "show"), "award_id").groupBy("game_id").agg(F.array_sort(F.collect_set("show")).alias("shows"))
    return top.join(won, "game_id", "left").withColumn("shows", F.coalesce("shows", F.array().cast("array<string>")))


def award_rows(years: DataFrame) -> DataFrame:
    """(year, show, role, title) of nested years (year, awards array<struct<show,winner,nominees>>): winners and nominees.

    Null and empty titles and lists give no rows.
    """
    a = years.select("year", F.explode("awards").alias("a")).select("year", "a.show", "a.winner", "a.nominees")
    role = lambda name, title: a.select("year", "show", F.lit(name).alias("role"), title.alias("title"))
    return role("winner", F.col("winner")).unionByName(role("nominee", F.explode("nominees"))).where("title is not null and title <> ''")


def award_titles(*columns: DataFrame) -> DataFrame:
    """(title) of all awards, winners and nominees, each once, in order."""
    out = columns[0].toDF("title")
    for c in columns[1:]:
        out = out.unionByName(c.toDF("title"))
    return out.where("title is not null").distinct().orderBy("title")


def shown_baselines(baselines: DataFrame, hidden: tuple[str, ...]) -> DataFrame:
    """Baselines but those of hidden platforms; a missing platform is shown."""
    return baselines.where(~F.coalesce(F.col("source_platform").isin(list(hidden)), F.lit(False)))


def titled_like(items: DataFrame, pattern: str) -> DataFrame:
    """Items whose title is like a pattern, in any case."""
    return items.where(F.col("title").ilike(pattern))


def facets(items: DataFrame) -> DataFrame:
    """(facet, value, n) of years, genres and platforms."""
    of = lambda name, value: items.select(F.lit(name).alias("facet"), value.alias("value"))
    rows = of("year", F.col("release_year").cast("string")).unionByName(of("genre", F.explode("genres"))).unionByName(of("platform", F.explode("platforms")))
    return rows.where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def histogram(reviews: DataFrame) -> DataFrame:
    """Ten buckets of scores from 0 to 100, the last one closed, with counts and shares in percent."""
    spark = reviews.sparkSession
    counts = reviews.where("score between 0 and 100").groupBy(F.least(F.floor(F.col("score") / 10), F.lit(9)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    buckets = spark.range(10).select(F.col("id").cast("int").alias("bucket"))
    total = counts.agg(F.sum("n").alias("total"))
    return buckets.join(counts, "bucket", "left").join(F.broadcast(total)).select(
        "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(half_up_1(F.try_divide(100.0 * F.col("n"), F.col("total"))), F.lit(0.0)).alias("percent")
    )


def score_summary(reviews: DataFrame) -> DataFrame:
    """(n, best, mean): scores from 0 to 100, the largest bucket of ten's count, and their mean to one decimal."""
    counted = histogram(reviews).agg(F.max("n").alias("best"))
    return reviews.where("score between 0 and 100").agg(F.count("*").alias("n"), half_up_1(F.avg("score")).alias("mean")).join(counted)  # rows of one


def custom_scores(reviews: DataFrame, config: CustomScoreConfig = CustomScoreConfig()) -> DataFrame:
    """(game_id, score, count) under a reader's own rules; platforms may be lists parted by ``|``.

    The fence takes the values at a quarter and three quarters of the sorted list, without interpolation, and only
    from four reviews on. Sums run in the order of scores and weights, as the last bits decide at halves: so the score of
    an item doesn't depend on the order of its rows, nor on how Spark parts them.
    """
    rows = reviews.where("score is not null")
    if config.language:
        rows = rows.where(F.col("language") == config.language)
    if config.platform:
        rows = rows.where(F.array_contains(F.split("platform", r"\|"), config.platform))
    if config.disabled_sources:
        rows = rows.where(~F.coalesce("source_name", F.lit("")).isin(sorted(config.disabled_sources)))
    if config.exclude_outliers:
        of_game = W.partitionBy("game_id")
        nth = F.row_number().over(of_game.orderBy("score", "weight")) - 1
        rows = rows.withColumns({"__nth": nth, "__of": F.count("*").over(of_game)})
        at = lambda share: F.max(F.when(F.col("__nth") == F.floor(F.col("__of") * share), F.col("score"))).over(of_game)
        rows = rows.withColumns({"__q1": at(0.25), "__q3": at(0.75)})
        gap = 1.5 * (F.col("__q3") - F.col("__q1"))
        rows = rows.where((F.col("__of") < 4) | F.col("score").between(F.col("__q1") - gap, F.col("__q3") + gap))
    scale = (0.8 if config.reduce_big_media else 1.0) * (1.1 if config.boost_indie else 1.0)
    weight = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight")) * scale
    upto = W.partitionBy("game_id").orderBy("score", "weight").rowsBetween(W.unboundedPreceding, 0)
    sums = rows.select("game_id", F.count(F.lit(1)).over(upto).alias("count"), F.sum(F.col("score") * weight).over(upto).alias("s"), F.sum(weight).over(upto).alias("w"))
    last = sums.groupBy("game_id").agg(F.max(F.struct("count", "s", "w")).alias("last"))
    mean = F.try_divide(F.col("last.s"), F.col("last.w"))
    return last.select("game_id", F.coalesce(half_up_1(mean), F.lit(0.0)).alias("score"), F.col("last.count").alias("count"))


def match_awards(awards: DataFrame, games: DataFrame) -> DataFrame:
    """(award_id, game_id, tier): the first item, by tier and then id, whose title fits an award's.

    Tier 1: equal; 2 and 3: the item's title begins with the award's, or the other way, and is at most twice as long; 4:
    four fifths of the item's words of three letters or more are words of the award's title. Titles are matched once,
    however many awards or items have them. A title meets its beginnings of half its length or more in an equi join, and
    titles that share words meet by the item's rarest: of n words a fifth may be missing, so the award has one of the
    n/5 + 1 that the fewest awards have. Null and empty titles match nothing, and by words neither do titles without a
    word of three letters. Items of one title are their smallest id; repeated award ids keep their rows.
    """
    a = awards.where("key <> ''").select(F.col("key").alias("ak")).distinct()
    g = games.where("key <> ''").groupBy(F.col("key").alias("gk")).agg(F.min("game_id").alias("game_id"))
    begins = lambda c: F.explode(F.transform(F.sequence(F.ceil(F.length(c) / 2).cast("int"), F.length(c)), lambda n: F.substr(c, F.lit(1), n)))
    longer = g.select("gk", "game_id", begins(F.col("gk")).alias("ak")).join(a, "ak").select("ak", "game_id", F.when(F.col("ak") == F.col("gk"), 1).otherwise(2).alias("tier"))
    shorter = a.select("ak", begins(F.col("ak")).alias("gk")).where("ak <> gk").join(g, "gk").select("ak", "game_id", F.lit(3).alias("tier"))
    words = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) >= 3)
    by_word = a.select("ak", F.explode(F.array_distinct(words(F.col("ak")))).alias("word"))
    common = by_word.groupBy("word").agg(F.count("*").alias("n"))
    asked = g.select("gk", F.explode(F.array_distinct(words(F.col("gk")))).alias("word")).join(common, "word", "left")
    place = F.row_number().over(W.partitionBy("gk").orderBy(F.coalesce("n", F.lit(0)), "word"))
    rare = asked.withColumn("place", place).where((F.col("place") <= F.floor(F.size(words(F.col("gk"))) / 5) + 1) & F.col("n").isNotNull()).select("gk", "word")
    pairs = rare.join(by_word, "word").select("ak", "gk").distinct()
    shared = F.size(F.filter(words(F.col("gk")), lambda w: F.array_contains(words(F.col("ak")), w)))
    alike = pairs.where(F.try_divide(shared, F.size(words(F.col("gk")))) >= 0.8).join(g, "gk").select("ak", "game_id", F.lit(4).alias("tier"))
    best = longer.unionByName(shorter).unionByName(alike).groupBy("ak").agg(F.min(F.struct("tier", "game_id")).alias("best"))
    return awards.select("award_id", F.col("key").alias("ak")).join(best, "ak").select("award_id", "best.game_id", "best.tier")


def consensus(won: DataFrame, least: int = 2) -> DataFrame:
    """(year, game_id, shows) of items that several shows chose in a year; rows of (year, show, game_id)."""
    return won.groupBy("year", "game_id").agg(F.sort_array(F.collect_set("show")).alias("shows")).where(F.size("shows") >= least)
