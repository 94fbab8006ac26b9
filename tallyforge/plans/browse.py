"""Ranking and browsing queries over the testbed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.functions.scores import band
from tallyforge.operators import browse as B
from tallyforge.params import CustomScoreConfig
from tallyforge.plans.registry import query
from tallyforge.plans.scoring import BASE, snapshots_of
from tallyforge.sources import testbed as T
from tallyforge.sources.testbed import GAMES, REVIEWS, with_

#: The testbed's items have at most 49 reviews.
LEAST = 30
ITEMS = """items as (select g.*, s.weighted_score, s.raw_average, coalesce(s.sample_count, 0) as review_count from games g left join snapshots s using (game_id))"""
IBASE = (*BASE, ITEMS)


def items_of(spark, sf_dir):
    """Items with their scores; those without a snapshot keep nulls."""
    s = snapshots_of(spark, sf_dir).select("game_id", "weighted_score", "raw_average", F.col("sample_count").alias("review_count"))
    return T.games(spark, sf_dir).join(s, "game_id", "left").withColumn("review_count", F.coalesce("review_count", F.lit(0)))


_TOP = "select {cols} from items where weighted_score is not null and review_count >= 30 and release_year is not null"


@query("q_rank_all", with_(*IBASE, body="select * from (" + _TOP.format(cols="game_id, title, release_year, weighted_score, row_number() over (order by weighted_score desc, game_id) as position") + ") where position <= 30"))
def q_rank_all(spark, sf_dir):
    return B.rank_all(items_of(spark, sf_dir), 30, LEAST).select("game_id", "title", "release_year", "weighted_score", "position")


@query("q_rank_year", with_(*IBASE, body="select * from (" + _TOP.format(cols="game_id, release_year, weighted_score, row_number() over (partition by release_year order by weighted_score desc, game_id) as position") + ") where position <= 10"))
def q_rank_year(spark, sf_dir):
    return B.rank_years(items_of(spark, sf_dir), 10, LEAST).select("game_id", "release_year", "weighted_score", "position")


@query("q_top10", with_(*IBASE, body="select game_id, title, weighted_score, case when weighted_score >= 90 then 'outstanding' when weighted_score >= 75 then 'great' when weighted_score >= 60 then 'good' when weighted_score >= 40 then 'mixed' else 'weak' end as band from items where weighted_score is not null and review_count >= 30 order by weighted_score desc, game_id limit 10"))
def q_top10(spark, sf_dir):
    top = items_of(spark, sf_dir).where(B.eligible(LEAST)).orderBy(F.desc("weighted_score"), "game_id").limit(10)
    return top.select("game_id", "title", "weighted_score", band(F.col("weighted_score")).alias("band"))


@query("q_browse", with_(*IBASE, body="""select game_id, title, release_year, review_count from items where contains(lower(title), 'e') and release_year = 2016
 order by (weighted_score is not null and review_count >= 30) desc, case when weighted_score is not null and review_count >= 30 then 0 else review_count end desc,
 coalesce(weighted_score, -1) desc, title, game_id limit 50 offset 50"""))
def q_browse(spark, sf_dir):
    found = B.browse(items_of(spark, sf_dir), search="E", year=2016)
    return B.page(found, B.ranking_order("weighted_score", True, LEAST), 1).select("game_id", "title", "release_year", "review_count")


@query("q_browse_facets", with_(GAMES, body="select game_id, title from games where list_contains(genres, 'small') and list_contains(platforms, 'Brand#5')"))
def q_browse_facets(spark, sf_dir):
    return B.browse(T.games(spark, sf_dir), genre="small", platform="Brand#5").select("game_id", "title")


@query("q_facets", with_(GAMES, body="select facet, value, count(*) as n from (select 'year' as facet, cast(release_year as varchar) as value from games union all select 'genre', unnest(genres) from games union all select 'platform', unnest(platforms) from games) where value is not null group by 1, 2"))
def q_facets(spark, sf_dir):
    return B.facets(T.games(spark, sf_dir))


@query("q_hist", with_(REVIEWS, body="""select b.bucket, coalesce(n, 0) as n, coalesce(floor(100.0 * n / sum(n) over () * 10 + 0.5) / 10, 0.0) as percent
 from (select cast(range as int) as bucket from range(10)) b left join (select cast(least(floor(score / 10), 9) as int) as bucket, count(*) as n from reviews where score between 0 and 100 group by 1) using (bucket)"""))
def q_hist(spark, sf_dir):
    return B.histogram(T.reviews(spark, sf_dir))


_CUSTOM = """named as (select r.*, s.name as source_name, 1.0 + r.source_id % 3 as weight from reviews r join sources s using (source_id)),
kept as (select * from named where language = 'N' and list_contains(string_split(platform, '|'), 'O') and source_name not in ('Supplier#000000001', 'Supplier#000000003', 'Supplier#000000007')),
placed as (select *, row_number() over (partition by game_id order by score) - 1 as nth, count(*) over (partition by game_id) as of_ from kept),
fenced as (select *, max(case when nth = floor(of_ * 0.25) then score end) over (partition by game_id) as q1, max(case when nth = floor(of_ * 0.75) then score end) over (partition by game_id) as q3 from placed)"""


@query("q_custom", with_(T.SOURCES, REVIEWS, _CUSTOM, body="select game_id, floor(sum(score * weight) / sum(weight) * 10 + 0.5) / 10 as score, count(*) as count from fenced where of_ < 4 or score between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by 1"))
def q_custom(spark, sf_dir):
    names = T.sources(spark, sf_dir).select("source_id", F.col("name").alias("source_name"))
    rows = T.reviews(spark, sf_dir).join(names, "source_id").withColumn("weight", 1.0 + F.col("source_id") % 3)
    off = frozenset(f"Supplier#{k:09d}" for k in (1, 3, 7))
    return B.custom_scores(rows, CustomScoreConfig(language="N", platform="O", exclude_outliers=True, disabled_sources=off))


# titles of awards: equal ones, beginnings, longer ones, words in another order with more around them, one word missing
_AWARDS = """awards as (
  select p_partkey as award_id, 2014 + cast(p_partkey % 12 as int) as year, ['first', 'second', 'third'][1 + p_partkey % 3] as outlet,
    trim(regexp_replace(regexp_replace(lower(strip_accents(case p_partkey % 6
      when 0 then p_name when 1 then split_part(p_name, ' ', 1) when 2 then p_name || ': X'
      when 3 then 'The ' || split_part(p_name, ' ', 2) || ' & ' || split_part(p_name, ' ', 1) || ' Édition ' || p_partkey % 7
      when 4 then 'of it' else p_name || ' special anniversary pack ' || p_partkey % 5 end)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as key
  from part
),
titled as (
  select game_id, lower(case game_id % 7 when 0 then title || ' edition' when 1 then title || ' big collection story' when 2 then 'to ' || title
    when 3 then title || ' ' || title || ' special edition of' when 4 then 'it of' else title end) as gk from games
),
keyed as (select gk, min(game_id) as game_id from titled group by 1),
pairs as (
  select ak, game_id, gk, list_filter(string_split(ak, ' '), lambda w: length(w) >= 3) as aw, list_filter(string_split(gk, ' '), lambda w: length(w) >= 3) as gw
  from (select distinct key as ak from awards), keyed where gk <> '' and ak <> ''
),
tiers as (
  select *, case when ak = gk then 1 when starts_with(gk, ak) and length(gk) <= 2 * length(ak) then 2 when starts_with(ak, gk) and length(ak) <= 2 * length(gk) then 3
    when len(aw) > 0 and len(gw) > 0 and len(list_filter(gw, lambda w: list_contains(aw, w))) / len(gw) >= 0.8 then 4 end as tier from pairs
),
matched as (
  select award_id, best.game_id, best.tier
  from awards join (select ak, arg_min(game_id, tier * 1000000000::bigint + game_id) as game_id, min(tier) as tier from tiers where tier is not null group by 1) best on ak = key
)"""


def _awards(spark, sf_dir):
    part, name = F.col("p_partkey"), F.col("p_name")
    word, text, n = lambda k: F.split_part(name, F.lit(" "), F.lit(k)), lambda by: (part % by).cast("string"), part % 6
    title = (
        F.when(n == 0, name).when(n == 1, word(1)).when(n == 2, F.concat(name, F.lit(": X")))
        .when(n == 3, F.concat(F.lit("The "), word(2), F.lit(" & "), word(1), F.lit(" Édition "), text(7)))
        .when(n == 4, "of it").otherwise(F.concat(name, F.lit(" special anniversary pack "), text(5)))
    )
    show = F.get(F.array(*map(F.lit, ("first", "second", "third"))), (part % 3).cast("int"))
    return T.table(spark, sf_dir, "part").select(part.alias("award_id"), (2014 + part % 12).cast("int").alias("year"), show.alias("show"), X.title_award(title).alias("key"))


def _matched(spark, sf_dir):
    n, t = F.col("game_id") % 7, F.col("title")
    title = (
        F.when(n == 0, F.concat(t, F.lit(" edition"))).when(n == 1, F.concat(t, F.lit(" big collection story"))).when(n == 2, F.concat(F.lit("to "), t))
        .when(n == 3, F.concat(t, F.lit(" "), t, F.lit(" special edition of"))).when(n == 4, "it of").otherwise(t)
    )
    return B.match_awards(_awards(spark, sf_dir), T.games(spark, sf_dir).select("game_id", F.lower(title).alias("key")))


@query("q_awards", with_(GAMES, _AWARDS, body="select * from matched"))
def q_awards(spark, sf_dir):
    return _matched(spark, sf_dir)


@query("q_consensus", with_(GAMES, _AWARDS, body="select 2014 + cast(game_id % 3 as int) as year, game_id, list_sort(list_distinct(list(outlet))) as shows from matched join awards using (award_id) group by 1, 2 having count(distinct outlet) >= 2"))
def q_consensus(spark, sf_dir):
    won = _matched(spark, sf_dir).join(_awards(spark, sf_dir).select("award_id", "show"), "award_id")
    return B.consensus(won.select((2014 + F.col("game_id") % 3).cast("int").alias("year"), "show", "game_id"))


@query("q_award_years", with_(*IBASE, _AWARDS, body="select distinct year from awards where year in (select release_year from items where weighted_score is not null and review_count >= 30)"))
def q_award_years(spark, sf_dir):
    ranked = items_of(spark, sf_dir).where(B.eligible(LEAST)).select(F.col("release_year").alias("year"))
    return _awards(spark, sf_dir).select("year").distinct().join(ranked, "year", "left_semi")
