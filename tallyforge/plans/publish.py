"""Published views over the testbed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import publish as P
from tallyforge.operators import scoring
from tallyforge.plans.registry import query
from tallyforge.plans.scoring import BASE, metrics_of, snapshots_of, weights_of
from tallyforge.sources import testbed as T
from tallyforge.sources.testbed import GAMES, REVIEWS, SOURCES, with_

SBASE = (*BASE, SOURCES)
_LIST = """listed as (select game_id, title, release_year, developer, genres, platforms, raw_average as mean, trimmed_mean as robust, calibrated_score as calibrated,
 weighted_score as weighted, coalesce(sample_count, 0) as review_count, (len(genres) > 0 or len(platforms) > 0 or coalesce(developer, '') <> '') as has_enhanced_data
 from games left join snapshots using (game_id))"""
_SHOWN = """shown as (select * from (select *, row_number() over (partition by source_id order by case when genre is null and platform is null then 0 when platform is null then 1 else 2 end,
 context_weight desc, genre nulls first, platform nulls first) as position from weights) where position <= 10)"""
_RECENT = """recent as (select source_id, position, review_id, title, score from (select *, row_number() over (partition by source_id order by review_date desc nulls last, review_id) as position from reviews)
 join games using (game_id) where position <= 20)"""
_SLIST = """slisted as (select s.source_id, s.name, s.country_region, case when coalesce(m.sample_count, 0) > 0 then m.sample_count else coalesce(c.n, 0) end as review_count, m.mean_score, w.base_weight
 from sources s left join metrics m using (source_id) left join (select source_id, round(avg(context_weight), 4) as base_weight from weights group by 1) w using (source_id)
 left join (select source_id, count(*) as n from reviews group by 1) c using (source_id))"""


def _items(spark, sf_dir):
    return P.item_list(T.games(spark, sf_dir), snapshots_of(spark, sf_dir))


@query("q_item_list", with_(*BASE, _LIST, body="select * from listed"))
def q_item_list(spark, sf_dir):
    return _items(spark, sf_dir)


@query("q_item_detail", with_(*SBASE, _LIST, body="""select game_id, title, r.review_id, r.name as source, r.score, coalesce(w.context_weight, 1.0) as weight, r.language,
 row_number() over (partition by game_id order by r.review_date desc, r.review_id desc) as position from listed join (select * from reviews left join sources using (source_id)) r using (game_id)
 left join (select * from weights where genre is null and platform is null) w using (source_id)"""))
def q_item_detail(spark, sf_dir):
    """The nested documents, unnested again: a row for each review with its place in the list."""
    nested = P.item_detail(_items(spark, sf_dir), T.reviews(spark, sf_dir), T.sources(spark, sf_dir), weights_of(spark, sf_dir))
    flat = nested.select("game_id", "title", F.posexplode("reviews").alias("at", "r"))
    return flat.select("game_id", "title", "r.review_id", "r.source", "r.score", "r.weight", "r.language", (F.col("at") + 1).alias("position"))


@query("q_item_documents", with_(*BASE, _LIST, body="select game_id, title, weighted, review_count from listed"))
def q_item_documents(spark, sf_dir):
    """One JSON document for each item, parsed again."""
    docs = P.as_documents(_items(spark, sf_dir), "game_id")
    return docs.select(F.from_json("json", "game_id bigint, title string, weighted double, review_count bigint").alias("d")).select("d.*")


@query("q_src_list", with_(*SBASE, _SLIST, body="select * from slisted"))
def q_src_list(spark, sf_dir):
    return P.source_list(T.sources(spark, sf_dir), metrics_of(spark, sf_dir), weights_of(spark, sf_dir), T.reviews(spark, sf_dir))


@query("q_src_recent", with_(GAMES, REVIEWS, _RECENT, body="select * from recent"))
def q_src_recent(spark, sf_dir):
    return P.recent_reviews(T.reviews(spark, sf_dir), T.games(spark, sf_dir))


@query("q_src_weights", with_(*BASE, _SHOWN, body="select source_id, genre, platform, context_weight, position from shown"))
def q_src_weights(spark, sf_dir):
    return P.shown_weights(weights_of(spark, sf_dir)).select("source_id", "genre", "platform", "context_weight", "position")


@query("q_src_detail", with_(*SBASE, _SLIST, _SHOWN, _RECENT, body="""select source_id, name, review_count, n_recent, best, n_weights, n_genres from slisted left join
 (select source_id, count(*) as n_recent, max(score) as best from recent group by 1) using (source_id) left join (select source_id, count(*) as n_weights from shown group by 1) using (source_id)
 left join (select source_id, count(*) as n_genres from gcov group by 1) using (source_id)"""))
def q_src_detail(spark, sf_dir):
    reviews, games, weights = T.reviews(spark, sf_dir), T.games(spark, sf_dir), weights_of(spark, sf_dir)
    unscored = reviews.withColumn("score", F.when(F.col("source_id") % 4 != 0, F.col("score")))  # they count as others do
    nested = P.source_detail(
        P.source_list(T.sources(spark, sf_dir), metrics_of(spark, sf_dir), weights, reviews), P.recent_reviews(reviews, games), P.shown_weights(weights), scoring.coverage(scoring.review_counts(unscored), games, "genres")
    )
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c).cast("long"))
    return nested.select("source_id", "name", "review_count", size("recent").alias("n_recent"), F.array_max("recent.score").alias("best"), size("weights").alias("n_weights"), size("coverage").alias("n_genres"))


@query("q_meta", with_(GAMES, REVIEWS, SOURCES, body="select (select count(*) from games) as games, count(*) as reviews, count(distinct game_id) as reviewed_games, count(distinct language) as languages, (select count(*) from sources) as sources from reviews"))
def q_meta(spark, sf_dir):
    return P.meta(T.games(spark, sf_dir), T.reviews(spark, sf_dir), T.sources(spark, sf_dir))


@query("q_latest", with_(*BASE, body="select count(*) as games, sum(sample_count)::bigint as reviews, round(avg(weighted_score), 3) as mean from snapshots"))
def q_latest(spark, sf_dir):
    return snapshots_of(spark, sf_dir).agg(F.count("*").alias("games"), F.sum("sample_count").alias("reviews"), F.round(F.avg("weighted_score"), 3).alias("mean"))


@query("q_fill_rate", "select round(100.0 * count(case when o_orderstatus <> 'F' then 1 end) / count(*), 2) as score_rate, round(100.0 * count(case when o_orderkey % 5 <> 0 then 1 end) / count(*), 2) as count_rate from orders")
def q_fill_rate(spark, sf_dir):
    rate = lambda c: F.round(100.0 * F.count(c) / F.count("*"), 2)
    return T.baselines(spark, sf_dir).agg(rate("external_score").alias("score_rate"), rate("review_count").alias("count_rate"))


@query("q_provider_counts", with_(REVIEWS, body="select game_id, count(*) filter (where data_source = 'alpha') as alpha, count(*) filter (where data_source = 'beta') as beta, max(case when score >= 90 then 1 else 0 end) = 1 as has_top from reviews group by 1"))
def q_provider_counts(spark, sf_dir):
    of = lambda p: F.count_if(F.col("data_source") == p)
    return T.reviews(spark, sf_dir).groupBy("game_id").agg(of("alpha").alias("alpha"), of("beta").alias("beta"), F.bool_or(F.col("score") >= 90).alias("has_top"))
