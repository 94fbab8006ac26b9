"""Scoring queries over the testbed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions.scores import normalized
from tallyforge.operators import scoring
from tallyforge.operators.incremental import ScoreState
from tallyforge.operators.runtime import materialised, scratch
from tallyforge.plans.registry import query
from tallyforge.sources import testbed as T
from tallyforge.sources.testbed import GAMES, REVIEWS, with_

OVERALL = "overall as (select avg(score) as gm, stddev_pop(score) as gs from reviews)"
METRICS = """metrics as (select source_id, n as sample_count, round(mean, 4) as mean_score, round(std, 4) as score_std, round(mean - gm, 4) as score_bias,
 round(case when gs > 0 then least(1.0, std / gs) else 0.0 end, 4) as discrimination_power
 from (select source_id, count(*) as n, avg(score) as mean, stddev_pop(score) as std from reviews group by 1 having count(*) >= 3), overall)"""
COVER = """gcov as (select source_id, value, count(*) as n from (select r.source_id, unnest(g.genres) as value from reviews r join games g using (game_id)) where value <> '' group by 1, 2),
pcov as (select source_id, value, count(*) as n from (select r.source_id, unnest(g.platforms) as value from reviews r join games g using (game_id)) where value <> '' group by 1, 2)"""
WEIGHTS = """contexts as (select source_id, null::varchar as genre, null::varchar as platform, null::bigint as gn, null::bigint as pn from metrics
 union all select source_id, value, null, n, null from (select *, row_number() over (partition by source_id order by n desc, value) as k from gcov) where k <= 40
 union all select source_id, null, value, null, n from (select *, row_number() over (partition by source_id order by n desc, value) as k from pcov) where k <= 25),
weighing as (
  select source_id, genre, platform, conf, disc, sample_count, conf * disc * case when gn is null then 1.0 else greatest(0.8, least(1.2, 0.8 + 0.4 * gn / sample_count)) end
    * case when pn is null then 1.0 else greatest(0.8, least(1.1, 0.8 + 0.3 * pn / sample_count)) end * 0.95 as raw
  from (select c.*, m.sample_count, greatest(0.6, least(1.1, 0.6 + 0.5 * least(1.0, ln(1.0 + m.sample_count) / ln(5001.0)))) as conf,
    greatest(0.7, least(1.1, 0.7 + 0.3 * discrimination_power)) as disc from contexts c join metrics m using (source_id))
),
weights as (
  select source_id, genre, platform, round(raw, 6) as context_weight, round(conf, 6) as confidence,
    source_id || coalesce(' (' || genre || ')', '') || coalesce(' on ' || platform, '') || ': ' || sample_count || ' historical reviews, '
    || case when disc >= 1.0 then 'high' when disc >= 0.85 then 'moderate' else 'low' end || ' score discrimination, '
    || case when sample_count >= 500 then 'large historical sample' when sample_count >= 100 then 'sufficient sample size' when sample_count >= 30 then 'moderate sample size' else 'limited sample size' end
    || ' — final weight: ' || printf('%.2f', raw) as explanation
  from weighing
)"""
SNAPSHOTS = """keys as (select game_id, tier, i, j, genre, platform from (
 select game_id, 1 as tier, i, j, genres[i] as genre, platforms[j] as platform from games, range(1, 3) t(i), range(1, 2) u(j)
 union all select game_id, 2, i, 0, genres[i], null from games, range(1, 3) t(i)
 union all select game_id, 3, 0, j, null, platforms[j] from games, range(1, 2) u(j)
 union all select game_id, 4, 0, 0, null, null from games)),
found as (select p.game_id, p.source_id, arg_min(w.context_weight, k.tier * 100 + k.i * 10 + k.j) as w
 from (select distinct game_id, source_id from reviews) p join keys k using (game_id)
 join weights w on w.source_id = p.source_id and w.genre is not distinct from k.genre and w.platform is not distinct from k.platform group by 1, 2),
rowwise as (select r.game_id, r.source_id, r.score, coalesce(f.w, 1.0) as w,
 case when m.sample_count >= 10 then greatest(0.0, least(100.0, gm + (r.score - case when coalesce(m.mean_score, 0) = 0 then gm else m.mean_score end)
 / case when m.score_std > 0 then m.score_std else 1.0 end * gs)) else greatest(0.0, least(100.0, r.score)) end as cal,
 row_number() over (partition by r.game_id order by r.score) as k, count(*) over (partition by r.game_id) as n
 from reviews r join games g using (game_id) left join metrics m using (source_id) left join found f on f.game_id = r.game_id and f.source_id = r.source_id, overall),
snapshots as (select game_id, count(*) as sample_count, count(distinct source_id) as source_count, round(avg(score), 4) as raw_average, round(median(score), 4) as median_score,
 round(case when count(*) >= 20 then avg(score) filter (where k > floor(n * 0.05) and k <= n - floor(n * 0.05)) else avg(score) end, 4) as trimmed_mean,
 round(greatest(0.0, least(100.0, avg(cal))), 4) as calibrated_score, round(case when sum(w) > 0 then sum(score * w) / sum(w) else avg(score) end, 4) as weighted_score,
 round(stddev_pop(score), 4) as score_std from rowwise group by 1)"""
BASE = (GAMES, REVIEWS, OVERALL, METRICS, COVER, WEIGHTS, SNAPSHOTS)


def counts_of(spark, sf_dir):
    return scoring.score_counts(T.reviews(spark, sf_dir))


def metrics_of(spark, sf_dir):
    return scoring.source_metrics(counts_of(spark, sf_dir), T.games(spark, sf_dir))


def _weights(counts, metrics, games):
    return scoring.weights(metrics, scoring.coverage(counts, games, "genres", "platforms"))


def _items_counts(spark, sf_dir):
    games = T.games(spark, sf_dir)
    return materialised(scoring.of_items(counts_of(spark, sf_dir), games), "counts"), games


def weights_of(spark, sf_dir):
    counts, games = _items_counts(spark, sf_dir)
    return _weights(counts, scoring.source_metrics(counts, games), games)


def snapshots_of(spark, sf_dir):
    """Scores from counts and metrics that are computed once, as the steps of a run do it."""
    counts, games = _items_counts(spark, sf_dir)
    metrics = materialised(scoring.source_metrics(counts, games), "metrics")
    return scoring.snapshots(counts, games, metrics, _weights(counts, metrics, games))


_RAW = """raw as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_orderkey % 9 when 0 then null when 1 then '  ' when 2 then ['A+','a','B-','f','F+','D'][1 + l_partkey % 6]
 when 3 then (l_partkey % 12) || '/' || (l_suppkey % 11) when 4 then 'abc' when 5 then '1.2.3/5' else ' ' || (l_partkey % 130 - 5) || '.5' end as value,
 [100.0, 10.0, 5.0, 4.0, 20.0, 0.0, null][1 + l_partkey % 7] as scale from lineitem)"""
_NORM = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, value, scale, round(case
 when rule like 'letter:%' then map(['A+','A','B-','F','D'], [97.0, 90.0, 77.0, 40.0, 60.0])[v]
 when rule like 'fraction:%' then least(100.0, greatest(0.0, try_cast(split_part(v, '/', 1) as double) / try_cast(split_part(v, '/', 2) as double) * 100))
 when rule like 'scale%' then least(100.0, greatest(0.0, try_cast(v as double) * case scale when 100 then 1.0 when 10 then 10.0 when 5 then 20.0 when 4 then 25.0 else 100.0 / scale end)) end, 4) as score, rule
 from (select *, case when v is null or v = '' then 'empty_value' when v in ('A+','A','B-','F','D') then 'letter:' || v when v = 'F+' then 'unknown_letter'
 when v = '1.2.3/5' then 'unparseable_fraction' when v like '%/%' and try_cast(split_part(v, '/', 2) as double) > 0 then 'fraction:' || v when v like '%/%' then 'unparseable_fraction'
 when v = 'ABC' then 'unparseable_value' when scale = 100 then 'scale_100' when scale = 10 then 'scale_10' when scale = 5 then 'scale_5' when scale = 4 then 'scale_4_star'
 when scale > 0 then 'scale_custom' else 'no_scale_info' end as rule from (select *, upper(trim(value)) as v from raw))"""


def _raw(spark, sf_dir):
    key, part = F.col("l_orderkey") % 9, F.col("l_partkey")
    grade = F.get(F.array(*map(F.lit, ("A+", "a", "B-", "f", "F+", "D"))), (part % 6).cast("int"))
    value = (
        F.when(key == 0, F.lit(None).cast("string")).when(key == 1, "  ").when(key == 2, grade)
        .when(key == 3, F.concat_ws("/", part % 12, F.col("l_suppkey") % 11)).when(key == 4, "abc").when(key == 5, "1.2.3/5")
        .otherwise(F.concat(F.lit(" "), (part % 130 - 5).cast("string"), F.lit(".5")))
    )
    scale = F.get(F.array(*(F.lit(x).cast("double") for x in (100, 10, 5, 4, 20, 0, None))), (part % 7).cast("int"))
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value.alias("value"), scale.alias("scale"))


@query("q_norm", "with " + _RAW + _NORM)
def q_norm(spark, sf_dir):
    got = normalized(F.col("value"), F.col("scale"))
    return _raw(spark, sf_dir).withColumn("r", got).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "value", "scale", F.round("r.score", 4).alias("score"), "r.rule")


@query("q_norm_rules", "with " + _RAW + ", normed as (" + _NORM + ") select rule, count(*) as n, round(min(score), 4) as lo, round(max(score), 4) as hi from normed group by 1")
def q_norm_rules(spark, sf_dir):
    return q_norm(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))


@query("q_src_metrics", with_(*BASE[:4], body="select * from metrics"))
def q_src_metrics(spark, sf_dir):
    return metrics_of(spark, sf_dir)


@query("q_coverage", with_(*BASE[:5], body="select source_id, 'genre' as kind, value, n from gcov union all select source_id, 'platform', value, n from pcov"))
def q_coverage(spark, sf_dir):
    out = scoring.coverage(counts_of(spark, sf_dir), T.games(spark, sf_dir), "genres", "platforms")
    return out.withColumn("kind", F.when(F.col("kind") == "genres", "genre").otherwise("platform"))


@query("q_weights", with_(*BASE[:6], body="select * from weights"))
def q_weights(spark, sf_dir):
    return weights_of(spark, sf_dir)


@query("q_snapshots", with_(*BASE, body="select * from snapshots"))
def q_snapshots(spark, sf_dir):
    return snapshots_of(spark, sf_dir)


@query("q_snapshots_kept", with_(*BASE, body="select * from snapshots"))
def q_snapshots_kept(spark, sf_dir):
    """Scores from counts that three batches of reviews have been added to, and one of them taken out and added again."""
    reviews, games = T.reviews(spark, sf_dir), T.games(spark, sf_dir)
    part = lambda k: reviews.where(F.pmod(F.xxhash64("review_id"), F.lit(3)) == k)
    state = ScoreState.at(scratch(spark, "scores"), reviews, 8)
    for k in range(3):
        state.apply(part(k), note=("batches", k))
    state.apply(part(2), note=("batches", 2))  # again, which changes nothing
    state.apply(removed=part(1))
    state.apply(part(1))
    return state.snapshots(games)


@query("q_distribution", with_(GAMES, REVIEWS, body="select game_id, language as value, 'language' as kind, count(*) as n from reviews group by 1, 2 union all select game_id, platform, 'platform', count(*) from reviews group by 1, 2"))
def q_distribution(spark, sf_dir):
    reviews = T.reviews(spark, sf_dir)
    out = [scoring.distribution(reviews, c, "m").select("game_id", F.explode("m").alias("value", "n"), F.lit(c).alias("kind")) for c in ("language", "platform")]
    return out[0].unionByName(out[1])


@query("q_run_summary", with_(*BASE, body="select count(*) as n, round(avg(weighted_score), 3) as mean, round(stddev_pop(weighted_score), 3) as std, min(weighted_score) as lo, max(weighted_score) as hi from snapshots"))
def q_run_summary(spark, sf_dir):
    w = F.col("weighted_score")
    return snapshots_of(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(w), 3).alias("mean"), F.round(F.stddev_pop(w), 3).alias("std"), F.min(w).alias("lo"), F.max(w).alias("hi"))


