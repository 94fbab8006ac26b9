"""Source metrics, contextual weights and the five aggregate scores of an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.scores import clamp, discrimination_factor, relevance, sample_confidence, weight_explanation
from tallyforge.operators.runtime import dealt, large
from tallyforge.params import ScoringParams


def score_counts(reviews: DataFrame) -> DataFrame:
    """(game_id, source_id, score, n): how often an item has a score from a source. All of scoring follows from it.

    Reviews without a score are left out. Counts add up, so those of new reviews may be added to stored ones; a hot item
    is as many rows as it has different scores of its sources, however many reviews. Reviews are dealt by item before they
    are counted: most have a count of their own, so that counting a file's rows first would hold them all in memory.
    """
    scored = reviews.where("score is not null").select("game_id", "source_id", "score")
    return dealt(scored, "game_id").groupBy("game_id", "source_id", "score").agg(F.count("*").alias("n"))


def of_items(counts: DataFrame, games: DataFrame) -> DataFrame:
    """``score_counts`` with what scoring needs of the items, so that it is met once for all that follows.

    ``items`` holds (genres, platforms) of the item, several where its id is repeated, and is null where it is unknown;
    ``first`` marks one row of each item and source. Metrics, coverage and scores take counts with or without these.
    """
    if "items" in counts.columns:
        return counts
    lists = games.groupBy("game_id").agg(F.collect_list(F.struct("genres", "platforms")).alias("items"))
    first = F.row_number().over(W.partitionBy("game_id", "source_id").orderBy("score")) == 1
    return counts.withColumn("first", first).join(large(lists), "game_id", "left")


def review_counts(reviews: DataFrame) -> DataFrame:
    """(game_id, source_id, n) of all reviews, scored or not, for ``coverage``; dealt by item, as its items meet them there."""
    return dealt(reviews.select("game_id", "source_id"), "game_id").groupBy("game_id", "source_id").agg(F.count("*").alias("n"))


def _std() -> Column:
    """The population's deviation from counts; exactly 0 where all scores are equal."""
    n, x = F.sum("n"), F.sum(F.col("score") * F.col("n"))
    square = F.sum(F.col("score") * F.col("score") * F.col("n"))
    return F.when(F.min("score") == F.max("score"), 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), (square - x * x / n) / n)))


def _mean() -> Column:
    return F.sum(F.col("score") * F.col("n")) / F.sum("n")


def source_metrics(counts: DataFrame, games: DataFrame, p: ScoringParams = ScoringParams()) -> DataFrame:
    """Per source with enough scores: mean, deviation, bias and discrimination against all scores of known items.

    ``counts`` as ``score_counts`` gives them; a null source is one too; without scores there are no rows.
    """
    known = counts.where("items is not null") if "items" in counts.columns else counts.join(large(games.select("game_id")), "game_id", "left_semi")
    overall = known.agg(_mean().alias("gm"), _std().alias("gs"))  # one row
    per = known.groupBy("source_id").agg(F.sum("n").alias("sum_n"), _mean().alias("mean"), _std().alias("std"))
    power = F.when(F.col("gs") > 0, F.least(F.lit(1.0), F.col("std") / F.col("gs"))).otherwise(0.0)
    return per.where(F.col("sum_n") >= p.least_per_source).join(F.broadcast(overall)).select(
        "source_id", F.col("sum_n").alias("sample_count"), F.round("mean", 4).alias("mean_score"), F.round("std", 4).alias("score_std"),
        F.round(F.col("mean") - F.col("gm"), 4).alias("score_bias"), F.round(power, 4).alias("discrimination_power"),
    )


def coverage(counts: DataFrame, games: DataFrame, *columns: str) -> DataFrame:
    """(source_id, kind, value, n): a source's scores by each value of list columns of the items; ``kind`` is the column.

    Null and empty values are left out. ``counts`` are those of scores or, for unscored reviews too, ``review_counts``.
    """

    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("values")) for c in columns))).alias("k")
    if "items" in counts.columns:
        rows = counts.select("source_id", "n", F.inline("items"))
    else:
        rows = counts.join(large(games.select("game_id", *columns)), "game_id")
    # lists are unfolded where a source's counts are: before, they would be as many groups as rows
    lists = dealt(rows.select("source_id", "n", *columns), "source_id").select("source_id", "n", kinds)
    values = lists.select("source_id", "n", "k.kind", F.explode("k.values").alias("value")).where("value is not null and value != ''")
    return values.groupBy("source_id", "kind", "value").agg(F.sum("n").alias("n"))


def coverage_map(cover: DataFrame, name: str) -> DataFrame:
    entry = F.struct(F.col("value").alias("key"), F.col("n").alias("value"))
    return cover.groupBy("source_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(name))


def weights(metrics: DataFrame, cover: DataFrame, p: ScoringParams = ScoringParams()) -> DataFrame:
    """A weight for each source, and for each of its most frequent genres and platforms; ``cover`` as ``coverage`` gives it.

    Sources without metrics have none. Of equally frequent values the smaller by name comes first.
    """
    rank = F.row_number().over(W.partitionBy("source_id", "kind").orderBy(F.desc("n"), "value"))
    top = cover.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("kind") == "genres", p.top_genres).otherwise(p.top_platforms))
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    none = F.lit(None)
    whole = metrics.select("source_id", none.cast("string").alias("genre"), none.cast("string").alias("platform"), none.cast("long").alias("gn"), none.cast("long").alias("pn"))
    context = whole.unionByName(top.select("source_id", of("genres", "value").alias("genre"), of("platforms", "value").alias("platform"), of("genres", "n").alias("gn"), of("platforms", "n").alias("pn")))
    n = F.col("sample_count")
    confidence, power = sample_confidence(n), discrimination_factor(F.col("discrimination_power"))
    weight = confidence * power * relevance(F.col("gn"), n, 0.4, 1.2) * relevance(F.col("pn"), n, 0.3, 1.1) * p.disclosure
    return context.join(metrics, "source_id").select(
        "source_id", "genre", "platform", F.round(weight, 6).alias("context_weight"), F.round(confidence, 6).alias("confidence"),
        weight_explanation(F.col("source_id").cast("string"), F.col("genre"), F.col("platform"), n, power, weight).alias("explanation"),
    )


def weight_maps(weights_: DataFrame) -> DataFrame:
    """One row for each source: its weights by ``genre|platform``, by genre and by platform, and the one for neither."""
    g, p, w = F.col("genre"), F.col("platform"), F.col("context_weight").alias("value")
    by = lambda rows, key: F.map_from_entries(F.collect_list(F.when(rows, F.struct(key.alias("key"), w))))
    return weights_.groupBy("source_id").agg(
        by(g.isNotNull() & p.isNotNull(), F.concat_ws("|", g, p)).alias("by_both"), by(g.isNotNull() & p.isNull(), g).alias("by_genre"),
        by(g.isNull() & p.isNotNull(), p).alias("by_platform"), F.max(F.when(g.isNull() & p.isNull(), F.col("context_weight"))).alias("by_none"),
    )


def weight_for(genres: Column, platforms: Column) -> Column:
    """The first of these that the source has: genre and platform, genre, platform, neither; else 1. A null list is empty.

    The columns of ``weight_maps`` are looked into in turn, each only where those before have nothing.
    """
    genres, platforms = (F.coalesce(c, F.array().cast("array<string>")) for c in (genres, platforms))
    first = lambda held, keys: F.get(F.filter(F.transform(keys, lambda k: F.try_element_at(held, k)), lambda w: w.isNotNull()), F.lit(0))
    pairs = F.flatten(F.transform(genres, lambda g: F.transform(platforms, lambda p: F.concat_ws("|", g, p))))
    both = F.when(F.size("by_both") > 0, first(F.col("by_both"), pairs))
    return F.coalesce(both, first(F.col("by_genre"), genres), first(F.col("by_platform"), platforms), "by_none", F.lit(1.0))


def snapshots(counts: DataFrame, games: DataFrame, metrics: DataFrame, weights_: DataFrame, p: ScoringParams = ScoringParams()) -> DataFrame:
    """Mean, median, trimmed, calibrated and weighted score of every known item that has scores, from ``score_counts``.

    The median, and the mean without the lowest and highest share where there are enough, come from places among an
    item's counts: the running sum in the order of scores. Items whose weights sum to nothing keep the mean. Without
    scores there are no rows; repeated items repeat their counts.
    """
    overall = counts.agg(_mean().alias("gm"), _std().alias("gs"))
    facts = metrics.select("source_id", "sample_count", "mean_score", "score_std").join(weight_maps(weights_), "source_id", "left")
    mean = F.when(F.coalesce("mean_score", F.lit(0.0)) == 0, F.col("gm")).otherwise(F.col("mean_score"))
    std = F.when(F.col("score_std") > 0, F.col("score_std")).otherwise(1.0)
    calibrated = F.when(F.col("sample_count") >= p.least_to_calibrate, clamp(F.col("gm") + (F.col("score") - mean) / std * F.col("gs"), 0.0, 100.0))
    item = of_items(counts, games).select("game_id", "source_id", "score", "n", "first", F.posexplode("items").alias("nth", "item"))
    held = item.select("game_id", "source_id", "score", "n", (F.col("first") & (F.col("nth") == 0)).alias("first"), "item.genres", "item.platforms")
    weighed = dealt(held, "source_id").join(large(facts), "source_id", "left").join(F.broadcast(overall)).withColumn("w", weight_for(F.col("genres"), F.col("platforms")))
    rows = dealt(weighed.select("game_id", "source_id", "score", "n", "first", "w", F.coalesce(calibrated, clamp(F.col("score"), 0.0, 100.0)).alias("calibrated")), "game_id")
    of = W.partitionBy("game_id")
    upto = F.sum("n").over(of.orderBy("score").rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumns({"upto": upto, "of": F.sum("n").over(of)})
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("score")))  # noqa: E731  the score at place k, from 0
    cut = F.when(F.col("of") >= p.least_to_trim, F.floor(F.col("of") * p.trim_share)).otherwise(0)
    kept = F.greatest(F.least("upto", F.col("of") - cut) - F.greatest(F.col("upto") - F.col("n"), cut), F.lit(0))
    ws, wt = F.sum(F.col("score") * F.col("w") * F.col("n")), F.sum(F.col("w") * F.col("n"))
    return placed.groupBy("game_id").agg(
        F.sum("n").alias("sample_count"), F.count_if(F.col("first") & F.col("source_id").isNotNull()).alias("source_count"), F.round(_mean(), 4).alias("raw_average"),
        F.round((at(F.floor((F.col("of") - 1) / 2)) + at(F.floor(F.col("of") / 2))) / 2, 4).alias("median_score"),
        F.round(F.sum(F.col("score") * kept) / F.sum(kept), 4).alias("trimmed_mean"),
        F.round(clamp(F.sum(F.col("calibrated") * F.col("n")) / F.sum("n"), 0.0, 100.0), 4).alias("calibrated_score"),
        F.round(F.when(wt > 0, ws / wt).otherwise(_mean()), 4).alias("weighted_score"), F.round(_std(), 4).alias("score_std"),
    )


def distribution(reviews: DataFrame, column: str, name: str) -> DataFrame:
    """(game_id, map of value to count), without empty values."""
    counts = reviews.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy("game_id", column).agg(F.count("*").alias("n"))
    return counts.groupBy("game_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(column).alias("key"), F.col("n").alias("value"))))).alias(name))
