"""Reports on items that no provider matched, and checks of what is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import text as X


def unmatched(games: DataFrame, identities: DataFrame, reviews: DataFrame, baselines: DataFrame, lost: Column) -> DataFrame:
    """The items for which ``lost`` holds, with slug, reviews of their own and listed elsewhere, and why they are hard.

    An item has the smallest slug of its identities; one without reviews or baselines has 0.
    """
    slugs = identities.groupBy("game_id").agg(F.min("external_slug").alias("slug"))
    own = reviews.groupBy("game_id").agg(F.count("*").alias("own"))
    listed = baselines.groupBy("game_id").agg(F.sum("review_count").alias("listed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = games.where(lost).select("game_id", "title", "release_year").join(slugs, "game_id", "left").join(own, "game_id", "left").join(listed, "game_id", "left")
    return rows.select("game_id", "title", "release_year", "slug", zero("own").alias("own"), zero("listed").alias("listed"), (zero("own") + zero("listed")).alias("total"), X.title_categories(F.coalesce("title", F.lit("")), F.col("slug")).alias("categories"))


def category_summary(rows: DataFrame, examples: int = 3) -> DataFrame:
    """(category, n, percent, examples): how many items a category has, of all, and its most reviewed titles."""
    each = rows.select("game_id", "title", "slug", "total", F.explode("categories").alias("category"))
    place = F.row_number().over(W.partitionBy("category").orderBy(F.desc("total"), "game_id"))
    best = each.withColumn("place", place).where(F.col("place") <= examples)
    shown = best.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce(F.nullif("title", F.lit("")), "slug").alias("t")))).alias("best"))
    counts = each.groupBy("category").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("of"))  # one row
    return counts.join(shown, "category").join(F.broadcast(total)).select("category", "n", F.round(100.0 * F.col("n") / F.col("of"), 1).alias("percent"), F.transform("best", lambda b: b["t"]).alias("examples"))


def most_reviewed(rows: DataFrame, most: int, category: str | None = None) -> DataFrame:
    """The most reviewed items, of one category or of all."""
    chosen = rows.where(F.array_contains("categories", category)) if category else rows
    return chosen.orderBy(F.desc("total"), "game_id").limit(most)


def missing_documents(ids: DataFrame, present: DataFrame) -> DataFrame:
    """(key, state): keys that should have a document and have none, and documents whose key is gone."""
    want, have = ids.select(F.col("key").cast("string")).distinct(), present.select(F.col("key").cast("string")).distinct()
    return want.join(have, "key", "left_anti").withColumn("state", F.lit("missing")).unionByName(have.join(want, "key", "left_anti").withColumn("state", F.lit("stale")))


def top_values(rows: DataFrame, column: str, most: int = 15) -> DataFrame:
    """(value, n) of a column's most frequent values, empty ones left out."""
    counts = rows.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(most)
