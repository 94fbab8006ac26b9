"""The write path of a provider: items, identities, baselines and reviews of a whole batch at once.

Every function takes whole tables and gives whole tables; keys that are null are never replaced. Of repeated keys in a
batch the last by the order given counts. Empty batches change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators.tables import earlier_year, fill_empty, last_of_each, merge, orphans, repaired_year, upsert


def identity_rows(batch: DataFrame, provider: str, method: str, confidence: float = 0.95) -> DataFrame:
    """Identities of products (game_id, external_id, slug, title, url, identity_suffix, collected_at)."""
    suffix = F.coalesce(F.concat(F.lit("-"), "identity_suffix"), F.lit(""))
    return batch.select(
        F.concat(X.minted(f"{provider}-id-", F.col("external_id")), suffix).alias("identity_id"), "game_id", F.lit(provider).alias("source_name"),
        F.col("external_id").cast("string").alias("external_id"), F.col("slug").alias("external_slug"), F.col("title").alias("external_title"),
        F.col("url").alias("external_url"), F.lit(confidence).alias("match_confidence"), F.lit(method).alias("match_method"), F.col("collected_at").alias("updated_at"),
    )


def baseline_rows(batch: DataFrame, provider: str) -> DataFrame:
    """Baselines of the same products, with listed_score and listed."""
    suffix = F.coalesce(F.concat(F.lit("-"), "identity_suffix"), F.lit(""))
    return batch.select(
        F.concat(X.minted(f"{provider}-base-", F.col("external_id")), suffix).alias("baseline_id"), "game_id", F.lit(provider).alias("source_platform"),
        F.col("listed_score").cast("double").alias("external_score"), F.col("listed").cast("int").alias("review_count"), F.col("url").alias("source_url"), "collected_at",
    )


def numeric_reviews(batch: DataFrame, provider: str) -> DataFrame:
    """Reviews of (game_id, outlet, external_review_id, score, review_date): those without a score go, outlets become
    sources under minted ids."""
    name = X.outlet(F.col("outlet"))
    return batch.where("score is not null").select(
        X.minted(f"{provider}-rev-", F.col("external_review_id"), F.col("game_id")).alias("review_id"), "game_id", X.minted("src-", name, size=12).alias("source_id"),
        F.col("score").cast("double").alias("score"), "review_date", F.lit(provider).alias("data_source"),
    )


def write_games(tables: dict[str, DataFrame], products: DataFrame, reviews: DataFrame, provider: str, method: str = "title_year") -> dict[str, DataFrame]:
    """games, game_identity, external_baseline and reviews after a provider's batch.

    Items are merged, the earlier year winning; identities, baselines and reviews replace those of their keys.
    """
    new = last_of_each(products, ["game_id"], "collected_at").select("game_id", "title", "release_year")
    games = tables["games"]
    for c in games.columns:
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(games.schema[c].dataType))
    put = lambda name, rows, key, order: upsert(tables[name], rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(tables[name].schema[c].dataType).alias(c) for c in tables[name].columns)), [key], order)
    return {
        "games": merge(games, new.select(games.columns), ["game_id"], earlier_year()),
        "game_identity": put("game_identity", identity_rows(products, provider, method), "identity_id", "updated_at"),
        "external_baseline": put("external_baseline", baseline_rows(products, provider), "baseline_id", "collected_at"),
        "reviews": put("reviews", numeric_reviews(reviews, provider), "review_id", "review_date"),
    }


def write_metadata(tables: dict[str, DataFrame], products: DataFrame, provider: str, method: str = "metadata_title") -> dict[str, DataFrame]:
    """games, game_identity and external_baseline after a repair of titles and years: no reviews change."""
    new = last_of_each(products, ["game_id"], "collected_at").join(tables["games"].select("game_id"), "game_id", "left_semi")
    fields = [c for c in ("title", "release_year", "developer") if c in new.columns and c in tables["games"].columns]
    old = tables["games"]
    new = new.select("game_id", *fields)
    for c in old.columns:
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(old.schema[c].dataType))
    rules = repaired_year() | ({"developer": fill_empty("developer")} if "developer" in fields else {})
    written = write_games(tables, products, products.limit(0).select("game_id", F.lit("").alias("outlet"), F.lit("").alias("external_review_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("date").alias("review_date")), provider, method)
    return {"games": merge(old, new.select(old.columns), ["game_id"], rules), "game_identity": written["game_identity"], "external_baseline": written["external_baseline"]}


def replace_reviews(existing: DataFrame, new: DataFrame, providers: tuple[str, ...]) -> DataFrame:
    """The new reviews in the place of those that the same items have of ``providers``; other items keep theirs."""
    gone = new.select("game_id").distinct().withColumn("__gone", F.lit(True))
    of = F.coalesce(F.col("data_source").isin(list(providers)), F.lit(False))
    return existing.join(gone, "game_id", "left").where(~(F.coalesce("__gone", F.lit(False)) & of)).select(existing.columns).unionByName(new.select(existing.columns))


def set_columns(existing: DataFrame, new: DataFrame, key: str, *columns: str) -> DataFrame:
    """The columns as ``new`` has them where it has the key, nulls too; other rows and columns stay."""
    fresh = new.select(key, F.lit(True).alias("__met"), *(F.col(c).alias(f"__new_{c}") for c in columns)).dropDuplicates([key])
    both = existing.join(fresh, key, "left")
    return both.withColumns({c: F.when(F.col("__met"), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in columns}).select(existing.columns)


def purge(tables: dict[str, DataFrame], provider: str) -> dict[str, DataFrame]:
    """Without a provider's reviews, baselines and identities, and without the items that it alone had."""
    other = lambda name, c: tables[name].where(~F.col(c).eqNullSafe(provider))
    reviews, baselines, identities = other("reviews", "data_source"), other("external_baseline", "source_platform"), other("game_identity", "source_name")
    candidates = tables["game_identity"].where(F.col("source_name") == provider).select("game_id").distinct()
    lost = orphans(tables["games"].join(candidates, "game_id", "left_semi").select("game_id"), "game_id", reviews, identities, baselines)
    return {"reviews": reviews, "external_baseline": baselines, "game_identity": identities, "games": tables["games"].join(lost, "game_id", "left_anti")}


def purge_rows(tables: dict[str, DataFrame], mock: dict[str, Column], sources: str = "sources") -> dict[str, DataFrame]:
    """Without the rows that a condition of each table marks as made up, and without sources that then have no review."""
    out = {name: frame.where(~F.coalesce(mock[name], F.lit(False))) if name in mock else frame for name, frame in tables.items()}
    out[sources] = out[sources].join(out["reviews"].select("source_id").distinct(), "source_id", "left_semi")
    return out


def mean_baselines(reviews: DataFrame) -> DataFrame:
    """(game_id, external_score, review_count): the mean of an item's scores to two decimals, and how many there are."""
    return reviews.where("score is not null").groupBy("game_id").agg(F.round(F.avg("score"), 2).alias("external_score"), F.count("*").alias("review_count"))


def known_titles(titles: list[str], games: DataFrame, most: int = 25) -> DataFrame:
    """(position, title, game_id): the first ``most`` of a list's titles that are stored, in the list's order."""
    wanted = games.sparkSession.createDataFrame(list(enumerate(titles)), "position int, title string")
    met = games.join(F.broadcast(wanted), "title").groupBy("position", "title").agg(F.min("game_id").alias("game_id"))
    return met.orderBy("position").limit(most)
