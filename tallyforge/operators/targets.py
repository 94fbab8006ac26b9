"""Which items a provider run should fetch, and which fetched products it may accept.

Nulls: a missing count is 0, a missing year is unknown. Repeated rows of an item count once per review; empty tables
give no targets. Columns of the reviews other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators.runtime import large, spread
from tallyforge.operators.tables import first_of_each
from tallyforge.params import BackfillOptions, RepairOptions


def provider_counts(reviews: DataFrame, *providers: str) -> DataFrame:
    """(game_id, n_<provider>..., n_other): an item's scored reviews by provider, in one aggregation."""
    of = F.col("data_source")
    known = [F.count_if(of == p).alias(f"n_{p}") for p in providers]
    return reviews.where("score is not null").groupBy("game_id").agg(*known, F.count_if(~F.coalesce(of.isin(list(providers)), F.lit(False))).alias("n_other"))


def without_provider(games: DataFrame, reviews: DataFrame, provider: str) -> DataFrame:
    """(game_id, other) of items that others review and ``provider`` doesn't."""
    counts = provider_counts(reviews, provider)
    return games.select("game_id").join(counts, "game_id", "left").where((F.coalesce(f"n_{provider}", F.lit(0)) == 0) & (F.col("n_other") > 0)).select("game_id", F.col("n_other").alias("other"))


def sample_targets(snapshots: DataFrame, reviews: DataFrame, provider: str, sample_counts: set[int] | frozenset[int]) -> DataFrame:
    """(game_id, sample_count, own, other) of items whose snapshot has one of the sample counts."""
    chosen = snapshots.where(F.col("sample_count").isin(sorted(sample_counts))).select("game_id", "sample_count")
    return chosen.join(provider_counts(reviews, provider), "game_id").select("game_id", "sample_count", F.col(f"n_{provider}").alias("own"), F.col("n_other").alias("other"))


def repair_targets(snapshots: DataFrame, games: DataFrame, reviews: DataFrame, o: RepairOptions) -> DataFrame:
    """Items that the archive provider has reviews of, best first; gates and the sample counts only where they are on."""
    counts = provider_counts(reviews, o.archive, o.web, o.rival)
    rows = snapshots.select("game_id", "sample_count", "weighted_score").join(games.select("game_id", "title", "release_year"), "game_id").join(counts, "game_id")
    rows = rows.where(F.col(f"n_{o.archive}") > 0)
    if o.sample_counts:
        rows = rows.where(F.col("sample_count").isin(sorted(o.sample_counts)))
    if o.only_without_rival:
        rows = rows.where(F.col(f"n_{o.rival}") == 0)
    if o.skip_existing_web:
        rows = rows.where(F.col(f"n_{o.web}") == 0)
    return _first(rows, o.limit, F.desc_nulls_last("weighted_score"), F.asc("title"), F.asc("game_id"))


def metadata_targets(snapshots: DataFrame, games: DataFrame, reviews: DataFrame, identities: DataFrame, o: RepairOptions) -> DataFrame:
    """Items without a release year, of some score and sample; reviews and identities are counted apart, so neither
    swells the other's count."""
    counts = provider_counts(reviews, o.archive, o.web, o.rival)
    known = identities.where(F.col("source_name") == o.web).select("game_id", F.lit(1).alias("has_identity")).distinct()
    rows = (
        snapshots.select("game_id", "sample_count", "weighted_score")
        .where((F.col("weighted_score") >= o.least_score) & (F.col("sample_count") >= o.least_sample))
        .join(games.where("release_year is null").select("game_id", "title"), "game_id").join(counts, "game_id").join(known, "game_id", "left")
        .withColumn("has_identity", F.coalesce("has_identity", F.lit(0)))
    )
    if o.require_rival:
        rows = rows.where(F.col(f"n_{o.rival}") > 0)
    if o.skip_existing_identity:
        rows = rows.where("has_identity = 0")
    return _first(rows, o.limit, F.desc("weighted_score"), F.desc("sample_count"), F.asc("title"), F.asc("game_id"))


def _first(rows: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(limit) if limit else rows


def with_slugs(targets: DataFrame, overrides: DataFrame) -> DataFrame:
    """Adds manual_slug from (key, slug): by the item's id, else by its title."""
    by = lambda name: overrides.select(F.col("key").alias(name), F.col("slug").alias(f"__{name}"))
    both = targets.withColumn("__id", F.col("game_id").cast("string")).join(by("__id"), "__id", "left").join(by("title"), "title", "left")
    return both.withColumn("manual_slug", F.coalesce("____id", "__title")).select(*targets.columns, "manual_slug")


def backfill_reasons(found: DataFrame, counts: DataFrame, o: BackfillOptions, samples: DataFrame | None = None) -> DataFrame:
    """``found`` (row_id, listed, game_id) with what the item has, and the reason why it is selected or left out.

    ``counts`` (game_id, existing): reviews of others. With ``samples`` (of ``sample_targets``) only those items are
    wanted, and only without reviews of the provider's own; else items with few reviews that the provider has more of.
    A row without a known item is unmatched.
    """
    rows = found.join(counts.select("game_id", "existing"), "game_id", "left")
    listed = F.coalesce("listed", F.lit(0))
    lost = F.col("game_id").isNull() | F.col("existing").isNull()
    if samples is None:
        existing = F.coalesce("existing", F.lit(0))
        reason = F.when(lost, "unmatched").when(existing > o.most_existing, "existing_above_cap")
        reason = reason.when((listed < o.least_listed) | (listed <= existing), "low_gain").otherwise("selected")
        return rows.withColumn("reason", reason)
    rows = rows.join(samples.select("game_id", "sample_count", "own", "other"), "game_id", "left")
    reason = F.when(lost, "unmatched").when(F.col("sample_count").isNull(), "not_target_sample").when(F.col("own") > 0, "already_has_own")
    return rows.withColumn("reason", reason.when(listed < o.least_listed, "low_gain").otherwise("selected"))


def no_provider_reasons(found: DataFrame, missing: DataFrame, o: BackfillOptions) -> DataFrame:
    """The same for every item of ``missing`` (of ``without_provider``), whatever it has."""
    rows = found.join(missing, "game_id", "left")
    listed = F.coalesce("listed", F.lit(0))
    return rows.withColumn("reason", F.when(F.col("other").isNull(), "unmatched").when(listed < o.least_listed, "low_gain").otherwise("selected"))


def with_suffix(selected: DataFrame) -> DataFrame:
    """Adds the suffix of the identity's key: the item's id where one provider row became several items, else null."""
    several = selected.groupBy("row_id").agg(F.count("*").alias("__n"))
    return selected.join(several, "row_id").withColumn("identity_suffix", F.when(F.col("__n") > 1, F.col("game_id").cast("string"))).drop("__n")


def worth_repair(listed: Column, numeric: Column, existing: Column, least_listed: int) -> Column:
    """Whether a product lists enough reviews and has more with a score than the item has already."""
    return (F.coalesce(listed, F.lit(0)) >= least_listed) & (F.coalesce(numeric, F.lit(0)) > F.coalesce(existing, F.lit(0)))


def incomplete(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in which one of the columns is missing or empty."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    whole = filled(columns[0])
    for c in columns[1:]:
        whole = whole & filled(c)
    return rows.where(~whole)


def acceptance(title: Column, year: Column, product_title: Column, product_year: Column, tolerance: int = 1) -> Column:
    """struct(accepted, reason): whether a product is the item. Titles must be equal once normalised; a year in the
    item's title must be the product's; else years may differ by ``tolerance``, or the product's be earlier."""
    tagged = X.year_tag(title)[1]
    year, product_year = F.nullif(year, F.lit(0)), F.nullif(product_year, F.lit(0))
    said = lambda ok, *parts: F.struct(F.lit(ok).alias("accepted"), F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("none")) for p in parts)).alias("reason"))
    both = product_year.isNotNull() & year.isNotNull()
    return (
        F.when(X.title_repair(product_title) != X.title_repair(title), said(False, "title mismatch: ", product_title))
        .when(tagged.isNotNull() & ~tagged.eqNullSafe(product_year), said(False, "version year mismatch: ", product_year, " not ", tagged))
        .when(both & (F.abs(product_year - year) <= tolerance), said(True, "title_year"))
        .when(both & (product_year < year) & tagged.isNull(), said(True, "title_earlier_year_repair: ", year, " to ", product_year))
        .when(both, said(False, "release year mismatch: ", product_year, " not ", year))
        .otherwise(said(True, "title_only"))
    )


def accepted_products(targets: DataFrame, products: DataFrame, tolerance: int = 1) -> DataFrame:
    """(game_id, slug, position, accepted, reason): each item's first candidate slug with an acceptable product.

    Targets are (game_id, title, release_year, manual_slug); candidates are the manual slug, then those of the title.
    Products are (slug, product_title, product_year), one of a slug. Without an accepted one, ``accepted`` is false and
    ``reason`` lists what each candidate lacked, in order.
    """
    slugs = F.array_distinct(F.filter(F.concat(F.array("manual_slug"), X.slug_candidates(F.col("title"))), lambda s: s.isNotNull() & (s != "")))
    asked = spread(targets, "game_id").select("game_id", "title", "release_year", F.posexplode(slugs).alias("position", "slug"))
    tried = asked.join(large(products.select("slug", "product_title", "product_year", F.lit(True).alias("found"))), "slug", "left")
    verdict = acceptance(F.col("title"), F.col("release_year"), F.col("product_title"), F.col("product_year"), tolerance)
    none = F.struct(F.lit(False).alias("accepted"), F.lit("404").alias("reason"))
    tried = tried.withColumn("verdict", F.when(F.col("found"), verdict).otherwise(none))
    ok = first_of_each(tried.where("verdict.accepted"), ["game_id"], F.asc("position")).select("game_id", "slug", "position", "verdict.accepted", "verdict.reason")
    lost = tried.join(large(ok.select("game_id")), "game_id", "left_anti").groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("position", F.concat_ws(":", "slug", "verdict.reason").alias("said")))).alias("tried"))
    none_of = lambda c, t: F.lit(None).cast(t).alias(c)
    return ok.unionByName(lost.select("game_id", none_of("slug", "string"), none_of("position", "int"), F.lit(False).alias("accepted"), F.array_join(F.transform("tried", lambda t: t["said"]), "; ").alias("reason")))
