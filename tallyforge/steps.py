"""The steps of a whole run: import, catalog, duplicates, platforms, backfill, repair, scores, publication.

Raw reviews are (ID, Game, Website, Review, Score), dates (Game, release_date); ``catalog`` is what ``read_catalog``
gives. A backfill reads ``listings`` (row_id, external_id, title, release_year, listed, listed_score, slug, url,
collected_at) and ``listing_reviews`` (external_id, outlet, external_review_id, score, review_date); a repair reads
``products`` (slug, external_id, product_title, product_year, listed, listed_score, url, collected_at) and
``product_reviews`` (slug, outlet, external_review_id, score, review_date). All may be empty; null titles are no items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.functions.scores import number
from tallyforge.operators import identity as I
from tallyforge.operators import provider as V
from tallyforge.operators import publish as P
from tallyforge.operators import resolve as R
from tallyforge.operators import targets as G
from tallyforge.operators.runtime import checkpointed, large, materialised, spread
from tallyforge.operators.scoring import coverage, of_items, review_counts, score_counts, snapshots, source_metrics, weights
from tallyforge.operators.tables import fill_empty, merge, repoint, replace_scope, upsert
from tallyforge.params import RunOptions
from tallyforge.pipeline import Step, Tables, of_version, with_version

ARCHIVE = "archive"
_STORE = ("games", "sources", "reviews", "game_identity", "external_baseline")


def _shaped(rows: DataFrame, like: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``like``; what they lack is null."""
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(like.schema[c].dataType).alias(c) for c in like.columns))


def imported(t: Tables, o: RunOptions) -> Tables:
    """Items, sources, identities, mean baselines and reviews of the raw files; the archive's own reviews are replaced.

    Rows with an item and a score are stored once, and read for each of these tables. Names of outlets are costly: sources
    take them from different ones, behind a checkpoint, as Spark would drop the first of two distincts.
    """
    raw = t["raw_reviews"].withColumn("Score", number(F.col("Score").cast("string"))).where("Score is not null and Game is not null")
    raw = materialised(raw.select(F.col("ID").cast("string"), "Game", F.col("Website").cast("string"), F.col("Review").cast("string"), "Score"), "raw")
    title, outlet = F.col("title"), X.outlet(F.col("Website"))
    titles = checkpointed(raw.select(F.col("Game").alias("title")).distinct())
    if "raw_dates" in t:
        titles = titles.join(t["raw_dates"].select(F.col("Game").alias("title"), F.col("release_date").cast("string").alias("release_date")), "title", "left")
    else:
        titles = titles.withColumn("release_date", F.lit(None).cast("string"))
    items = titles.select(X.minted("mc-", title).alias("game_id"), "title", "release_date", X.year_of(F.col("release_date")).alias("release_year"))
    names = checkpointed(raw.select("Website").distinct()).select(outlet.alias("name")).distinct()
    sources = names.select(X.minted("mc-src-", F.col("name"), size=12).alias("source_id"), "name", F.lit("media").alias("source_type"), F.lit("en").alias("language"))
    reviews = raw.select(
        F.concat(F.lit("mc-rev-"), "ID").alias("review_id"), X.minted("mc-", F.col("Game")).alias("game_id"),
        X.minted("mc-src-", outlet, size=12).alias("source_id"), F.col("Score").alias("score"), F.lit("en").alias("language"),
        X.cut_off(F.col("Review"), 2000).alias("summary"), F.lit(ARCHIVE).alias("data_source"),
    )
    base = V.mean_baselines(reviews).select(X.minted("mc-bl-", F.col("game_id")).alias("baseline_id"), "game_id", F.lit("metacritic").alias("source_platform"), "external_score", "review_count", F.lit(ARCHIVE).alias("data_source"))
    known = items.select(X.minted("mc-id-", title).alias("identity_id"), "game_id", F.lit(ARCHIVE).alias("source_name"), title.alias("external_title"), F.lit(1.0).alias("match_confidence"), F.lit("primary").alias("match_method"), F.lit(False).alias("needs_manual_review"))
    put = lambda name, rows, key: upsert(t[name], _shaped(rows, t[name]), [key])
    return {
        "games": put("games", items, "game_id"), "sources": put("sources", sources, "source_id"), "game_identity": put("game_identity", known, "identity_id"),
        "external_baseline": put("external_baseline", base, "baseline_id"), "reviews": replace_scope(t["reviews"], _shaped(reviews, t["reviews"]), F.col("data_source") == ARCHIVE),
    }


def enriched(t: Tables, o: RunOptions) -> Tables:
    """Items with what a catalog knows, where they have nothing; each catalog row by the first of its nine keys."""
    c, games = t["catalog"], t["games"]
    rows = c.withColumn("row_id", F.col("line_no"))
    keys = R.catalog_keys(F.col("name"), F.col("slug"), F.col("metacritic_url"), X.year_of(F.col("released")))
    slugs = t["game_identity"].select("game_id", F.col("external_slug").alias("slug"))
    won = R.ordered_lookup(rows, keys, R.catalog_index(games, slugs)).select("row_id", "game_id")
    found = won.join(rows, "row_id").select(
        "game_id", F.array_join("developers", ", ").alias("developer"), F.array_join("publishers", ", ").alias("publisher"),
        F.col("genres"), F.col("parent_platforms").alias("platforms"), X.cut_off(F.col("description_raw"), 2000).alias("description"),
    )
    empty = lambda n: F.when(F.size(F.col(f"old.{n}")) > 0, F.col(f"old.{n}")).otherwise(F.when(F.size(F.col(f"new.{n}")) > 0, F.col(f"new.{n}")))
    rules = {n: fill_empty(n) for n in ("developer", "publisher", "description")} | {n: empty(n) for n in ("genres", "platforms")}
    return {"games": merge(games, _shaped(found, games), ["game_id"], rules)}


def without_duplicates(t: Tables, o: RunOptions) -> Tables:
    """One item of each group of duplicates, the one with most reviews; what refers to the others refers to it.

    Keys of titles, edges and who stays are each computed once, as all four tables need them.
    """
    games = t["games"]
    base, year = X.year_tag(F.col("title"))
    titles = spread(games.select("game_id", "title", "release_year"), "game_id")
    keyed = checkpointed(titles.select("game_id", X.title_canonical(F.col("title")).alias("key"), X.title_canonical(base).alias("base_key"), year.alias("tag_year"), "release_year"))
    edges = checkpointed(R.duplicate_edges(keyed).unionByName(I.tagged_edges(keyed)).distinct())
    counts = t["reviews"].groupBy(F.col("game_id").alias("id")).agg(F.count("*").alias("n"))
    members = R.groups(edges).join(large(counts), "id", "left")
    mapping = checkpointed(R.canonical(members, F.desc(F.coalesce("n", F.lit(0))), F.asc("id")))
    to = lambda name: repoint(t[name], mapping, "game_id")
    kept = games.join(mapping.select(F.col("old").alias("game_id")), "game_id", "left_anti")
    of = mapping.select(F.col("old").alias("game_id"), "canonical").join(games, "game_id").drop("game_id").withColumnRenamed("canonical", "game_id")
    lists = {n: F.when(F.size(F.col(f"old.{n}")) > 0, F.col(f"old.{n}")).otherwise(F.col(f"new.{n}")) for n in ("genres", "platforms")}
    return {
        "games": merge(kept, of.select(games.columns), ["game_id"], {"release_year": F.coalesce("old.release_year", "new.release_year"), **lists}),
        "reviews": to("reviews"), "game_identity": I.best_identities(to("game_identity")),
        "external_baseline": R.best_baselines(to("external_baseline")),
    }


def without_mock(t: Tables, o: RunOptions) -> Tables:
    """Without reviews and baselines of a provider called mock, and without sources that had no others.

    A table without such rows stays as it is, and isn't written again.
    """
    mine = F.col("data_source").endswith("mock")
    made_up = [n for n in ("reviews", "external_baseline") if not t[n].where(mine).isEmpty()]
    out = V.purge_rows({n: t[n] for n in ("reviews", "external_baseline", "sources")}, dict.fromkeys(made_up, mine))
    return {n: out[n] for n in (*made_up, "sources")}


def with_platforms(t: Tables, o: RunOptions) -> Tables:
    """Reviews without a platform get all of their item's, parted by ``|``; if no item has any, they stay as they are."""
    lists = t["games"].select("game_id", F.nullif(F.array_join("platforms", "|"), F.lit("")).alias("__all"))
    if lists.where("__all is not null").isEmpty():
        return {}
    out = t["reviews"].join(lists, "game_id", "left").withColumn("platform", F.coalesce("platform", "__all"))
    return {"reviews": out.select(t["reviews"].columns)}


def backfilled(t: Tables, o: RunOptions) -> Tables:
    """What a provider lists of the store's items, as ``BackfillOptions`` choose them, with the reasons of each row.

    ``purge`` removes the provider's own rows first. With ``list_only``, or without ``write``, nothing but the reasons
    comes out. ``years`` keep listings of those years, ``most_items`` the most listed ones of each year.
    """
    b = o.backfill
    tables = {n: t[n] for n in _STORE}
    if b.purge and b.write and not b.list_only:
        tables |= V.purge(tables, b.provider)
    listings = t["listings"].where(F.col("release_year").isin(list(b.years))) if b.years else t["listings"]
    if b.most_items is not None:
        nth = F.row_number().over(W.partitionBy("release_year").orderBy(F.desc_nulls_last("listed"), "row_id"))
        listings = listings.withColumn("__nth", nth).where(F.col("__nth") <= b.most_items).drop("__nth")
    games = tables["games"]
    local = games.select("game_id", X.title_import(F.col("title")).alias("norm"), "release_year", X.year_tag(F.col("title"))[1].alias("tag_year"))
    rows = listings.select("row_id", X.title_import(F.col("title")).alias("norm"), F.col("release_year").alias("year"))
    found = listings.select("row_id", "listed").join(I.resolve_titles(rows, local), "row_id", "left")
    if b.missing_only:
        reasons = G.no_provider_reasons(found, G.without_provider(games, tables["reviews"], b.provider), b)
    else:
        own = G.provider_counts(tables["reviews"], b.provider)
        counts = games.select("game_id").join(own, "game_id", "left").select("game_id", F.coalesce("n_other", F.lit(0)).alias("existing"))
        samples = None
        if b.target_samples:
            samples = G.sample_targets(of_version(t["score_snapshots"], o.scoring.version), tables["reviews"], b.provider, b.target_samples)
        reasons = G.backfill_reasons(found, counts, b, samples)
    out = {"backfill_reasons": reasons.select("row_id", "game_id", "listed", "reason")}
    if b.list_only or not b.write:
        return out
    chosen = G.with_suffix(reasons.where("reason = 'selected'").select("row_id", "game_id"))
    batch = listings.drop("game_id").join(chosen, "row_id")
    reviews = t["listing_reviews"].join(batch.select("external_id", "game_id").distinct(), "external_id")
    return out | {n: f for n, f in tables.items() if n != "sources"} | V.write_games(tables, batch, reviews, b.provider) | {"sources": _with_sources(tables["sources"], t["listing_reviews"])}


def _with_sources(sources: DataFrame, reviews: DataFrame) -> DataFrame:
    """The sources with the outlets of new reviews."""
    name = X.outlet(F.col("outlet"))
    new = reviews.where("score is not null").select(X.minted("src-", name, size=12).alias("source_id"), name.alias("name"), F.lit("media").alias("source_type")).distinct()
    return sources.unionByName(_shaped(new.join(sources.select("source_id"), "source_id", "left_anti"), sources))


def repaired(t: Tables, o: RunOptions) -> Tables:
    """Items whose product is accepted take its reviews in the place of the archive's, where there are more of them; with
    ``metadata`` those without a year take its title and year alone. ``list_only``, or no ``write``: the verdicts alone."""
    r, scores = o.repair, of_version(t["score_snapshots"], o.scoring.version)
    tables = {n: t[n] for n in _STORE}
    if r.metadata:
        targets = G.metadata_targets(scores, tables["games"], tables["reviews"], tables["game_identity"], r).withColumn("release_year", F.lit(None).cast("int"))
    else:
        targets = G.repair_targets(scores, tables["games"], tables["reviews"], r)
    slugs = t["overrides"] if "overrides" in t else t["products"].sparkSession.createDataFrame([], "key string, slug string")
    named = G.with_slugs(targets.select("game_id", "title", "release_year"), slugs)
    verdicts = G.accepted_products(named, t["products"], r.year_tolerance)
    out = {"repair_verdicts": verdicts}
    if r.list_only or not r.write:
        return out
    batch = verdicts.where("accepted").select("game_id", "slug").join(t["products"].withColumnsRenamed({"product_title": "title", "product_year": "release_year"}), "slug")
    batch = batch.withColumn("identity_suffix", F.lit(None).cast("string"))
    if r.metadata:
        return out | V.write_metadata(tables, batch, r.web)
    new = t["product_reviews"].join(batch.select("slug", "game_id"), "slug")
    numeric = new.where("score is not null").groupBy("game_id").agg(F.count("*").alias("numeric"))
    have = tables["reviews"].where(F.col("data_source").isin(r.archive, r.web) & F.col("score").isNotNull()).groupBy("game_id").agg(F.count("*").alias("have"))
    worth = batch.join(numeric, "game_id", "left").join(have, "game_id", "left").where(G.worth_repair(F.col("listed"), F.col("numeric"), F.col("have"), r.least_listed)).select("game_id")
    batch, new = batch.join(worth, "game_id", "left_semi"), new.join(worth, "game_id", "left_semi")
    written = V.write_games(tables, batch, new.limit(0), r.web)
    reviews = V.replace_reviews(tables["reviews"], _shaped(V.numeric_reviews(new, r.web), tables["reviews"]), (r.archive, r.web))
    return out | written | {"reviews": reviews, "sources": _with_sources(tables["sources"], new)}


def metrics_step(t: Tables, o: RunOptions) -> Tables:
    return {"source_metrics": with_version(t.get("source_metrics"), source_metrics(t["score_counts"], t["games"], o.scoring), o.scoring.version)}


def weights_step(t: Tables, o: RunOptions) -> Tables:
    cover = coverage(t["score_counts"], t["games"], "genres", "platforms")
    return {"weights": with_version(t.get("weights"), weights(of_version(t["source_metrics"], o.scoring.version), cover, o.scoring), o.scoring.version)}


def snapshots_step(t: Tables, o: RunOptions) -> Tables:
    metrics, own = (of_version(t[n], o.scoring.version) for n in ("source_metrics", "weights"))
    return {"score_snapshots": with_version(t.get("score_snapshots"), snapshots(t["score_counts"], t["games"], metrics, own, o.scoring), o.scoring.version)}


def documents(t: Tables, o: RunOptions) -> Tables:
    """What is published, as (key, json): a document of each item and source, and the totals."""
    v = o.scoring.version
    scores, metrics, own = (of_version(t[n], v) for n in ("score_snapshots", "source_metrics", "weights"))
    games, reviews, sources = t["games"], t["reviews"], t["sources"]
    items = P.item_detail(P.item_list(games, scores), reviews, sources, own)
    shown = P.source_detail(
        P.source_list(sources, metrics, own, reviews), P.recent_reviews(reviews, games), P.shown_weights(own), coverage(review_counts(reviews), games, "genres")
    )
    return {
        "item_documents": P.as_documents(items, "game_id"), "source_documents": P.as_documents(shown, "source_id"),
        "meta_documents": P.as_documents(P.meta(games, reviews, sources).withColumn("version", F.lit(v)), "version"),
    }


#: Counts, metrics, weights and scores, each computed once and read by what follows.
SCORING = [
    Step("counts", lambda t, o: {"score_counts": of_items(score_counts(t["reviews"]), t["games"])}, ("reviews", "games"), ("score_counts",)),
    Step("metrics", metrics_step, ("score_counts", "games", "source_metrics?"), ("source_metrics",)),
    Step("weights", weights_step, ("score_counts", "games", "source_metrics", "weights?"), ("weights",)),
    Step("scores", snapshots_step, ("score_counts", "games", "source_metrics", "weights", "score_snapshots?"), ("score_snapshots",)),
]
#: From files to published documents. Backfill and repair choose by the scores of the run before.
WHOLE = [
    Step("import", imported, ("raw_reviews", "raw_dates?", *_STORE), _STORE),
    Step("catalog", enriched, ("catalog", "games", "game_identity"), ("games",), optional=True),
    Step("backfill", backfilled, ("listings", "listing_reviews", "score_snapshots", *_STORE), (*_STORE, "backfill_reasons"), optional=True),
    Step("repair", repaired, ("products", "product_reviews", "overrides?", "score_snapshots", *_STORE), (*_STORE, "repair_verdicts"), optional=True),
    Step("duplicates", without_duplicates, ("games", "reviews", "game_identity", "external_baseline"), ("games", "reviews", "game_identity", "external_baseline")),
    Step("mock", without_mock, ("reviews", "external_baseline", "sources"), ("reviews", "external_baseline", "sources"), when=lambda o: not o.mock),
    Step("platforms", with_platforms, ("games", "reviews"), ("reviews",)),
    *SCORING,
    Step("documents", documents, ("games", "reviews", "sources", "source_metrics", "weights", "score_snapshots"), ("item_documents", "source_documents", "meta_documents"), when=lambda o: o.publish),
]
