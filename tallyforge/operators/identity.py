"""Provider titles to items, and duplicate items, sources and identities to one of each.

Keys that are null or empty match nothing; repeated rows are taken once; of equal candidates the smallest id counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators.resolve import canonical, groups
from tallyforge.operators.runtime import large
from tallyforge.operators.tables import first_of_each, repoint

# Provider titles that stand for several items.
COMBINED = (("pokemon scarlet and violet", "pokemon scarlet"), ("pokemon scarlet and violet", "pokemon violet"))


def resolve_titles(rows: DataFrame, games: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(row_id, game_id) of the items that provider rows (row_id, norm, year) mean.

    An item is meant if it is the last of that title and year, or the only one of that title; not if both years are
    known and differ by more than one. A row without such an item is asked again under the titles that ``aliases``
    (norm, other) give it. Games are (game_id, norm, release_year, tag_year); a missing year is that of the title's tag.
    """
    local = games.where("norm <> ''").select("game_id", "norm", "release_year", F.coalesce("release_year", "tag_year").alias("local_year"))
    of_year = local.where("release_year is not null").groupBy("norm", F.col("release_year").alias("year")).agg(F.max("game_id").alias("game_id"))
    alone = local.groupBy("norm").agg(F.count_distinct("game_id").alias("n"), F.min("game_id").alias("game_id")).where("n = 1").select("norm", "game_id")
    years = local.select("game_id", "local_year").distinct()

    def asked(r: DataFrame) -> DataFrame:
        both = r.join(of_year, ["norm", "year"]).select("row_id", "game_id", "year").unionByName(r.join(alone, "norm").select("row_id", "game_id", "year"))
        near = F.col("year").isNull() | F.col("local_year").isNull() | (F.abs(F.col("local_year") - F.col("year")) <= 1)
        return both.join(years, "game_id").where(near).select("row_id", "game_id").distinct()

    r = rows.where("norm <> ''").select("row_id", "norm", "year")
    direct = asked(r)
    if aliases is None:
        aliases = rows.sparkSession.createDataFrame(list(COMBINED), "norm string, other string")
    again = r.join(direct.select("row_id").distinct(), "row_id", "left_anti").join(F.broadcast(aliases), "norm").select("row_id", F.col("other").alias("norm"), "year")
    return direct.unionByName(asked(again))


def resolve_one(rows: DataFrame, found: DataFrame, prefix: str, title: str = "title") -> DataFrame:
    """(row_id, game_id): the one item that a row means, or an id minted from its title where it means none or several.

    Minted ids depend on the title alone, so rows of one run agree without seeing each other.
    """
    one = found.groupBy("row_id").agg(F.count("*").alias("n"), F.min(F.col("game_id").cast("string")).alias("known"))
    return rows.join(one, "row_id", "left").select("row_id", F.when(F.col("n") == 1, F.col("known")).otherwise(X.minted(prefix, F.lower(F.trim(title)))).alias("game_id"))


def best_identities(rows: DataFrame) -> DataFrame:
    """One identity for each item, provider and external id: the surest, with a URL, with a slug, the newest, the last."""
    keyed = rows.withColumns({"__source": F.coalesce("source_name", F.lit("")), "__external": F.coalesce(F.col("external_id").cast("string"), F.lit(""))})
    order = (
        F.desc(F.coalesce("match_confidence", F.lit(0.0))), F.desc(F.col("external_url").isNotNull()), F.desc(F.col("external_slug").isNotNull()),
        F.desc_nulls_last("updated_at"), F.desc("identity_id"),
    )
    return first_of_each(keyed, ["game_id", "__source", "__external"], *order).drop("__source", "__external")


def tagged_edges(games: DataFrame) -> DataFrame:
    """(a, b): items whose title ends in a year, with the plain-titled items of that title and year.

    Games are (game_id, key, base_key, tag_year, release_year); each group is joined with its smallest id.
    """
    tagged = games.where("tag_year is not null and base_key <> ''").select("game_id", F.col("base_key").alias("key"), F.col("tag_year").alias("year"))
    plain = games.where("tag_year is null and key <> '' and release_year is not null").select("game_id", "key", F.col("release_year").alias("year"))
    both = plain.join(tagged.select("key", "year").distinct(), ["key", "year"], "left_semi").unionByName(tagged.join(plain.select("key", "year").distinct(), ["key", "year"], "left_semi"))
    lead = both.groupBy("key", "year").agg(F.min("game_id").alias("lead"))
    return both.join(lead, ["key", "year"]).where("game_id <> lead").select(F.col("game_id").alias("a"), F.col("lead").alias("b")).distinct()


def canonical_items(edges: DataFrame, games: DataFrame, reviews: DataFrame, provider: str, prefix: str) -> DataFrame:
    """(old, canonical): each group's items but the one that stays.

    That is the first by: an id with ``prefix``, a title without a year tag, most reviews of ``provider``, most reviews,
    the oldest, the smallest id. Games are (game_id, title, created_at).
    """
    counts = reviews.groupBy(F.col("game_id").alias("id")).agg(F.count_if(F.col("data_source") == provider).alias("own"), F.count("*").alias("n"))
    tag = X.year_tag(F.col("title"))[1].isNotNull()
    facts = games.select(F.col("game_id").alias("id"), F.col("game_id").cast("string").startswith(prefix).alias("first"), F.coalesce(tag, F.lit(False)).alias("tagged"), "created_at")
    members = groups(edges).join(large(facts), "id").join(large(counts), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return canonical(members, F.desc("first"), F.asc("tagged"), F.desc(zero("own")), F.desc(zero("n")), F.asc_nulls_first("created_at"), F.asc("id"))


def merged_items(games: DataFrame, mapping: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
    """The items that stay, their gaps filled from those merged into them: the first value that isn't empty of each
    scalar, and each list's distinct values in order; the item that stays comes first, then the others by id."""
    m = games.join(mapping.select(F.col("old").alias("game_id"), "canonical"), "game_id", "left")
    m = m.select(F.coalesce("canonical", "game_id").alias("root"), F.struct(F.col("canonical").isNotNull(), F.col("game_id")).alias("ord"), *scalars, *lists)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    first = [F.min_by(F.col(c), F.when(filled(c), F.col("ord"))).alias(c) for c in scalars]
    both = [F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("v")))).alias(c) for c in lists]
    out = m.groupBy("root").agg(*first, *both)
    return out.select(F.col("root").alias("game_id"), *scalars, *(F.array_distinct(F.flatten(F.filter(F.transform(c, lambda x: x["v"]), lambda v: v.isNotNull()))).alias(c) for c in lists))


def merged_sources(sources: DataFrame, prefix: str = "src-") -> tuple[DataFrame, DataFrame]:
    """(sources, mapping): one source for each canonical name, under an id minted from that name.

    A row that has the id already gives the other columns, else the first by id. ``mapping`` is (old, canonical) of ids
    that go; references are re-pointed by it, and derived metrics and weights of the old ids dropped.
    """
    name = X.outlet(F.col("name"))
    named = sources.withColumn("__name", name).withColumn("__id", X.minted(prefix, F.col("__name"), size=12))
    seed = first_of_each(named, ["__id"], F.desc(F.col("source_id").cast("string") == F.col("__id")), F.asc("source_id"))
    kept = seed.withColumn("source_id", F.col("__id")).withColumn("name", F.col("__name")).select(sources.columns)
    old = named.select(F.col("source_id").cast("string").alias("old"), F.col("__id").alias("canonical")).where("old <> canonical").distinct()
    return kept, old


def repoint_all(tables: dict[str, DataFrame], mapping: DataFrame, columns: tuple[str, ...] = ("game_id",)) -> dict[str, DataFrame]:
    """Every table with the old ids replaced in those of ``columns`` that it has."""
    out = {}
    for name, frame in tables.items():
        for c in columns:
            if c in frame.columns:
                frame = repoint(frame, mapping, c)
        out[name] = frame
    return out


def provider_pairs(identities: DataFrame) -> DataFrame:
    """(left, right): the pairs of providers that have identities, each once; as few rows as providers allow."""
    names = identities.where("source_name is not null").groupBy("source_name").agg(F.count("*").alias("n"))
    return names.select(F.col("source_name").alias("left")).join(names.select(F.col("source_name").alias("right")), F.col("left") < F.col("right"))


def with_matches(identities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Identities with the confidence and method of their best match; those in none are marked for review.

    ``pairs`` are (a_id, b_id, confidence, method); an identity may be on either side. Without pairs nothing is marked.
    """
    side = lambda c: pairs.select(F.col(c).alias("identity_id"), "confidence", "method")
    best = first_of_each(side("a_id").unionByName(side("b_id")), ["identity_id"], F.desc("confidence"), F.asc("method"))
    any_ = F.lit(not pairs.isEmpty())
    return identities.join(best, "identity_id", "left").withColumn("needs_manual_review", F.col("method").isNull() & any_)
