"""Provider targets, title resolution, duplicate identities and the write path over the testbed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators import identity as I
from tallyforge.operators import provider as P
from tallyforge.operators import targets as G
from tallyforge.params import BackfillOptions, RepairOptions
from tallyforge.operators.runtime import spread
from tallyforge.plans.registry import query
from tallyforge.plans.resolve import _EDGES, _KEYED, _REACH
from tallyforge.plans.scoring import BASE, snapshots_of
from tallyforge.sources import testbed as T
from tallyforge.sources.testbed import BASELINES, GAMES, REVIEWS, with_

_BY = """by_provider as (select game_id, count(*) filter (where data_source = 'alpha') as n_alpha, count(*) filter (where data_source = 'beta') as n_beta, count(*) filter (where data_source = 'gamma') as n_gamma from tagged group by 1)"""
# every seventh item has reviews of one provider alone, every eleventh of a third
_TAGGED = """tagged as (select review_id, game_id, score, case when game_id % 7 = 0 then 'beta' when game_id % 11 = 0 and review_id like '%1' then 'gamma' else data_source end as data_source from reviews)"""
_IDENT = """identities as (select o_orderkey as identity_id, o_custkey as game_id, case o_orderkey % 3 when 0 then 'alpha' when 1 then 'beta' end as source_name, case when o_orderkey % 4 = 0 then null else cast(o_orderkey % 2 as varchar) end as external_id,
 case when o_orderstatus = 'F' then null else 'https://x.org/' || o_orderkey end as external_url, case when o_orderkey % 5 = 0 then null else 's-' || o_orderkey end as external_slug,
 [0.7, 0.85, 0.95, null][1 + o_orderkey % 4] as match_confidence, o_orderdate as updated_at from orders)"""


def _tagged(spark, sf_dir):
    r, third = T.reviews(spark, sf_dir), (F.col("game_id") % 11 == 0) & F.col("review_id").endswith("1")
    return r.withColumn("data_source", F.when(F.col("game_id") % 7 == 0, "beta").when(third, "gamma").otherwise(F.col("data_source")))


def _identities(spark, sf_dir):
    k = F.col("o_orderkey")
    sure = F.get(F.array(*(F.lit(x).cast("double") for x in (0.7, 0.85, 0.95, None))), (k % 4).cast("int"))
    return T.table(spark, sf_dir, "orders").select(
        k.alias("identity_id"), F.col("o_custkey").alias("game_id"), F.when(k % 3 == 0, "alpha").when(k % 3 == 1, "beta").alias("source_name"),
        F.when(k % 4 != 0, (k % 2).cast("string")).alias("external_id"), F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("https://x.org/"), k.cast("string"))).alias("external_url"),
        F.when(k % 5 != 0, F.concat(F.lit("s-"), k.cast("string"))).alias("external_slug"), sure.alias("match_confidence"), F.col("o_orderdate").alias("updated_at"),
    )


@query("q_provider_gaps", with_(GAMES, REVIEWS, _TAGGED, _BY, body="select game_id, n_beta + n_gamma as other from games join by_provider using (game_id) where n_alpha = 0 and n_beta + n_gamma > 0"))
def q_provider_gaps(spark, sf_dir):
    return G.without_provider(T.games(spark, sf_dir), _tagged(spark, sf_dir), "alpha")


@query("q_target_samples", with_(*BASE, _TAGGED, _BY, body="select game_id, sample_count, n_alpha as own, n_beta + n_gamma as other from snapshots join by_provider using (game_id) where sample_count in (20, 25, 30)"))
def q_target_samples(spark, sf_dir):
    return G.sample_targets(snapshots_of(spark, sf_dir), _tagged(spark, sf_dir), "alpha", {20, 25, 30})


@query("q_repair_targets", with_(*BASE, _TAGGED, _BY, body="""select game_id, title, sample_count, n_alpha, n_beta, n_gamma from snapshots join games using (game_id) join by_provider using (game_id)
 where n_alpha > 0 and n_gamma = 0 and sample_count between 20 and 32 order by weighted_score desc, title, game_id limit 200"""))
def q_repair_targets(spark, sf_dir):
    o = RepairOptions("alpha", "beta", "gamma", frozenset(range(20, 33)), only_without_rival=True, limit=200)
    return G.repair_targets(snapshots_of(spark, sf_dir), T.games(spark, sf_dir), _tagged(spark, sf_dir), o).select("game_id", "title", "sample_count", "n_alpha", "n_beta", "n_gamma")


@query("q_metadata_targets", with_(*BASE, _TAGGED, _BY, _IDENT, body="""select game_id, sample_count, n_gamma, cast(0 as int) as has_identity from snapshots join games using (game_id) join by_provider using (game_id)
 where game_id % 2 = 0 and weighted_score >= 40 and sample_count >= 10 and n_gamma > 0 and game_id not in (select game_id from identities where source_name = 'beta')"""))
def q_metadata_targets(spark, sf_dir):
    games = T.games(spark, sf_dir).withColumn("release_year", F.when(F.col("game_id") % 2 != 0, F.col("release_year")))
    o = RepairOptions("alpha", "beta", "gamma", least_score=40.0, least_sample=10, require_rival=True, skip_existing_identity=True)
    return G.metadata_targets(snapshots_of(spark, sf_dir), games, _tagged(spark, sf_dir), _identities(spark, sf_dir), o).select("game_id", "sample_count", "n_gamma", "has_identity")


# a provider's listing: titles of the items with their number, some with a year that is off, some that stand for two
_LOCAL = "local_ as (select game_id, title || ' ' || (game_id // 2) as norm, case when game_id % 5 = 0 then null else release_year end as release_year, case when game_id % 10 = 0 then release_year end as tag_year from games)"
_LISTING = """listing as (select game_id as row_id, case when game_id % 9 = 0 then 'both ' || (game_id // 2) else title || ' ' || (game_id // 2) end as norm, cast(case when game_id % 4 = 0 then null else release_year + game_id % 3 end as int) as year, game_id % 40 as listed from games),
aliases as (select 'both ' || (game_id // 2) as norm, title || ' ' || (game_id // 2) as other from games)"""
_RESOLVED = """of_year as (select norm, release_year as year, max(game_id) as game_id from local_ where release_year is not null group by 1, 2), alone as (select norm, min(game_id) as game_id from local_ group by 1 having count(distinct game_id) = 1),
asked as (select row_id, norm, year, 0 as turn from listing union all select row_id, other, year, 1 from listing join (select distinct * from aliases) using (norm)),
met as (select row_id, turn, game_id, year from asked join of_year using (norm, year) union select row_id, turn, game_id, year from asked join alone using (norm)),
near as (select distinct row_id, turn, game_id from met join local_ using (game_id) where year is null or coalesce(release_year, tag_year) is null or abs(coalesce(release_year, tag_year) - year) <= 1),
resolved as (select row_id, game_id from near n where turn = 0 or not exists (select 1 from near o where o.row_id = n.row_id and o.turn = 0))"""
_RESOLVE = (GAMES, _LOCAL, _LISTING, _RESOLVED)


def _title(c="title"):
    return F.concat_ws(" ", c, F.floor(F.col("game_id") / 2).cast("string"))


def _local(spark, sf_dir):
    i, y = F.col("game_id"), F.col("release_year")
    return T.games(spark, sf_dir).select("game_id", _title().alias("norm"), F.when(i % 5 != 0, y).alias("release_year"), F.when(i % 10 == 0, y).alias("tag_year"))


def _listing(spark, sf_dir):
    i = F.col("game_id")
    norm = F.when(i % 9 == 0, F.concat_ws(" ", F.lit("both"), F.floor(i / 2).cast("string"))).otherwise(_title())
    return T.games(spark, sf_dir).select(i.alias("row_id"), norm.alias("norm"), F.when(i % 4 != 0, (F.col("release_year") + i % 3).cast("int")).alias("year"), (i % 40).alias("listed"), norm.alias("title"))


def _found(spark, sf_dir):
    aliases = T.games(spark, sf_dir).select(F.concat_ws(" ", F.lit("both"), F.floor(F.col("game_id") / 2).cast("string")).alias("norm"), _title().alias("other")).distinct()
    return I.resolve_titles(_listing(spark, sf_dir), _local(spark, sf_dir), aliases)


@query("q_resolve_titles", with_(*_RESOLVE, body="select * from resolved"))
def q_resolve_titles(spark, sf_dir):
    return _found(spark, sf_dir)


@query("q_resolve_one", with_(*_RESOLVE, body="""select row_id, case when n = 1 then cast(known as varchar) else 'web-' || substr(md5(lower(trim(norm))), 1, 16) end as game_id
 from listing left join (select row_id, count(*) as n, min(game_id) as known from resolved group by 1) using (row_id)"""))
def q_resolve_one(spark, sf_dir):
    return I.resolve_one(_listing(spark, sf_dir), _found(spark, sf_dir), "web-")


_REASONS = """counts as (select game_id, count(*) as existing from reviews where data_source = 'alpha' group by 1), asked2 as (select l.row_id, l.listed, f.game_id from listing l left join resolved f using (row_id)),
reasons as (select row_id, game_id, case when game_id is null or existing is null then 'unmatched' when existing > 18 then 'existing_above_cap' when listed < 6 or listed <= existing then 'low_gain' else 'selected' end as reason from asked2 left join counts using (game_id))"""


def _reasons(spark, sf_dir):
    counts = T.reviews(spark, sf_dir).where("data_source = 'alpha'").groupBy("game_id").agg(F.count("*").alias("existing"))
    asked = _listing(spark, sf_dir).select("row_id", "listed").join(_found(spark, sf_dir), "row_id", "left")
    return G.backfill_reasons(asked, counts, BackfillOptions(most_existing=18, least_listed=6))


@query("q_backfill_reasons", with_(*_RESOLVE[:1], REVIEWS, *_RESOLVE[1:], _REASONS, body="select reason, count(*) as n from reasons group by 1"))
def q_backfill_reasons(spark, sf_dir):
    return _reasons(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@query("q_backfill_selected", with_(*_RESOLVE[:1], REVIEWS, *_RESOLVE[1:], _REASONS, body="select row_id, game_id, case when count(*) over (partition by row_id) > 1 then cast(game_id as varchar) end as identity_suffix from reasons where reason = 'selected'"))
def q_backfill_selected(spark, sf_dir):
    return G.with_suffix(_reasons(spark, sf_dir).where("reason = 'selected'")).select("row_id", "game_id", "identity_suffix")


@query("q_backfill_samples", with_(*BASE, _TAGGED, _BY, _LOCAL, _LISTING, _RESOLVED, """samples as (select game_id, n_alpha as own from snapshots join by_provider using (game_id) where sample_count in (28, 29, 30, 31))""",
    body="""select reason, count(*) as n from (select case when f.game_id is null or c.n_beta is null then 'unmatched' when s.game_id is null then 'not_target_sample' when own > 0 then 'already_has_own' when listed < 6 then 'low_gain' else 'selected' end as reason
 from listing l left join resolved f using (row_id) left join by_provider c on c.game_id = f.game_id left join samples s on s.game_id = f.game_id) group by 1"""))
def q_backfill_samples(spark, sf_dir):
    tagged = _tagged(spark, sf_dir)
    counts = G.provider_counts(tagged, "alpha").select("game_id", F.col("n_other").alias("existing"))
    samples = G.sample_targets(snapshots_of(spark, sf_dir), tagged, "alpha", {28, 29, 30, 31})
    asked = _listing(spark, sf_dir).select("row_id", "listed").join(_found(spark, sf_dir), "row_id", "left")
    return G.backfill_reasons(asked, counts, BackfillOptions(least_listed=6, target_samples=frozenset({28, 29, 30, 31})), samples).groupBy("reason").agg(F.count("*").alias("n"))


@query("q_no_provider_reasons", with_(GAMES, REVIEWS, _TAGGED, _BY, _LOCAL, _LISTING, _RESOLVED, body="""select reason, count(*) as n from (select case when m.game_id is null then 'unmatched' when listed < 6 then 'low_gain' else 'selected' end as reason
 from listing left join resolved using (row_id) left join (select game_id from by_provider where n_alpha = 0) m using (game_id)) group by 1"""))
def q_no_provider_reasons(spark, sf_dir):
    missing = G.without_provider(T.games(spark, sf_dir), _tagged(spark, sf_dir), "alpha")
    asked = _listing(spark, sf_dir).select("row_id", "listed").join(_found(spark, sf_dir), "row_id", "left")
    return G.no_provider_reasons(asked, missing, BackfillOptions(least_listed=6, missing_only=True)).groupBy("reason").agg(F.count("*").alias("n"))


# products under slugs of the items' titles: some of another title, some of another year
_PRODUCTS = """wanted as (select game_id, case when game_id % 6 = 0 then title || ' (' || release_year || ')' else title || ' ' || game_id end as title, case when game_id % 8 = 0 then null else release_year end as release_year, case when game_id % 10 = 0 then 'manual-' || game_id end as manual_slug from games),
products as (select case when game_id % 10 = 0 then 'manual-' || game_id else replace(title, ' ', '-') || '-' || game_id end as slug, case when game_id % 7 = 0 then 'other' else title || ' ' || game_id end as product_title, cast(case when game_id % 9 = 0 then null else release_year - 2 + game_id % 5 end as int) as product_year from games where game_id % 6 <> 0)"""


def _wanted(spark, sf_dir):
    i, t, y = F.col("game_id"), F.col("title"), F.col("release_year")
    named = F.concat_ws(" ", t, i.cast("string"))
    wanted = T.games(spark, sf_dir).select("game_id", F.when(i % 6 == 0, F.concat(t, F.lit(" ("), y.cast("string"), F.lit(")"))).otherwise(named).alias("title"), F.when(i % 8 != 0, y).alias("release_year"), F.when(i % 10 == 0, F.concat_ws("-", F.lit("manual"), i.cast("string"))).alias("manual_slug"))
    slug = F.when(i % 10 == 0, F.concat_ws("-", F.lit("manual"), i.cast("string"))).otherwise(F.replace(named, F.lit(" "), F.lit("-")))
    products = T.games(spark, sf_dir).where(i % 6 != 0).select(slug.alias("slug"), F.when(i % 7 == 0, "other").otherwise(named).alias("product_title"), F.when(i % 9 != 0, (y - 2 + i % 5).cast("int")).alias("product_year"))
    return wanted, products


@query("q_accepted_products", with_(GAMES, _PRODUCTS, body="""select game_id, slug, reason from (select w.game_id, p.slug, case when product_title <> w.title then null when product_year is not null and w.release_year is not null and abs(product_year - w.release_year) <= 1 then 'title_year'
 when product_year < w.release_year then 'title_earlier_year_repair: ' || w.release_year || ' to ' || product_year when product_year is not null and w.release_year is not null then null else 'title_only' end as reason
 from wanted w join products p on p.slug = coalesce(manual_slug, replace(w.title, ' ', '-')) where game_id % 6 <> 0) where reason is not null"""))
def q_accepted_products(spark, sf_dir):
    wanted, products = _wanted(spark, sf_dir)
    return G.accepted_products(wanted, products).where("accepted").select("game_id", "slug", "reason")


@query("q_refused_products", with_(GAMES, _PRODUCTS, body="select count(*) as n, count(*) filter (where game_id % 6 = 0) as tagged from wanted where game_id not in (select game_id from (select w.game_id, case when product_title <> w.title then false when product_year is not null and w.release_year is not null then abs(product_year - w.release_year) <= 1 or product_year < w.release_year else true end as ok from wanted w join products p on p.slug = coalesce(manual_slug, replace(w.title, ' ', '-')) where game_id % 6 <> 0) where ok)"))
def q_refused_products(spark, sf_dir):
    wanted, products = _wanted(spark, sf_dir)
    refused = G.accepted_products(wanted, products).where("not accepted")
    return refused.agg(F.count("*").alias("n"), F.count_if(F.col("game_id") % 6 == 0).alias("tagged"))


@query("q_incomplete", with_(GAMES, "gaps as (select game_id, case when game_id % 3 = 0 then '' else developer end as developer, genres, case when game_id % 4 = 0 then null else platforms end as platforms from games)", body="select game_id from gaps where not (coalesce(developer, '') <> '' and platforms is not null)"))
def q_incomplete(spark, sf_dir):
    i = F.col("game_id")
    g = T.games(spark, sf_dir).withColumns({"developer": F.when(i % 3 == 0, "").otherwise(F.col("developer")), "platforms": F.when(i % 4 != 0, F.array_join("platforms", "|")), "genres": F.array_join("genres", "|")})
    return G.incomplete(g, "developer", "genres", "platforms").select("game_id")


@query("q_worth_repair", with_(BASELINES, GAMES, REVIEWS, _TAGGED, _BY, body="select game_id, max(coalesce(review_count, 0)) as listed from baselines join by_provider using (game_id) where coalesce(review_count, 0) >= 10 and coalesce(review_count, 0) > n_alpha group by 1"))
def q_worth_repair(spark, sf_dir):
    counts = G.provider_counts(_tagged(spark, sf_dir), "alpha")
    rows = T.baselines(spark, sf_dir).join(counts, "game_id").where(G.worth_repair(F.col("review_count"), F.col("review_count"), F.col("n_alpha"), 10))
    return rows.groupBy("game_id").agg(F.max("review_count").alias("listed"))


@query("q_canon_identities", with_(_IDENT, body="""select identity_id, game_id, source_name from (select *, row_number() over (partition by game_id, coalesce(source_name, ''), coalesce(external_id, '') order by coalesce(match_confidence, 0) desc,
 (external_url is not null) desc, (external_slug is not null) desc, updated_at desc nulls last, identity_id desc) as k from identities) where k = 1"""))
def q_canon_identities(spark, sf_dir):
    return I.best_identities(_identities(spark, sf_dir)).select("identity_id", "game_id", "source_name")


_TAGS = """tagged_titles as (select game_id, case when game_id % 6 = 0 then lower(title) || ' (' || release_year || ')' else lower(title) end as title, case when game_id % 4 = 0 then null else release_year end as release_year from games),
parts as (select game_id, release_year, title as key, try_cast(regexp_extract(title, '\\((\\d{4})\\)$', 1) as int) as tag, trim(regexp_replace(title, '\\(\\d{4}\\)$', '')) as base from tagged_titles),
both_ as (select game_id, key, release_year as year from parts p where tag is null and release_year is not null and exists (select 1 from parts t where t.tag = p.release_year and t.base = p.key)
 union all select game_id, base, tag from parts t where tag is not null and exists (select 1 from parts p where p.tag is null and p.release_year = t.tag and p.key = t.base)),
edges as (select distinct game_id as a, lead as b from (select game_id, min(game_id) over (partition by key, year) as lead from both_) where game_id <> lead)"""


def _tagged_titles(spark, sf_dir):
    i, y, low = F.col("game_id"), F.col("release_year"), F.lower("title")
    g = spread(T.games(spark, sf_dir).select("game_id", "title", "release_year"), "game_id").select("game_id", F.when(i % 6 == 0, F.concat(low, F.lit(" ("), y.cast("string"), F.lit(")"))).otherwise(low).alias("title"), F.when(i % 4 != 0, y).alias("release_year"))
    base, year = X.year_tag(F.col("title"))
    return g.withColumns({"key": F.col("title"), "base_key": base, "tag_year": year})


@query("q_canon_tagged", with_(GAMES, _TAGS, body="select a, b from edges"))
def q_canon_tagged(spark, sf_dir):
    return I.tagged_edges(_tagged_titles(spark, sf_dir))


_CHOSEN = """members as (select id, root, title, (cast(id as varchar) like '1%') as first, regexp_matches(title, '\\(\\d{4}\\)$') as tagged, id % 5 as made, coalesce(own, 0) as own, coalesce(n, 0) as n from roots join tagged_titles g on g.game_id = id
 left join (select game_id, count(*) filter (where data_source = 'alpha') as own, count(*) as n from reviews group by 1) r on r.game_id = id),
chosen as (select id as old, canonical from (select id, first_value(id) over (partition by root order by first desc, tagged, own desc, n desc, made, id) as canonical from members) where id <> canonical)"""


def _created(g):
    return g.withColumn("created_at", F.timestamp_seconds(F.col("game_id") % 5))


def _mapping(spark, sf_dir):
    g = _tagged_titles(spark, sf_dir)
    return I.canonical_items(I.tagged_edges(g), _created(g), T.reviews(spark, sf_dir), "alpha", "1")


@query("q_canon_order", _REACH.format(ctes=",\n".join((GAMES, REVIEWS, _TAGS))).replace(", both_ as", ", both2 as").replace("from both_ union select r.a", "from both2 union select r.a").replace("join both_ e", "join both2 e") + ", " + _CHOSEN + " select old, canonical from chosen")
def q_canon_order(spark, sf_dir):
    """Which of a group stays, by six keys."""
    return _mapping(spark, sf_dir)


@query("q_canon_merged", _REACH.format(ctes=",\n".join((GAMES, REVIEWS, _TAGS))).replace(", both_ as", ", both2 as").replace("from both_ union select r.a", "from both2 union select r.a").replace("join both_ e", "join both2 e") + ", " + _CHOSEN + """, filled as (select coalesce(canonical, game_id) as root, (canonical is not null) as gone, game_id,
 case when game_id % 3 = 0 then '' else developer end as developer, platforms from games left join chosen on old = game_id)
 select root as game_id, arg_min(developer, cast(gone as int) * 1000000000::bigint + game_id) filter (where developer <> '') as developer, len(list_distinct(flatten(list(platforms)))) as platforms from filled group by 1""")
def q_canon_merged(spark, sf_dir):
    """The items that stay, with gaps filled and lists united."""
    g = T.games(spark, sf_dir).withColumn("developer", F.when(F.col("game_id") % 3 == 0, "").otherwise(F.col("developer")))
    return I.merged_items(g, _mapping(spark, sf_dir), ["developer"], ["platforms"]).select("game_id", "developer", F.size("platforms").alias("platforms"))


@query("q_canon_repoint_all", _REACH.format(ctes=",\n".join((GAMES, REVIEWS, BASELINES, _KEYED, _EDGES))) + """ select 'reviews' as tab, coalesce(root, game_id) as game_id, count(*) as n from reviews left join roots on id = game_id group by 2
 union all select 'baselines', coalesce(root, game_id), count(*) from baselines left join roots on id = game_id group by 2""")
def q_canon_repoint_all(spark, sf_dir):
    from tallyforge.operators import resolve as R
    from tallyforge.plans.resolve import _keyed

    mapping = R.groups(R.duplicate_edges(_keyed(spark, sf_dir))).select(F.col("id").alias("old"), F.col("root").alias("canonical"))
    moved = I.repoint_all({"reviews": T.reviews(spark, sf_dir), "baselines": T.baselines(spark, sf_dir)}, mapping)
    of = lambda name: moved[name].groupBy("game_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "game_id", "n")
    return of("reviews").unionByName(of("baselines"))


_OUTLETS = "outlets as (select s_suppkey as source_id, case s_suppkey % 6 when 0 then ' IGN.com ' when 1 then 'pcgamer' when 2 then 'PC  Gamer' when 3 then '' when 4 then 'Site ' || (s_suppkey // 12) else s_name end as name, s_nationkey as country_region from supplier)"
_MERGED = """named as (select *, case source_id % 6 when 0 then 'IGN' when 1 then 'PC Gamer' when 2 then 'PC Gamer' when 3 then 'Unknown Source' else name end as canonical from outlets), ided as (select *, 'src-' || substr(md5(canonical), 1, 12) as target from named)"""


def _outlets(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.when(k % 6 == 0, " IGN.com ").when(k % 6 == 1, "pcgamer").when(k % 6 == 2, "PC  Gamer").when(k % 6 == 3, "").when(k % 6 == 4, F.concat_ws(" ", F.lit("Site"), F.floor(k / 12).cast("string"))).otherwise(F.col("s_name"))
    return T.table(spark, sf_dir, "supplier").select(k.cast("string").alias("source_id"), name.alias("name"), F.col("s_nationkey").alias("country_region"))


@query("q_source_merge", with_(_OUTLETS, _MERGED, body="select target as source_id, canonical as name, country_region from (select *, row_number() over (partition by target order by cast(source_id as varchar)) as k from ided) where k = 1"))
def q_source_merge(spark, sf_dir):
    return I.merged_sources(_outlets(spark, sf_dir))[0]


@query("q_source_repoint", with_(_OUTLETS, _MERGED, REVIEWS, body="select target as source_id, count(*) as n from reviews r join ided i on i.source_id = r.source_id group by 1"))
def q_source_repoint(spark, sf_dir):
    mapping = I.merged_sources(_outlets(spark, sf_dir))[1]
    rows = T.reviews(spark, sf_dir).withColumn("source_id", F.col("source_id").cast("string"))
    return I.repoint_all({"reviews": rows}, mapping, ("source_id",))["reviews"].groupBy("source_id").agg(F.count("*").alias("n"))


@query("q_provider_pairs", with_(_IDENT, body="select distinct a.source_name as left, b.source_name as right from identities a, (select distinct source_name from identities) b where a.source_name < b.source_name"))
def q_provider_pairs(spark, sf_dir):
    return I.provider_pairs(_identities(spark, sf_dir))


@query("q_match_review", with_(_IDENT, body="""select identity_id, conf as confidence, (conf is null) as needs_manual_review from identities left join (select identity_id, max(conf) as conf from
 (select a.identity_id, a.match_confidence as conf from identities a where match_confidence >= 0.85 union all select identity_id + 1, match_confidence from identities where match_confidence >= 0.85) group by 1) using (identity_id)"""))
def q_match_review(spark, sf_dir):
    ident = _identities(spark, sf_dir)
    pairs = ident.where("match_confidence >= 0.85").select(F.col("identity_id").alias("a_id"), (F.col("identity_id") + 1).alias("b_id"), F.col("match_confidence").alias("confidence"), F.lit("m").alias("method"))
    return I.with_matches(ident, pairs).select("identity_id", "confidence", "needs_manual_review")


# a provider's batch: products of every third item, with reviews of which some have no score
_BATCH = """products as (select game_id, cast(game_id as varchar) as external_id, upper(title) as title, cast(release_year - 1 as int) as release_year, game_id % 50 as listed, case when game_id % 2 = 0 then cast(game_id as varchar) end as suffix from games where game_id % 3 = 0),
fresh as (select game_id, l_orderkey || '-' || l_linenumber as rid, case when l_quantity < 10 then null else l_quantity * 2 end as score, l_shipdate as review_date from lineitem join products on game_id = l_partkey)"""


def _batch(spark, sf_dir):
    i = F.col("game_id")
    products = T.games(spark, sf_dir).where(i % 3 == 0).select(
        i.cast("string").alias("game_id"), i.cast("string").alias("external_id"), F.upper("title").alias("title"), (F.col("release_year") - 1).cast("int").alias("release_year"),
        (i % 50).alias("listed"), F.lit(80.0).alias("listed_score"), F.lit("s").alias("slug"), F.lit("u").alias("url"), F.when(i % 2 == 0, i.cast("string")).alias("identity_suffix"),
        F.timestamp_seconds(F.lit(5)).alias("collected_at"),
    )
    line = T.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("game_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("external_review_id"), F.when(F.col("l_quantity") >= 10, F.col("l_quantity") * 2.0).alias("score"),
        F.lit("IGN").alias("outlet"), F.col("l_shipdate").cast("date").alias("review_date"),
    )
    games = T.games(spark, sf_dir).select(i.cast("string").alias("game_id"), "title", "release_year", F.when(i % 4 == 0, "").otherwise(F.col("developer")).alias("developer"))
    rows = T.reviews(spark, sf_dir).select("review_id", i.cast("string").alias("game_id"), F.col("source_id").cast("string").alias("source_id"), "score", F.col("review_date").cast("date").alias("review_date"), "data_source")
    tables = {
        "games": games, "reviews": rows,
        "game_identity": P.identity_rows(products, "web", "old").limit(0), "external_baseline": P.baseline_rows(products, "web").limit(0),
    }
    return tables, products, line.join(products.select("game_id"), "game_id", "left_semi")


@query("q_write_games", with_(GAMES, REVIEWS, _BATCH, body="""select 'games' as tab, count(*) as n, sum(least(g.release_year, p.release_year)) as total from games g left join products p using (game_id) union all select 'game_identity', count(*), count(distinct external_id || coalesce(suffix, '')) from products
 union all select 'external_baseline', count(*), sum(listed) from products union all select 'reviews', (select count(*) from reviews) + (select count(*) from (select distinct game_id, rid from fresh where score is not null)), (select count(*) from (select distinct game_id, rid from fresh where score is not null))"""))
def q_write_games(spark, sf_dir):
    t = P.write_games(*_batch(spark, sf_dir), "web")
    said = lambda name, total: t[name].agg(F.count("*").alias("n"), total.cast("long").alias("total")).select(F.lit(name).alias("tab"), "n", "total")
    return (
        said("games", F.sum("release_year")).unionByName(said("game_identity", F.count_distinct("identity_id")))
        .unionByName(said("external_baseline", F.sum("review_count"))).unionByName(said("reviews", F.count_if(F.col("data_source") == "web")))
    )


@query("q_write_metadata", with_(GAMES, _BATCH, body="select cast(g.game_id as varchar) as game_id, case when p.release_year <= g.release_year then p.release_year else g.release_year end as release_year, case when g.game_id % 4 = 0 then '' else developer end as developer from games g left join products p using (game_id)"))
def q_write_metadata(spark, sf_dir):
    tables, products, _ = _batch(spark, sf_dir)
    return P.write_metadata(tables, products, "web")["games"].select("game_id", "release_year", "developer")


@query("q_replace_reviews", with_(REVIEWS, body="select game_id, data_source, count(*) as n from (select game_id, data_source from reviews where not (data_source = 'beta' and game_id in (select game_id from reviews where game_id % 3 = 0 and data_source = 'alpha')) union all select game_id, 'beta' from reviews where game_id % 3 = 0 and data_source = 'alpha') group by 1, 2"))
def q_replace_reviews(spark, sf_dir):
    r = T.reviews(spark, sf_dir).select("review_id", "game_id", "score", "data_source")
    new = r.where("game_id % 3 = 0 and data_source = 'alpha'").withColumn("data_source", F.lit("beta")).withColumn("review_id", F.concat("review_id", F.lit("x")))
    return P.replace_reviews(r, new, ("beta",)).groupBy("game_id", "data_source").agg(F.count("*").alias("n"))


@query("q_set_columns", with_(GAMES, body="select game_id, title, case when game_id % 2 = 0 then case when game_id % 4 = 0 then 'new' end else developer end as developer from games"))
def q_set_columns(spark, sf_dir):
    g = T.games(spark, sf_dir).select("game_id", "title", "developer")
    new = g.where("game_id % 2 = 0").select("game_id", F.when(F.col("game_id") % 4 == 0, "new").alias("developer"))
    return P.set_columns(g, new, "game_id", "developer")


@query("q_purge", with_(GAMES, REVIEWS, BASELINES, _IDENT, _TAGGED, body="""select 'games' as tab, count(*) as n from games g where not (game_id in (select game_id from identities where source_name = 'beta') and not exists (select 1 from tagged r where r.game_id = g.game_id and r.data_source <> 'beta')
 and not exists (select 1 from identities i where i.game_id = g.game_id and i.source_name is distinct from 'beta') and not exists (select 1 from baselines b where b.game_id = g.game_id and b.source_platform <> '5-LOW' and b.game_id % 2 = 0))
 union all select 'reviews', count(*) from tagged where data_source <> 'beta' union all select 'identities', count(*) from identities where source_name is distinct from 'beta'"""))
def q_purge(spark, sf_dir):
    baselines = T.baselines(spark, sf_dir).where("game_id % 2 = 0 and source_platform <> '5-LOW'")
    t = P.purge({"games": T.games(spark, sf_dir), "reviews": _tagged(spark, sf_dir), "external_baseline": baselines, "game_identity": _identities(spark, sf_dir)}, "beta")
    said = lambda name, shown: t[name].agg(F.count("*").alias("n")).select(F.lit(shown).alias("tab"), "n")
    return said("games", "games").unionByName(said("reviews", "reviews")).unionByName(said("game_identity", "identities"))


@query("q_purge_mock", with_(REVIEWS, T.SOURCES, body="select source_id from sources where source_id in (select source_id from reviews where data_source <> 'beta' and game_id % 3 = 0)"))
def q_purge_mock(spark, sf_dir):
    r = T.reviews(spark, sf_dir)
    t = P.purge_rows({"reviews": r, "sources": T.sources(spark, sf_dir)}, {"reviews": (F.col("data_source") == "beta") | (F.col("game_id") % 3 != 0)})
    return t["sources"].select("source_id")


@query("q_mean_baselines", with_(REVIEWS, body="select game_id, round(avg(score), 2) as external_score, count(*) as review_count from reviews group by 1"))
def q_mean_baselines(spark, sf_dir):
    return P.mean_baselines(T.reviews(spark, sf_dir))


@query("q_known_titles", with_(GAMES, "wanted as (select unnest(['red widget', 'none', 'small ring', 'hot gear']) as title, unnest([0, 1, 2, 3]) as position)", body="select position, title, min(game_id) as game_id from games join wanted using (title) group by 1, 2"))
def q_known_titles(spark, sf_dir):
    return P.known_titles(["red widget", "none", "small ring", "hot gear"], T.games(spark, sf_dir))
