"""Upserts, merges, backfills, target selections and reports over the testbed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators import tables as K
from tallyforge.operators.runtime import spread
from tallyforge.plans.browse import items_of
from tallyforge.plans.registry import query
from tallyforge.plans.scoring import BASE
from tallyforge.sources import testbed as T
from tallyforge.sources.testbed import BASELINES, GAMES, REVIEWS, with_

_OLD = "old as (select game_id, title, release_year, case when game_id % 4 = 0 then '' else developer end as developer from games where game_id % 3 <> 0)"
_NEW = "new as (select game_id, upper(title) as title, cast(release_year - 1 + game_id % 3 as int) as release_year, developer || '!' as developer, game_id as line_no from games where game_id % 2 = 0)"
_G = (GAMES, _OLD, _NEW)


def _old(spark, sf_dir):
    g = T.games(spark, sf_dir).where("game_id % 3 <> 0")
    return g.select("game_id", "title", "release_year", F.when(F.col("game_id") % 4 == 0, "").otherwise(F.col("developer")).alias("developer"))


def _new(spark, sf_dir):
    g = T.games(spark, sf_dir).where("game_id % 2 = 0")
    year = (F.col("release_year") - 1 + F.col("game_id") % 3).cast("int")
    return g.select("game_id", F.upper("title").alias("title"), year.alias("release_year"), F.concat("developer", F.lit("!")).alias("developer"), F.col("game_id").alias("line_no"))


@query("q_upsert", with_(*_G, body="select game_id, title, release_year, developer from new union all select * from old where game_id not in (select game_id from new)"))
def q_upsert(spark, sf_dir):
    return K.upsert(_old(spark, sf_dir), _new(spark, sf_dir), ["game_id"], "line_no")


@query("q_insert_ignore", with_(*_G, body="select * from old union all select game_id, title, release_year, developer from new where game_id not in (select game_id from old)"))
def q_insert_ignore(spark, sf_dir):
    return K.insert_ignore(_old(spark, sf_dir), _new(spark, sf_dir), ["game_id"], "line_no")


@query("q_merge_games", with_(*_G, body="select game_id, coalesce(o.title, n.title) as title, least(o.release_year, n.release_year) as release_year, coalesce(o.developer, n.developer) as developer from old o full join new n using (game_id)"))
def q_merge_games(spark, sf_dir):
    return K.merge(_old(spark, sf_dir), _new(spark, sf_dir).drop("line_no"), ["game_id"], K.earlier_year())


@query("q_repair_metadata", with_(*_G, body="""select game_id, coalesce(o.title, n.title) as title, case when n.release_year is not null and (o.release_year is null or n.release_year <= o.release_year) then n.release_year else o.release_year end as release_year,
 coalesce(nullif(o.developer, ''), n.developer) as developer from old o full join new n using (game_id)"""))
def q_repair_metadata(spark, sf_dir):
    return K.merge(_old(spark, sf_dir), _new(spark, sf_dir).drop("line_no"), ["game_id"], {**K.repaired_year(), "developer": K.fill_empty("developer")})


@query("q_replace_provider", with_(REVIEWS, body="select review_id, score, data_source from reviews where data_source <> 'beta' union all select review_id || 'x', score, 'beta' from reviews where data_source = 'alpha' and game_id % 10 = 0"))
def q_replace_provider(spark, sf_dir):
    r = T.reviews(spark, sf_dir).select("review_id", "score", "data_source", "game_id")
    new = r.where("data_source = 'alpha' and game_id % 10 = 0").select(F.concat("review_id", F.lit("x")).alias("review_id"), "score", F.lit("beta").alias("data_source"))
    return K.replace_scope(r.drop("game_id"), new, F.col("data_source") == "beta")


@query("q_orphans", with_(GAMES, REVIEWS, BASELINES, body="select game_id from games g where not exists (select 1 from baselines b where b.game_id = g.game_id and b.review_count is not null) and not exists (select 1 from reviews r where r.game_id = g.game_id and r.score > 98)"))
def q_orphans(spark, sf_dir):
    return K.orphans(T.games(spark, sf_dir), "game_id", T.baselines(spark, sf_dir).where("review_count is not null"), T.reviews(spark, sf_dir).where("score > 98")).select("game_id")


@query("q_changed_scores", with_(REVIEWS, body="select review_id from reviews where abs(score - round(score / 7) * 7) >= 1e-9"))
def q_changed_scores(spark, sf_dir):
    return T.reviews(spark, sf_dir).where(K.changed(F.col("score"), F.round(F.col("score") / 7) * 7)).select("review_id")


_BACK = "blank as (select review_id, game_id, case when game_id % 3 = 0 then null else platform end as platform from reviews)"


def _blank(spark, sf_dir):
    return T.reviews(spark, sf_dir).withColumn("platform", F.when(F.col("game_id") % 3 != 0, F.col("platform")))


@query("q_backfill_first", with_(GAMES, REVIEWS, _BACK, body="select review_id, coalesce(platform, platforms[1]) as platform from blank left join games using (game_id)"))
def q_backfill_first(spark, sf_dir):
    return _blank(spark, sf_dir).join(T.games(spark, sf_dir), "game_id", "left").select("review_id", F.coalesce("platform", F.get("platforms", F.lit(0))).alias("platform"))


@query("q_backfill_all", with_(GAMES, REVIEWS, _BACK, body="select coalesce(platform, array_to_string(genres, '|')) as platform, count(*) as n from blank left join games using (game_id) group by 1"))
def q_backfill_all(spark, sf_dir):
    filled = F.coalesce("platform", F.array_join("genres", "|"))
    return _blank(spark, sf_dir).join(T.games(spark, sf_dir), "game_id", "left").groupBy(filled.alias("platform")).agg(F.count("*").alias("n"))


@query("q_targets_backfill", with_(*BASE, BASELINES, body="""select game_id, title, n, listed from games join (select game_id, count(*) filter (where data_source = 'alpha') as n from reviews group by 1) using (game_id)
 join (select game_id, max(review_count) as listed from baselines group by 1) using (game_id) where n < 12 and listed >= 20 order by listed desc, title, game_id limit 100"""))
def q_targets_backfill(spark, sf_dir):
    n = T.reviews(spark, sf_dir).groupBy("game_id").agg(F.count_if(F.col("data_source") == "alpha").alias("n"))
    listed = T.baselines(spark, sf_dir).groupBy("game_id").agg(F.max("review_count").alias("listed"))
    found = T.games(spark, sf_dir).join(n, "game_id").join(listed, "game_id").where("n < 12 and listed >= 20")
    return found.orderBy(F.desc("listed"), "title", "game_id").limit(100).select("game_id", "title", "n", "listed")


@query("q_target_reasons", with_(*BASE, body="""select case when coalesce(sample_count, 0) = 0 then 'no_reviews' when sample_count >= 34 then 'enough' when release_year < 2016 then 'too_old' else 'selected' end as reason, count(*) as n
 from games left join snapshots using (game_id) group by 1"""))
def q_target_reasons(spark, sf_dir):
    n = F.col("review_count")
    reason = F.when(n == 0, "no_reviews").when(n >= 34, "enough").when(F.col("release_year") < 2016, "too_old").otherwise("selected")
    return items_of(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("q_unmatched", with_(*BASE, body="""select game_id, title, coalesce(sample_count, 0) as reviews, len(string_split(title, ' ')) as words from games left join snapshots using (game_id)
 where game_id not in (select o_custkey from orders) order by reviews desc, game_id limit 30"""))
def q_unmatched(spark, sf_dir):
    left = K.orphans(items_of(spark, sf_dir), "game_id", T.baselines(spark, sf_dir))
    top = left.select("game_id", "title", F.col("review_count").alias("reviews"), F.size(F.split("title", " ")).alias("words"))
    return top.orderBy(F.desc("reviews"), "game_id").limit(30)


_TITLED = """titled as (
  select p_partkey, case p_partkey % 9 when 0 then 'The ' || p_name when 1 then p_name || ' VII' when 2 then p_name || ' (2015)' when 3 then p_name || ': remaster' when 4 then split_part(p_name, ' ', 1)
    when 5 then p_name || ' 3' when 6 then p_name || ' Épisode 2 on Xbox' when 7 then p_name || ' IV 4 season pass' else p_name || ' plain' end as title,
    case p_partkey % 4 when 0 then replace(p_name, ' ', '-') || '-7' when 1 then replace(p_name, ' ', '-') || '-iii' else '' end as slug
  from part
),
normed as (select *, trim(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) as norm, replace(slug, '-', ' ') as words from titled)"""
_ROMANS = X.CATEGORIES["roman_numeral_in_title"]
_LABELS = ", ".join(f"case when regexp_matches(title, '{p.replace(chr(39), chr(39) * 2)}')" + (f" or regexp_matches(words, '{p}')" if name.startswith("roman") else "") + f" then '{name}' end" for name, p in X.CATEGORIES.items())


def _crossed(a: str, b: str) -> str:
    """SQL of the label of a Roman numeral in one text and an Arabic one in the other."""
    return f"case when norm <> '' and words <> '' and norm <> words and regexp_matches({a}, '{_ROMANS}') and regexp_matches({b}, '\\b\\d+\\b') then 'roman_vs_arabic_numeral_mismatch' end"


@query("q_title_labels", with_(_TITLED, body=f"""select label, count(*) as n from (
  select unnest(case when len(found) = 0 then ['uncategorized'] else found end) as label from (
    select list_filter([{_LABELS}, {_crossed("title", "words")}, {_crossed("words", "title")},
      case when norm = '' or len(string_split(norm, ' ')) <= 1 then 'very_short_title_1_word' when len(string_split(norm, ' ')) <= 2 then 'short_title_2_words' end], lambda l: l is not null) as found from normed)
) group by 1"""))
def q_title_labels(spark, sf_dir):
    """How often each title category occurs."""
    n, name = F.col("p_partkey") % 9, F.col("p_name")
    title = (
        F.when(n == 0, F.concat(F.lit("The "), name)).when(n == 1, F.concat(name, F.lit(" VII"))).when(n == 2, F.concat(name, F.lit(" (2015)")))
        .when(n == 3, F.concat(name, F.lit(": remaster"))).when(n == 4, F.split_part(name, F.lit(" "), F.lit(1))).when(n == 5, F.concat(name, F.lit(" 3")))
        .when(n == 6, F.concat(name, F.lit(" Épisode 2 on Xbox"))).when(n == 7, F.concat(name, F.lit(" IV 4 season pass"))).otherwise(F.concat(name, F.lit(" plain")))
    )
    slug, k = F.replace(name, F.lit(" "), F.lit("-")), F.col("p_partkey") % 4
    slug = F.when(k == 0, F.concat(slug, F.lit("-7"))).when(k == 1, F.concat(slug, F.lit("-iii"))).otherwise("")
    return T.table(spark, sf_dir, "part").select(F.explode(X.title_categories(title, slug)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("q_audit", with_(GAMES, BASELINES, """titles as (select lower(title) as key, count(*) as n from games group by 1 having count(*) > 1 order by n desc, key limit 10)""", body="""select key as what, n from titles union all select 'duplicate titles', count(*) from (select 1 from games group by lower(title) having count(*) > 1)
 union all select 'duplicate baselines', count(*) from (select 1 from baselines group by game_id, source_platform having count(*) > 1) union all select 'shared urls', count(*) from (select 1 from baselines where trim(source_url) <> '' group by source_url having count(distinct game_id) > 1)"""))
def q_audit(spark, sf_dir):
    g, b = T.games(spark, sf_dir), T.baselines(spark, sf_dir)
    titles = g.groupBy(F.lower("title").alias("what")).agg(F.count("*").alias("n")).where("n > 1")
    count = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    twice = b.groupBy("game_id", "source_platform").agg(F.count("*").alias("k")).where("k > 1")
    shared = b.where("trim(source_url) <> ''").groupBy("source_url").agg(F.countDistinct("game_id").alias("k")).where("k > 1")
    return (
        titles.orderBy(F.desc("n"), "what").limit(10).unionByName(count(titles, "duplicate titles"))
        .unionByName(count(twice, "duplicate baselines")).unionByName(count(shared, "shared urls"))
    )


_WILD = "wild as (select p_partkey, case p_partkey % 6 when 0 then p_name || ' & Co (PS4)' when 1 then ' ' || p_name || ' VII' when 2 then p_name || ': gold edition (2015)' when 3 then upper(p_name) || ' + the x' when 4 then 'Café ' || p_name || '!' else 'Ōkami_' || p_name || ' 大神' end as title, 'https://x.org/game/pc/' || replace(p_name, ' ', '-') || '?a=1' as url from part)"
_ROMAN_SQL = "array_to_string(list_transform(string_split({t}, ' '), lambda w: coalesce(map([" + ", ".join(f"'{k}'" for k in X.ROMAN) + "], [" + ", ".join(f"'{v}'" for v in X.ROMAN.values()) + "])[w], w)), ' ')"
_FOLD = "trim(regexp_replace(regexp_replace(lower(strip_accents({t})), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _wild(spark, sf_dir):
    n, name = F.col("p_partkey") % 6, F.col("p_name")
    title = (
        F.when(n == 0, F.concat(name, F.lit(" & Co (PS4)"))).when(n == 1, F.concat(F.lit(" "), name, F.lit(" VII"))).when(n == 2, F.concat(name, F.lit(": gold edition (2015)")))
        .when(n == 3, F.concat(F.upper(name), F.lit(" + the x"))).when(n == 4, F.concat(F.lit("Café "), name, F.lit("!"))).otherwise(F.concat(F.lit("Ōkami_"), name, F.lit(" 大神")))
    )
    url = F.concat(F.lit("https://x.org/game/pc/"), F.replace(name, F.lit(" "), F.lit("-")), F.lit("?a=1"))
    return spread(T.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", title.alias("title"), url.alias("url"))


@query("q_titles", with_(_WILD, body=f"""select p_partkey, {_ROMAN_SQL.format(t=_FOLD.format(t="replace(regexp_replace(title, '(?i)\\s*\\(ps4\\)\\s*$', ''), '&', ' and ')"))} as canonical,
 {_ROMAN_SQL.format(t=_FOLD.format(t="replace(regexp_replace(title, '\\s*\\([^)]+\\)\\s*$', ''), '&', ' and ')"))} as imported, {_FOLD.format(t="replace(regexp_replace(title, '\\s*\\([^)]+\\)\\s*$', ''), '&', ' and ')")} as repaired,
 regexp_replace(regexp_replace(trim(lower(title)), '[[:punct:]]', '', 'g'), '\\s+', ' ', 'g') as matched,
 trim(regexp_replace(regexp_replace(lower(strip_accents(replace(title, '&', ' and '))), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) as enriched,
 {_FOLD.format(t="title")} as awarded from wild"""))
def q_titles(spark, sf_dir):
    t = F.col("title")
    return _wild(spark, sf_dir).select(
        "p_partkey", X.title_canonical(t).alias("canonical"), X.title_import(t).alias("imported"), X.title_repair(t).alias("repaired"),
        X.title_match(t).alias("matched"), X.title_enrich(t).alias("enriched"), X.title_award(t).alias("awarded"),
    )


@query("q_slugs", with_(_WILD, body="""select p_partkey, trim(regexp_replace(replace(replace(lower(strip_accents(title)), '&', ' and '), '+', ' plus '), '[^a-z0-9]+', '-', 'g'), '-') as slug, regexp_extract(url, '/game/[^/]+/([^/?#]+)', 1) as of_url,
 replace(regexp_extract(url, '/([^/?#]+)(\\?.*)?$', 1), '-', ' ') as words, 'mc-' || substr(md5(title), 1, 16) as game_key, coalesce(try_cast(regexp_extract(trim(title), '^(.+?)\\s+\\((\\d{4})\\)\\s*$', 2) as int), 0) as tagged_year from wild"""))
def q_slugs(spark, sf_dir):
    t, u = F.col("title"), F.col("url")
    return _wild(spark, sf_dir).select(
        "p_partkey", X.slug(t).alias("slug"), X.platform_slug(u).alias("of_url"), X.url_slug(u).alias("words"), X.minted("mc-", t).alias("game_key"), F.coalesce(X.year_tag(t)[1], F.lit(0)).alias("tagged_year")
    )


@query("q_slug_candidates", with_(_WILD, body="""select p_partkey, unnest(list_distinct(list_filter([case when y <> '' then s || '-' || y end, case when y <> '' then ns || '-' || y end, f, nf, s, ns, c], lambda x: x is not null and x <> ''))) as slug from (select p_partkey, y,
 trim(regexp_replace(replace(replace(lower(strip_accents(title)), '&', ' and '), '+', ' plus '), '[^a-z0-9]+', '-', 'g'), '-') as f, trim(regexp_replace(replace(replace(lower(strip_accents(stem)), '&', ' and '), '+', ' plus '), '[^a-z0-9]+', '-', 'g'), '-') as s,
 trim(regexp_replace(replace(replace(lower(strip_accents(replace(title, '+', ' '))), '&', ' and '), '+', ' plus '), '[^a-z0-9]+', '-', 'g'), '-') as nf, trim(regexp_replace(replace(replace(lower(strip_accents(replace(stem, '+', ' '))), '&', ' and '), '+', ' plus '), '[^a-z0-9]+', '-', 'g'), '-') as ns,
 trim(regexp_replace(replace(replace(lower(strip_accents(split_part(stem, ':', 1))), '&', ' and '), '+', ' plus '), '[^a-z0-9]+', '-', 'g'), '-') as c
 from (select *, regexp_extract(trim(title), '\\((\\d{4})\\)\\s*$', 1) as y, regexp_replace(trim(title), '\\s+\\(\\d{4}\\)\\s*$', '') as stem from wild))"""))
def q_slug_candidates(spark, sf_dir):
    return _wild(spark, sf_dir).select("p_partkey", F.explode(X.slug_candidates(F.col("title"))).alias("slug"))


@query("q_props", "select k, count(*) as n, round(avg(value), 3) as mean from (select cast(json_extract(props, '$.k') as bigint) as k, value from events) group by 1")
def q_props(spark, sf_dir):
    parsed = F.from_json("props", "k bigint")["k"]
    return T.table(spark, sf_dir, "events").groupBy(parsed.alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean"))


@query("q_lists", "select o_orderkey, case o_orderkey % 3 when 0 then ['a', 'b'] when 1 then ['a', 'b', 'c'] else [] end as items from orders")
def q_lists(spark, sf_dir):
    n = F.col("o_orderkey") % 3
    raw = F.when(n == 0, '["a", " b", ""]').when(n == 1, "a| b|c|").otherwise("")
    return T.table(spark, sf_dir, "orders").select("o_orderkey", X.listed(raw).alias("items"))
