"""Entity resolution queries over the testbed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators import resolve as R
from tallyforge.operators import tables as K
from tallyforge.plans.registry import query
from tallyforge.sources import testbed as T
from tallyforge.sources.testbed import BASELINES, GAMES, REVIEWS, with_

_BAND = "banded as (select r.* from reviews r where not (data_source = 'beta' and exists (select 1 from reviews o where o.data_source = 'alpha' and o.game_id = r.game_id and o.source_id = r.source_id and abs(o.score - r.score) <= 0.51)))"


@query("q_canon_reviews", with_(REVIEWS, _BAND, body="select review_id, game_id, source_id, score, data_source from banded"))
def q_canon_reviews(spark, sf_dir):
    return R.band_duplicates(T.reviews(spark, sf_dir), "alpha", "beta").select("review_id", "game_id", "source_id", "score", "data_source")


_BEST = """best as (select * from (select *, row_number() over (partition by game_id, source_platform order by (review_count is not null) desc, review_count desc nulls last,
 (external_score is not null) desc, external_score desc nulls last, collected_at desc nulls last, baseline_id desc) as k from baselines) where k = 1)"""


@query("q_canon_baselines", with_(BASELINES, _BEST, body="select baseline_id, game_id, source_platform, external_score, coalesce(review_count, -1) as review_count from best"))
def q_canon_baselines(spark, sf_dir):
    best = R.best_baselines(T.baselines(spark, sf_dir))
    return best.select("baseline_id", "game_id", "source_platform", "external_score", F.coalesce("review_count", F.lit(-1)).alias("review_count"))


@query("q_canon_baseline_urls", with_(GAMES, BASELINES, _BEST, """fits as (
  select b.*, list_filter(string_split(lower(replace(regexp_extract(source_url, '([^/]+)$', 1), '-', ' ')), ' '), lambda w: w <> '') as words,
    string_split(lower(title) || ' ' || game_id % 211 || ' urgent medium', ' ') as have
  from best b join games using (game_id)
)""", body="""select baseline_id, source_url from (
  select *, row_number() over (partition by source_url order by coalesce(len(list_filter(words, lambda w: list_contains(have, w))) / len(words), 0) desc, review_count desc nulls last, baseline_id desc) as j from fits
) where j = 1"""))
def q_canon_baseline_urls(spark, sf_dir):
    """Of baselines that share a URL the one whose item's title has most of the URL's words."""
    title = F.concat(F.lower("title"), F.lit(" "), (F.col("game_id") % 211).cast("string"), F.lit(" urgent medium"))
    titles = T.games(spark, sf_dir).select("game_id", title.alias("title"))
    rows = R.best_baselines(T.baselines(spark, sf_dir)).join(titles, "game_id")
    return R.best_by_url(rows, R.slug_fit(F.col("title"), F.lower(X.url_slug(F.col("source_url"))))).select("baseline_id", "source_url")


_KEYED = "keyed as (select game_id, lower(title) as key, case when game_id % 3 = 0 then null else release_year end as release_year from games)"
_EDGES = """edges as (select distinct game_id as a, lead as b from (select game_id, min(game_id) over (partition by key, release_year) as lead from keyed where release_year is not null
 union all select k.game_id, y.lead from keyed k join (select key, min(game_id) as lead from keyed group by 1 having count(distinct release_year) <= 1) y using (key)) where game_id <> lead)"""


def _keyed(spark, sf_dir):
    year = F.when(F.col("game_id") % 3 != 0, F.col("release_year"))
    return T.games(spark, sf_dir).select("game_id", F.lower("title").alias("key"), year.alias("release_year"))


@query("q_canon_edges", with_(GAMES, _KEYED, _EDGES, body="select a, b from edges"))
def q_canon_edges(spark, sf_dir):
    return R.duplicate_edges(_keyed(spark, sf_dir))


_REACH = """with recursive {ctes}, both_ as (select a, b from edges union select b, a from edges), reach(a, b) as (select a, a from both_ union select r.a, e.b from reach r join both_ e on r.b = e.a),
roots as (select a as id, min(b) as root from reach group by 1) """


@query("q_canon_groups", _REACH.format(ctes=",\n".join((GAMES, _KEYED, _EDGES))) + "select * from roots")
def q_canon_groups(spark, sf_dir):
    return R.groups(R.duplicate_edges(_keyed(spark, sf_dir)))


@query("q_canon_games", _REACH.format(ctes=",\n".join((GAMES, REVIEWS, _KEYED, _EDGES))) + """, ranked as (select id, first_value(id) over (partition by root order by coalesce(n, 0) desc, id) as canonical
 from roots left join (select game_id, count(*) as n from reviews group by 1) on game_id = id) select id as old, canonical from ranked where id <> canonical""")
def q_canon_games(spark, sf_dir):
    counts = T.reviews(spark, sf_dir).groupBy(F.col("game_id").alias("id")).agg(F.count("*").alias("n"))
    members = R.groups(R.duplicate_edges(_keyed(spark, sf_dir))).join(counts, "id", "left")
    return R.canonical(members, F.desc(F.coalesce("n", F.lit(0))), F.asc("id"))


@query("q_canon_repoint", _REACH.format(ctes=",\n".join((GAMES, REVIEWS, _KEYED, _EDGES))) + "select coalesce(root, game_id) as game_id, count(*) as n from reviews left join roots on id = game_id group by 1")
def q_canon_repoint(spark, sf_dir):
    mapping = R.groups(R.duplicate_edges(_keyed(spark, sf_dir))).select(F.col("id").alias("old"), F.col("root").alias("canonical"))
    return K.repoint(T.reviews(spark, sf_dir), mapping, "game_id").groupBy("game_id").agg(F.count("*").alias("n"))


# a catalog made of the items themselves: altered titles, shifted years, slugs and page addresses
_STORED = """stored as (select game_id, case game_id % 9 when 0 then title || ' ii' when 1 then 'the ' || title when 2 then title || ' deluxe edition' when 3 then title || ' (2015)' when 4 then title || ' & co_' || game_id when 5 then 'Ōkami ' || title || ' ' || game_id else title || ' ' || game_id end as title,
 case when game_id % 3 = 0 then null else release_year end as release_year, replace(title, ' ', '-') || '-' || game_id as slug from games)"""
_CATALOG = """catalog as (select p_partkey as row_id, p_partkey as line_no, case when p_partkey % 5 = 0 then replace(p_name, ' ', '-') || '-' || (p_partkey - 5) end as slug,
 case when p_partkey % 5 = 1 then 'https://x.org/game/pc/' || replace(p_name, ' ', '-') || '-' || (p_partkey + 1) || '?a' end as url,
 case p_partkey % 8 when 0 then p_name || ' 2' when 1 then upper(p_name) || ' (PC)' when 2 then p_name || ' goty' when 3 then 'a ' || p_name when 4 then p_name || ' ii' when 5 then p_name || ' and Co' || p_partkey when 6 then 'okami ' || p_name || ' 大神 ' || p_partkey
  when 7 then p_name || case when p_partkey % 2 = 1 then ' & co_' else ' ' end || p_partkey else p_name || ' ' || p_partkey end as name,
 cast(case when p_partkey % 7 = 0 then null else 2014 + p_size % 12 end as int) as year from part)"""
_NORM4 = "trim(regexp_replace(regexp_replace(lower(strip_accents({t})), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_NORM = _NORM4.replace("{t}", "replace({t}, '&', ' and ')")
_BARE = _NORM.format(t="regexp_replace(regexp_replace(regexp_replace({t}, '\\([^)]*\\)', '', 'g'), '(?i)\\b(deluxe edition|goty)\\b', '', 'g'), '\\b(19|20)\\d{{2}}\\b', '', 'g')")


def _variants_sql(t: str) -> str:
    """A list of a text's numeral variants, in order, without nulls."""
    swaps = [(r, str(n)) for n, r in X.SWAPPED] + [(str(n), r) for n, r in X.SWAPPED]
    return "list_filter([" + ", ".join(f"case when regexp_matches({t}, '\\b{o}\\b') then regexp_replace({t}, '\\b{o}\\b', '{w}', 'g') end" for o, w in swaps) + "], lambda v: v is not null)"


_INDEX4 = f"""normed as (select game_id, coalesce(release_year, try_cast(regexp_extract(title, '\\((\\d{{4}})\\)', 1) as int)) as year, {_NORM.format(t="title")} as plain, {_BARE.format(t="title")} as bare, slug from stored),
idx4 as (select kind, key, max(game_id) as game_id from (select 'slug' as kind, slug as key, game_id from normed union all select 'title_year', plain || '|' || year, game_id from normed
 union all select 'title', plain, game_id from normed) where key <> '' group by 1, 2),
asked4 as (select row_id, line_no, unnest([{{'t': 1, 'k': 'slug', 'v': slug, 'm': 'slug'}}, {{'t': 2, 'k': 'slug', 'v': regexp_extract(url, '/game/[^/]+/([^/?#]+)', 1), 'm': 'url_slug'}},
 {{'t': 3, 'k': 'title_year', 'v': {_NORM.format(t="name")} || '|' || year, 'm': 'title_year'}}, {{'t': 4, 'k': 'title', 'v': {_NORM.format(t="name")}, 'm': 'title'}}]) as a from catalog)"""
_INDEX9 = f"""cuts as (select *, case when regexp_matches(bare, '^(the|a|an) ') then regexp_replace(bare, '^(the|a|an) ', '') end as cut from normed),
pairs9 as (select game_id, unnest(list_concat([case when bare <> plain then {{'k': 'bare_year', 'v': bare || '|' || year}} end, case when bare <> plain then {{'k': 'bare', 'v': bare}} end, {{'k': 'article', 'v': cut}}, {{'k': 'bare', 'v': cut}},
 {{'k': 'article', 'v': 'the ' || bare}}, {{'k': 'article', 'v': 'a ' || bare}}, {{'k': 'article', 'v': 'an ' || bare}}],
 list_transform({_variants_sql("bare")}, lambda v: {{'k': 'bare_year', 'v': v || '|' || year}}), list_transform({_variants_sql("bare")}, lambda v: {{'k': 'bare', 'v': v}}),
 list_transform(coalesce({_variants_sql("cut")}, []), lambda v: {{'k': 'article', 'v': v}}), list_transform(coalesce({_variants_sql("cut")}, []), lambda v: {{'k': 'bare', 'v': v}}))) as p from cuts),
idx9 as (select kind, key, max(game_id) as game_id from (select kind, key, game_id from idx4 union all select p.k, p.v, game_id from pairs9) where key <> '' group by 1, 2),
bares as (select *, {_BARE.format(t="name")} as bare from catalog),
asked9 as (select * from asked4 union all select row_id, line_no, unnest(list_concat([{{'t': 5, 'k': 'bare_year', 'v': bare || '|' || year, 'm': 'bare_year'}}, {{'t': 6, 'k': 'bare', 'v': bare, 'm': 'bare'}}],
 list_transform({_variants_sql("bare")}, lambda v, i: {{'t': cast(5 + 2 * i as int), 'k': 'bare_year', 'v': v || '|' || year, 'm': 'numeral_year'}}), list_transform({_variants_sql("bare")}, lambda v, i: {{'t': cast(6 + 2 * i as int), 'k': 'bare', 'v': v, 'm': 'numeral'}}),
 [{{'t': 1000, 'k': 'article', 'v': case when regexp_matches(bare, '^(the|a|an) ') then regexp_replace(bare, '^(the|a|an) ', '') end, 'm': 'article'}},
 {{'t': 1001, 'k': 'bare', 'v': case when regexp_matches(bare, '^(the|a|an) ') then regexp_replace(bare, '^(the|a|an) ', '') end, 'm': 'article'}}])) from bares)"""
_WON = """hit as (select row_id, line_no, arg_min(game_id, a.t) as game_id, arg_min(a.m, a.t) as method from {asked} join {idx} i on i.kind = a.k and i.key = a.v where a.v <> '' group by 1, 2),
won as (select row_id, line_no, game_id, method from (select *, row_number() over (partition by game_id order by line_no, row_id) as k from hit) where k = 1)"""
_ENRICH4 = (GAMES, _STORED, _CATALOG, _INDEX4.replace("' and '", "''"), _WON.format(asked="asked4", idx="idx4"))
_ENRICH9 = (GAMES, _STORED, _CATALOG, _INDEX4, _INDEX9, _WON.format(asked="asked9", idx="idx9"))


def _stored(spark, sf_dir):
    n, t, text = F.col("game_id") % 9, F.col("title"), F.col("game_id").cast("string")
    title = (
        F.when(n == 0, F.concat(t, F.lit(" ii"))).when(n == 1, F.concat(F.lit("the "), t)).when(n == 2, F.concat(t, F.lit(" deluxe edition")))
        .when(n == 3, F.concat(t, F.lit(" (2015)"))).when(n == 4, F.concat(t, F.lit(" & co_"), text)).when(n == 5, F.concat(F.lit("Ōkami "), t, F.lit(" "), text)).otherwise(F.concat_ws(" ", t, text))
    )
    slug = F.concat_ws("-", F.replace(t, F.lit(" "), F.lit("-")), text)
    return T.games(spark, sf_dir).select("game_id", title.alias("title"), F.when(F.col("game_id") % 3 != 0, F.col("release_year")).alias("release_year"), slug.alias("slug"))


def _catalog(spark, sf_dir):
    part, name = F.col("p_partkey"), F.col("p_name")
    slug = lambda by: F.concat_ws("-", F.replace(name, F.lit(" "), F.lit("-")), (part + by).cast("string"))
    n = part % 8
    altered = (
        F.when(n == 0, F.concat(name, F.lit(" 2"))).when(n == 1, F.concat(F.upper(name), F.lit(" (PC)"))).when(n == 2, F.concat(name, F.lit(" goty")))
        .when(n == 3, F.concat(F.lit("a "), name)).when(n == 4, F.concat(name, F.lit(" ii"))).when(n == 5, F.concat(name, F.lit(" and Co"), part.cast("string")))
        .when(n == 6, F.concat(F.lit("okami "), name, F.lit(" 大神 "), part.cast("string")))
        .when(n == 7, F.concat(name, F.when(part % 2 == 1, " & co_").otherwise(" "), part.cast("string"))).otherwise(F.concat_ws(" ", name, part.cast("string")))
    )
    return T.table(spark, sf_dir, "part").select(
        part.alias("row_id"), part.alias("line_no"), F.when(part % 5 == 0, slug(-5)).alias("slug"),
        F.when(part % 5 == 1, F.concat(F.lit("https://x.org/game/pc/"), slug(1), F.lit("?a"))).alias("url"), altered.alias("name"),
        F.when(part % 7 != 0, (2014 + F.col("p_size") % 12).cast("int")).alias("year"),
    )


def _enriched(spark, sf_dir, every):
    stored = _stored(spark, sf_dir)
    keys = R.catalog_keys(F.col("name"), F.col("slug"), F.col("url"), F.col("year"), every)
    return R.ordered_lookup(_catalog(spark, sf_dir), keys, R.catalog_index(stored, stored, ampersand=every))


@query("q_enrich", with_(*_ENRICH4, body="select * from won"))
def q_enrich(spark, sf_dir):
    """The four ways of the first enrichment."""
    return _enriched(spark, sf_dir, False)


@query("q_enrich_methods", with_(*_ENRICH4, body="select method, count(*) as n from won group by 1"))
def q_enrich_methods(spark, sf_dir):
    return _enriched(spark, sf_dir, False).groupBy("method").agg(F.count("*").alias("n"))


@query("q_enrich_all", with_(*_ENRICH9, body="select * from won"))
def q_enrich_all(spark, sf_dir):
    """The nine ways of the second enrichment."""
    return _enriched(spark, sf_dir, True)


@query("q_enrich_left", with_(*_ENRICH9, body="select game_id from games where game_id not in (select game_id from won)"))
def q_enrich_left(spark, sf_dir):
    """What is still without a match."""
    return K.orphans(T.games(spark, sf_dir).select("game_id"), "game_id", _enriched(spark, sf_dir, True))


_VARIANTS = "select p_partkey, p_name || case p_partkey % 4 when 0 then ' vii' when 1 then ' 3' when 2 then ' x ii' else '' end as name from part"


@query("q_numeral_variants", f"""select p_partkey, v as variant from (select p_partkey, unnest([{', '.join(f"case when regexp_matches(name, '\\b{r}\\b') then regexp_replace(name, '\\b{r}\\b', '{n}', 'g') end" for n, r in X.SWAPPED)},
 {', '.join(f"case when regexp_matches(name, '\\b{n}\\b') then regexp_replace(name, '\\b{n}\\b', '{r}', 'g') end" for n, r in X.SWAPPED)}]) as v from ({_VARIANTS})) where v is not null""")
def q_numeral_variants(spark, sf_dir):
    n = F.col("p_partkey") % 4
    name = F.concat("p_name", F.when(n == 0, " vii").when(n == 1, " 3").when(n == 2, " x ii").otherwise(""))
    return T.table(spark, sf_dir, "part").withColumn("name", name).select("p_partkey", F.explode(X.numeral_variants(F.col("name"))).alias("variant"))


_WORDS = "list_distinct(['k' || ({k} // 3), 'm' || ({k} // 5), 'n' || ({k} % 11), 'b' || ({k} // 7), p_brand, split_part(p_name, ' ', 1)])"
_TOKENS = f"""lt as (select p_partkey as l, {_WORDS.format(k="p_partkey")} as t from part), rt as (select p_partkey as r, {_WORDS.format(k="(p_partkey + 1)")} as t from part),
rare as (select token from (select r, unnest(t) as token from rt) group by 1 having count(*) <= 200),
met as (select distinct l, r from (select l, unnest(t) as token from lt) join (select r, unnest(t) as token from rt) using (token) where token in (select token from rare)),
jac as (select l, r, len(list_intersect(lt.t, rt.t)) / len(list_distinct(list_concat(lt.t, rt.t))) as jaccard from met join lt using (l) join rt using (r)),
near as (select l, r, jaccard from jac where jaccard >= 0.7)"""


def _tokens(spark, sf_dir, by):
    k, div = F.col("p_partkey") + by, lambda n: F.floor((F.col("p_partkey") + by) / n).cast("string")
    words = (F.concat(F.lit("k"), div(3)), F.concat(F.lit("m"), div(5)), F.concat(F.lit("n"), (k % 11).cast("string")), F.concat(F.lit("b"), div(7)))
    return T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(*words, "p_brand", F.split_part("p_name", F.lit(" "), F.lit(1))).alias("tokens"))


def _near(spark, sf_dir):
    return R.token_jaccard(_tokens(spark, sf_dir, 0), _tokens(spark, sf_dir, 1))


@query("q_jaccard", with_(_TOKENS, body="select l, r, round(jaccard, 4) as jaccard from near"))
def q_jaccard(spark, sf_dir):
    return _near(spark, sf_dir).select("l", "r", F.round("jaccard", 4).alias("jaccard"))


@query("q_jaccard_one_to_one")
def q_jaccard_one_to_one(spark, sf_dir):
    return R.one_to_one(_near(spark, sf_dir))


# identities of two providers: titles altered by letters or a word, gaps in what they tell, names that are developers here
# and publishers there
_SIDES = """a as (
  select game_id as id, trim(regexp_replace(regexp_replace(lower(trim(case when game_id % 6 = 0 then title || chr(39) || 's é & co. ' || game_id % 50 else title || ' ' || game_id % 90 end)), '[[:punct:]]', '', 'g'), '\\s+', ' ', 'g')) as key,
    case when game_id % 4 <> 0 then release_year end as release_year, case game_id % 5 when 0 then 'Studio A' when 1 then null else developer end as developer,
    case game_id % 7 when 0 then 'Maker' when 1 then 'Studio B' when 2 then '' when 3 then developer end as publisher, platforms
  from games
),
b as (
  select id + 100000 as id, case id % 4 when 0 then key || 's' when 1 then 'x' || substr(key, 3) when 2 then key || ' xy' else key end as key,
    case when id % 11 < 8 then release_year end as release_year, case id % 9 when 0 then ' studio a' when 1 then 'Maker' when 2 then 'Studio B' when 3 then publisher else developer end as developer,
    case id % 8 when 0 then 'MAKER ' when 1 then 'Studio A' when 2 then developer when 3 then 'Studio B' else publisher end as publisher, case when id % 3 = 0 then ['other'] else platforms end as platforms
  from a
)"""


def _sides(spark, sf_dir):
    g, i = T.games(spark, sf_dir), F.col("game_id")
    text = lambda by: (i % by).cast("string")
    title = F.when(i % 6 == 0, F.concat("title", F.lit("'s é & co. "), text(50))).otherwise(F.concat("title", F.lit(" "), text(90)))
    a = g.select(
        i.alias("id"), F.trim(X.title_match(title)).alias("key"), F.when(i % 4 != 0, F.col("release_year")).alias("release_year"),
        F.when(i % 5 == 0, "Studio A").when(i % 5 != 1, F.col("developer")).alias("developer"),
        F.when(i % 7 == 0, "Maker").when(i % 7 == 1, "Studio B").when(i % 7 == 2, "").when(i % 7 == 3, F.col("developer")).alias("publisher"), "platforms",
    )
    i = F.col("id")
    key = F.when(i % 4 == 0, F.concat("key", F.lit("s"))).when(i % 4 == 1, F.concat(F.lit("x"), F.substr("key", F.lit(3)))).when(i % 4 == 2, F.concat("key", F.lit(" xy"))).otherwise(F.col("key"))
    b = a.select(
        (i + 100_000).alias("id"), key.alias("key"), F.when(i % 11 < 8, F.col("release_year")).alias("release_year"),
        F.when(i % 9 == 0, " studio a").when(i % 9 == 1, "Maker").when(i % 9 == 2, "Studio B").when(i % 9 == 3, F.col("publisher")).otherwise(F.col("developer")).alias("developer"),
        F.when(i % 8 == 0, "MAKER ").when(i % 8 == 1, "Studio A").when(i % 8 == 2, F.col("developer")).when(i % 8 == 3, "Studio B").otherwise(F.col("publisher")).alias("publisher"),
        F.when(i % 3 == 0, F.array(F.lit("other"))).otherwise(F.col("platforms")).alias("platforms"),
    )
    return a, b


# what two identities share, as the tiers ask for it
_SHARED = """a.release_year = b.release_year as y, nullif(lower(trim(a.developer)), '') = lower(trim(b.developer)) as d,
    nullif(lower(trim(a.publisher)), '') = lower(trim(b.publisher)) as p, len(list_intersect(a.platforms, b.platforms)) > 0 as o"""
_EXACT = f"""same as (
  select a_id, b_id, case when y then 1.0 when d then 0.95 when o then 0.75 when p then 0.7 end as confidence,
    case when y then 'exact_title_year' when d then 'exact_title_dev' when o then 'fuzzy_title_platform' else 'fuzzy_title_dev' end as method
  from (select a.id as a_id, b.id as b_id, {_SHARED} from a join b using (key) where key <> '') where y or d or o or p
),
exact as (select a_id, arg_min(b_id, (-confidence, b_id)) as b_id, cast(max(confidence) as double) as confidence, arg_min(method, (-confidence, b_id)) as method from same group by 1)"""
# titles that share something, against each other; edits bound the longest common subsequence, which is found row by row
_FUZZY = f"""rest as (
  select a.id as a_id, b.id as b_id, a.key as x, b.key as y_, {_SHARED} from (select * from a where id not in (select a_id from exact)) a join b on a.key <> b.key
    and a.key <> '' and b.key <> '' and levenshtein(a.key, b.key) <= 0.2 * (length(a.key) + length(b.key))
),
titles as (select distinct x, y_ from rest where y or d or o or p),
steps(x, y_, i, best) as (
  select x, y_, 0, list_transform(range(length(y_)), lambda j: 0) from titles
  union all
  select x, y_, i + 1, list_transform(range(1, length(y_) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
    greatest(best[k], case when substr(x, i + 1, 1) = substr(y_, k, 1) then 1 + case when k > 1 then best[k - 1] else 0 end else 0 end))))
  from steps where i < length(x)
),
alike as (select x, y_, 2 * best[-1] / (length(x) + length(y_)) as ratio from steps where i = length(x)),
near as (
  select a_id, b_id, case when ratio > 0.9 and y then 0.85 when ratio > 0.85 and o then 0.75 when ratio > 0.8 and (d or p) then 0.7 end as confidence,
    case when ratio > 0.9 and y then 'fuzzy_title_year' when ratio > 0.85 and o then 'fuzzy_title_platform' else 'fuzzy_title_dev' end as method
  from rest join alike using (x, y_)
),
fuzzy as (select a_id, arg_min(b_id, (-confidence, b_id)) as b_id, cast(max(confidence) as double) as confidence, arg_min(method, (-confidence, b_id)) as method from near where confidence is not null group by 1)"""


@query("q_match", with_(GAMES, _SIDES, _EXACT, _FUZZY, body="select * from exact union all select * from fuzzy").replace("with ", "with recursive ", 1))
def q_match(spark, sf_dir):
    return R.match_providers(*_sides(spark, sf_dir), X.indel_ratio)


@query("q_match_exact", with_(GAMES, _SIDES, _EXACT, body="select a_id, b_id, confidence from exact"))
def q_match_exact(spark, sf_dir):
    """Those matches whose titles are equal."""
    a, b = _sides(spark, sf_dir)
    best = R.match_providers(a, b, X.indel_ratio)
    keys = best.join(a.select(F.col("id").alias("a_id"), F.col("key").alias("x")), "a_id").join(b.select(F.col("id").alias("b_id"), F.col("key").alias("y")), "b_id")
    return keys.where("x = y").select("a_id", "b_id", "confidence")


_SUPPLIED = "names as (select s_suppkey as source_id, case s_suppkey % 6 when 0 then ' IGN.com ' when 1 then 'https://www.gamespot/' when 2 then 'PC  Gamer' when 3 then '' when 4 then 'gamesradar' else s_name end as name from supplier)"


@query("q_canon_sources", with_(_SUPPLIED, body="select source_id, case source_id % 6 when 0 then 'IGN' when 1 then 'GameSpot' when 2 then 'PC Gamer' when 3 then 'Unknown Source' when 4 then 'GamesRadar+' else name end as canonical, 'mc-src-' || substr(md5(case source_id % 6 when 0 then 'IGN' when 1 then 'GameSpot' when 2 then 'PC Gamer' when 3 then 'Unknown Source' when 4 then 'GamesRadar+' else name end), 1, 12) as target_id from names"))
def q_canon_sources(spark, sf_dir):
    n = F.col("s_suppkey") % 6
    name = F.when(n == 0, " IGN.com ").when(n == 1, "https://www.gamespot/").when(n == 2, "PC  Gamer").when(n == 3, "").when(n == 4, "gamesradar").otherwise(F.col("s_name"))
    named = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), X.outlet(name).alias("canonical"))
    return named.withColumn("target_id", X.minted("mc-src-", F.col("canonical"), size=12))
