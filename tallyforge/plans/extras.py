"""Reports, shown values, paging, versions and small functions over the testbed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import scores as S
from tallyforge.functions import text as X
from tallyforge.operators import browse as B
from tallyforge.operators import report as Q
from tallyforge.operators import resolve as R
from tallyforge.pipeline import of_version, with_version
from tallyforge.plans.browse import IBASE, LEAST, _AWARDS, _awards, _matched, items_of
from tallyforge.plans.registry import query
from tallyforge.plans.scoring import BASE, snapshots_of
from tallyforge.plans.targets import _IDENT, _identities
from tallyforge.sources import testbed as T
from tallyforge.sources.files import first_seen
from tallyforge.sources.testbed import BASELINES, GAMES, REVIEWS, with_

_LOST = """lost as (select game_id, case game_id % 7 when 0 then 'The ' || title when 1 then title || ' VII' when 2 then title || ' (2015)' when 3 then title || ': remaster' when 4 then split_part(title, ' ', 1) when 5 then 'Big ' || title else title end as title, release_year, game_id from games where game_id % 3 <> 0),
slugs as (select game_id, min(external_slug) as slug from identities group by 1),
totals as (select l.game_id, l.title, s.slug, coalesce(o.n, 0) as own, coalesce(b.n, 0) as listed, coalesce(o.n, 0) + coalesce(b.n, 0) as total from lost l left join slugs s using (game_id)
 left join (select game_id, count(*) as n from reviews group by 1) o using (game_id) left join (select game_id, sum(review_count) as n from baselines group by 1) b using (game_id))"""


def _label_sql() -> str:
    """The category list of a title and a slug."""
    norm = "trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
    words = "replace(coalesce(slug, ''), '-', ' ')"
    roman = X.CATEGORIES["roman_numeral_in_title"].replace("'", "''")
    has = lambda text, p: f"regexp_matches({text}, '{p}')"
    marks = [f"case when {has('title', p.replace(chr(39), chr(39) * 2))}{' or ' + has(words, roman) if name.startswith('roman') else ''} then '{name}' end" for name, p in X.CATEGORIES.items()]
    crossed = f"({has('title', roman)} and {has(words, chr(92) + 'b' + chr(92) + 'd+' + chr(92) + 'b')}) or ({has('title', chr(92) + 'b' + chr(92) + 'd+' + chr(92) + 'b')} and {has(words, roman)})"
    marks.append(f"case when {norm} <> '' and {words} <> '' and {norm} <> {words} and ({crossed}) then 'roman_vs_arabic_numeral_mismatch' end")
    n = f"len(list_filter(string_split({norm}, ' '), lambda w: w <> ''))"
    marks.append(f"case when {n} <= 1 then 'very_short_title_1_word' when {n} <= 2 then 'short_title_2_words' end")
    return "list_filter([" + ", ".join(marks) + "], lambda m: m is not null)"


_LABELLED = f"""labelled as (select *, case when len(c) > 0 then c else ['uncategorized'] end as categories from (select *, {_label_sql()} as c from totals)),
each_ as (select game_id, title, slug, total, unnest(categories) as category from labelled)"""
_REPORT = (GAMES, REVIEWS, BASELINES, _IDENT, _LOST, _LABELLED)


def _unmatched(spark, sf_dir):
    i, t = F.col("game_id"), F.col("title")
    n = i % 7
    title = (
        F.when(n == 0, F.concat(F.lit("The "), t)).when(n == 1, F.concat(t, F.lit(" VII"))).when(n == 2, F.concat(t, F.lit(" (2015)"))).when(n == 3, F.concat(t, F.lit(": remaster")))
        .when(n == 4, F.split_part(t, F.lit(" "), F.lit(1))).when(n == 5, F.concat(F.lit("Big "), t)).otherwise(t)
    )
    g = T.games(spark, sf_dir).withColumn("title", title)
    return Q.unmatched(g, _identities(spark, sf_dir), T.reviews(spark, sf_dir), T.baselines(spark, sf_dir), i % 3 != 0)


@query("q_unmatched_report", with_(*_REPORT, body="select game_id, title, slug, own, listed, total, categories from labelled"))
def q_unmatched_report(spark, sf_dir):
    return _unmatched(spark, sf_dir).drop("release_year")


@query("q_category_summary", with_(*_REPORT, body="""select category, count(*) as n, round(100.0 * count(*) / (select count(*) from labelled), 1) as percent,
 (list(title order by total desc, game_id))[1:3] as examples from each_ group by 1"""))
def q_category_summary(spark, sf_dir):
    return Q.category_summary(_unmatched(spark, sf_dir))


@query("q_unmatched_top", with_(*_REPORT, body="select game_id, title, total from labelled order by total desc, game_id limit 30"))
def q_unmatched_top(spark, sf_dir):
    return Q.most_reviewed(_unmatched(spark, sf_dir), 30).select("game_id", "title", "total")


@query("q_numeral_mismatch_top", with_(*_REPORT, body="select game_id, title, slug from labelled where list_contains(categories, 'roman_vs_arabic_numeral_mismatch') order by total desc, game_id limit 20"))
def q_numeral_mismatch_top(spark, sf_dir):
    return Q.most_reviewed(_unmatched(spark, sf_dir), 20, "roman_vs_arabic_numeral_mismatch").select("game_id", "title", "slug")


@query("q_top_platforms", with_(REVIEWS, body="select platform as value, count(*) as n from reviews where platform <> '' group by 1 order by n desc, value limit 15"))
def q_top_platforms(spark, sf_dir):
    return Q.top_values(T.reviews(spark, sf_dir), "platform")


@query("q_missing_documents", with_(GAMES, body="select cast(game_id as varchar) as key, 'missing' as state from games where game_id % 5 = 0 union all select 'x' || game_id, 'stale' from games where game_id % 50 = 1"))
def q_missing_documents(spark, sf_dir):
    g = T.games(spark, sf_dir)
    present = g.where("game_id % 5 <> 0").select(F.col("game_id").cast("string").alias("key")).unionByName(g.where("game_id % 50 = 1").select(F.concat(F.lit("x"), F.col("game_id").cast("string")).alias("key")))
    return Q.missing_documents(g.select(F.col("game_id").alias("key")), present)


@query("q_page_count", with_(GAMES, body="select count(*) as rows, cast(ceil(count(*) / 50) as bigint) as pages from games where contains(lower(title), 'e')"))
def q_page_count(spark, sf_dir):
    return B.page_count(B.browse(T.games(spark, sf_dir), search="E"))


@query("q_by_locale", with_(GAMES, body="select game_id, title from games order by title, game_id limit 40"))
def q_by_locale(spark, sf_dir):
    return T.games(spark, sf_dir).orderBy(*B.by_locale("title")).limit(40).select("game_id", "title")


@query("q_by_column", with_(BASELINES, body="select baseline_id, game_id from baselines where game_id is not null order by coalesce(review_count, -1), game_id, baseline_id limit 60"))
def q_by_column(spark, sf_dir):
    return T.baselines(spark, sf_dir).orderBy(*B.by_column("review_count"), "baseline_id").limit(60).select("baseline_id", "game_id")


@query("q_score_summary", with_(REVIEWS, body="select (select count(*) from reviews) as n, max(n) as best, (select floor(avg(score) * 10 + 0.5) / 10 from reviews) as mean from (select least(floor(score / 10), 9) as b, count(*) as n from reviews group by 1)"))
def q_score_summary(spark, sf_dir):
    return B.score_summary(T.reviews(spark, sf_dir))


@query("q_award_span", with_(*IBASE, _AWARDS, body="select game_id from items where weighted_score is not null and release_year between (select min(year) + 2 from awards) and (select max(year) - 2 from awards)"))
def q_award_span(spark, sf_dir):
    years = _awards(spark, sf_dir).agg((F.min("year") + 2).alias("lo"), (F.max("year") - 2).alias("hi")).select(F.explode(F.array("lo", "hi")).alias("year"))
    return B.in_award_years(items_of(spark, sf_dir), years).select("game_id")


@query("q_top_with_awards", with_(*IBASE, _AWARDS, body="""select game_id, weighted_score, coalesce(shows, []) as shows from (select * from items where weighted_score is not null and review_count >= 30 order by weighted_score desc, game_id limit 10)
 left join (select game_id, list_sort(list_distinct(list(outlet))) as shows from matched join awards using (award_id) group by 1) using (game_id)"""))
def q_top_with_awards(spark, sf_dir):
    top = items_of(spark, sf_dir).where(B.eligible(LEAST)).orderBy(F.desc("weighted_score"), "game_id").limit(10).select("game_id", "weighted_score")
    return B.with_awards(top, _matched(spark, sf_dir), _awards(spark, sf_dir))


@query("q_award_titles", with_(GAMES, _AWARDS, body="select distinct title from (select key as title from awards union all select developer from games)"))
def q_award_titles(spark, sf_dir):
    return B.award_titles(_awards(spark, sf_dir).select("key"), T.games(spark, sf_dir).select("developer"))


@query("q_shown_baselines", with_(BASELINES, body="select baseline_id from baselines where source_platform not in ('5-LOW', '1-URGENT')"))
def q_shown_baselines(spark, sf_dir):
    return B.shown_baselines(T.baselines(spark, sf_dir), ("5-LOW", "1-URGENT")).select("baseline_id")


@query("q_titled_like", with_(GAMES, body="select game_id from games where title ilike '%RING%'"))
def q_titled_like(spark, sf_dir):
    return B.titled_like(T.games(spark, sf_dir), "%RING%").select("game_id")


@query("q_listed_items", with_(GAMES, "gaps as (select game_id, case when game_id % 2 = 0 then genres end as genres, case when game_id % 3 = 0 then platforms end as platforms from games)", body="select game_id, genres[1:2] as shown from gaps where genres is not null or platforms is not null"))
def q_listed_items(spark, sf_dir):
    i = F.col("game_id")
    g = T.games(spark, sf_dir).select("game_id", F.when(i % 2 == 0, F.col("genres")).alias("genres"), F.when(i % 3 == 0, F.col("platforms")).alias("platforms"))
    return g.where(F.col("genres").isNotNull() | F.col("platforms").isNotNull()).select("game_id", F.slice("genres", 1, 2).alias("shown"))


# one decimal as a browser writes it: exact halves, which are odd quarters, away from zero
_ONE = "case when abs({x}) * 4 % 2 = 1 then printf('%.1f', sign({x}) * floor(abs({x}) * 10 + 0.5) / 10) else printf('%.1f', {x}) end"


@query("q_shown_scores", with_(*BASE, body=f"""select game_id, case when weighted_score >= 95 then 'legend' when weighted_score >= 90 then 'classic' when weighted_score >= 80 then 'strong' when weighted_score is not null then 'listed' end as band,
  case when score_std > 0 then {_ONE.format(x="median_score")} else 'N/A' end as said, case when raw_average < 50.25 then '' else '+' end || {_ONE.format(x="(raw_average - 50.25)")} as sign,
  least(100.0, 100.0 * source_count / sample_count) as share from snapshots"""))
def q_shown_scores(spark, sf_dir):
    return snapshots_of(spark, sf_dir).select(
        "game_id", S.top_band(F.col("weighted_score")).alias("band"), S.score_text(F.when(F.col("score_std") > 0, F.col("median_score"))).alias("said"),
        S.signed_text(F.col("raw_average") - 50.25).alias("sign"), S.share_of(F.col("source_count"), F.col("sample_count")).alias("share"),
    )


@query("q_shown_summaries", "select doc_id, case when length(text) > 100 then substr(text, 1, 100) || '...' else text end as shown from documents")
def q_shown_summaries(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", X.shown_summary(F.col("text")).alias("shown"))


@query("q_entry_names", """select p_partkey, list_filter([case p_partkey % 3 when 0 then p_brand when 1 then 'S' || p_size end, case when p_partkey % 2 = 0 then trim(p_type) else '' end], lambda n: n is not null and n <> '') as names from part""")
def q_entry_names(spark, sf_dir):
    n = F.col("p_partkey")
    entry = lambda name, short: F.struct(name.alias("name"), short.alias("shortName"))
    first = entry(F.when(n % 3 == 0, F.col("p_brand")).when(n % 3 == 1, " "), F.when(n % 3 == 1, F.concat(F.lit("S"), F.col("p_size").cast("string"))))
    second = entry(F.when(n % 2 == 0, F.concat(F.lit(" "), "p_type")).otherwise(""), F.lit(""))
    return T.table(spark, sf_dir, "part").select("p_partkey", X.entry_names(F.array(first, second)).alias("names"))


_NESTED = """select 2014 + p_partkey % 12 as year, ['first', 'second', 'third'][1 + p_partkey % 3] as outlet, p_name as winner, [p_name || ' 2', case when p_partkey % 2 = 0 then null else p_type end] as nominees from part"""


@query("q_award_rows", f"""with nested as ({_NESTED}) select cast(year as int) as year, outlet, 'winner' as role, winner as title from nested
 union all select cast(year as int), outlet, 'nominee', title from (select year, outlet, unnest(nominees) as title from nested) where title is not null""")
def q_award_rows(spark, sf_dir):
    """Winners and nominees of years with their shows, nested as they are kept."""
    n = F.col("p_partkey")
    show = F.get(F.array(*map(F.lit, ("first", "second", "third"))), (n % 3).cast("int"))
    award = F.struct(show.alias("show"), F.col("p_name").alias("winner"), F.array(F.concat("p_name", F.lit(" 2")), F.when(n % 2 != 0, F.col("p_type"))).alias("nominees"))
    years = T.table(spark, sf_dir, "part").groupBy((2014 + n % 12).cast("int").alias("year")).agg(F.collect_list(award).alias("awards"))
    return B.award_rows(years).withColumnRenamed("show", "outlet")


@query("q_top_entries", with_(REVIEWS, body="select source_id, list(game_id order by n desc, game_id)[1:15] as top, coalesce(max(n) filter (where game_id = 1), 0) as first from (select source_id, game_id, count(*) as n from reviews group by 1, 2) group by 1"))
def q_top_entries(spark, sf_dir):
    n = T.reviews(spark, sf_dir).groupBy("source_id", "game_id").agg(F.count("*").alias("n"))
    m = n.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("game_id", "n"))).alias("m"))
    return m.select("source_id", F.transform(S.top_entries(F.col("m")), lambda e: e["key"]).alias("top"), S.count_of(F.col("m"), F.lit(1).cast("long")).alias("first"))


@query("q_texts", """select p_partkey, replace(replace(replace(lower(p_name || ': It''s'), ' ', '-'), ':', ''), '''', '') as slug, case p_partkey % 4 when 0 then 'https://a/b' when 1 then 'https://h/g/' || p_partkey when 2 then 'https://h/x' else '' end as url,
 md5('{"a":' || p_partkey || ',"b":"' || p_name || '"}') as digest, ['the ' || p_name, 'a ' || p_name, 'an ' || p_name] as articles, case when p_partkey % 2 = 0 then 2000 + p_size else 1990 + p_size % 10 end as year, [p_name, p_type] as lists, '1970-01-01T00:00:05Z' as at_time from part""")
def q_texts(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    url = F.when(k % 4 == 0, "https://a/b").when(k % 4 == 1, F.concat(F.lit("/g/"), k.cast("string"))).when(k % 4 == 2, "x").otherwise("")
    year = X.year_or_date(F.when(k % 2 == 0, 2000 + F.col("p_size")), F.concat((1990 + F.col("p_size") % 10).cast("string"), F.lit("-01-02")))
    named = T.table(spark, sf_dir, "part").withColumns({"b": name, "a": k})
    return named.select(
        "p_partkey", X.simple_slug(F.concat(name, F.lit(": It's"))).alias("slug"), X.absolute_url(url, "https://h").alias("url"), F.md5(X.canonical_json("b", "a")).alias("digest"),
        X.with_articles(name).alias("articles"), year.alias("year"), X.flat_distinct(F.array(F.array(name), F.lit(None).cast("array<string>"), F.array(name, "p_type"))).alias("lists"), X.now_text(F.timestamp_seconds(F.lit(5))).alias("at_time"),
    )


@query("q_ids_union", with_(GAMES, body="select game_id, list_sort(list_distinct([game_id % 5, game_id % 7, game_id % 5, 3])) as ids from games"))
def q_ids_union(spark, sf_dir):
    i = F.col("game_id")
    return T.games(spark, sf_dir).select("game_id", F.array_sort(F.array_distinct(F.concat(F.array(i % 5, i % 7), F.array(i % 5, F.lit(3).cast("long"))))).alias("ids"))


@query("q_identity_items", with_(GAMES, _IDENT, body="select identity_id, title, developer from identities join games using (game_id)"))
def q_identity_items(spark, sf_dir):
    return _identities(spark, sf_dir).select("identity_id", "game_id").join(T.games(spark, sf_dir).select("game_id", "title", "developer"), "game_id").select("identity_id", "title", "developer")


# pages of a listing: orders of a customer by date, twenty to a page, each page repeating the last of the one before
_PAGES = """listed as (select o_custkey as listing, o_orderkey as key, row_number() over (partition by o_custkey order by o_orderkey) - 1 as k from orders)"""


@query("q_paged", with_(_PAGES, body="select listing, key from listed where k < 45"))
def q_paged(spark, sf_dir):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("listing").orderBy("key")) - 1
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("listing"), F.col("o_orderkey").alias("key")).withColumn("k", place)
    page, position = (F.floor(F.col("k") / 20) + 1).cast("int"), F.col("k") % 20 + 1
    pages = rows.select("listing", "key", page.alias("page"), position.alias("position"))
    again = rows.where("k % 20 = 19").select("listing", "key", (page + 1).alias("page"), F.lit(0).alias("position"))
    return first_seen(pages.unionByName(again), 45).select("listing", "key")


@query("q_versions", with_(*BASE[:4], body="select source_id, 'v1' as version, sample_count from metrics where source_id % 2 = 0 union all select source_id, 'v2', sample_count + 1 from metrics"))
def q_versions(spark, sf_dir):
    from tallyforge.plans.scoring import metrics_of

    m = metrics_of(spark, sf_dir).select("source_id", "sample_count")
    both = with_version(with_version(None, m, "v1"), m.withColumn("sample_count", F.col("sample_count") + 1), "v2")
    both = with_version(both, m.where("source_id % 2 = 0"), "v1")
    return of_version(both, "v1").withColumn("version", F.lit("v1")).unionByName(of_version(both, "v2").withColumn("version", F.lit("v2")))


@query("q_slug_fit", with_(BASELINES, GAMES, "fits as (select baseline_id, title || ' 1' as t, replace(regexp_extract(source_url, '/([^/?#]+)$', 1), '-', ' ') as s from baselines join games using (game_id))", body="select baseline_id, len(list_filter(string_split(s, ' '), lambda w: w <> '' and list_contains(string_split(t, ' '), w))) / len(list_filter(string_split(s, ' '), lambda w: w <> '')) as fit from fits"))
def q_slug_fit(spark, sf_dir):
    rows = T.baselines(spark, sf_dir).join(T.games(spark, sf_dir).select("game_id", F.concat("title", F.lit(" 1")).alias("t")), "game_id")
    return rows.select("baseline_id", R.slug_fit(F.col("t"), X.url_slug(F.col("source_url"))).alias("fit"))
