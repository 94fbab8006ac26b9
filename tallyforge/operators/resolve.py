"""Entity resolution: canonical choice, duplicate groups, ordered lookups, token and fuzzy matching."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators.runtime import checkpointed, large, spread
from tallyforge.operators.tables import first_of_each


def band_duplicates(reviews: DataFrame, keep: str, drop: str, width: float = 0.51) -> DataFrame:
    """Reviews without those of provider ``drop`` that ``keep`` has for the same item and source with nearly the score."""
    kept = reviews.where(F.col("data_source") == keep).select("game_id", "source_id", F.col("score").alias("other")).distinct()
    twice = (
        reviews.where(F.col("data_source") == drop).join(large(kept), ["game_id", "source_id"])
        .where(F.abs(F.col("score") - F.col("other")) <= width).select("review_id").distinct()
    )
    return reviews.join(large(twice), "review_id", "left_anti")


def best_baselines(rows: DataFrame) -> DataFrame:
    """One baseline for each item and platform: with a count, the larger, with a score, the higher, the newest."""
    order = (
        F.col("review_count").isNotNull().desc(), F.desc_nulls_last("review_count"), F.col("external_score").isNotNull().desc(),
        F.desc_nulls_last("external_score"), F.desc_nulls_last("collected_at"), F.desc("baseline_id"),
    )
    return first_of_each(rows, ["game_id", "source_platform"], *order)


def best_by_url(rows: DataFrame, fit: Column) -> DataFrame:
    """Of baselines that share a URL, the one whose title fits the URL best, then as above; others keep their rows."""
    named = rows.where(F.trim("source_url") != "")
    best = first_of_each(named.withColumn("__fit", fit), ["source_url"], F.desc("__fit"), F.desc_nulls_last("review_count"), F.desc("baseline_id")).drop("__fit")
    return best.unionByName(rows.where(F.coalesce(F.trim("source_url"), F.lit("")) == ""))


def slug_fit(title: Column, slug: Column) -> Column:
    """Share of a slug's words that the title has."""
    words = F.filter(F.split(slug, " "), lambda w: w != "")
    have = F.split(title, " ")
    return F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: F.array_contains(have, w))), F.size(words)), F.lit(0.0))


def duplicate_edges(games: DataFrame) -> DataFrame:
    """(a, b): items with one normalised title in the same year, or with one title that has at most one known year.

    Each member is joined with the group's smallest id, so a group gives as many edges as members.
    """
    keyed = games.where("key <> ''")
    of_year = keyed.where("release_year is not null").withColumn("lead", F.min("game_id").over(W.partitionBy("key", "release_year")))
    years = keyed.groupBy("key").agg(F.countDistinct("release_year").alias("years"), F.min("game_id").alias("lead")).where("years <= 1")
    of_title = keyed.join(large(years.select("key", "lead")), "key")
    edges = of_year.select(F.col("game_id").alias("a"), F.col("lead").alias("b")).unionByName(of_title.select(F.col("game_id").alias("a"), F.col("lead").alias("b")))
    return edges.where("a <> b").distinct()


def groups(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges`` (a, b): the smallest id that it is connected with.

    Edges are turned into stars round by round: first the larger neighbours of every id hang on the smallest of it and
    its neighbours, then every id and its smaller ones do. A chain of n ids takes about log n rounds, each a checkpoint in
    the shared folder. Edges may repeat, and point either way; an id joined with itself alone is its own root; edges
    with a null end are ignored. A hub's neighbours are met by partial minima and by joins that Spark may split.
    """
    known = edges.where("a is not null and b is not null")
    now = checkpointed(known.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        facts = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if facts == mark:
            break
        mark = facts
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hub = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        wide = both.where("b > a").join(large(hub), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = wide.groupBy("a").agg(F.min("b").alias("low"))
        moved = wide.join(large(low), "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = checkpointed(moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
    ids = known.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return ids.join(large(now.select(F.col("a").alias("id"), F.col("b").alias("root"))), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def canonical(members: DataFrame, *order: Column) -> DataFrame:
    """(old, canonical) for each member but the first of its group; members are (id, root, ...)."""
    first = first_of_each(members, ["root"], *order).select("root", F.col("id").alias("canonical"))
    return members.join(large(first), "root").where("id <> canonical").select(F.col("id").alias("old"), "canonical")


def ordered_lookup(rows: DataFrame, keys: Column, index: DataFrame) -> DataFrame:
    """The target of each row's first key that the index has: one join instead of one for each strategy.

    ``keys``: array of struct(tier, kind, key, method). ``index``: (kind, key, game_id), a key once. A row is (row_id,
    line_no, ...); of the rows that find one target, the first by line keeps it and the others get none. Null and empty
    keys find nothing.
    """
    asked = spread(rows, "row_id").select("row_id", "line_no", F.inline(keys)).where("key is not null and key <> ''")
    found = asked.join(large(index), ["kind", "key"]).groupBy("row_id", "line_no").agg(F.min(F.struct("tier", "method", "game_id")).alias("best"))
    flat = found.select("row_id", "line_no", "best.game_id", "best.method")
    return first_of_each(flat, ["game_id"], F.asc("line_no"), F.asc("row_id"))


def _key(tier: int, kind: str, key: Column, method: str) -> Column:
    return F.struct(F.lit(tier).alias("tier"), F.lit(kind).alias("kind"), key.alias("key"), F.lit(method).alias("method"))


def catalog_keys(name: Column, slug: Column, url: Column, year: Column, every: bool = True) -> Column:
    """The keys of a catalog row, most telling first: slug, slug of its URL, title with year, title.

    Without ``every`` titles lose their ``&``, as in ``catalog_index`` without ``ampersand``. With it, ``&`` is a word,
    and there are also the bare title (without parentheses, editions and years) with and without year, each variant of
    its numerals with and without year, and the title without its article.
    """
    dated = lambda t: F.concat_ws("|", t, year.cast("string"))
    on = lambda t: F.when(year.isNotNull(), dated(t))
    plain, bare = X.title_enrich(name, every), X.title_enrich(X.bare(name), every)
    keys = [_key(1, "slug", slug, "slug"), _key(2, "slug", X.platform_slug(url), "url_slug"), _key(3, "title_year", on(plain), "title_year"), _key(4, "title", plain, "title")]
    if not every:
        return F.array(*keys)
    keys += [_key(5, "bare_year", on(bare), "bare_year"), _key(6, "bare", bare, "bare")]
    pair = lambda v, i: F.array(
        F.struct((7 + 2 * i).alias("tier"), F.lit("bare_year").alias("kind"), on(v).alias("key"), F.lit("numeral_year").alias("method")),
        F.struct((8 + 2 * i).alias("tier"), F.lit("bare").alias("kind"), v.alias("key"), F.lit("numeral").alias("method")),
    )
    variants = F.flatten(F.transform(X.numeral_variants(bare), pair))
    cut = F.when(X.without_article(bare) != bare, X.without_article(bare))
    return F.concat(F.array(*keys), variants, F.array(_key(1000, "article", cut, "article"), _key(1001, "bare", cut, "article")))


def catalog_index(games: DataFrame, slugs: DataFrame | None = None, ampersand: bool = True) -> DataFrame:
    """(kind, key, game_id) under which items of (game_id, title, release_year) are found; the largest id stays.

    ``ampersand``: whether ``&`` is a word of titles, or goes. Null and empty titles and slugs are no keys.
    ``slugs``: (game_id, slug) of their identities. A title's year is the item's, or else the one in parentheses.
    """
    tag = F.regexp_extract("title", r"\((\d{4})\)", 1).try_cast("int")
    plain, bare = X.title_enrich(F.col("title"), ampersand), X.title_enrich(X.bare(F.col("title")), ampersand)
    g = spread(games, "game_id").select("game_id", F.coalesce("release_year", tag).cast("string").alias("year"), plain.alias("plain"), bare.alias("bare"))
    cut = F.when(X.without_article(F.col("bare")) != F.col("bare"), X.without_article(F.col("bare")))
    g = g.withColumn("variants", X.numeral_variants(F.col("bare"))).withColumn("cut", cut).withColumn("cut_variants", F.coalesce(X.numeral_variants(F.col("cut")), F.array().cast("array<string>")))
    one = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    dated = lambda t: F.when(F.col("year").isNotNull(), F.concat_ws("|", t, "year"))
    other = F.when(F.col("bare") != F.col("plain"), F.col("bare"))
    many = lambda kind, list_, of=lambda v: v: F.transform(list_, lambda v: one(kind, of(v)))
    keys = F.concat(
        F.array(one("title_year", dated(F.col("plain"))), one("title", F.col("plain")), one("bare_year", F.when(other.isNotNull(), dated(other))), one("bare", other)),
        many("bare_year", F.col("variants"), dated), many("bare", F.col("variants")),
        F.array(one("article", F.col("cut")), one("bare", F.col("cut"))), many("article", F.col("cut_variants")), many("bare", F.col("cut_variants")),
        many("article", X.with_articles(F.col("bare"))),
    )
    rows = g.select("game_id", F.inline(keys)).where("key is not null and key <> ''")
    if slugs is not None:
        rows = rows.unionByName(slugs.where("slug is not null and slug <> ''").select("game_id", F.lit("slug").alias("kind"), F.col("slug").alias("key")))
    return rows.groupBy("kind", "key").agg(F.max("game_id").alias("game_id"))


def last_index(rows: DataFrame, kind: str, key: Column) -> DataFrame:
    """An index (kind, key, game_id) in which the last item written under a key stays."""
    named = rows.select(F.lit(kind).alias("kind"), key.alias("key"), "game_id").where("key is not null and key <> ''")
    return named.groupBy("kind", "key").agg(F.max("game_id").alias("game_id"))


def token_jaccard(left: DataFrame, right: DataFrame, least: float = 0.7, frequent: int = 200) -> DataFrame:
    """(l, r, jaccard) of rows (id, tokens) that share a token which is not too frequent, and are similar enough.

    Tokens that more than ``frequent`` rows of ``right`` have make no pairs, but count for the similarity: that is the
    rule of the match, and it bounds the rows that a token brings together. Sizes travel with the tokens, so that pairs
    whose sizes alone forbid the similarity are never made. Rows without tokens match nothing.
    """
    sized = lambda d, i, t: d.select(F.col("id").alias(i), F.array_distinct("tokens").alias(t)).where(F.size(t) > 0)
    l_, r = sized(left, "l", "lt"), sized(right, "r", "rt")
    by_token = r.select("r", F.size("rt").alias("rn"), F.explode("rt").alias("token"))
    rare = by_token.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") <= frequent).select("token")
    met = l_.select("l", F.size("lt").alias("ln"), F.explode("lt").alias("token")).join(large(by_token.join(large(rare), "token")), "token")
    pairs = met.where(F.least("ln", "rn") >= least * F.greatest("ln", "rn")).select("l", "r").distinct()
    common = F.size(F.array_intersect("lt", "rt"))
    jaccard = common / (F.size("lt") + F.size("rt") - common)
    return pairs.join(large(l_), "l").join(large(r), "r").select("l", "r", jaccard.alias("jaccard")).where(F.col("jaccard") >= least)


#: Pairs of a component up to which one task settles it.
SETTLED_AT_ONCE = 100_000


def one_to_one(pairs: DataFrame, at_once: int = SETTLED_AT_ONCE) -> DataFrame:
    """Greedy one-to-one choice: each left row (l, r, jaccard), in order, takes its best right row that is still free.

    Rows that no chain of pairs connects don't matter to each other, so components are settled apart: those of up to
    ``at_once`` pairs in one grouped step, however long their chains of wishes are, and only larger ones in rounds. Of
    equally good right rows the smaller is taken; a pair that is repeated counts with its best similarity.
    """
    pairs = checkpointed(pairs.groupBy("l", "r").agg(F.max("jaccard").alias("jaccard")))
    node = lambda side: F.concat(F.lit(side), F.col(side).cast("string"))
    root = groups(pairs.select(node("l").alias("a"), node("r").alias("b")))
    placed = pairs.withColumn("id", node("l")).join(large(root), "id").drop("id")
    size = placed.groupBy("root").agg(F.count("*").alias("n"))
    placed = checkpointed(placed.join(large(size), "root"))

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["l", "jaccard", "r"], ascending=[True, False, True], kind="stable")
        free, kept, last = set(frame["r"]), [], None
        for k, (left, right) in enumerate(zip(frame["l"], frame["r"])):
            if left != last and right in free:
                kept.append(k)
                free.discard(right)
                last = left
        return frame.iloc[kept][["l", "r", "jaccard"]]

    small = placed.where(F.col("n") <= at_once).drop("n").groupBy("root").applyInPandas(settle, pairs.schema)
    rest = placed.where(F.col("n") > at_once).select("l", "r", "jaccard")
    return small.unionByName(_in_rounds(rest))


def _in_rounds(pairs: DataFrame) -> DataFrame:
    """The same in rounds: left rows whose best choice no earlier row wants are settled, what they take is removed, and
    the next round begins. A round is a checkpoint; there are as many as the longest chain of wishes."""
    open_, taken = checkpointed(pairs), None
    while not open_.isEmpty():
        best = first_of_each(open_, ["l"], F.desc("jaccard"), F.asc("r"))
        won = first_of_each(best, ["r"], F.asc("l"))
        # a row may still lose its choice to an earlier one that will be left without its own best
        first_wish = open_.groupBy("r").agg(F.min("l").alias("first"))
        sure = checkpointed(won.join(large(first_wish), "r").where("l = first").select("l", "r", "jaccard"))
        taken = sure if taken is None else taken.unionByName(sure)
        open_ = checkpointed(open_.join(large(sure.select("l")), "l", "left_anti").join(large(sure.select("r")), "r", "left_anti"))
    return taken if taken is not None else pairs


def two_passes(rows: DataFrame, keys: Column, games: DataFrame, index: DataFrame, words: Column, game_words: Column, least: float = 0.7) -> DataFrame:
    """(row_id, game_id, method) of a catalog (row_id, line_no, ...): by keys, then what is left by words.

    The second pass reads the catalog again only if items are left, and of it only rows that share a word with one of
    them (a semi join, before anything is paired) and found nothing before. An item takes one row and a row one item, in
    the order of lines. ``words`` and ``game_words`` are arrays of rows and of items.
    """
    first = checkpointed(ordered_lookup(rows, keys, index).select("row_id", "game_id", "method"))
    left = checkpointed(games.join(large(first.select("game_id")), "game_id", "left_anti").select(F.col("game_id").alias("id"), game_words.alias("tokens")).where(F.size("tokens") > 0))
    if left.isEmpty():
        return first
    wanted = left.select(F.explode("tokens").alias("word")).distinct()
    again = rows.join(large(first.select("row_id")), "row_id", "left_anti").select("row_id", "line_no", words.alias("tokens"))
    hit = again.select("row_id", F.explode("tokens").alias("word")).join(large(wanted), "word", "left_semi").select("row_id").distinct()
    asked = checkpointed(again.join(large(hit), "row_id", "left_semi"))
    order = F.struct("line_no", "row_id")
    near = token_jaccard(asked.select(order.alias("id"), "tokens"), left, least)
    numbered = near.select("l", "r", "jaccard").withColumn("row_id", F.col("l.row_id")).withColumn("l", F.format_string("%020d %s", F.col("l.line_no"), F.col("l.row_id").cast("string")))
    settled = one_to_one(numbered.select("l", "r", "jaccard"))
    second = settled.join(large(numbered.select("l", "row_id").distinct()), "l").select("row_id", F.col("r").alias("game_id"), F.lit("words").alias("method"))
    return first.unionByName(second)


def near_titles(x: DataFrame, y: DataFrame, above: float, *shared: str) -> DataFrame:
    """(x, y) of different titles, of rows (x, *shared) and (y, *shared) that share those columns, that may be alike.

    Every pair is there whose indel ratio, 1 - edits / (both lengths), is more than ``above``; a few are not. Two
    titles of lengths m and n allow d edits. The second is cut into d + 1 parts of like length, one of which d edits leave
    whole, and it is met in the first no further from its place than the edits before it, and those after, can have moved
    it: of the k-th part, k before and d - k after. So titles meet in one equi join on length, edits, part and its text,
    beside what they share, and no pair of titles without a common part is made. Null and empty titles meet nothing.
    """
    loss = Fraction(1 - above).limit_denominator(1000)
    least, most = float((1 - loss) / (1 + loss)), float((1 + loss) / (1 - loss))
    edits = lambda m, n: F.floor(((m + n) * loss.numerator - 1) / loss.denominator).cast("int")
    # lengths that the other title of a pair may have
    lengths = lambda n: F.filter(F.sequence(F.greatest(F.lit(1), F.floor(n * least).cast("int")), F.ceil(n * most).cast("int")), lambda m: F.abs(m - n) <= edits(m, n))
    ints = lambda first, last: F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    size = lambda n, d, k: F.floor(n / (d + 1)).cast("int") + F.when(k >= d + 1 - n % (d + 1), 1).otherwise(0)
    start = lambda n, d, k: F.floor(n / (d + 1)).cast("int") * k + F.greatest(F.lit(0), k - (d + 1 - n % (d + 1)))

    n, d, k = F.length("y"), F.col("d"), F.col("k")
    cut = y.where("y <> ''").select(*shared, "y", F.explode(F.array_distinct(F.transform(lengths(n), lambda m: edits(m, F.length("y"))))).alias("d"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), d)).alias("k"))
    parts = cut.select(*shared, "y", n.alias("n"), "d", "k", F.substr("y", start(n, d, k) + 1, size(n, d, k)).alias("part"))

    m, n = F.length("x"), F.col("n")
    asked = x.where("x <> ''").select(*shared, "x", F.explode(lengths(m)).alias("n")).withColumn("d", edits(m, n))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), d)).alias("k"))
    at = start(n, d, k)
    first = F.greatest(F.lit(0), at - k, at + m - n - (d - k), at - F.floor((d + n - m) / 2).cast("int"))
    last = F.least(m - size(n, d, k), at + k, at + m - n + d - k, at + F.floor((d + m - n) / 2).cast("int"))
    asked = asked.select("*", F.explode(ints(first, last)).alias("at"))
    asked = asked.select(*shared, "x", "n", "d", "k", F.substr("x", F.col("at") + 1, size(n, d, k)).alias("part"))
    return asked.join(large(parts), [*shared, "n", "d", "k", "part"]).where("x <> y").select("x", "y", "d").distinct()


#: Tiers of a match: confidence, method, similarity beyond which titles fit (none: equal titles), what else must be
#: shared. An identity with an equal title, in any tier, is not compared with others.
TIERS = (
    (1.0, "exact_title_year", None, "year"), (0.95, "exact_title_dev", None, "developer"), (0.75, "fuzzy_title_platform", None, "platform"),
    (0.7, "fuzzy_title_dev", None, "maker"), (0.85, "fuzzy_title_year", 0.9, "year"), (0.75, "fuzzy_title_platform", 0.85, "platform"),
    (0.7, "fuzzy_title_dev", 0.8, "maker"),
)


def match_providers(a: DataFrame, b: DataFrame, similarity) -> DataFrame:
    """(a_id, b_id, confidence, method): each identity's best match with the other provider; first by id on ties.

    Rows are (id, key, release_year, developer, publisher, platforms); null or empty keys, years, names and platforms
    are shared with nothing. Names are compared in lower case, developers with developers and publishers with publishers;
    the last tier takes either. Identities of one title that share a year, a name or a platform are one row of an index
    with their smallest id, so titles are compared once, however many identities have them. An identity that a tier has
    matched is not asked again. Titles meet by ``near_titles``, then a bound on edits, which no pair above the similarity
    exceeds, goes before ``similarity`` (a column function). Repeated ids are one identity with what all its rows tell.
    """
    name = lambda kind, c: F.concat(F.lit(kind), F.nullif(F.lower(F.trim(c)), F.lit("")))
    shares = {
        "year": lambda: F.col("release_year").cast("string"),
        "developer": lambda: name("", "developer"),
        "maker": lambda: F.explode(F.array_compact(F.array(name("developer ", "developer"), name("publisher ", "publisher")))),
        "platform": lambda: F.explode(F.array_distinct(F.transform("platforms", lambda p: F.lower(F.trim(p))))),
    }
    of = lambda d, what: d.where("key <> ''").select("id", "key", shares[what]().alias("shared")).where("shared is not null and shared <> ''")
    index = {what: of(b, what).groupBy("key", "shared").agg(F.min("id").alias("b_id")) for what in shares}
    found, open_ = [], a
    for confidence, method, above, what in TIERS:
        rows, known = of(open_, what), index[what]
        if above is None:
            met = rows.join(large(known), ["key", "shared"])
        else:
            title = lambda d, c: d.select(F.col("key").alias(c), "shared").distinct()
            near = near_titles(title(rows, "x"), title(known, "y"), above, "shared")
            near = near.where(F.call_function("levenshtein", F.col("x"), F.col("y"), F.col("d")) >= 0)
            near = near.where(similarity(F.col("x"), F.col("y")) > above).select("x", "y")
            met = rows.withColumnRenamed("key", "x").join(large(near), "x").join(large(known.withColumnRenamed("key", "y")), ["y", "shared"])
        best = checkpointed(met.groupBy(F.col("id").alias("a_id")).agg(F.min("b_id").alias("b_id")).withColumns({"confidence": F.lit(confidence), "method": F.lit(method)}))
        found.append(best)
        open_ = open_.join(large(best.select(F.col("a_id").alias("id"))), "id", "left_anti")
    return reduce(DataFrame.unionByName, found)
