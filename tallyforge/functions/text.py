"""Titles, slugs, names and URLs as column expressions; accents and edit similarity in two Arrow functions."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Roman numerals of title words.
ROMAN = {
    "i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10",
    "xi": "11", "xii": "12", "xiii": "13", "xiv": "14", "xv": "15", "xvi": "16",
}
# Numerals that are swapped in title variants.
SWAPPED = ((10, "x"), (9, "ix"), (8, "viii"), (7, "vii"), (6, "vi"), (5, "v"), (4, "iv"), (3, "iii"), (2, "ii"))
# Platforms in a tag at the end of a title.
PLATFORM_TAGS = r"ps[1-5]|playstation(?: [1-5])?|xbox(?: one| 360| series x/s)?|switch|wii u?|3ds|ds|pc|ios|android|vita|psp"
# Words that name an edition.
EDITIONS = (
    r"complete\s+edition", r"definitive\s+edition", r"deluxe\s+edition", r"game\s+of\s+the\s+year", r"goty\s+edition", "goty",
    r"hd\s+remaster", r"hd\s+remastered", "remastered", "remake", "remaster", r"enhanced\s+edition", r"special\s+edition",
    r"ultimate\s+edition", r"gold\s+edition", r"collectors?\s+edition", r"directors?\s+cut", r"anniversary\s+edition",
    r"standard\s+edition", r"digital\s+edition",
)
# Names under which outlets are known, by canonical name.
OUTLETS = {
    "IGN": ("ign", "ign.com"), "GameSpot": ("gamespot", "game spot"), "Game Informer": ("game informer", "gameinformer"),
    "ActionTrip": ("action trip", "actiontrip"), "Finger Guns": ("finger guns", "fingerguns"), "Firing Squad": ("firing squad", "firingsquad"),
    "GameCritics": ("game critics", "gamecritics"), "Game Rant": ("game rant", "gamerant"), "Gamers' Temple": ("gamers' temple", "gamers\\' temple"),
    "PC Gamer": ("pc gamer", "pcgamer"), "GamesRadar+": ("games radar", "gamesradar", "gamesradar+"), "Eurogamer": ("eurogamer",),
    "Destructoid": ("destructoid",), "Polygon": ("polygon",), "Kotaku": ("kotaku",), "The Guardian": ("the guardian",), "VG247": ("vg247",),
    "Nintendo Life": ("nintendo life",), "Push Square": ("push square",), "Rock Paper Shotgun": ("rock paper shotgun", "rockpapershotgun"),
    "Comicbook.com": ("comicbook.com",), "DarkStation": ("darkstation",), "Fandom": ("fandom",), "PLAY! Zine": ("play zine", "play! zine"),
    "Ragequit.gr": ("ragequit.gr",), "SpazioGames": ("spaziogames",), "Trusted Reviews": ("trusted reviews", "trustedreviews"),
}


@F.pandas_udf(T.StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Compatibility decomposition, then ASCII alone."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


@F.pandas_udf(T.StringType())
def drop_marks(text: pd.Series) -> pd.Series:
    """Canonical decomposition without combining marks; other letters stay."""
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    return text.map(lambda t: t if t is None or t.isascii() else bare(t))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence over both lengths; two empty texts are equal."""
    return pd.Series([_ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def _ratio(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full  # a zero bit for each step of the longest common subsequence
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def squeeze(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^ | $", "")


def _arabic(t: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))
    return F.array_join(F.transform(F.split(t, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def without_platform_tag(t: Column) -> Column:
    return F.regexp_replace(t, rf"(?i)\s*\((?:{PLATFORM_TAGS})\)\s*$", "")


def without_parentheses(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"\([^)]*\)", ""), r"^\s+|\s+$", "")


def without_editions(t: Column) -> Column:
    return squeeze(F.regexp_replace(t, rf"(?i)\b({'|'.join(EDITIONS)})\b", ""))


def without_year(t: Column) -> Column:
    return squeeze(F.regexp_replace(t, r"\b(19|20)\d{2}\b", ""))


def bare(t: Column) -> Column:
    """Without parentheses, editions and years."""
    return without_year(without_editions(without_parentheses(t)))


def year_tag(t: Column) -> tuple[Column, Column]:
    """(base, year) of a title that ends in a year in parentheses; nulls of another."""
    year = F.regexp_extract(F.trim(t), r"^(.+?)\s+\((\d{4})\)\s*$", 2).try_cast("int")
    return F.when(year.isNotNull(), F.regexp_extract(F.trim(t), r"^(.+?)\s+\((\d{4})\)\s*$", 1)), year


_text = lambda t: F.coalesce(t, F.lit(""))


def title_match(t: Column) -> Column:
    """Accents stay; ASCII punctuation goes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(_text(t)), r"^\s+|\s+$", ""), r"\p{Punct}", ""), r"\s+", " ")


def title_canonical(t: Column) -> Column:
    folded = F.lower(ascii_fold(F.replace(without_platform_tag(_text(t)), F.lit("&"), F.lit(" and "))))
    return _arabic(squeeze(F.regexp_replace(folded, r"[^a-z0-9\s]", " ")))


def title_import(t: Column) -> Column:
    folded = F.lower(ascii_fold(F.replace(F.regexp_replace(_text(t), r"\s*\([^)]+\)\s*$", ""), F.lit("&"), F.lit(" and "))))
    return _arabic(squeeze(F.regexp_replace(folded, r"[^a-z0-9\s]", " ")))


def title_repair(t: Column) -> Column:
    folded = F.replace(F.lower(ascii_fold(F.regexp_replace(_text(t), r"\s*\([^)]+\)\s*$", ""))), F.lit("&"), F.lit(" and "))
    return squeeze(F.regexp_replace(folded, r"[^a-z0-9\s]", " "))


def title_enrich(t: Column, ampersand: bool = True) -> Column:
    """Marks, and everything but a to z, digits and spaces, go; ``&`` becomes a word or, without ``ampersand``, goes."""
    text = F.lower(drop_marks(_text(t)))
    text = F.replace(text, F.lit("&"), F.lit(" and ")) if ampersand else text
    return squeeze(F.regexp_replace(F.regexp_replace(text, r"(?U)\s", " "), "[^a-z0-9 ]", ""))


def title_award(t: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(drop_marks(_text(t))), r"[^a-z0-9\s]", " "))


def numeral_variants(t: Column) -> Column:
    """A title for each numeral that it has, swapped in all places; Roman ones first."""
    swap = lambda old, new: F.when(t.rlike(rf"\b{old}\b"), F.regexp_replace(t, rf"\b{old}\b", new))
    return F.array_compact(F.array(*(swap(r, str(n)) for n, r in SWAPPED), *(swap(str(n), r) for n, r in SWAPPED)))


def without_article(t: Column) -> Column:
    return F.regexp_replace(t, "^(the|a|an) ", "")


def with_articles(t: Column) -> Column:
    """The text after each article."""
    return F.array(*(F.concat(F.lit(a), t) for a in ("the ", "a ", "an ")))


def simple_slug(t: Column) -> Column:
    """Lower case, blanks as dashes, without colons and apostrophes."""
    return F.translate(F.lower(_text(t)), " :'", "-")


def absolute_url(url: Column, base: str) -> Column:
    """A link on its own, or under ``base``; an empty one stays empty."""
    slash = F.when(url.startswith("/"), "").otherwise("/")
    return F.when(_text(url) == "", "").when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit(base), slash, url))


def slug(t: Column) -> Column:
    text = F.replace(F.replace(F.lower(ascii_fold(_text(t))), F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" plus "))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "['’]", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_candidates(t: Column) -> Column:
    """Slugs under which a title may be listed, each once: with its year, whole, without ``+``, before ``:``."""
    base, year = year_tag(t)
    stem = F.coalesce(base, F.trim(t))
    no_plus = lambda x: slug(F.replace(x, F.lit("+"), F.lit(" ")))
    dated = lambda s: F.when(year.isNotNull(), F.concat(s, F.lit("-"), year.cast("string")))
    featuring = F.when(F.lower(stem).rlike(r" (featuring|feat\.?) "), slug(F.regexp_extract(stem, r"(?i)^(.*?) (?:featuring|feat\.?) ", 1)))
    every = F.array(dated(slug(stem)), dated(no_plus(stem)), slug(t), no_plus(t), slug(stem), no_plus(stem), featuring, slug(F.split_part(stem, F.lit(":"), F.lit(1))))
    return F.array_distinct(F.filter(every, lambda s: s.isNotNull() & (s != "")))


def url_slug(url: Column) -> Column:
    """The last part of a URL's path, as words."""
    path_ = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/+|/+$", "")
    return F.replace(F.element_at(F.split(path_, "/"), -1), F.lit("-"), F.lit(" "))


def platform_slug(url: Column) -> Column:
    """The slug of ``/game/<platform>/<slug>``, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"/game/[^/]+/([^/?#]+)", 1), F.lit(""))


def outlet(name: Column) -> Column:
    """An outlet's canonical name; an unknown one stays as written, an empty one is unknown.

    Patterns are tried only on names with a character that they need, as a name is looked up for each review.
    """
    text = _text(name)
    blank = reduce(or_, (F.contains(text, F.lit(c)) for c in ("  ", "\t", "\n", "\v", "\f", "\r")), F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" ")))
    clean = F.when(blank, squeeze(text)).otherwise(text)
    key = F.replace(F.lower(clean), F.lit("&amp;"), F.lit("&"))
    bare = F.regexp_replace(F.regexp_replace(key, r"https?://(www\.)?", ""), "^/+|/+$", "")
    key = F.replace(F.when(F.contains(key, F.lit("/")), bare).otherwise(key), F.lit("www."), F.lit(""))
    table = F.create_map(*(F.lit(x) for known, names in OUTLETS.items() for n in names for x in (n, known)))
    return F.when(clean == "", "Unknown Source").otherwise(F.coalesce(F.try_element_at(table, key), clean))


def minted(prefix: str, *parts: Column, size: int = 16) -> Column:
    """A key from a prefix and the md5 of its parts; null parts count as empty."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, size))


def cut_off(t: Column, most: int, dots: bool = False) -> Column:
    """At most ``most`` characters; with dots, one less and three dots. Blank text and ``nan`` are null."""
    clean = F.nullif(F.nullif(F.trim(t), F.lit("")), F.lit("nan"))
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.substring(clean, 1, most - 1), F.lit("...")) if dots else F.substring(clean, 1, most))


def shown_summary(t: Column, most: int = 100) -> Column:
    """A text as lists show it: its first ``most`` characters and three dots where it is longer."""
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def entry_names(entries: Column) -> Column:
    """The names of a list of structs (name, shortName): the short one where there is no other; blanks and nulls go."""
    name = lambda e: F.coalesce(F.nullif(F.trim(e["name"]), F.lit("")), F.trim(e["shortName"]))
    return F.filter(F.transform(entries, name), lambda n: n.isNotNull() & (n != ""))


def listed(t: Column) -> Column:
    """A list from JSON text, or from text parted by ``|``; blanks go."""
    parsed = F.coalesce(F.from_json(t, "array<string>"), F.split(_text(t), r"\|"))
    return F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def year_of(t: Column) -> Column:
    return F.regexp_extract(_text(t), r"^(\d{4})", 1).try_cast("int")


def year_or_date(year: Column, date: Column) -> Column:
    """The year, or the one that the date begins with."""
    return F.coalesce(year, year_of(date.cast("string")))


def canonical_json(*columns: str) -> Column:
    """The columns as JSON with sorted names, nulls too: the same text for the same values, to be hashed."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def now_text(at: Column | None = None) -> Column:
    """A time as UTC text; the current one, unless a job gives its own so that it can run again with the same result."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def flat_distinct(lists: Column) -> Column:
    """The distinct values of lists of lists, in order; null lists count as empty."""
    return F.array_distinct(F.flatten(F.filter(lists, lambda x: x.isNotNull())))


# Patterns of title categories, by label.
CATEGORIES = {
    "roman_numeral_in_title": r"(?i)\b(?:I{1,3}|IV|VI{0,3}|IX|XI{0,3}|XIV|XV|XVI{0,3}|XIX|XX)\b",
    "arabic_numeral_in_title": r"\b\d{1,2}\b", "parenthetical_content": r"\(.*?\)", "year_suffix_in_title": r"\b(19|20)\d{2}\b",
    "special_characters": "[':\\-&.!?’‘]", "subtitle_colon": r":\s*\S", "leading_article_the_a_an": r"(?i)^(the|a|an)\s+",
    "edition_variant_goty_remaster_etc": r"(?i)\b(goty|game of the year|definitive|remaster|remake|deluxe|ultimate|complete|enhanced|hd|collection|anniversary|legendary|gold|platinum|director.s cut|special edition|expanded)\b",
    "platform_name_in_title": r"(?i)\b(ps[2-5]|psp|psv|ps vita|xbox|x360|xbone|xsx|xss|switch|wii\s*u|wii|3ds|ds|gamecube|game boy|gba|pc|steam|ios|android|vr|meta quest)\b",
    "dlc_expansion_or_episode": r"(?i)\b(dlc|expansion|expansion pass|season pass|chapter|episode|act|part|mission pack|add.on|addon)\b",
}


def title_categories(title: Column, slug_: Column) -> Column:
    """Labels of what makes a title hard to match; ``uncategorized`` where there is none."""
    norm, words = title_enrich(title, ampersand=False), F.replace(_text(slug_), F.lit("-"), F.lit(" "))
    roman = CATEGORIES["roman_numeral_in_title"]
    marks = [F.when((title.rlike(p) | words.rlike(p)) if name.startswith("roman") else title.rlike(p), F.lit(name)) for name, p in CATEGORIES.items()]
    crossed = (title.rlike(roman) & words.rlike(r"\b\d+\b"), title.rlike(r"\b\d+\b") & words.rlike(roman))
    marks += [F.when((norm != "") & (words != "") & (norm != words) & c, F.lit("roman_vs_arabic_numeral_mismatch")) for c in crossed]
    n = F.size(F.filter(F.split(norm, " "), lambda w: w != ""))
    marks.append(F.when(n <= 1, "very_short_title_1_word").when(n <= 2, "short_title_2_words"))
    found = F.array_compact(F.array(*marks))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("uncategorized")))
