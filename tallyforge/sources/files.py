"""Readers for provider files: CSV, Parquet, JSON lines, pages with embedded state, and a folder of cached responses."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.scores import number
from tallyforge.functions.text import url_slug, year_of

REVIEWS_CSV = "ID string, Game string, Website string, Review string, Score string"
NAMED = "array<struct<name:string>>"
CATALOG = (
    "slug string, name string, released string, metacritic int, metacritic_url string, description_raw string, "
    f"developers {NAMED}, publishers {NAMED}, genres {NAMED}, parent_platforms array<struct<platform:struct<name:string>>>"
)
# Private marks that pages put for characters of their state.
PRIVATE = (("&q;", '"'), ("&a;", "&"), ("&s;", "'"), ("&l;", "<"), ("&g;", ">"))


def _bare(name: str) -> str:
    """A column's name without a byte-order mark, carriage returns and blanks."""
    return name.replace("﻿", "").replace("\r", "").strip()


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """A reviews CSV with quoted line breaks; rows without a number for a score are dropped."""
    raw = spark.read.schema(REVIEWS_CSV).csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", enforceSchema=True)
    return raw.withColumn("Score", number(F.col("Score"))).where("Score is not null")


def read_dates(spark: SparkSession, path: str) -> DataFrame:
    """(Game, release_date) of a Parquet file whose names may end in carriage returns; no rows where it can't be used.

    The first date of a game that is not null counts, in the order of the file's rows.
    """
    empty = spark.createDataFrame([], "Game string, release_date string")
    try:
        raw = spark.read.parquet(path)
    except Exception:  # noqa: BLE001  a missing or broken optional file is no file
        return empty
    raw = raw.toDF(*map(_bare, raw.columns))
    if not {"Game", "release_date"} <= set(raw.columns):
        return empty
    order = F.struct(F.input_file_name(), F.monotonically_increasing_id())
    dated = raw.withColumn("__at", order).where("release_date is not null and Game is not null")
    return dated.groupBy("Game").agg(F.min_by(F.col("release_date").cast("string"), "__at").alias("release_date"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an explicit schema, one record of names a line; lines that are no JSON are left out.

    ``line_no`` orders the lines of all files as a reader of one file after the other would: by the file's name, then by
    where the line's split begins in it, then by the line's place in the split.
    """
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")).alias("at"))
    blocks = lines.groupBy("at.file", "at.block").agg(F.min("at.nth").alias("least"), F.count("*").alias("n"))
    begin = F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1))  # a row for each split
    starts = blocks.select("file", "block", "least", F.coalesce(begin, F.lit(0)).alias("begin"))
    lines = lines.select("value", "at.*").join(F.broadcast(starts), ["file", "block"]).select("value", (F.col("begin") + F.col("nth") - F.col("least")).alias("line_no"))
    d = lines.select("line_no", F.from_json("value", CATALOG).alias("d")).where("d is not null").select("line_no", "d.*")
    names = lambda c: F.filter(F.transform(c, lambda x: x["name"]), lambda x: x.isNotNull() & (x != ""))
    platforms = F.filter(F.transform("parent_platforms", lambda x: x["platform"]["name"]), lambda x: x.isNotNull())
    return d.withColumns({c: names(F.col(c)) for c in ("developers", "publishers", "genres")}).withColumn("parent_platforms", platforms)


def read_targets(spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """A CSV of targets whose columns go by several names: {column: (names, ...)}; the first that is not empty counts."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*map(_bare, raw.columns))
    pick = lambda names: F.coalesce(*(F.nullif(F.trim(n), F.lit("")) for n in names if n in raw.columns), F.lit(None).cast("string"))
    return raw.select(*(pick(names).alias(c) for c, names in columns.items()))


def overrides(targets: DataFrame) -> DataFrame:
    """(key, slug): slugs by game_id and by title; of several, the last by ``line_no``."""
    rows = targets.select("line_no", F.expr("stack(2, game_id, slug, title, slug) as (key, slug)"))
    return rows.where("key is not null and slug is not null").groupBy("key").agg(F.max_by("slug", "line_no").alias("slug"))


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """HTML references resolved."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def page_states(pages: DataFrame, script: str = "app-state") -> DataFrame:
    """(url, state): the JSON that a page embeds in the script of that id, as a variant; pages without one are left out."""
    found = F.regexp_extract("html", rf'(?s)<script[^>]*id="{script}"[^>]*>(.*?)</script>', 1)
    text = unescaped(found)
    for mark, sign in PRIVATE:
        text = F.replace(text, F.lit(mark), F.lit(sign))
    return pages.select("url", text.alias("text")).where("text <> ''").select("url", F.try_parse_json("text").alias("state")).where("state is not null")


def state_entries(states: DataFrame, prefix: str) -> DataFrame:
    """(url, key, value) of the state's entries whose key begins with ``prefix``, values as JSON text."""
    entries = F.map_entries(F.from_json(F.to_json("state"), "map<string,string>"))
    return states.select("url", F.explode(entries).alias("e")).where(F.col("e.key").startswith(prefix)).select("url", "e.key", "e.value")


def provider_url(url):
    """(id, slug, title) of ``https://host/game/<id>/<slug>``; nulls where there is none."""
    number_ = F.regexp_extract(url, r"/game/(\d+)/", 1).try_cast("long")
    return number_, F.nullif(F.regexp_extract(url, r"/game/\d+/([^/?#]+)", 1), F.lit("")), F.initcap(url_slug(url))


def cached_responses(urls: DataFrame, folder: str) -> DataFrame:
    """(url, body) of responses that were fetched before: files named by the md5 of their URL in a folder that every
    executor reads through Spark. Nothing is fetched; a URL without a file has a null body, and repeated URLs are one."""
    files = urls.sparkSession.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("body"))
    return urls.select("url").distinct().withColumn("name", F.md5("url")).join(files, "name", "left").select("url", "body")


PRODUCT = "title string, premiereYear int, releaseDate string, criticScoreSummary struct<score double, reviewCount int>"


def products(responses: DataFrame) -> DataFrame:
    """(url, product_title, product_year, listed, listed_score) of product pages; those without a body, or whose body is
    no product, are left out. Missing parts are null."""
    parsed = responses.select("url", F.from_json("body", PRODUCT).alias("d")).where("d.title is not null")
    year = F.coalesce("d.premiereYear", year_of(F.col("d.releaseDate")))
    return parsed.select("url", F.col("d.title").alias("product_title"), year.alias("product_year"), F.col("d.criticScoreSummary.reviewCount").alias("listed"), F.col("d.criticScoreSummary.score").alias("listed_score"))


def page_urls(listings: DataFrame, most: int | None = None, size: int = 20) -> DataFrame:
    """(listing, page, url) of each listing's pages from 1: as many as ``expected`` rows need and one more, or ``most``."""
    cap = F.lit(most) if most else F.greatest(F.lit(1), (F.ceil(F.coalesce("expected", F.lit(0)) / size) + 1).cast("int"))
    rows = listings.select("listing", "base", F.explode(F.sequence(F.lit(1), cap)).alias("page"))
    return rows.select("listing", "page", F.concat("base", F.when(F.col("page") > 1, F.concat(F.lit("?page="), F.col("page").cast("string"))).otherwise("")).alias("url"))


def offset_urls(listings: DataFrame, size: int = 50) -> DataFrame:
    """(listing, page, url) of each listing's slices by offset and limit until the total; the first one always."""
    limit = max(1, min(size, 100))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.coalesce("expected", F.lit(0)) - 1), F.lit(limit))
    rows = listings.select("listing", "base", F.posexplode(starts).alias("page", "offset"))
    return rows.select("listing", (F.col("page") + 1).alias("page"), F.concat("base", F.lit("?offset="), F.col("offset").cast("string"), F.lit(f"&limit={limit}")).alias("url"))


def first_seen(items: DataFrame, most: int | None = None) -> DataFrame:
    """Items (listing, page, position, key, ...) as a reader of one page after the other would take them.

    Of items with one key in a listing the first counts. Reading stops before the first page that is missing or brings
    nothing new, and after ``most`` items of a listing.
    """
    order = F.row_number().over(W.partitionBy("listing", "key").orderBy("page", "position"))
    fresh = items.where("key is not null").withColumn("__nth", order).where("__nth = 1").drop("__nth")
    pages = fresh.groupBy("listing", "page").agg(F.count("*").alias("__n"))
    read = pages.withColumn("__nth", F.row_number().over(W.partitionBy("listing").orderBy("page"))).where("page = __nth").select("listing", "page")
    kept = fresh.join(read, ["listing", "page"], "left_semi")
    if most is None:
        return kept
    return kept.withColumn("__nth", F.row_number().over(W.partitionBy("listing").orderBy("page", "position"))).where(F.col("__nth") <= most).drop("__nth")
