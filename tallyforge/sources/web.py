"""Responses of web pages: fetched by tasks, with retries, from a cache in shared storage, or round by round.

``get(url)`` is what asks the web: it returns (status, body, location) or raises OSError. It is passed in, so that tests
and recorded runs need no network; ``http_get`` asks for real.
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyforge.operators.runtime import checkpointed, file_names, scratch
from tallyforge.operators.tables import first_of_each
from tallyforge.params import BackfillOptions

Get = Callable[[str], tuple[int, str | None, str | None]]
RESPONSES = "url string, status int, body string"
CACHED = RESPONSES + ", fetched_at timestamp"
# Statuses that move a page, and those of a client's fault that are tried again all the same.
MOVED, AGAIN = (301, 302, 303, 307, 308), (408, 429)


class FetchError(RuntimeError):
    """A page that can't be had: a fault of the request, or a failure in every attempt."""


@dataclass(frozen=True)
class Fetching:
    """How pages are asked for. ``as_json``: a body that is no JSON is a failure too. ``tasks``: how many ask at a time."""

    retries: int = 3
    backoff: float = 1.0
    pause: float = 0.0
    redirects: int = 10
    as_json: bool = False
    tasks: int = 8


def http_get(url: str, agent: str = "tallyforge", timeout: float = 40) -> tuple[int, str | None, str | None]:
    class Still(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args):
            return None

    request = urllib.request.Request(url, headers={"User-Agent": agent})
    try:
        with urllib.request.build_opener(Still).open(request, timeout=timeout) as r:
            return r.status, r.read().decode("utf-8", "replace"), None
    except urllib.error.HTTPError as e:
        return e.code, None, e.headers.get("Location")
    except http.client.HTTPException as e:
        raise OSError(str(e)) from e


def fetch(url: str, get: Get, how: Fetching = Fetching(), wait: Callable[[float], None] = time.sleep) -> tuple[int, str | None]:
    """(status, body) of a page. Moves are followed; a page that is gone, or moved nowhere, has no body.

    Another fault of the request (4xx) ends at once with FetchError; failures of the server or the network, and timeouts,
    are tried ``retries`` times more, after pauses that double.
    """
    at = url
    for _ in range(how.redirects + 1):
        for attempt in range(how.retries + 1):
            try:
                status, body, location = get(at)
                if 200 <= status < 300:
                    if how.as_json:
                        json.loads(body or "")
                    return status, body
                if status in MOVED or status == 404:
                    break
                if status < 500 and status not in AGAIN:
                    raise FetchError(f"{url}: {status}")
                failure = str(status)
            except (OSError, ValueError) as e:
                failure = str(e)
            if attempt == how.retries:
                raise FetchError(f"{url}: {failure}")
            wait(how.backoff * 2**attempt)
        target = urljoin(at, location) if status in MOVED and location else at
        if target == at:
            return status, None
        at = target
    raise FetchError(f"{url}: more than {how.redirects} moves")


def fetched(urls: DataFrame, cache: str, get: Get = http_get, how: Fetching = Fetching(), refresh: bool = False) -> DataFrame:
    """(url, status, body) of every different URL, from the table at ``cache`` or else the web.

    What is fetched is added to the cache in one commit, so a task that runs again adds nothing twice; only bodies count
    as cached, so a page that was gone is asked for again. Nulls are left out. With ``refresh`` everything is fetched;
    the newest response counts. URLs are dealt over ``tasks`` tasks, which is how many pages are asked for at a time.
    """
    spark = urls.sparkSession
    wanted = checkpointed(urls.select("url").where("url is not null").distinct())
    held = lambda: spark.read.schema(CACHED).parquet(cache) if file_names(spark, cache) else spark.createDataFrame([], CACHED)
    missing = wanted if refresh else wanted.join(held().where("body is not null").select("url"), "url", "left_anti")

    def run(frames):
        for frame in frames:
            rows = []
            for url in frame["url"]:
                rows.append((url, *fetch(url, get, how)))
                time.sleep(how.pause)
            yield pd.DataFrame(rows, columns=["url", "status", "body"])

    if not missing.isEmpty():
        answers = missing.repartition(how.tasks).mapInPandas(run, RESPONSES)
        answers.withColumn("fetched_at", F.current_timestamp()).write.mode("append").parquet(cache)
    newest = first_of_each(held().join(wanted, "url", "left_semi"), ["url"], F.desc("fetched_at"), F.desc_nulls_last("body")).select("url", "status", "body")
    return wanted.join(newest, "url", "left")


def web_source(get: Get = http_get, how: Fetching = Fetching()) -> type[DataSource]:
    """A source for ``spark.dataSource.register``: ``spark.read.format("web").option("urls", ...)`` reads responses.

    ``urls``: a short list, a URL a line; ``batch``: how many a partition has. Longer lists are tables for ``fetched``.
    """

    class Batch(InputPartition):
        def __init__(self, urls: list[str]):
            self.urls = urls

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            urls = list(dict.fromkeys(u.strip() for u in self.options.get("urls", "").splitlines() if u.strip()))
            size = int(self.options.get("batch", 20))
            return [Batch(urls[k : k + size]) for k in range(0, len(urls), size)]

        def read(self, partition):
            for url in partition.urls if partition else ():
                yield url, *fetch(url, get, how)

    class Web(DataSource):
        @classmethod
        def name(cls):
            return "web"

        def schema(self):
            return RESPONSES

        def reader(self, schema):
            return Reader(self.options)

    return Web


Ask = Callable[[DataFrame], DataFrame]


def crawl(listings: DataFrame, ask: Ask, parse: Callable[[DataFrame], DataFrame], url: Callable[[Column, Column, Column], Column], most_pages: Column | int | None = None, most_items: int | None = None) -> DataFrame:
    """(listing, page, position, key, item): items of listings that are read page by page, each key once.

    ``listings``: (listing, base, expected). ``ask`` gives (url, status, body) of a table of URLs; ``parse`` gives
    (listing, page, position, key, item, total) of pages (listing, page, body); ``url(base, page, offset)`` names a page,
    offset being the items before it. Each round asks for one page of every listing that is still open. A listing is
    closed by a page that is missing, has no items or no new key, by reaching its total (or what is expected, where the
    page doesn't say), by ``most_pages``, which may be a column of listings, or by ``most_items``. Rounds are as many as
    the longest listing has pages; their items and the open listings are written in the shared folder.
    """
    spark = listings.sparkSession
    cap = F.lit(None).cast("int") if most_pages is None else F.lit(most_pages) if isinstance(most_pages, int) else most_pages
    open_ = checkpointed(listings.select("listing", "base", F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), cap.alias("cap"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("kept")))
    folder, page, kinds = scratch(spark, "crawl"), 0, None
    while not open_.isEmpty():
        page += 1
        asked = open_.withColumns({"page": F.lit(page), "url": url(F.col("base"), F.lit(page), F.col("offset"))})
        bodies = asked.join(ask(asked.select("url")).where("body is not null").select("url", "body"), "url")
        items = checkpointed(parse(bodies.select("listing", "page", "body")))
        fresh = first_of_each(items.where("key is not null"), ["listing", "key"], F.asc("position"))
        if kinds is not None:
            fresh = fresh.join(spark.read.schema(kinds).parquet(f"{folder}/*").select("listing", "key"), ["listing", "key"], "left_anti")
        fresh = checkpointed(fresh)
        if most_items is not None:
            fresh = fresh.join(open_.select("listing", "kept"), "listing")
            nth = F.row_number().over(W.partitionBy("listing").orderBy("position"))
            fresh = fresh.withColumn("nth", nth + F.col("kept")).where(F.col("nth") <= most_items).drop("nth", "kept")
        kept = fresh.select("listing", "page", "position", "key", "item")
        kept.write.parquet(f"{folder}/{page:06d}")
        kinds = kept.schema
        counts = items.groupBy("listing").agg(F.count("*").alias("n"), F.max("total").alias("total"))
        new = fresh.groupBy("listing").agg(F.count("*").alias("new"))
        state = open_.join(counts, "listing").join(new, "listing")  # without items or new keys a listing is closed
        total = F.coalesce(F.nullif("total", F.lit(0)), F.col("expected"))
        state = state.withColumns({"offset": F.col("offset") + F.col("n"), "kept": F.col("kept") + F.col("new"), "of": total})
        more = ((F.col("of") == 0) | (F.col("offset") < F.col("of"))) & (F.col("cap").isNull() | (F.col("cap") > page))
        more = more & (F.col("kept") < most_items) if most_items is not None else more
        open_ = checkpointed(state.where(more).select("listing", "base", "expected", "cap", "offset", "kept"))
    if kinds is None:
        return parse(listings.limit(0).select("listing", F.lit(1).alias("page"), F.lit("").alias("body"))).select("listing", "page", "position", "key", "item")
    return spark.read.schema(kinds).parquet(f"{folder}/*")


def year_listings(spark: SparkSession, host: str, o: BackfillOptions, ask: Ask, parse, url) -> DataFrame:
    """The items that a provider lists of each of the options' years, by ``crawl``: up to ``most_pages`` and ``most_items``."""
    years = spark.createDataFrame([(y, f"{host}/{y}") for y in dict.fromkeys(o.years)], "listing int, base string").withColumn("expected", F.lit(None).cast("long"))
    return crawl(years, ask, parse, url, o.most_pages, o.most_items)


def review_listings(found: DataFrame, o: BackfillOptions, ask: Ask, parse, url, size: int = 20) -> DataFrame:
    """The reviews of items (listing, base, listed) by ``crawl``: as many pages as their number needs and one more, or
    ``most_review_pages`` where that is less."""
    need = F.greatest(F.lit(1), (F.ceil(F.coalesce("listed", F.lit(0)) / size) + 1).cast("int"))
    cap = need if o.most_review_pages is None else F.least(need, F.lit(o.most_review_pages))
    return crawl(found.select("listing", "base", F.lit(None).cast("long").alias("expected"), "listed"), ask, parse, url, cap)


def first_accepted(targets: DataFrame, candidates: str, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``targets`` with (place, candidate): the first of their candidates, an array column, that is accepted.

    ``ask`` gets (target columns, candidate) and returns the rows that are accepted, perhaps with more columns. A round asks
    for one candidate of every target that has none yet; there are as many as the longest list. Targets without an
    accepted candidate are left out; a null candidate is passed over.
    """
    open_, found = checkpointed(targets.withColumn("__target", F.monotonically_increasing_id())), None
    place = 0
    while not open_.isEmpty():
        place += 1
        asked = open_.withColumn("candidate", F.get(candidates, F.lit(place - 1))).where("candidate is not null")
        won = checkpointed(ask(asked).withColumn("place", F.lit(place)))
        found = won if found is None else found.unionByName(won)
        left = open_.where(F.size(candidates) > place)
        open_ = checkpointed(left.join(won.select("__target"), "__target", "left_anti"))
    if found is None:
        found = ask(open_.limit(0).withColumn("candidate", F.get(candidates, F.lit(0)))).withColumn("place", F.lit(0))
    return found.drop("__target")


def recorded(spark: SparkSession, responses: DataFrame, cache: str) -> str:
    """Puts responses (url, body) into a cache, so that ``fetched`` serves them; returns the cache."""
    responses.select("url", F.lit(200).alias("status"), "body", F.current_timestamp().alias("fetched_at")).write.mode("append").parquet(cache)
    return cache
