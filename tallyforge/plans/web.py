"""Queries that read pages: responses from a recorded cache and an invented web, listings page by page, candidates in turn."""

from __future__ import annotations

import hashlib
import json
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators.runtime import scratch
from tallyforge.plans.registry import query
from tallyforge.sources import testbed as T
from tallyforge.sources import web

_FAST = web.Fetching(backoff=0.0)


def _invented(url: str):
    """A web of pages that say their address; some fail at first, some are gone, some have moved."""
    if url.startswith("http://gone/"):
        return 404, None, None
    if url.startswith("http://moved/to/"):
        return 200, "fetched " + url, None
    if url.startswith("http://moved/"):
        return 301, None, "/to/" + url.rsplit("/", 1)[1]
    if hashlib.md5(url.encode()).hexdigest() < "4":
        tries = _invented.__dict__.setdefault("tries", {})
        tries[url] = tries.get(url, 0) + 1
        if tries[url] % 2:
            return 503, None, None
    return 200, "fetched " + url, None


@query("q_web_responses", """with recorded as (select url, max(html) as body from pages where page_id % 2 = 0 and html is not null group by 1),
wanted as (select url from pages where url is not null union select 'http://gone/' || page_id from pages where page_id % 10 = 0 union select 'http://moved/' || page_id from pages where page_id % 10 = 1)
select w.url, case when starts_with(w.url, 'http://gone/') then 404 else 200 end as status,
  md5(case when starts_with(w.url, 'http://gone/') then null when starts_with(w.url, 'http://moved/') then 'fetched http://moved/to/' || split_part(w.url, '/', 4) else coalesce(r.body, 'fetched ' || w.url) end) as body
from wanted w left join recorded r using (url)""")
def q_web_responses(spark, sf_dir):
    """Half of the pages from what was recorded, the rest fetched, with retries and moves."""
    pages = T.table(spark, sf_dir, "pages")
    kept = pages.where("page_id % 2 = 0 and html is not null").groupBy("url").agg(F.max("html").alias("body"))
    cache = web.recorded(spark, kept, scratch(spark, "responses"))
    odd = lambda n, name: pages.where(F.col("page_id") % 10 == n).select(F.concat(F.lit(f"http://{name}/"), F.col("page_id").cast("string")).alias("url"))
    got = web.fetched(pages.select("url").unionByName(odd(0, "gone")).unionByName(odd(1, "moved")), cache, _invented, _FAST)
    return got.select("url", "status", F.md5("body").alias("body"))


#: Keys that a listing's items repeat after, and items of a page.
_KEYS, _LIMIT = 31, 20


def _listing_page(url: str):
    """Items of one product from an offset on; their keys come again after a while, so that a page may bring nothing new."""
    parts = urlsplit(url)
    total, offset = int(parts.path.rsplit("/", 1)[1]) % 67, int(parse_qs(parts.query)["offset"][0])
    items = [{"id": f"r{k % _KEYS}", "score": k} for k in range(offset, min(total, offset + _LIMIT))]
    return 200, json.dumps({"items": items, "total": total}), None


@query("q_web_listings", """select p_partkey as listing, 'r' || k as key, 1 + k // 20 as page, k as score from part, range(31) t(k) where k < p_partkey % 67""")
def q_web_listings(spark, sf_dir):
    """Every listing is read until its total, or until a page brings nothing new."""
    listings = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("listing"), F.concat(F.lit("http://x/reviews/"), F.col("p_partkey").cast("string")).alias("base"), F.lit(None).cast("long").alias("expected"))
    cache = scratch(spark, "listings")
    ask = lambda urls: web.fetched(urls, cache, _listing_page, web.Fetching(as_json=True))

    def parse(pages):
        d = pages.withColumn("d", F.from_json("body", "items array<struct<id:string,score:long>>, total long"))
        return d.select("listing", "page", "d.total", F.posexplode("d.items").alias("position", "item")).withColumn("key", F.col("item.id"))

    url = lambda base, page, offset: F.concat(base, F.lit("?offset="), offset.cast("string"))
    got = web.crawl(listings, ask, parse, url)
    return got.select("listing", "key", F.col("page").cast("long").alias("page"), F.col("item.score").alias("score"))


_CANDIDATES = """titled as (select p_partkey, case p_partkey % 4 when 0 then p_name || ' (2015)' when 1 then p_name || ': two' when 2 then p_name || ' + one' else p_name end as title, p_name from part),
asked as (select p_partkey, unnest(c) as candidate, generate_subscripts(c, 1) as place from (select p_partkey, case p_partkey % 4
  when 0 then [replace(p_name, ' ', '-') || '-2015', replace(p_name, ' ', '-')] when 1 then [replace(p_name, ' ', '-') || '-two', replace(p_name, ' ', '-')]
  when 2 then [replace(p_name, ' ', '-') || '-plus-one', replace(p_name, ' ', '-') || '-one'] else [replace(p_name, ' ', '-')] end as c from titled))"""


@query("q_web_candidates", f"with {_CANDIDATES} select p_partkey, arg_min(candidate, place) as candidate, min(place) as place from asked where md5('http://x/game/' || candidate) < '8' group by 1")
def q_web_candidates(spark, sf_dir):
    """The first slug under which a product is found, asked one after the other."""
    n, name = F.col("p_partkey") % 4, F.col("p_name")
    title = F.when(n == 0, F.concat(name, F.lit(" (2015)"))).when(n == 1, F.concat(name, F.lit(": two"))).when(n == 2, F.concat(name, F.lit(" + one"))).otherwise(name)
    targets = T.table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), "p_name").withColumn("slugs", X.slug_candidates(F.col("title")))
    cache = scratch(spark, "products")
    get = lambda url: (200, "{}", None) if hashlib.md5(url.encode()).hexdigest() < "8" else (404, None, None)

    def ask(rows):
        rows = rows.withColumn("url", F.concat(F.lit("http://x/game/"), F.col("candidate")))
        return rows.join(web.fetched(rows.select("url"), cache, get).where("body is not null").select("url"), "url", "left_semi").drop("url")

    return web.first_accepted(targets, "slugs", ask).select("p_partkey", "candidate", F.col("place").cast("long").alias("place"))
