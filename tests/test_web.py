"""Fetching: retries, moves and faults; the cache; listings page by page and candidates in turn, against plain loops."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import web


def script(*answers):
    """A web that gives these answers one after the other; exceptions are raised. The calls are kept."""
    left, calls = list(answers), []

    def get(url):
        calls.append(url)
        a = left.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    get.calls = calls
    return get


def test_retries_double_their_pauses():
    waits = []
    get = script((503, None, None), OSError("reset"), (429, None, None), (200, "x", None))
    assert web.fetch("u", get, web.Fetching(retries=3, backoff=0.5), waits.append) == (200, "x") and waits == [0.5, 1.0, 2.0]
    with pytest.raises(web.FetchError, match="503"):
        web.fetch("u", script(*[(503, None, None)] * 2), web.Fetching(retries=1), waits.append)


def test_faults_end_at_once():
    get = script((403, None, None))
    with pytest.raises(web.FetchError, match="403"):
        web.fetch("u", get, web.Fetching(), lambda s: None)
    assert len(get.calls) == 1
    assert web.fetch("u", script((404, None, None))) == (404, None)


def test_moves_are_followed():
    get = script((301, None, "/b"), (302, None, "http://h2/c"), (200, "x", None))
    assert web.fetch("http://h/a", get) == (200, "x") and get.calls == ["http://h/a", "http://h/b", "http://h2/c"]
    assert web.fetch("http://h/a", script((301, None, None))) == (301, None)
    with pytest.raises(web.FetchError, match="moves"):
        web.fetch("http://h/a", script(*[(301, None, f"/{k}") for k in range(4)]), web.Fetching(redirects=3))


def test_json_that_is_none_is_tried_again():
    assert web.fetch("u", script((200, "<html>", None), (200, "{}", None)), web.Fetching(as_json=True, backoff=0)) == (200, "{}")


def test_cache(spark, tmp_path):
    """Bodies are fetched once; pages that were gone are asked for again; a failure writes nothing."""
    cache, seen = str(tmp_path / "cache"), str(tmp_path / "calls")

    def get(url):
        with open(seen, "a") as f:
            f.write(url + "\n")
        return (404, None, None) if "gone" in url else (200, f"{url}!", None)

    urls = spark.createDataFrame([("a",), ("b",), ("a",), ("gone",), (None,)], "url string")
    want = {("a", 200, "a!"), ("b", 200, "b!"), ("gone", 404, None)}
    for refresh, calls in ((False, ["a", "b", "gone"]), (False, ["gone"]), (True, ["a", "b", "gone"])):
        open(seen, "w").close()
        assert {tuple(r) for r in web.fetched(urls, cache, get, refresh=refresh).collect()} == want
        assert sorted(open(seen).read().split()) == calls
    before = spark.read.parquet(cache).count()
    with pytest.raises(Exception, match="500"):
        web.fetched(urls, cache, lambda url: (500, None, None), web.Fetching(retries=0), refresh=True).collect()
    assert spark.read.parquet(cache).count() == before
    assert web.fetched(urls.limit(0), cache, get).count() == 0


def test_source_of_responses(spark):
    spark.dataSource.register(web.web_source(lambda url: (200, url.upper(), None)))
    got = spark.read.format("web").option("urls", "a\nb\n\na\nc").option("batch", 2).load()
    assert sorted(map(tuple, got.collect())) == [("a", 200, "A"), ("b", 200, "B"), ("c", 200, "C")] and got.rdd.getNumPartitions() == 2


#: Pages of listings: (items, total); what isn't there is missing.
SITE = {
    "x": [(["a", "b", "a"], 7), (["b", "c"], 7), (["d", None], 7), (["e"], 7)], "none": [], "empty": [([], 0), (["z"], 0)],
    "again": [(["a", "b"], 0), (["b", "a"], 0), (["c"], 0)], "long": [([f"k{p}"], 0) for p in range(6)], "told": [(["p"], 0), (["q"], 0), (["r"], 0)],
}


def plain(name, expected, cap, most):
    """A reader of one page after the other."""
    out, seen, offset = [], set(), 0
    for page, (items, total) in enumerate(SITE[name], 1):
        new = 0
        for position, key in enumerate(items):
            if key is not None and key not in seen:
                if most is not None and len(out) >= most:
                    return out
                seen.add(key)
                out.append((page, position, key))
                new += 1
        offset += len(items)
        if not items or not new or (total or expected or 0) and offset >= (total or expected) or cap and page >= cap:
            break
    return out


@pytest.mark.parametrize("cap, most", [(None, None), (2, None), (None, 3)])
def test_listings(spark, cap, most):
    listings = spark.createDataFrame([(n, f"http://s/{n}", 2 if n == "told" else None) for n in SITE], "listing string, base string, expected int")

    def ask(urls):
        at = lambda url: (url.split("/")[3], int(url.split("/")[4]) - 1)
        rows = [(r.url, json.dumps({"items": [{"id": k} for k in SITE[n][p][0]], "total": SITE[n][p][1]}) if p < len(SITE[n]) else None) for r in urls.collect() for n, p in [at(r.url)]]
        return spark.createDataFrame(rows, "url string, body string")

    def parse(pages):
        d = pages.withColumn("d", F.from_json("body", "items array<struct<id:string>>, total long"))
        return d.select("listing", "page", "d.total", F.posexplode("d.items").alias("position", "item")).withColumn("key", F.col("item.id"))

    got = web.crawl(listings, ask, parse, lambda base, page, offset: F.concat(base, F.lit("/"), page.cast("string")), cap, most)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.listing, []).append((int(r.page), r.position, r.key))
    assert {n: sorted(v) for n, v in rows.items()} == {n: w for n, s in SITE.items() if (w := plain(n, 2 if n == "told" else None, cap, most))}
    assert web.crawl(listings.limit(0), ask, parse, lambda *a: F.lit("u")).count() == 0


def test_candidates_in_turn(spark):
    targets = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (2, ["x"]), (3, []), (4, None), (5, ["q", None, "b"])], "id int, c array<string>")
    asked = []

    def ask(rows):
        asked.append(sorted(r.candidate for r in rows.collect()))
        return rows.where("candidate in ('b', 'c')")

    assert sorted((r.id, r.candidate, r.place) for r in web.first_accepted(targets, "c", ask).collect()) == [(1, "b", 2), (5, "b", 3)]
    assert ["a", "q", "x", "x"] in asked and ["b"] in asked
