import duckdb

from tallyforge.llm import urls


def rows(spark):
    link = lambda u: f"<html><head><link rel='canonical' href='{u}'></head></html>"
    data = [
        (1, "http://a.org/x", link("https://Sub.Example.com/en/7")),  # alias of a blocked URL
        (2, "http://b.org/y", '<meta http-equiv="refresh" content="0; url=http://a.org/x#frag">'),  # chain
        (3, "http://c.org/z", link("http://www.example.com/en/")),  # alias of an allowed URL
        (4, "http://d.org/z", link("//c.org/z") + '<META HTTP-EQUIV=refresh content="1;URL=/q?a=1&amp;b=2">'),
        (5, "http://d.org/q?a=1&b=2", None), (6, "http://d.org/q", "<p>none</p>"),
        (7, "http://net/es/1", link("http://www.example.com/en/")),  # its own rule goes first
        (8, None, None), (9, "", ""), (10, "no scheme/en/", link("http://net/es/")),
        (11, "http://EXAMPLE.com", link("")), (12, "http://x.net/fr/?q#f", None), (12, "http://x.net/fr/?q#f", None),
        (None, "http://notexample.com/en/x", None), (13, "http://e.org/1", link("relative/path")),
    ]
    return spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as host", "'x' as verdict")


def test_aliases_and_precedence(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(rows(spark)).collect()}
    assert got[1] == ("a.org", "/x", None, "block") and got[2][3] == "block"
    assert got[3][3] == got[4][3] == got[5][3] == "allow" and got[6][3] == "allow"
    assert got[7] == ("net", "/es/1", "net/es/", "block")
    assert got[8] == got[9] == got[10] == ("", "", None, "allow")
    assert got[11] == ("example.com", "", None, "allow")
    assert got[12] == ("x.net", "/fr/", "net/fr/", "block")
    assert got[None] == ("notexample.com", "/en/x", "com/", "allow")


def test_sql_agrees(spark):
    pages = rows(spark).drop("host", "verdict").toPandas()  # noqa: F841
    want = duckdb.sql(urls.SQL).fetchall()
    got = [tuple(r) for r in urls.judge(rows(spark)).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None if i != i else i and int(i), *r) for i, *r in want]))


def test_empty(spark):
    assert urls.judge(rows(spark).where("false")).collect() == []


def test_relative_targets_are_resolved(spark):
    link, base = lambda u: f"<link rel=canonical href='{u}'>", "<base href='http://net/es/a/'>"
    cases = [
        ("http://h.org/d/p?q", "index.html", "http://h.org/d/index.html"), ("http://h.org/d/e/p", "../new/", "http://h.org/d/new/"),
        ("http://h.org/d/p?q#f", "?id=3", "http://h.org/d/p?id=3"), ("http://h.org", "x?y=/../z", "http://h.org/x?y=/../z"), ("http://h.org?q", "?a=1", "http://h.org?a=1"),
        ("http://h.org/d/", "./a/./b/..", "http://h.org/d/a/"), ("http://h.org/d", "../../../a", "http://h.org/a"), ("http://h.org/d", "/a/../b/.", "http://h.org/b/"),
        ("http://h.org/d", "#f", "http://h.org/d"), ("http://h.org/d", "mailto:a@b.cc", None), ("http://h.org/d", "https://k.org/e", "https://k.org/e"),
    ]
    pages = spark.createDataFrame([(i, u, link(to)) for i, (u, to, _) in enumerate(cases)], "page_id int, url string, html string")
    assert sorted((r.url, r.other) for r in urls.alias_edges(pages).collect()) == sorted((u, want) for u, _, want in cases if want)
    planted = [(1, "http://h.org/1", base + link("../b?x")), (2, "http://k.org/d/2", '<meta http-equiv=refresh content="0; url=../../h">'), (3, "http://k.org/h", link("http://www.example.net/fr/"))]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(planted, "page_id int, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block"}
