import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import publish as P
from tallyforge.operators.store import BucketTable
from tallyforge.operators.tables import newest
from tallyforge.sources import files as S
from tallyforge.streaming.events import merge_batches, windowed


def test_csv_and_dates(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('ID,Game,Website,Review,Score\n1,"A, B",x,"two\nlines ""q""",8.5\n2,C,y,z,tbd\n', encoding="utf-8")
    rows = S.read_reviews(spark, str(path)).collect()
    assert [(r.Game, r.Review, r.Score) for r in rows] == [("A, B", 'two\nlines "q"', 8.5)]
    assert S.read_dates(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([("A", None), ("A", "2020"), ("A", "2019")], "`Game\r` string, `release_date\r` string").write.parquet(str(tmp_path / "d"))
    assert [tuple(r) for r in S.read_dates(spark, str(tmp_path / "d")).collect()] == [("A", "2020")]


def test_targets(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("﻿slug,metacritic_slug,game_id,title\n a ,,1,T\nb,c,1,\n", encoding="utf-8")
    got = S.read_targets(spark, str(path), {"slug": ("metacritic_slug", "slug"), "game_id": ("game_id",), "title": ("title",)})
    assert [tuple(r) for r in got.collect()] == [("a", "1", "T"), ("c", "1", None)]
    kept = S.overrides(got.withColumn("line_no", F.monotonically_increasing_id()))
    assert {r.key: r.slug for r in kept.collect()} == {"1": "c", "T": "a"}


def test_catalog(spark, tmp_path):
    row = {"slug": "s", "name": "N", "genres": [{"name": "RPG"}, {"name": ""}], "parent_platforms": [{"platform": {"name": "PC"}}]}
    (tmp_path / "c.jsonl").write_text(json.dumps(row) + "\n" + json.dumps({"slug": "t"}) + "\n")
    got = S.read_catalog(spark, str(tmp_path / "c.jsonl")).orderBy("line_no").collect()
    assert (got[0].genres, got[0].parent_platforms, got[1].slug) == (["RPG"], ["PC"], "t")


def test_page_state(spark):
    state = json.dumps({"api/game?time=2020": [1, 2], "game/7/x": {"id": 7}})
    page = f'<html><script id="app-state" type="j">{state.replace(chr(34), "&q;")}</script></html>'
    pages = spark.createDataFrame([("u", page), ("v", "<html></html>"), ("w", None)], "url string, html string")
    got = S.state_entries(S.page_states(pages), "game/").collect()
    assert [(r.url, r.key, json.loads(r.value)) for r in got] == [("u", "game/7/x", {"id": 7})]
    ids = spark.createDataFrame([("https://h/game/12/some-title?x",)], "u string").select(*S.provider_url(F.col("u"))).first()
    assert tuple(ids) == (12, "some-title", "Some Title")


def test_cached_responses(spark, tmp_path):
    product = {"title": "T", "releaseDate": "2020-02-03", "criticScoreSummary": {"score": 81, "reviewCount": 7}}
    (tmp_path / hashlib.md5(b"http://a").hexdigest()).write_text(json.dumps(product))
    (tmp_path / hashlib.md5(b"http://c").hexdigest()).write_text("not json")
    urls = spark.createDataFrame([("http://a",), ("http://b",), ("http://a",), ("http://c",)], "url string")
    got = S.cached_responses(urls, str(tmp_path))
    assert {r.url: r.body and r.body[:3] for r in got.collect()} == {"http://a": '{"t', "http://b": None, "http://c": "not"}
    assert [tuple(r) for r in S.products(got).collect()] == [("http://a", "T", 2020, 7, 81.0)]


def test_pages(spark):
    listings = spark.createDataFrame([("x", "u", 45), ("y", "v", None)], "listing string, base string, expected int")
    assert sorted((r.listing, r.page, r.url) for r in S.page_urls(listings).collect()) == [("x", 1, "u"), ("x", 2, "u?page=2"), ("x", 3, "u?page=3"), ("x", 4, "u?page=4"), ("y", 1, "v")]
    assert sorted(r.url for r in S.offset_urls(listings, 30).collect()) == ["u?offset=0&limit=30", "u?offset=30&limit=30", "v?offset=0&limit=30"]
    rows = [("x", 1, 0, "a"), ("x", 1, 1, "b"), ("x", 1, 2, "a"), ("x", 2, 0, "b"), ("x", 2, 1, "c"), ("x", 3, 0, "a"), ("x", 4, 0, "z"), ("y", 2, 0, "q"), ("w", 1, 0, None)]
    items = spark.createDataFrame(rows, "listing string, page int, position int, key string")
    assert sorted((r.listing, r.key) for r in S.first_seen(items).collect()) == [("x", "a"), ("x", "b"), ("x", "c")]
    assert sorted(r.key for r in S.first_seen(items, 2).collect()) == ["a", "b"]


def test_catalog_lines_in_order_over_files(spark, tmp_path):
    for k, name in enumerate(("b.jsonl", "a.jsonl")):
        (tmp_path / name).write_text("".join(json.dumps({"slug": f"{name[0]}{i}"}) + "\n" for i in range(5 + k)))
    got = [r.slug for r in S.read_catalog(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [f"a{i}" for i in range(6)] + [f"b{i}" for i in range(5)]


def test_document_for_each_key(spark, tmp_path):
    frame = spark.createDataFrame([(1, "é"), (2, None), (3, "x")], "id int, t string")
    write = lambda f: P.write_files(f, "id", str(tmp_path / "docs"), 4)
    assert write(frame) == {"written": 3, "removed": 0} and write(frame) == {"written": 0, "removed": 0}
    stamp = (tmp_path / "docs" / "1.json").stat().st_mtime_ns
    assert write(frame.where("id <> 2").withColumn("t", F.when(F.col("id") == 3, "y").otherwise(F.col("t")))) == {"written": 1, "removed": 1}
    assert sorted(f.name for f in (tmp_path / "docs").glob("*.json*")) == ["1.json", "3.json"] and (tmp_path / "docs" / "1.json").stat().st_mtime_ns == stamp
    assert (tmp_path / "docs" / "3.json").read_text() == '{"id":3,"t":"y"}'
    assert (tmp_path / "docs" / "1.json").read_text(encoding="utf-8") == '{"id":1,"t":"é"}'
    with pytest.raises(Exception, match="not a file name"):
        P.write_files(frame.withColumn("id", F.lit("../x")), "id", str(tmp_path / "docs"))
    P.write_table(frame, "id", str(tmp_path / "table"), 4)
    assert P.read_document(spark, str(tmp_path / "table"), "3", 4).collect()[0].json == '{"id":3,"t":"x"}'
    assert P.read_document(spark, str(tmp_path / "table"), "9", 4).count() == 0


def test_publication_writes_what_changed(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(list(rows), "key string, json string")
    table = P.published(spark, str(tmp_path / "p"), 8)
    assert P.publish(docs(*((str(k), f"v{k}") for k in range(40)), (None, "x"), ("7", "a")), table) == {"written": 40, "removed": 0}
    first = table.manifest()
    same = docs(*((str(k), f"v{k}") for k in range(40)))
    assert P.publish(same, table) == {"written": 0, "removed": 0} and table.manifest() == first
    assert P.publish(docs(*((str(k), f"v{k}") for k in range(1, 40)), ("new", "n")), table) == {"written": 1, "removed": 1}
    assert {r.key: r.json for r in table.read().collect()} == {**{str(k): f"v{k}" for k in range(1, 40)}, "new": "n"}
    moved = [b for b, f in table.manifest()["folders"].items() if first["folders"].get(b) != f]
    assert len(moved) <= 2 and [r.json for r in table.lookup("new").collect()] == ["n"]
    assert P.publish(docs(), table) == {"written": 0, "removed": 40} and table.read().count() == 0


def test_documents(spark, tmp_path):
    P.write_documents(spark.createDataFrame([(1, "é", None)], "id int, t string, x int"), "id", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"id":1,"t":"é","x":null}'


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed(stream).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("totals").agg(F.sum("n")).first()[0] == events.count()
    users = stream.select("user_id", "event_id", "value")
    table = BucketTable(spark, str(tmp_path / "merged"), users.schema, ["user_id"], 8)
    q = merge_batches(users, table, "event_id", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    last = {r.user_id: r.event_id for r in events.groupBy("user_id").agg(F.max("event_id").alias("event_id")).collect()}
    assert {r.user_id: r.event_id for r in table.read().collect()} == last


def test_repeated_and_late_batches(spark, tmp_path):
    """A batch that runs again changes nothing, a late row doesn't replace a newer one, and few buckets are written."""
    schema = "id long, at long, v string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    table = BucketTable(spark, str(tmp_path / "t"), schema, ["id"], 16)
    table.replace(spark.range(500).selectExpr("id", "0L as at", "'first' as v"))
    before = table.manifest()
    rule = lambda old, new: newest(old, new, ["id"], "at")
    touched = table.change(rows((7, 5, "b"), (7, 4, "a"), (None, 1, "n")), rule, ("s", 0))
    after = table.manifest()
    assert 1 <= len(touched) <= 2 and {b for b in before["folders"] if before["folders"][b] != after["folders"][b]} == {str(b) for b in touched}
    assert table.change(rows((7, 9, "x")), rule, ("s", 0)) == [] and table.manifest() == after
    table.change(rows((7, 3, "late"), (8, 1, "new")), rule, ("s", 1))
    assert {r.id: r.v for r in table.read().where("v <> 'first'").collect()} == {7: "b", 8: "new", None: "n"} and table.read().count() == 501
    found = table.lookup(7)
    assert [r.v for r in found.collect()] == ["b"] and len(found.inputFiles()) == 1
    assert table.change(rows(), rule) == []
    table.vacuum(1)
    assert table.read().count() == 501 and len(list((tmp_path / "t" / "_manifests").glob("*.json"))) == 1
    with pytest.raises(ValueError, match="doesn't touch"):
        table.change(rows((7, 1, "x")), lambda old, new: table.read())
    with pytest.raises(FileExistsError):
        table._commit({"version": table.manifest()["version"] - 1}, {}, {})
