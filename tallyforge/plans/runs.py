"""Queries that go through whole runs: import, duplicates, scores, publication, catalogs read twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge import steps
from tallyforge.functions import text as X
from tallyforge.operators import publish as P
from tallyforge.operators import resolve as R
from tallyforge.operators.runtime import scratch
from tallyforge.params import RunOptions
from tallyforge.pipeline import Pipeline, of_version
from tallyforge.plans.registry import query
from tallyforge.plans.resolve import _catalog, _stored
from tallyforge.plans.scoring import BASE
from tallyforge.sources import testbed as T
from tallyforge.sources.testbed import with_

# raw reviews whose items go by two names, of which the one with more reviews stays
_RAW = """named as (
  select l_suppkey as source_id, l_quantity * 2 as score, p_name || ' ' || p_partkey || case when l_linenumber % 3 = 0 then ' (PS4)' else '' end as title, p_name || ' ' || p_partkey as base
  from lineitem join part on p_partkey = l_partkey
),
titles as (select base, title, count(*) as n, 'mc-' || substr(md5(title), 1, 16) as id from named group by 1, 2),
chosen as (select base, first_value(id) over (partition by base order by n desc, id) as game_id, title from titles),
games as (select distinct game_id, []::varchar[] as genres, []::varchar[] as platforms from chosen),
reviews as (select game_id, source_id, score from named join chosen using (base, title))"""


def _raw(spark, sf_dir):
    lines, parts, sources = T.table(spark, sf_dir, "lineitem"), T.table(spark, sf_dir, "part"), T.table(spark, sf_dir, "supplier")
    rows = lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).join(sources, F.col("s_suppkey") == F.col("l_suppkey"))
    title = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, " (PS4)").otherwise(""))
    return rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ID"), title.alias("Game"), F.col("s_name").alias("Website"), F.lit("").alias("Review"), (F.col("l_quantity") * 2).cast("string").alias("Score"))


def _run(spark, sf_dir, **options):
    return Pipeline(steps.WHOLE, scratch(spark, "run")).run(spark, {"raw_reviews": _raw(spark, sf_dir)}, RunOptions(rebuild=True, **options))


@query("q_run_scores", with_(_RAW, *BASE[2:], body="select * from snapshots"))
def q_run_scores(spark, sf_dir):
    """Scores after a whole run from raw reviews."""
    return of_version(_run(spark, sf_dir, publish=False)["score_snapshots"], "v1")


@query("q_run_published", with_(_RAW, body="""select 'items' as what, count(*) as documents, count(*) as written, 0 as removed, 0 as again from games
 union all select 'sources', count(distinct source_id), count(distinct source_id), 0, 0 from reviews"""))
def q_run_published(spark, sf_dir):
    """How many documents a run publishes, and how many a second publication writes."""
    out, rows = _run(spark, sf_dir), []
    for what, name in (("items", "item_documents"), ("sources", "source_documents")):
        table = P.published(spark, scratch(spark, what), 16)
        first, again = P.publish(out[name], table), P.publish(out[name], table)
        rows.append((what, table.read().count(), first["written"], first["removed"] + again["removed"], again["written"]))
    return spark.createDataFrame(rows, "what string, documents long, written long, removed long, again long")


@query("q_enrich_twice")
def q_enrich_twice(spark, sf_dir):
    """A catalog's rows by their keys, and by words for items that no key finds."""
    stored, rows = _stored(spark, sf_dir), _catalog(spark, sf_dir)
    keys = R.catalog_keys(F.col("name"), F.col("slug"), F.col("url"), F.col("year"))
    words = lambda t: F.array_distinct(F.split(X.title_enrich(F.col(t)), " "))
    return R.two_passes(rows, keys, stored, R.catalog_index(stored, stored), words("name"), words("title"))
