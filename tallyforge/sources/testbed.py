"""The domain's tables, from the star-schema tables that tests and benchmarks run on; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("game_id"), F.col("p_name").alias("title"),
        (F.lit(2014) + F.col("p_size") % 12).cast("int").alias("release_year"), F.col("p_brand").alias("developer"),
        F.array("p_type", F.split_part("p_name", F.lit(" "), F.lit(1))).alias("genres"), F.array("p_brand").alias("platforms"),
    )


def sources(spark, sf_dir) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), F.col("n_name").alias("country_region")
    )


def reviews(spark, sf_dir) -> DataFrame:
    """Scores are quantities on a scale of 50; providers are the parity of the line number."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("game_id"), F.col("l_suppkey").alias("source_id"),
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("l_quantity") / 50 * 100)).alias("score"),
        F.col("l_returnflag").alias("language"), F.col("l_linestatus").alias("platform"), F.col("l_shipdate").alias("review_date"),
        F.when(F.col("l_linenumber") % 2 == 0, "alpha").otherwise("beta").alias("data_source"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.date_format("l_shipdate", "yyyyMMdd")).alias("review_id"),
    )


def baselines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("game_id"), F.col("o_orderpriority").alias("source_platform"),
        F.when(F.col("o_orderstatus") == "F", F.lit(None)).otherwise(F.col("o_totalprice")).alias("external_score"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise(F.col("o_orderkey") % 97).cast("int").alias("review_count"),
        F.col("o_orderdate").alias("collected_at"), F.col("o_orderkey").alias("baseline_id"),
        F.concat(F.lit("https://site/game/pc/"), F.translate(F.concat_ws("-", "o_orderpriority", F.col("o_orderkey") % 211), " ", "-")).alias("source_url"),
    )


GAMES = "games as (select p_partkey as game_id, p_name as title, cast(2014 + p_size % 12 as int) as release_year, p_brand as developer, [p_type, split_part(p_name, ' ', 1)] as genres, [p_brand] as platforms from part)"
SOURCES = "sources as (select s_suppkey as source_id, s_name as name, n_name as country_region from supplier join nation on s_nationkey = n_nationkey)"
REVIEWS = """reviews as (select l_partkey as game_id, l_suppkey as source_id, least(100.0, greatest(0.0, l_quantity / 50 * 100)) as score,
 l_returnflag as language, l_linestatus as platform, l_shipdate as review_date, case when l_linenumber % 2 = 0 then 'alpha' else 'beta' end as data_source,
 concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int), strftime(l_shipdate, '%Y%m%d')) as review_id from lineitem)"""
BASELINES = """baselines as (select o_custkey as game_id, o_orderpriority as source_platform, case when o_orderstatus = 'F' then null else o_totalprice end as external_score,
 cast(case when o_orderkey % 5 = 0 then null else o_orderkey % 97 end as int) as review_count, o_orderdate as collected_at, o_orderkey as baseline_id,
 'https://site/game/pc/' || replace(concat_ws('-', o_orderpriority, o_orderkey % 211), ' ', '-') as source_url from orders)"""


def with_(*ctes: str, body: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + body
