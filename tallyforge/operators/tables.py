"""Keyed tables without row-level writes: every change is a new DataFrame, written over its partitions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tallyforge.operators.runtime import large


def last_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row written under each key."""
    n = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def first_of_each(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    n = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def largest_of_each(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key, the largest column by column; rows with a null in the key all stay. Maps, which have no order,
    don't decide."""
    whole = reduce(and_, (F.col(k).isNotNull() for k in key))
    order = [F.desc_nulls_last(f.name) for f in rows.schema if f.name not in key and not isinstance(f.dataType, MapType)]
    known = rows.where(whole)
    return (first_of_each(known, key, *order) if order else known.dropDuplicates(key)).unionByName(rows.where(~whole))


def upsert(existing: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """New rows replace whole rows of the same key; of several new ones, the last by ``order``, or without it the largest."""
    new = last_of_each(new, key, order).select(existing.columns) if order else largest_of_each(new.select(existing.columns), key)
    return existing.join(new.select(*key), key, "left_anti").unionByName(new)


def newest(existing: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of all rows of a key the one with the largest ``order``; of equal ones a new row, and then the larger by its columns."""
    rows = existing.withColumn("__new", F.lit(0)).unionByName(new.select(existing.columns).withColumn("__new", F.lit(1)))
    rest = [F.desc_nulls_last(c) for c in existing.columns if c not in key]
    return first_of_each(rows, key, F.desc_nulls_last(order), F.desc("__new"), *rest).drop("__new")


def insert_ignore(existing: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """New rows are added where their key is unknown; of several, the first by ``order``."""
    fresh = first_of_each(new, key, F.asc(order)).join(existing.select(*key), key, "left_anti")
    return existing.unionByName(fresh.select(existing.columns))


def replace_scope(existing: DataFrame, new: DataFrame, scope: Column) -> DataFrame:
    """Rows in scope (a version, a provider) go; the new ones come. Without new rows nothing changes."""
    if new.isEmpty():
        return existing
    return existing.where(~F.coalesce(scope, F.lit(False))).unionByName(new.select(existing.columns))


def merge(existing: DataFrame, new: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """Full outer merge; ``rules`` give columns from ``old.x`` and ``new.x``, others take the old value first.

    Of several new rows of a key the largest counts; rows with a null in the key are never the same.
    """
    cols = [c for c in existing.columns if c not in key]
    new = largest_of_each(new, key)
    both = existing.alias("old").join(new.alias("new"), key, "full_outer")
    return both.select(*key, *(rules.get(c, F.coalesce(f"old.{c}", f"new.{c}")).alias(c) for c in cols))


def earlier_year() -> dict[str, Column]:
    """The earliest release year wins."""
    return {"release_year": F.least("old.release_year", "new.release_year")}


def repaired_year() -> dict[str, Column]:
    """A repair's year replaces one that is later, equal or missing."""
    old, new = F.col("old.release_year"), F.col("new.release_year")
    return {"release_year": F.when(new.isNotNull() & (old.isNull() | (new <= old)), new).otherwise(old)}


def fill_empty(column: str) -> Column:
    """The new text only where the old one is empty."""
    return F.coalesce(F.nullif(F.col(f"old.{column}"), F.lit("")), F.col(f"new.{column}"))


def repoint(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replaces ids by what ``mapping`` (old, canonical) says; others and nulls stay. Of several canonical ids of an old
    one the smallest counts; columns may have any name but the two that begin with two underscores here."""
    m = mapping.groupBy(F.col("old").alias("__old")).agg(F.min("canonical").alias("__canonical"))
    out = rows.join(m, F.col(column) == F.col("__old"), "left")
    return out.withColumn(column, F.coalesce("__canonical", column)).select(rows.columns)


def orphans(parents: DataFrame, key: str, *children: DataFrame) -> DataFrame:
    """Parents that no child refers to."""
    for child in children:
        parents = parents.join(large(child.select(key)), key, "left_anti")
    return parents


def changed(old: Column, new: Column, least: float = 1e-9) -> Column:
    """Whether a number moved; null equals null."""
    return ~(old.eqNullSafe(new) | F.coalesce(F.abs(old - new) < least, F.lit(False)))


def write_scope(frame: DataFrame, path: str, column: str) -> None:
    """Replaces only the partitions (versions, providers) that ``frame`` has."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def catalog_columns(spark: SparkSession, name: str) -> list[str]:
    """A table's columns, none where there is no such table."""
    return spark.table(name).columns if spark.catalog.tableExists(name) else []
