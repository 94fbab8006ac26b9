"""Published views: lists, nested details, totals."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators.runtime import freed_shuffles, stored_parts
from tallyforge.operators.store import BucketTable

RECENT = 20
SHOWN_WEIGHTS = 10


def item_list(games: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every item with its four scores, where it has them."""
    s = snapshots.select(
        "game_id", F.col("raw_average").alias("mean"), F.col("trimmed_mean").alias("robust"), F.col("calibrated_score").alias("calibrated"),
        F.col("weighted_score").alias("weighted"), "sample_count",
    )
    enhanced = (F.coalesce(F.size("genres"), F.lit(0)) > 0) | (F.coalesce(F.size("platforms"), F.lit(0)) > 0) | (F.coalesce("developer", F.lit("")) != "")
    return games.join(s, "game_id", "left").select(
        "game_id", "title", "release_year", "developer", "genres", "platforms", "mean", "robust", "calibrated", "weighted",
        F.coalesce("sample_count", F.lit(0)).alias("review_count"), enhanced.alias("has_enhanced_data"),
    )


def item_detail(items: DataFrame, reviews: DataFrame, sources: DataFrame, weights: DataFrame) -> DataFrame:
    """Each item with its reviews, newest first, their sources' names and global weights, and language counts."""
    whole = weights.where("genre is null and platform is null").select("source_id", F.col("context_weight").alias("weight"))
    named = reviews.join(sources.select("source_id", "name"), "source_id", "left").join(whole, "source_id", "left")
    entry = F.struct(
        F.col("review_date").alias("date"), F.col("review_id"), F.col("name").alias("source"), "score", F.coalesce("weight", F.lit(1.0)).alias("weight"), "language", "platform"
    )
    nested = named.groupBy("game_id").agg(F.sort_array(F.collect_list(entry), asc=False).alias("reviews"))
    return items.join(nested, "game_id", "left").withColumn("reviews", F.coalesce("reviews", F.array().cast(nested.schema["reviews"].dataType)))


def source_list(sources: DataFrame, metrics: DataFrame, weights: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every source with its metrics, the mean of its contextual weights, and its reviews where it has no metrics."""
    mean = weights.groupBy("source_id").agg(F.round(F.avg("context_weight"), 4).alias("base_weight"))
    counts = reviews.groupBy("source_id").agg(F.count("*").alias("n"))
    out = sources.join(metrics.select("source_id", "sample_count", "mean_score"), "source_id", "left").join(mean, "source_id", "left").join(counts, "source_id", "left")
    known = F.coalesce("sample_count", F.lit(0))
    return out.select("source_id", "name", "country_region", F.when(known > 0, known).otherwise(F.coalesce("n", F.lit(0))).alias("review_count"), "mean_score", "base_weight")


def recent_reviews(reviews: DataFrame, games: DataFrame, most: int = RECENT) -> DataFrame:
    """The newest reviews of each source, with the items' titles."""
    place = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc_nulls_last("review_date"), "review_id"))
    return reviews.withColumn("position", place).where(F.col("position") <= most).join(games.select("game_id", "title"), "game_id").select("source_id", "position", "review_id", "title", "score")


def shown_weights(weights: DataFrame, most: int = SHOWN_WEIGHTS) -> DataFrame:
    """The first weights of each source: the global one, then genres and platforms by weight."""
    kind = F.when(F.col("genre").isNull() & F.col("platform").isNull(), 0).when(F.col("platform").isNull(), 1).otherwise(2)
    place = F.row_number().over(W.partitionBy("source_id").orderBy(kind, F.desc("context_weight"), "genre", "platform"))
    return weights.withColumn("position", place).where(F.col("position") <= most)


def source_detail(listed: DataFrame, recent: DataFrame, shown: DataFrame, cover: DataFrame) -> DataFrame:
    """Each source with its newest reviews, first weights and coverage, nested."""
    nest = lambda d, name, *c: d.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct(*c))).alias(name))
    return (
        listed.join(nest(recent, "recent", "position", "title", "score"), "source_id", "left")
        .join(nest(shown, "weights", "position", "genre", "platform", "context_weight"), "source_id", "left")
        .join(nest(cover, "coverage", "value", "n"), "source_id", "left")
    )


def meta(games: DataFrame, reviews: DataFrame, sources: DataFrame) -> DataFrame:
    """Totals of the published tables."""
    r = reviews.agg(F.count("*").alias("reviews"), F.countDistinct("game_id").alias("reviewed_games"), F.countDistinct("language").alias("languages"))
    return games.agg(F.count("*").alias("games")).join(r).join(sources.agg(F.count("*").alias("sources")))  # rows of one


def as_documents(frame: DataFrame, key: str) -> DataFrame:
    """(key, json): one compact document for each row; nulls stay."""
    return frame.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_documents(frame: DataFrame, key: str, path: str) -> None:
    """Documents as JSON lines under ``path``, dealt by key; stale ones go, as the folder is replaced."""
    as_documents(frame, key).select("json").write.mode("overwrite").text(path)


def write_table(frame: DataFrame, key: str, path: str, buckets: int = 64) -> None:
    """Documents (key, json) dealt over buckets by key and sorted there, to be read by key."""
    rows = as_documents(frame, key).withColumn("bucket", _bucket(F.col("key"), buckets))
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_document(spark: SparkSession, path: str, key: str, buckets: int = 64) -> DataFrame:
    """The document of one key: Spark opens the folder of its bucket alone, and there the row groups that may have it."""
    return spark.read.parquet(path).where((F.col("bucket") == _bucket(F.lit(key), buckets)) & (F.col("key") == key)).select("key", "json")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


PUBLISHED = "key string, digest string, json string"


def published(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    """The table under ``path`` that holds documents with their digests."""
    return BucketTable(spark, path, PUBLISHED, ["key"], buckets)


def document_changes(documents: DataFrame, table: BucketTable) -> DataFrame:
    """(key, digest, json, __bucket) of documents (key, json) that are new or other than the table's; those that went have no json.

    Null keys are no documents; of several documents of a key the largest counts. Documents are shuffled once, to where
    their bucket, or a slice of it, is written, and meet the digests of the table there.
    """
    old, none = table.read(), F.lit(None).cast("string")
    rows = documents.where("key is not null").select("key", "json", none.alias("__old")).unionByName(old.select("key", none.alias("json"), F.col("digest").alias("__old")))
    parts = max(table.buckets, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), stored_parts(documents))
    slices = 1 if parts == table.buckets else 4 * -(-parts // table.buckets)
    rows = rows.withColumns({"__bucket": table.bucket(), "__slice": F.pmod(F.xxhash64(F.lit("slice"), "key"), F.lit(slices))})
    both = rows.repartition(parts, "__bucket", "__slice").groupBy("__bucket", "__slice", "key").agg(F.max("json").alias("json"), F.max("__old").alias("__old"))
    return both.withColumn("digest", F.md5("json")).where(~F.col("digest").eqNullSafe(F.col("__old"))).select("key", "digest", "json", "__bucket")


def publish(documents: DataFrame, table: BucketTable) -> dict[str, int]:
    """Makes ``table`` hold these documents (key, json) and no others; returns how many were written and removed.

    Digests decide: only buckets with a document that is new, changed or gone are written, and readers see the old
    documents or the new ones, never some of each. Without changes nothing is written. What changed is written once, in
    the table's folder, where buckets that had no documents keep it.
    """
    with freed_shuffles(table.spark):
        staged, touched = table.stage(document_changes(documents, table))
        return _apply(table, staged, touched)


def _apply(table: BucketTable, staged: str, touched: list[int]) -> dict[str, int]:
    r = table.staged(staged, touched).agg(F.count("digest").alias("written"), F.count_if(F.col("digest").isNull()).alias("removed")).first()
    table.change_staged(staged, touched, lambda old, new: old.join(new.select("key"), "key", "left_anti").select(new.columns).unionByName(new.where("json is not null")))
    return {"written": r.written, "removed": r.removed}


def write_files(frame: DataFrame, key: str, folder: str, buckets: int = 64) -> dict[str, int]:
    """A file ``<key>.json`` for each row in a folder that all executors share; files of other keys are removed.

    Executors write the documents that changed since the last time, by the digests kept in ``<folder>/_published``, and
    remove those that went; a second run without changes writes nothing. A file appears whole, by rename, and the digests
    are noted last, so a run that died is done again. A key that is no plain file name is an error, so that nothing
    outside the folder is written or removed. The folder is one of a store that pyarrow opens by its address, or a plain
    path where the session is local; on a cluster a plain path would be each executor's own, and is refused.
    """
    spark = frame.sparkSession
    if "://" not in folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("give the address of a shared store, such as file:///mnt/shared/documents or hdfs://...")
    rows = as_documents(frame, key)
    bad = rows.where(F.col("key").isNull() | ~F.col("key").rlike(r"^[A-Za-z0-9-][A-Za-z0-9._-]*$")).limit(1).collect()
    if bad:
        raise ValueError(f"not a file name: {bad[0].key!r}")
    state = published(spark, f"{folder.rstrip('/')}/_published", buckets)
    staged, touched = state.stage(document_changes(rows, state))
    address = folder.rstrip("/") if "://" in folder else "file://" + os.path.abspath(folder)

    def put(part) -> None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(address)
        store.create_dir(inner, recursive=True)
        for row in part:
            name = f"{inner}/{row.key}.json"
            if row.json is None:
                if store.get_file_info(name).type != fs.FileType.NotFound:
                    store.delete_file(name)
                continue
            own = f"{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write(row.json.encode())
            store.move(own, name)

    state.staged(staged, touched).select("key", "json").foreachPartition(put)
    return _apply(state, staged, touched)
