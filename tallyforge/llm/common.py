"""What the operators of this subpackage share: tables, the shared folder, folds."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frees a shuffle's files as soon as the job that made them ends; they can be made again from the input.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local session; on a cluster, whose executors would not find it,
    this is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_tallyforge_dir", None)
    if own is None:
        own = spark.sparkContext._tallyforge_dir = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
    return own


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Jobs inside leave no shuffle files behind; for jobs whose result is written and read again."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)


_written: list[tuple[SparkSession, str]] = []


def materialise(df: DataFrame, label: str, level: int = 3) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: cuts lineage, survives lost executors.

    ``level``: of zstd, for tables of some size. Shuffle files of the job that wrote the table go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, label: str) -> str:
    """A name in the shared folder for files that workers write; ``drop_written`` removes it like a table."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: Bytes of a table as stored, of which one shard of its words or pieces is made.
SHARD_BYTES = 64 << 20


def stored_bytes(docs: DataFrame) -> int:
    """The size that Spark's plan says a table has; 0 for frames of the driver's own rows, whose size Spark doesn't know."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else 0


def shard_bits(docs: DataFrame) -> int:
    """How many bits number the shards of what is gathered from ``docs``: more of them for larger tables.

    At least as many shards as spark.sql.shuffle.partitions; beyond, one for each SHARD_BYTES of ``stored_bytes``.
    """
    return max(0, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1, stored_bytes(docs) // SHARD_BYTES - 1).bit_length()


def drawn(total: Column | int, most: int) -> Column:
    """Whether a row is among about ``most`` of ``total`` different ones, by a hash of its doc_id and text.

    Rows that are equal in both are drawn together; who collects what is drawn makes them one before.
    """
    share = F.least(F.lit(1e6), F.lit(1e6 * most) / (F.lit(total) if isinstance(total, int) else total) + 1)
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share


def written_so_far() -> list[str]:
    return [path for _, path in _written]


def drop_written(paths: list[str] | None = None) -> None:
    """Removes tables and folders that ``materialise`` and ``new_folder`` made in this session: those listed, or all."""
    for item in [x for x in _written if paths is None or x[1] in paths]:
        spark, path = item
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _written.remove(item)


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def in_slices(texts: list[str], most: int = 1 << 22):
    """(first, last) row numbers of runs with about ``most`` characters, one row at least."""
    first = size = 0
    for k, text in enumerate(texts):
        size += len(text) + 1
        if size >= most:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)
