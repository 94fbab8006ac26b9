"""Where checkpoints go, and small files in whatever store Spark reads."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one in a local session.

    On a cluster an unset folder is an error: executors would write on their own disks.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def checkpointed(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``checkpoint_dir``."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def large(frame: DataFrame) -> DataFrame:
    """``frame`` as a side of a join that grows with the input: sorted and merged, never sent whole through the driver.

    Spark guesses sizes from compressed files and before arrays are exploded, a tenth of what rows take in memory and less.
    """
    return frame.hint("merge")


#: Bytes of tables that one task of a shuffle gets, as Spark knows them: files, which take ten times that and more in memory.
PART_BYTES = 4 << 20


def stored_parts(frame: DataFrame) -> int:
    """How many parts of PART_BYTES the tables have that ``frame`` reads; rows of the driver or of a checkpoint count for nothing."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    plans = [leaves.apply(k) for k in range(leaves.size())]
    return sum(int(str(p.stats().sizeInBytes())) for p in plans if p.nodeName() != "LogicalRDD" and not p.isStreaming()) // PART_BYTES


def dealt(frame: DataFrame, *key: str) -> DataFrame:
    """``frame`` dealt by ``key`` over as many tasks as a shuffle has, or more for larger tables: what one task holds
    doesn't grow with them. A given number, as Spark would merge parts that are small before work that makes them large.
    """
    return frame.repartition(max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), stored_parts(frame)), *key)


def spread(frame: DataFrame, *key: str) -> DataFrame:
    """``frame`` dealt over tasks before costly work on each row: a small file is one task."""
    return dealt(frame, *key)


def scratch(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: How tables are written that take much of a run's disk.
COMPACT = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Jobs inside leave no shuffle files behind; else those stay until the driver's garbage is collected."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing(spark: SparkSession):
    """What ``materialised`` writes inside is removed at the end; for tables that nothing reads afterwards."""
    mine: list[str] = []
    token = _passing.set(mine)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in mine:
            remove(spark, path)


def materialised(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written as Parquet in the shared folder and read again: computed once, and of known size to the planner."""
    path = scratch(frame.sparkSession, label)
    if (mine := _passing.get()) is not None:
        mine.append(path)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none where there is no such folder."""
    target, fs = _at(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def read_file(spark: SparkSession, path: str) -> str:
    target, fs = _at(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_new_file(spark: SparkSession, path: str, text: str) -> None:
    """The file appears whole, by rename; one that is there already is an error."""
    target, fs = _at(spark, path)
    part, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(target) or not fs.rename(part, target):
        fs.delete(part, False)
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    target, fs = _at(spark, path)
    fs.delete(target, True)
