"""Tables in buckets by key: a change reads and writes the buckets that it touches, and a manifest switches to them.

``<path>/_manifests/<n>.json`` names, for each bucket, the folder that holds its rows. A change writes new folders first
and the next manifest last, so readers see all of it or nothing, and a job that dies leaves the table as it was. One
writer at a time: a second one finds its manifest's number taken and fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators.runtime import COMPACT, checkpointed, file_names, read_file, remove, stored_parts, write_new_file

Change = Callable[[DataFrame, DataFrame], DataFrame]


class BucketTable:
    """A table of ``schema`` under ``path``, in ``buckets`` by a hash of the ``key`` columns; null keys are keys too."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    def manifest(self) -> dict:
        """The newest: ``version``, ``folders`` by bucket, and ``notes`` of what has been applied; empty before the first."""
        names = sorted(n for n in file_names(self.spark, f"{self.path}/_manifests") if n.endswith(".json"))
        if not names:
            return {"version": 0, "buckets": self.buckets, "folders": {}, "notes": {}}
        out = json.loads(read_file(self.spark, f"{self.path}/_manifests/{names[-1]}"))
        if out["buckets"] != self.buckets:
            raise ValueError(f"the table has {out['buckets']} buckets")
        return out

    def bucket(self, *key: Column) -> Column:
        return F.pmod(F.xxhash64(*(key or self.key)), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """All rows, or those of some buckets, whose folders alone are opened."""
        folders = (manifest or self.manifest())["folders"]
        paths = [folder for b, folder in folders.items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def lookup(self, *values) -> DataFrame:
        """The rows of one key, from its bucket."""
        key = [F.lit(v) for v in values]
        at = self.spark.range(1).select(self.bucket(*(k.cast(self.schema[n].dataType) for k, n in zip(key, self.key)))).first()[0]
        rows = self.read([at])
        for name, k in zip(self.key, key):
            rows = rows.where(F.col(name).eqNullSafe(k))
        return rows

    def change(self, batch: DataFrame, rule: Change, note: tuple[str, int] | None = None, stored: bool = False) -> list[int]:
        """Replaces the buckets that ``batch`` touches by ``rule(their rows, batch)``; returns their numbers.

        The rule may only give rows whose keys are in those buckets. ``note``: a name and a number that grows; what has
        been applied under a number is not applied again, so a batch may be repeated. An empty batch changes nothing. ``stored``: the batch is a checkpoint already, or a file.
        """
        now = self.manifest()
        if note and now["notes"].get(note[0], -1) >= note[1]:
            return []
        parts, batch = stored_parts(batch), batch if stored else checkpointed(batch)
        touched = sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())  # as many as there are buckets
        if not touched and note is None:
            return []
        old = self.read(touched, now)
        fresh = self._write(rule(old, batch), touched, parts + stored_parts(old)) if touched else {}
        folders = {b: f for b, f in now["folders"].items() if int(b) not in touched} | fresh
        self._commit(now, folders, {**now["notes"], **({note[0]: note[1]} if note else {})})
        return touched

    def stage(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Writes ``rows``, whose column ``__bucket`` says where they belong, in a new folder that no manifest names yet; and which buckets they touch."""
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        rows.write.options(**COMPACT).partitionBy("__bucket").parquet(folder)
        return folder, sorted(map(int, self._parts(folder)))

    def staged(self, folder: str, only: list[int]) -> DataFrame:
        """Staged rows of some buckets."""
        return self.read(manifest={"folders": {b: f for b, f in self._parts(folder).items() if int(b) in only}})

    def change_staged(self, folder: str, touched: list[int], rule: Change) -> None:
        """As ``change``, for a batch that is staged. A bucket that had no rows takes the staged ones where they lie, not written again."""
        now = self.manifest()
        parts = self._parts(folder)
        new = {b: f for b, f in parts.items() if b not in now["folders"]}
        met = [b for b in touched if str(b) in now["folders"]]
        fresh = {}
        if met:
            old, batch = self.read(met, now), self.staged(folder, met)
            fresh = self._write(rule(old, batch), met, stored_parts(batch) + stored_parts(old))
        if touched:
            self._commit(now, {b: f for b, f in now["folders"].items() if int(b) not in met} | fresh | new, now["notes"])
        for path in [folder] if not new else [f for b, f in parts.items() if b not in new]:
            remove(self.spark, path)

    def replace(self, frame: DataFrame) -> None:
        """All rows anew."""
        now = self.manifest()
        self._commit(now, self._write(frame, list(range(self.buckets)), stored_parts(frame)), now["notes"])

    def _write(self, frame: DataFrame, touched: list[int], parts: int) -> dict[str, str]:
        """A bucket is written by one task, or by several, each with a slice of its keys, where there are more parts."""
        each = max(1, -(-parts // max(1, len(touched))))
        slice_ = F.pmod(F.xxhash64(F.lit("slice"), *self.key), F.lit(1 if each == 1 else 4 * each))
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        rows = frame.select([f.name for f in self.schema]).withColumn("__bucket", self.bucket())
        rows.repartition(max(1, len(touched)) * each, "__bucket", slice_).write.options(**COMPACT).partitionBy("__bucket").parquet(folder)
        written = self._parts(folder)
        if stray := set(map(int, written)) - set(touched):
            raise ValueError(f"the change has rows of buckets that the batch doesn't touch: {sorted(stray)}")
        return written

    def _parts(self, folder: str) -> dict[str, str]:
        """The folders of buckets in one that was written."""
        return {n.removeprefix("__bucket="): f"{folder}/{n}" for n in file_names(self.spark, folder) if n.startswith("__bucket=")}

    def _commit(self, before: dict, folders: dict[str, str], notes: dict) -> None:
        version = before["version"] + 1
        text = json.dumps({"version": version, "buckets": self.buckets, "folders": folders, "notes": notes})
        write_new_file(self.spark, f"{self.path}/_manifests/{version:012d}.json", text)

    def vacuum(self, keep: int = 2) -> None:
        """Removes manifests but the last ``keep``, and folders that none of those names; not while readers use them."""
        names = sorted(n for n in file_names(self.spark, f"{self.path}/_manifests") if n.endswith(".json"))
        kept = [json.loads(read_file(self.spark, f"{self.path}/_manifests/{n}")) for n in names[-keep:]]
        used = {f.rsplit("/", 2)[1] for m in kept for f in m["folders"].values()}
        for name in names[:-keep]:
            remove(self.spark, f"{self.path}/_manifests/{name}")
        for name in file_names(self.spark, self.path):
            if name.startswith("data-") and name not in used:
                remove(self.spark, f"{self.path}/{name}")
