"""Runs of named steps over a set of tables: each step reads tables by name and gives new ones.

A step's tables are written in a folder of their own before the next step begins, so a step is computed once, whatever
reads it; a file then says that it is finished. A run that failed goes on behind its last finished step. Only a whole run
becomes the one that ``current`` reads, so readers, and the next run, never see half of one. When a step is finished, the
run's own tables that it replaced are removed, so a run takes the disk of its last tables and of one step.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators.runtime import COMPACT, file_names, freed_shuffles, passing, read_file, remove, write_new_file
from tallyforge.params import RunOptions

Tables = dict[str, DataFrame]

#: Columns of the tables that a fresh store begins with.
SCHEMAS = {
    "games": "game_id string, title string, release_date string, release_year int, developer string, publisher string, genres array<string>, platforms array<string>, description string",
    "sources": "source_id string, name string, source_type string, country_region string, language string",
    "reviews": "review_id string, game_id string, source_id string, score double, language string, platform string, review_date date, summary string, data_source string",
    "game_identity": "identity_id string, game_id string, source_name string, external_id string, external_slug string, external_title string, external_url string, match_confidence double, match_method string, needs_manual_review boolean, updated_at timestamp",
    "external_baseline": "baseline_id string, game_id string, source_platform string, external_score double, review_count int, source_url string, collected_at timestamp, data_source string",
    "source_metrics": "source_id string, sample_count long, mean_score double, score_std double, score_bias double, discrimination_power double, version string",
    "weights": "source_id string, genre string, platform string, context_weight double, confidence double, explanation string, version string",
    "score_snapshots": "game_id string, sample_count long, source_count long, raw_average double, median_score double, trimmed_mean double, calibrated_score double, weighted_score double, score_std double, version string",
}


@dataclass(frozen=True)
class Step:
    """``run(tables, options)`` gives tables of ``outputs``, all or some; it may read those of ``inputs`` alone.

    An input that ends in ``?`` may be missing. ``when`` says from the options whether a step takes part; an ``optional``
    one does only if ``options.include`` names it.
    """

    name: str
    run: Callable[[Tables, RunOptions], Tables]
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    optional: bool = False
    when: Callable[[RunOptions], bool] = field(default=lambda o: True)


@dataclass
class Pipeline:
    """``done``: the steps of the last run that were computed in it, not read from an earlier attempt."""

    steps: list[Step]
    path: str
    done: list[str] = field(default_factory=list)

    def chosen(self, options: RunOptions) -> list[Step]:
        unknown = options.include - {s.name for s in self.steps}
        if unknown:
            raise ValueError(f"no such steps: {sorted(unknown)}")
        return [s for s in self.steps if (not s.optional or s.name in options.include) and s.when(options)]

    def _checked(self, tables: Mapping[str, DataFrame], options: RunOptions) -> list[Step]:
        """The chosen steps, each of whose inputs is given or made before it."""
        known, steps = set(tables), self.chosen(options)
        for step in steps:
            if lost := [n for n in step.inputs if not n.endswith("?") and n not in known]:
                raise ValueError(f"step {step.name} lacks {lost}")
            known |= set(step.outputs)
        return steps

    def run(self, spark: SparkSession, tables: Mapping[str, DataFrame], options: RunOptions = RunOptions(), run_id: str | None = None) -> Tables:
        """All tables after the chosen steps, in order; with ``rebuild`` those of SCHEMAS begin empty.

        With the ``run_id`` of a run that did not end, its finished steps are read, not computed again; the options must
        be the same. ``tables`` are what the first steps read; a step's own result goes before them.
        """
        now: Tables = {**(create_tables(spark) if options.rebuild else {}), **tables}
        steps = self._checked(now, options)
        folder = f"{self.path}/runs/{run_id or uuid.uuid4().hex}"
        self._same_options(spark, folder, steps, options)
        self.done, made = [], {}
        for n, step in enumerate(steps):
            note = f"{folder}/finished/{n:02d}-{step.name}.json"
            if note.rsplit("/", 1)[1] in file_names(spark, f"{folder}/finished"):
                written = json.loads(read_file(spark, note))
            else:
                names = [i.rstrip("?") for i in step.inputs] or [*now, *made]
                given = {k: _read(spark, made[k]) if k in made else now[k] for k in names if k in made or k in now}
                with freed_shuffles(spark), passing(spark):
                    written = self._written(step, given, options, f"{folder}/tables/{n:02d}-{step.name}")
                write_new_file(spark, note, json.dumps(written))
                self.done.append(step.name)
            for replaced in (made[name]["path"] for name in written if name in made):
                remove(spark, replaced)
            made |= written
        now |= {name: _read(spark, where) for name, where in made.items()}
        versions = file_names(spark, f"{self.path}/current")
        whole = {**self._pointers(spark), **made}
        write_new_file(spark, f"{self.path}/current/{len([v for v in versions if v.endswith('.json')]):012d}.json", json.dumps(whole))
        return now

    def _written(self, step: Step, given: Tables, options: RunOptions, folder: str) -> dict:
        """Where the step's tables lie, now that it has run, and their schemas."""
        out, written = step.run(given, options), {}
        if step.outputs and (stray := set(out) - set(step.outputs)):
            raise ValueError(f"step {step.name} doesn't declare {sorted(stray)}")
        for name, frame in out.items():
            target = f"{folder}-{uuid.uuid4().hex}/{name}"
            frame.write.options(**COMPACT).parquet(target)
            written[name] = {"path": target, "schema": frame.schema.jsonValue()}
        return written

    def _same_options(self, spark: SparkSession, folder: str, steps: list[Step], options: RunOptions) -> None:
        plain = lambda v: sorted(map(str, v)) if isinstance(v, (set, frozenset)) else v
        said = json.dumps([[s.name for s in steps], asdict(options)], default=plain, sort_keys=True)
        mark = hashlib.sha256(said.encode()).hexdigest()
        if "options" in file_names(spark, folder):
            if read_file(spark, f"{folder}/options") != mark:
                raise ValueError("the run was begun with other steps or options")
        else:
            write_new_file(spark, f"{folder}/options", mark)

    def _pointers(self, spark: SparkSession) -> dict:
        names = sorted(n for n in file_names(spark, f"{self.path}/current") if n.endswith(".json"))
        return json.loads(read_file(spark, f"{self.path}/current/{names[-1]}")) if names else {}

    def current(self, spark: SparkSession) -> Tables:
        """The tables as the last whole run left them; those that it didn't make are of the run before."""
        return {name: _read(spark, where) for name, where in self._pointers(spark).items()}


def _read(spark: SparkSession, where: dict) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(where["schema"])).parquet(where["path"])


def create_tables(spark: SparkSession, names: tuple[str, ...] = tuple(SCHEMAS)) -> Tables:
    """Empty tables of the store."""
    return {n: spark.createDataFrame([], SCHEMAS[n]) for n in names}


def of_version(frame: DataFrame, version: str) -> DataFrame:
    """The rows of one version, without the column; a scan of a table partitioned by version reads that folder alone."""
    return frame.where(F.col("version") == version).drop("version")


def with_version(existing: DataFrame | None, fresh: DataFrame, version: str) -> DataFrame:
    """``existing`` with the rows of ``version`` replaced by ``fresh``."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", version):
        raise ValueError(f"not a version: {version!r}")
    new = fresh.withColumn("version", F.lit(version))
    return new if existing is None else existing.where(F.col("version") != version).unionByName(new)
