"""A corpus made ready for training: language, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``docs`` must be a table that has been written: a stage
begins by removing the working tables of the stages before it, and no others.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, langid, packing, privacy, probminhash
from tallyforge.llm.common import drop_written, fold, materialise, table, written_so_far

#: SQL can't express a trained network or ProbMinHash; tests hold the rows against a brute-force version.
ORACLE_SQL = None
#: Share of a network's probability that a text's language must have, or the text is rejected.
SURE = 0.5

#: Working tables that stages have made.
_made: list[str] = []


def _stage(fn):
    """A stage that removes the working tables of those before it."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_written(_made)
        before = set(written_so_far())
        out = fn(spark, docs, sf_dir)
        _made[:] = [path for path in written_so_far() if path not in before]
        return out

    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no language can be given; a null lang becomes the predicted one.

    Those are null texts, texts without a letter, and texts in which no language has the larger part (SURE) of the
    network's probability. Where there is no label to learn from, every text with a letter stays. An empty table
    stays empty; null and repeated ids keep their rows; columns may have any name but the two that begin with two
    underscores here.
    """
    names, net = langid.train(docs, fold("doc_id", 3) != 1)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    kept = langid.predict(docs, names, net, "__lang", "__sure").where((F.col("__lang") != langid.UND) & (F.col("__sure") >= SURE))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class, the one with the smallest doc_id; null and empty texts are one class."""
    return probminhash.one_of_each(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a passage with the benchmark; null and empty texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and words that disclose it, in the texts; every row stays, null texts as they are."""
    return privacy.sanitise(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents' ids over windows of 2048: a row for each piece, with its ids as 32-bit numbers.

    A null text is empty and yields its end id; null and repeated ids keep their rows; an empty table gives none.
    """
    return packing.pack(packing.cut(docs, public_tokenizers.path("byte_bpe_50k.json"), 1, with_ids=True))


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packed),
]

def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each returns is written in the shared folder and read again."""
    docs, last = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
        drop_written(last)  # what the stage has read
        last = written_so_far()[-1:]
    drop_written(_made)
    return docs
