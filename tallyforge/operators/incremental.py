"""Scores kept up to date: stored counts take the changes of each batch, and every score follows from the counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.runtime import dealt, materialised
from tallyforge.operators.scoring import coverage, of_items, score_counts, snapshots, source_metrics, weights
from tallyforge.operators.store import BucketTable
from tallyforge.params import ScoringParams


class ScoreState:
    """``score_counts`` of all reviews so far, in buckets by item; a batch rewrites the buckets of its items alone."""

    def __init__(self, table: BucketTable):
        self.table = table

    @classmethod
    def at(cls, path: str, like: DataFrame, buckets: int = 64) -> ScoreState:
        """The state under ``path``; ``like`` are reviews, for the types of their columns."""
        return cls(BucketTable(like.sparkSession, path, score_counts(like).schema, ["game_id"], buckets))

    def apply(self, added: DataFrame | None = None, removed: DataFrame | None = None, note: tuple[str, int] | None = None) -> list[int]:
        """Takes in reviews that came, and takes out those that went (as they were counted); returns the buckets touched.

        A changed review is one of either. Reviews without a score count for nothing. What is taken out beyond what was
        there is ignored. A batch with the same ``note`` again changes nothing; so does one without rows.
        """
        parts = [score_counts(f).withColumn("n", sign * F.col("n")) for f, sign in ((added, 1), (removed, -1)) if f is not None]
        if not parts:
            return []
        delta = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return self.table.change(delta, _sums, note)

    def counts(self) -> DataFrame:
        return self.table.read()

    def snapshots(self, games: DataFrame, p: ScoringParams = ScoringParams()) -> DataFrame:
        """The scores of all items, as a run over all reviews gives them: metrics and weights are of all counts too."""
        counts = materialised(of_items(dealt(self.counts(), "game_id"), games), "counts")
        metrics = materialised(source_metrics(counts, games, p), "metrics")
        return snapshots(counts, games, metrics, weights(metrics, coverage(counts, games, "genres", "platforms"), p), p)


def _sums(old: DataFrame, delta: DataFrame) -> DataFrame:
    return dealt(old.unionByName(delta), "game_id").groupBy("game_id", "source_id", "score").agg(F.sum("n").alias("n")).where("n > 0")
