"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words is trained from texts confirmed as toxic and from unlabelled texts, by the
class-prior-corrected risk  prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])  with the logistic loss
l(z) = log(1 + exp(-z)). Where the bracket is negative, its gradient is stepped against, as the estimator prescribes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import drawn, fold, in_slices
from tallyforge.llm.textvec import NOT_ALNUM, word_hashes

BITS = 20
#: Bounds of the training sample: confirmed toxic texts, and unlabelled texts.
MOST_POSITIVE, MOST_UNLABELLED = 4000, 8000


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words, counts): the distinct hashed words of each whole text, text after text."""
    hashes, n = word_hashes(texts, NOT_ALNUM)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
    both = np.unique(row << np.uint64(BITS) | hashes >> np.uint64(64 - BITS))
    return (both & np.uint64((1 << BITS) - 1)).astype(np.int32), np.bincount((both >> np.uint64(BITS)).astype(np.int64), minlength=len(texts))


#: A word is a feature if it is in so many toxic texts, and so many deviations more frequent there than elsewhere.
LEAST, DEVIATIONS = 4, 4.0


def fit(words: np.ndarray, counts: np.ndarray, positive: np.ndarray, prior: float, steps: int = 300, rate: float = 0.1, shrink: float = 1e-3):
    """(weights, bias) by full-batch Adam over the chosen words; ``shrink``, times the prior, is an L2 penalty."""
    row = np.repeat(np.arange(len(counts)), counts)
    held, at = np.unique(words, return_inverse=True)
    n_pos, n_unl = max(1, positive.sum()), max(1, (~positive).sum())
    in_pos, in_unl = np.bincount(at, positive[row], len(held)), np.bincount(at, ~positive[row], len(held))
    share = (in_pos + in_unl) / (n_pos + n_unl)
    apart = (in_pos / n_pos - in_unl / n_unl) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_pos + 1 / n_unl))
    chosen = (in_pos >= LEAST) & (apart >= DEVIATIONS)
    row, at = row[chosen[at]], at[chosen[at]]
    w, b = np.zeros(len(held)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    pos, unl = positive / n_pos, ~positive / n_unl
    for t in range(1, steps + 1):
        z = np.bincount(row, w[at], len(counts)) + b
        up, down = 1 / (1 + np.exp(-z)), -1 / (1 + np.exp(z))  # slopes of l(-z) and of l(z)
        rest = (unl * np.logaddexp(0, z)).sum() - prior * (pos * np.logaddexp(0, z)).sum()
        slope = unl * up - prior * pos * up
        g = prior * pos * down + slope if rest >= 0 else -slope
        gw, gb = np.bincount(at, g[row], len(held)) + shrink * prior * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w = w - rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[~chosen] = 0
        b -= rate * mb / (1 - 0.9**t) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    out = np.zeros(1 << BITS, np.float32)
    out[held] = w
    return out, b


def train(docs: DataFrame, labels: DataFrame, allowed):
    """(weights, bias) from rows that ``allowed`` (a column of doc_id) admits, or None where no toxic label, or no text for it, is known.

    The prior is the share of toxic among those labels. A doc_id with several labels is toxic if one says so; null
    doc_ids and null labels teach nothing. Positive and unlabelled texts are drawn by a hash of doc_id and text, up to
    about MOST_POSITIVE and MOST_UNLABELLED rows; features are made on the executors, and equal ones are made one, so
    that rows repeated with one doc_id, or none, don't swell what comes to the driver.
    """
    known = (
        labels.where(allowed & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    if not toxic:
        return None
    prior = min(0.9, max(0.001, toxic / n))
    by_id = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * min(1, MOST_POSITIVE / toxic)
    ids = known.where((F.col("toxic") == 1) & by_id).select("doc_id", F.lit(True).alias("positive"))
    # the broadcast side holds about MOST_POSITIVE ids
    seen = docs.where(allowed).select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left")
    apart = F.xxhash64("doc_id", "text")  # rows that are drawn together count once
    total, confirmed = seen.agg(F.approx_count_distinct(apart), F.approx_count_distinct(F.when(F.col("positive"), apart))).first()
    unlabelled = drawn(max(1, total), MOST_UNLABELLED)
    positive = F.col("positive").isNotNull() & drawn(max(1, confirmed), MOST_POSITIVE)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            words, counts = features(texts)
            parts = np.split(words, np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_pydict({
                "positive": batch.column("positive"), "unlabelled": batch.column("unlabelled"),
                "words": pa.array([p.tobytes() for p in parts], pa.binary()),
            })

    flat = seen.select("text", positive.alias("positive"), unlabelled.alias("unlabelled")).where("positive or unlabelled")
    got = flat.mapInArrow(run, "positive boolean, unlabelled boolean, words binary").distinct().toPandas()
    # a toxic text that is also drawn as unlabelled counts on both sides
    if not got.positive.any() or not got.unlabelled.any():
        return None
    parts = [got[got.positive].assign(side=True), got[got.unlabelled].assign(side=False)]
    rows = [np.frombuffer(w, np.int32) for p in parts for w in p["words"]]
    side = np.concatenate([p["side"].to_numpy(bool) for p in parts])
    order = sorted(range(len(rows)), key=lambda i: (side[i], rows[i].tobytes()))  # the same for any partitioning
    words, counts = np.concatenate([rows[i] for i in order]), np.array([len(rows[i]) for i in order])
    return fit(words, counts, side[order], prior)


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) of every whole text: 0 to 1, higher if likelier toxic.

    A null text is empty and gets the bias alone; null and repeated doc_ids keep their rows; without a model (no toxic
    label to learn from) every score is 0; an empty table gives no rows.
    """
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    weights, bias = model
    used = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(weights).astype(np.int32), weights[weights != 0], float(bias)))

    def run(batches):
        places, values, b = used.value
        w = np.zeros(1 << BITS, np.float32)
        w[places] = values
        for batch in batches:
            doc_ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for first, last in in_slices(texts):
                hashes, n = word_hashes(texts[first:last], NOT_ALNUM)
                word = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
                told = w[word] != 0
                row = np.repeat(np.arange(last - first), n)[told]
                both = np.unique(row << BITS | word[told])
                z = np.bincount(both >> BITS, w[both & ((1 << BITS) - 1)], last - first) + b
                yield pa.RecordBatch.from_pydict({"doc_id": doc_ids.slice(first, last - first), "score": 1 / (1 + np.exp(-z))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores all documents with a model of the rows whose crc32(doc_id) modulo 5 is not 0."""
    model = train(docs, labels, fold("doc_id", 5) != 0)
    return score(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
