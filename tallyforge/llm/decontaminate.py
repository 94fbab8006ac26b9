"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A fixed mask over consecutive words keeps some and ignores the others, so a changed word spoils only the seeds whose
mask looks at it. Seeds of benchmark items and of documents meet in a join. Around each hit the document is laid along
the item, and an overlap counts if at least four fifths of its words agree.

The masks are lossless: whichever words of an overlap are changed, up to a fifth of them, some mask fits at some place
of it without looking at any of these. (Items of n words take the masks of the largest key up to n; a run of 16 to 19
words with three changes holds one of 15 with three at most, and so on.)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise

#: Masks for items from so many words on.
MASKS = {
    5: ("1111", "11101", "11011", "10111"),
    10: ("110111", "11100011", "1101011"),
    15: ("11011101", "110100001101", "1110111"),
}
#: Words of an overlap, and the share of them that agree; items with fewer words are compared as a whole.
OVERLAP, AGREE = 20, 0.8
#: Items of fewer words are no passages and match nothing.
LEAST = 5
#: Bytes of seeds and of items' words that are sent to the workers at a time, and bytes that a seed takes there. A
#: larger benchmark is met in blocks of items, one after the other.
BLOCK_BYTES, SEED_BYTES = 64 << 20, 64


def words(text: str) -> Column:
    """64-bit hashes of the words, runs of letters and digits in lower case; a null text has none."""
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(parts, ""), lambda w: F.xxhash64(w))


def _seeds(h: str, mask: str, number: int) -> Column:
    """The seeds of one mask, one for each place where it fits."""
    at = [i for i, c in enumerate(mask) if c == "1"]
    places = F.sequence(F.lit(0), F.size(h) - F.lit(len(mask)))
    made = F.transform(places, lambda i: F.xxhash64(F.lit(number), *(F.get(F.col(h), i + F.lit(k)) for k in at)))
    return F.when(F.size(h) >= len(mask), made).otherwise(F.array().cast("array<bigint>"))


def _seed(mask: str, number: int) -> Column:
    """The same seed of the words ``h`` at ``place``; null where the mask goes beyond them."""
    made = F.xxhash64(F.lit(number), *(F.get("h", F.col("place") + k) for k, c in enumerate(mask) if c == "1"))
    return F.when(F.col("place") + len(mask) <= F.size("h"), made)


def matches(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, overlap, agreeing) of each document and item that share a passage.

    ``overlap``: words compared, OVERLAP or the whole of a shorter item; ``agreeing``: how many of them are equal in
    the best run that holds a seed hit. Whole texts are read; null and empty texts match nothing; an item with fewer
    than LEAST words matches nothing. Equal documents or items each get their rows; rows with equal ids are one document
    or item, whose best overlap counts, of equal ones the longer; a null id is an id of its own. Other columns are
    ignored; empty tables give no rows.
    """
    return _matches(docs.select(F.col("doc_id").cast("long"), "text"), items, block_bytes)


def _matches(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The same of (doc_id, text), where doc_id may be of any type.

    What is sent to the workers is of ``block_bytes`` at most, but for single items that are larger.
    """
    bench = items.select("item_id", words("text").alias("g")).where(F.size("g") >= LEAST)
    family = reduce(lambda out, n: F.when(F.size("g") >= n, n).otherwise(out), sorted(MASKS), F.lit(0))
    bench = materialise(bench.dropDuplicates().withColumn("family", family), "bench")
    n, *masks = bench.agg(F.coalesce(F.sum(F.size("g")), F.lit(0)), F.sort_array(F.collect_set("family"))).first()
    used = [(m, mask) for m in masks[0] for mask in MASKS[m]]  # at most as many as MASKS has
    if not used:
        return bench.join(docs.limit(0), F.lit(False)).select("doc_id", "item_id", F.lit(0).alias("overlap"), F.lit(0).alias("agreeing"))
    per_word = SEED_BYTES * max(len(MASKS[m]) for m in masks[0]) + 8
    blocks = max(1, -(-n * per_word // block_bytes))
    if blocks == 1:
        near = _near(docs, bench, used)
    else:
        of = lambda k: bench.where(F.pmod(F.xxhash64("item_id", "g"), F.lit(blocks)) == k)
        near = reduce(DataFrame.unionByName, [materialise(_near(docs, of(k), used), "near") for k in range(blocks)])
    agree = F.transform(
        F.sequence(F.col("lo"), F.col("hi") - 1),
        lambda t: F.when(F.get("window", t + F.col("shift") - F.col("first")) == F.get("g", t), 1).otherwise(0),
    )
    runs = F.transform(
        F.sequence(F.lit(1), F.size("agree") - F.col("overlap") + 1),
        lambda i: F.aggregate(F.slice("agree", i, F.col("overlap")), F.lit(0), lambda a, b: a + b),
    )
    return (
        near.select("doc_id", "item_id", "overlap", agree.alias("agree"))
        .select("doc_id", "item_id", "overlap", F.array_max(runs).alias("agreeing"))
        .where(F.col("agreeing") >= F.lit(AGREE) * F.col("overlap"))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("agreeing", "overlap")).alias("best"))
        .select("doc_id", "item_id", "best.overlap", "best.agreeing")
    )


def _near(docs: DataFrame, bench: DataFrame, masks: list[tuple[int, str]]) -> DataFrame:
    """A row for each place where a document's and an item's seeds meet: the item's words and the document's around it.

    ``lo`` to ``hi`` are the item's words that a run holding the hit can have; ``window`` begins with the document's
    word ``first``; ``shift`` is how much later the document has a word than the item.
    """
    seeds = reduce(DataFrame.unionByName, (
        bench.where(F.col("family") == of).select("item_id", "g", F.lit(len(mask)).alias("span"), F.posexplode(_seeds("g", mask, number)).alias("item_place", "seed"))
        for number, (of, mask) in enumerate(masks)
    ))
    found = docs.select("doc_id", F.xxhash64("text").alias("text"), words("text").alias("h"))
    # A row for each word, whose seeds are compiled expressions, and so are the join and the cut of the words around a
    # hit: the list of a document's words is read where it lies, and only what lies around hits is passed on. (An outer
    # explode, as an inner one would make the lists twice.)
    rows = found.select("doc_id", "text", "h", F.posexplode_outer("h").alias("place", "word"))
    made = F.array(*(_seed(mask, number) for number, (_, mask) in enumerate(masks)))
    hits = rows.select("doc_id", "text", "h", "place", F.explode(made).alias("seed")).where("seed is not null")
    met = hits.join(F.broadcast(seeds), "seed")  # of a bounded size
    size = F.least(F.size("g"), F.lit(OVERLAP))
    lo = F.greatest(F.lit(0), F.least(F.col("item_place") + F.col("span"), F.size("g")) - size)
    hi = F.least(F.size("g"), F.col("item_place") + size)
    shift = F.col("place") - F.col("item_place")
    first = F.greatest(lo + shift, F.lit(0))
    near = met.select(
        "doc_id", "item_id", "text", lo.alias("lo"), hi.alias("hi"), shift.alias("shift"), size.alias("overlap"),
        first.alias("first"), F.slice("h", first + 1, hi + shift - first).alias("window"), F.xxhash64("g").alias("item"), "g",
    )
    # the hits of several masks at one place are one
    return near.groupBy("doc_id", "item_id", "text", "item", "lo", "hi", "shift", "overlap", "first").agg(F.first("window").alias("window"), F.first("g").alias("g"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents whose texts share no passage with an item, with all their columns.

    Null and empty texts, null and repeated ids and repeated rows stay as they are; a column of any name is kept; an
    empty table stays empty, and without items nothing goes.
    """
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    leaked = _matches(docs.select(key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("key")).distinct()
    kept = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return kept.join(leaked, "key", "left_anti").select("row.*")
