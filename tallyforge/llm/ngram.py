"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays, mapped by workers.

Words are numbered by the order of their 64-bit hashes. A bigram's key is a bijection of its two numbers that spreads
them evenly, so tables are cut by leading bits into shards of like size, whatever word is frequent. Counts meet in
packed arrays: a task sorts and sums what it has read before anything is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import fold, freed_shuffles, in_slices, new_folder, shard_bits
from tallyforge.llm.sharedfiles import map_array, map_counts, write_array, write_counts
from tallyforge.llm.textvec import mix, word_hashes

#: Ends every text, and stands before its first word.
END = np.uint64(0x9D39247E33776D41)
#: Tokens that a task gathers before it sorts and sums them.
FLUSH = 4_000_000


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    h = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
    h = h * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    h = h ^ (h >> np.uint64(27)) ^ (h >> np.uint64(54))
    h = h * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of each text's words and its end."""
    hashes, n = word_hashes(texts)
    return np.insert(hashes, np.cumsum(n), END), n + 1


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each one's values."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def _squeezed(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Keys in order as differences, then each value column, compressed."""
    parts = [np.diff(keys, prepend=keys[:1] * 0).astype("<u8"), *(v.astype("<u8") for v in values)]
    planes = [p.view(np.uint8).reshape(len(p), -1).T.tobytes() for p in parts]
    return np.uint64(len(keys)).tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _spread(data: bytes, columns: int) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8)
    out, at = [], 0
    for kind in ["<u8"] * (1 + columns):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    out[0] = np.cumsum(out[0])
    return [out[0], *(v.astype(np.int64) for v in out[1:])]


PACKED = "kind string, shard int, data binary"


def _rows(kind: str, bits: int, keys: np.ndarray, *values: np.ndarray):
    """A packed row for each shard that has some of the keys, which are in order."""
    ends = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(1, 1 << bits), "left") if bits else np.empty(0, np.int64)
    ends = np.concatenate([[0], ends, [len(keys)]]).astype(np.int64)
    shards = np.flatnonzero(np.diff(ends))
    if len(shards):
        data = [_squeezed(*(c[ends[s] : ends[s + 1]] for c in (keys, *values))) for s in shards]
        yield pa.RecordBatch.from_pydict({"kind": [kind] * len(shards), "shard": pa.array(shards, pa.int32()), "data": pa.array(data, pa.binary())})


class Words:
    """The word table: sorted hashes, cut into shards; ``find`` gives numbers, -1 for words that weren't counted."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.sizes = folder, sizes

    def open(self):
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.hashes = [map_array(f"{self.folder}/word-{s}", "<u8") for s in range(len(self.sizes))]
        return self

    def find(self, hashes: np.ndarray) -> np.ndarray:
        return _find(self.hashes, self.offsets, hashes)


def _find(shards: list[np.ndarray], offsets: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each key's place in the sorted arrays, -1 where it is in none. Looked up in order, so pages are read in order."""
    order = np.argsort(keys)
    asked = keys[order]
    got = np.full(len(keys), -1, np.int64)
    bits = len(shards).bit_length() - 1
    ends = np.searchsorted(asked >> np.uint64(64 - bits), np.arange(1, len(shards)), "left") if bits else np.empty(0, np.int64)
    ends = np.concatenate([[0], ends, [len(keys)]]).astype(np.int64)
    for s, held in enumerate(shards):
        part = asked[ends[s] : ends[s + 1]]
        if len(part) and len(held):
            at = np.searchsorted(held, part)
            same = held[np.minimum(at, len(held) - 1)] == part
            got[ends[s] : ends[s + 1]] = np.where(same, at + offsets[s], -1)
    out = np.empty(len(keys), np.int64)
    out[order] = got
    return out


def _pairs(found: np.ndarray, n: np.ndarray, end: int) -> np.ndarray:
    """The number before each token; before a text's first, the end's."""
    before = np.concatenate([[end], found[:-1]])
    before[np.cumsum(n)[:-1]] = end
    return before


def _discounts(n: np.ndarray) -> np.ndarray:
    """D for counts of 0, 1, 2, and 3 or more, from how many have a count of 1 to 4; halves where some count is missing."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0, *(min(max(k - (k + 1) * y * b / a, 0.05 * k), 0.95 * k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


class Model:
    """Where the tables lie, and their totals; ``open`` maps them."""

    def __init__(self, folder, words, pair_sizes, total, distinct, end, discount, unseen):
        self.folder, self.words, self.pair_sizes, self.total, self.distinct = folder, words, pair_sizes, total, distinct
        self.end, self.discount, self.unseen = end, discount, unseen

    def open(self):
        if not hasattr(self, "pairs"):
            self.words.open()
            self.pairs = [map_array(f"{self.folder}/pair-{s}", "<u8") for s in range(len(self.pair_sizes))]
            self.counts = [map_counts(f"{self.folder}/pair-count-{s}", n) for s, n in enumerate(self.pair_sizes)]
            self.offsets = np.concatenate([[0], np.cumsum(self.pair_sizes)]).astype(np.int64)
            self.of = {k: [map_array(f"{self.folder}/{k}-{s}", "<f4") for s in range(len(self.words.sizes))] for k in ("gamma", "lower")}
            self.of |= {k: [map_counts(f"{self.folder}/{k}-{s}", n) for s, n in enumerate(self.words.sizes)] for k in ("count", "context")}
        return self

    def _take(self, arrays: list[np.ndarray], offsets: np.ndarray, at: np.ndarray, empty: float) -> np.ndarray:
        """Values at places in order of shards; ``empty`` for -1."""
        out = np.full(len(at), empty, np.float64)
        shard = np.searchsorted(offsets, at, "right") - 1
        for s in np.unique(shard[at >= 0]):
            own = (shard == s) & (at >= 0)
            out[own] = arrays[s][at[own] - offsets[s]]
        return out

    def score(self, texts: list[str]):
        """(tokens, known tokens, base score, score) of each whole text."""
        self.open()
        hashes, n = tokens(texts)
        row = np.repeat(np.arange(len(texts)), n)
        distinct, back = np.unique(hashes, return_inverse=True)
        ids = self.words.find(distinct)
        take = lambda kind, empty: self._take(self.of[kind], self.words.offsets, ids, empty)[back]
        c, lower, gamma, context = take("count", 0), take("lower", self.unseen), take("gamma", 1), take("context", 0)
        found = ids[back]
        before = _pairs(found, n, self.end)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        at = {"gamma": 1.0, "context": 0.0}
        if self.end >= 0:
            one = np.array([self.end])
            at = {k: self._take(self.of[k], self.words.offsets, one, e)[0] for k, e in at.items()}
        g, t = np.concatenate([[1.0], gamma[:-1]]), np.concatenate([[0.0], context[:-1]])
        g[starts], t[starts] = at["gamma"], at["context"]
        own = np.zeros(len(found))
        known = np.flatnonzero((found >= 0) & (before >= 0))
        keys = mix(before[known].astype(np.uint64) << np.uint64(32) | found[known].astype(np.uint64))
        place = _find(self.pairs, self.offsets, keys)
        order = np.argsort(place)
        count = np.empty(len(place))
        count[order] = self._take(self.counts, self.offsets, place[order], 0)
        own[known] = np.maximum(count - self.discount[np.minimum(count, 3).astype(int)], 0)
        p = np.divide(own, t, out=np.zeros_like(own), where=t > 0) + g * lower
        base = np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))
        add = lambda v: np.bincount(row, v, len(texts))
        return n, add(c > 0).astype(np.int64), add(base), add(np.log10(p))


def train(docs: DataFrame) -> Model:
    """A model of the texts of ``docs``; null texts count as empty, other columns are ignored.

    Shards: the power of two that is at least spark.sql.shuffle.partitions. Only the shards' sizes and the counts of
    counts come to the driver.
    """
    spark = docs.sparkSession
    bits = shard_bits(docs)
    folder = new_folder(spark, "ngram")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))

    def gathered(batches, make):
        """``make(hashes, counts)`` over about FLUSH tokens at a time."""
        held, sizes, total = [], [], 0
        for batch in batches:
            data = batch.column(0).to_pylist()
            for a, b in in_slices(data):
                hashes, n = tokens(data[a:b])
                held.append(hashes)
                sizes.append(n)
                total += len(hashes)
                if total >= FLUSH:
                    yield from make(np.concatenate(held), np.concatenate(sizes))
                    held, sizes, total = [], [], 0
        if total:
            yield from make(np.concatenate(held), np.concatenate(sizes))

    def count_words(batches):
        yield from gathered(batches, lambda hashes, n: _rows("word", bits, *counted(hashes)))

    def merge_words(key, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = (np.concatenate(x) for x in zip(*(_spread(d, 1) for d in pdf["data"])))
        keys, counts = summed(keys, counts)
        write_array(f"{folder}/word-{key[0]}", keys.astype("<u8"))
        write_counts(f"{folder}/count-{key[0]}", counts)
        return pd.DataFrame({"shard": [key[0]], "n": [len(keys)], "total": [int(counts.sum())]})

    def by_shard(fn, rows, schema):
        return rows.groupBy("shard").applyInPandas(fn, schema).collect()

    with freed_shuffles(spark):
        found = by_shard(merge_words, texts.mapInArrow(count_words, PACKED), "shard int, n long, total long")
    sizes = [0] * (1 << bits)
    for r in found:
        sizes[r.shard] = r.n
    for s in range(1 << bits):
        if not sizes[s]:
            for name, kind in (("word", "<u8"), ("count", "<u4")):
                write_array(f"{folder}/{name}-{s}", np.empty(0, kind))
    words, total, distinct = Words(folder, sizes), sum(r.total for r in found), sum(sizes)
    if distinct >= 1 << 32:
        raise ValueError("more than 2**32 distinct words: their numbers don't fit a bigram's key")

    def count_pairs(batches):
        held = words.open()

        def make(hashes, n):
            names, back = np.unique(hashes, return_inverse=True)
            ids = held.find(names)[back]
            before = _pairs(ids, n, int(held.find(np.array([END]))[0]))
            return _rows("pair", bits, *counted(mix(before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64))))

        yield from gathered(batches, make)

    def merge_pairs(key, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = (np.concatenate(x) for x in zip(*(_spread(d, 1) for d in pdf["data"])))
        keys, counts = summed(keys, counts)
        write_array(f"{folder}/pair-{key[0]}", keys.astype("<u8"))
        write_counts(f"{folder}/pair-count-{key[0]}", counts)
        n = np.bincount(np.minimum(counts, 5), minlength=6)
        return pd.DataFrame({"shard": [key[0]], "n": [len(keys)], **{f"n{k}": [int(n[k])] for k in range(1, 5)}})

    fields = "shard int, n long, n1 long, n2 long, n3 long, n4 long"
    with freed_shuffles(spark):
        found = by_shard(merge_pairs, texts.mapInArrow(count_pairs, PACKED), fields)
    pair_sizes = [0] * (1 << bits)
    for r in found:
        pair_sizes[r.shard] = r.n
    for s in range(1 << bits):
        if not pair_sizes[s]:
            for name, kind in (("pair", "<u8"), ("pair-count", "<u4")):
                write_array(f"{folder}/{name}-{s}", np.empty(0, kind))
    discount = _discounts([sum(r[f"n{k}"] for r in found) for k in range(1, 5)])
    bounds = np.concatenate([[0], np.cumsum(sizes)])

    def word_facts(frames):
        """What each shard of bigrams adds to its words: as contexts their total and counts of 1, 2, 3 or more; as
        second words the number of distinct contexts."""
        for pdf in frames:
            for s in pdf["id"]:
                keys, counts = map_array(f"{folder}/pair-{s}", "<u8"), map_counts(f"{folder}/pair-count-{s}", pair_sizes[s]).astype(np.int64)
                both = unmix(np.asarray(keys))
                first, second = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
                ones = [(counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts >= 3).astype(np.int64)]
                for kind, (ids, *values) in (("context", summed(first, counts, *ones)), ("second", counted(second))):
                    ends = np.searchsorted(ids, bounds[1:].astype(np.uint64))
                    for w, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                        if b > a:
                            yield pd.DataFrame({"kind": [kind], "shard": [w], "data": [_squeezed(ids[a:b], *(v[a:b] for v in values))]})

    def merge_facts(key, pdf: pd.DataFrame) -> pd.DataFrame:
        s = key[0]
        n = int(sizes[s])
        sums = np.zeros((5, n), np.int64)
        for kind, data in zip(pdf["kind"], pdf["data"]):
            ids, *values = _spread(data, 4 if kind == "context" else 1)
            at = (ids - np.uint64(bounds[s])).astype(np.int64)
            for row, v in zip(range(4) if kind == "context" else [4], values):
                sums[row, at] += v  # ids are distinct in a packed row
        total = sums[0]
        gamma = np.divide(discount[1:] @ sums[1:4], total, out=np.ones(n), where=total > 0)
        write_counts(f"{folder}/context-{s}", total)
        write_array(f"{folder}/gamma-{s}", gamma.astype("<f4"))
        write_counts(f"{folder}/second-{s}", sums[4])
        m = np.bincount(np.minimum(sums[4], 5), minlength=6)
        more = int((sums[4] >= 3).sum())
        return pd.DataFrame({"shard": [s], "n": [int(sums[4].sum())], **{f"n{k}": [int(m[k])] for k in range(1, 5)}, "more": [more]})

    shards = spark.range(0, 1 << bits, 1, min(1 << bits, 4096))
    with freed_shuffles(spark):
        found = by_shard(merge_facts, shards.mapInPandas(word_facts, PACKED), fields + ", more long")
    below = _discounts([sum(r[f"n{k}"] for r in found) for k in range(1, 5)])
    pairs = max(1, sum(r.n for r in found))
    spare = (below[1] * sum(r.n1 for r in found) + below[2] * sum(r.n2 for r in found) + below[3] * sum(r.more for r in found)) / pairs
    unseen = spare / (distinct + 1) if found else 1.0

    def lower_order(frames):
        for pdf in frames:
            for s in pdf["id"]:
                if sizes[s]:
                    n = map_counts(f"{folder}/second-{s}", sizes[s]).astype(np.int64)
                    write_array(f"{folder}/lower-{s}", (np.maximum(n - below[np.minimum(n, 3)], 0) / pairs + unseen).astype("<f4"))
                else:
                    for name, kind in (("context", "<u4"), ("gamma", "<f4"), ("lower", "<f4")):
                        write_array(f"{folder}/{name}-{s}", np.empty(0, kind))
            yield pdf

    shards.mapInPandas(lower_order, "id long").count()
    end = int(Words(folder, sizes).open().find(np.array([END]))[0])
    return Model(folder, words, pair_sizes, total, distinct, end, discount, unseen)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every whole text, its tokens' log10 probabilities summed.

    A null text is empty: its end alone. Null and repeated ids keep their rows. After training on nothing, every token
    has probability 1.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in in_slices(texts):
                n, known, base, own = sent.value.score(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(a, b - a), *map(pa.array, (n, known, base, own))], ["doc_id", "n_tokens", "n_known", "base_score", "score"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def perplexity(docs: DataFrame) -> DataFrame:
    """Scores all documents by a model of those whose crc32(doc_id) modulo 10 is not 0."""
    model = train(docs.where(fold("doc_id", 10) != 0))
    return score(docs, model).select(
        "doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
