"""Near-duplicate classes by ProbMinHash over five-word shingles, banding, and exact verification.

Links are defined on sets, so each distinct shingle of a text has the weight 1, however often the text has it: then the
probability Jaccard similarity is the sets'. Each shingle is a Poisson process whose rate is its weight; every
arrival falls into a random slot, and a slot keeps its earliest arrival. A shingle stops when its next arrival is later
than every slot's. Two texts agree in a slot with the probability of their probability Jaccard similarity. Bands of
slots give candidates; a candidate is a link if the texts' sets of shingles have a Jaccard similarity of 0.8 or more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import in_slices, materialise
from tallyforge.llm.components import components
from tallyforge.llm.textvec import mix, word_hashes

WORDS, SIMILAR = 5, 0.8
#: At a similarity of 0.8 all bands miss with a probability of 3 in a million; at 0.65, of one in a hundred.
BANDS, ROWS = 24, 4
#: Members of a bucket that are all compared with one another; larger ones have a leader.
SMALL = 16
#: Bytes of shingles of one side of a large bucket that one task holds.
BLOCK_BYTES = 8 << 20
#: Characters of texts that a worker hashes at a time.
SLICE = 1 << 20
_FACTORS = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_DOC_BITS = np.uint64(13)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of each text's distinct shingles, in order; 51 bits of hash. Texts: at most 8192.

    Words are runs of characters other than white space, A to Z in lower case. A text of fewer than five words, but
    one at least, has one shingle, all its words; a text without words has none.
    """
    hashes, n = word_hashes(texts)
    size = np.minimum(n, WORDS)
    count = np.where(n > 0, n - size + 1, 0)
    row = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.cumsum(n) - n, count)
    h = np.zeros(len(at), np.uint64)
    hashes = np.append(hashes, np.zeros(WORDS, np.uint64))
    for k, factor in enumerate(_FACTORS):
        h += np.where(k < size[row], hashes[at + k] * factor, np.uint64(k))
    keys = np.sort(row.astype(np.uint64) << np.uint64(64 - 13) | mix(h) >> _DOC_BITS)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    weight = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> np.uint64(64 - 13)).astype(np.int64), keys & np.uint64((1 << 51) - 1), weight


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, slots: int = BANDS * ROWS) -> np.ndarray:
    """The shingle that holds each slot, for each text; 0 throughout for a text without shingles."""
    when = np.full(texts * slots, np.inf)
    who = np.zeros(texts * slots, np.uint64)
    row, x, w, k = row, np.zeros(len(row)), weight.astype(np.float64), 0
    while len(row):
        k += 1
        r = mix(shingle + mix(np.full(1, k, np.uint64)))
        x = x - np.log((r >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / w
        latest = when.reshape(texts, slots).max(axis=1)
        stay = x < latest[row]
        row, shingle, x, w, r = row[stay], shingle[stay], x[stay], w[stay], r[stay]
        slot = row * slots + (mix(r) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(when, slot, x)
        won = when[slot] == x
        who[slot[won]] = shingle[won]
    return who.reshape(texts, slots)


def _bands(batches):
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        for first, last in in_slices(texts, SLICE):
            for a in range(first, last, 2048):
                b = min(last, a + 2048)
                row, shingle, weight = shingles(texts[a:b])
                who = signatures(row, shingle, np.ones_like(weight), b - a).reshape(b - a, BANDS, ROWS)
                h = np.arange(BANDS, dtype=np.uint64)[None, :]
                for k in range(ROWS):
                    h = mix(h + who[:, :, k])
                size = np.bincount(row, minlength=b - a)
                some = size > 0
                lists = pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32), pa.array(h[some].view(np.int64).ravel())
                )
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), lists], ["node", "bands"])


def _sets(batches):
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        for first, last in in_slices(texts, SLICE):
            for a in range(first, last, 2048):
                b = min(last, a + 2048)
                row, shingle, _ = shingles(texts[a:b])
                ends = np.searchsorted(row, np.arange(b - a + 1))
                data = [(shingle[i:j] >> np.uint64(11)).tobytes() for i, j in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(data, pa.binary())], ["node", "shingles"])


def _verified(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(common >= SIMILAR * (len(both) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, text): the node is the text's md5, so equal texts are one node; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text"))


def links(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """(a, b): pairs of different texts that are similar, enough of them to connect each class.

    In buckets of up to ``small`` members, all are compared. In larger ones each member is compared with the first: the
    one whose buckets hold most texts, as an original stands before its altered copies. Those that are not linked with
    it are compared, in blocks, with all members of the buckets that it leads. So a large group of copies takes one
    comparison for each member, and every pair that shares a bucket is compared or connected.
    """
    texts = keyed(docs).select("node", "text")
    signed = materialise(texts.mapInArrow(_bands, "node binary, bands array<long>").distinct(), "bands")
    member = signed.select("node", F.explode("bands").alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(member.join(sizes, "bucket"), "shared")
    rank = shared.groupBy("node").agg(F.sum("n").alias("popular"))
    sets = materialise(texts.join(rank.select("node"), "node", "left_semi").mapInArrow(_sets, "node binary, shingles binary").distinct(), "sets")
    few, many = shared.where(F.col("n") <= small), shared.where(F.col("n") > small)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    lists = few.groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("nodes"))  # up to ``small``
    within = lists.select("nodes", F.posexplode("nodes").alias("i", "a")).select("a", F.explode(F.slice("nodes", F.col("i") + 2, F.lit(small))).alias("b"))
    best = many.join(rank, "node").groupBy("bucket").agg(F.max(F.struct("popular", "node"))["node"].alias("first"))
    led = materialise(many.join(best, "bucket").where("node != first").select("first", "node").distinct(), "led")
    found = _verify(within.unionByName(led.select(*pair("node", "first"))).distinct(), sets)
    either = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = materialise(led.join(either, (F.col("node") == F.col("a")) & (F.col("first") == F.col("b")), "left_anti"), "rest")
    return found if rest.isEmpty() else found.unionByName(materialise(_in_blocks(rest, led, sets), "links"))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets of shingles are similar."""
    side = lambda end, name: sets.select(F.col("node").alias(end), F.col("shingles").alias(name))
    both = pairs.join(side("b", "right"), "b").join(side("a", "left"), "a").select("a", "b", "left", "right")
    return materialise(both.mapInArrow(_verified, "a binary, b binary"), "links")


def _in_blocks(rest: DataFrame, led: DataFrame, sets: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Similar pairs of a node of ``rest`` (first, node) and another node of ``led`` under the same ``first``.

    Each side is dealt over blocks of about ``block_bytes`` by a hash of the node; a task holds one block of each side.
    """
    bytes_ = sets.select("node", F.octet_length("shingles").alias("bytes"))
    need = lambda rows, name: rows.join(bytes_, "node").groupBy("first").agg(F.ceil(F.sum("bytes") / block_bytes).cast("int").alias(name))
    blocks = materialise(need(rest, "asking").join(need(led.join(rest.select("first").distinct(), "first", "left_semi"), "held"), "first"), "blocks")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = rest.join(blocks, "first").select("first", "node", F.lit(True).alias("asks"), own("asking").alias("i"), all_("held").alias("j"))
    held = led.join(blocks, "first").select("first", "node", F.lit(False).alias("asks"), all_("asking").alias("i"), own("held").alias("j"))
    rows = asks.unionByName(held).join(sets, "node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf.asks], pdf[~pdf.asks]
        parts = [np.frombuffer(d, "<u8") for d in y["shingles"]]
        size = np.array([len(p) for p in parts])
        at = np.repeat(np.arange(len(parts)), size)
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        flat, at = flat[order], at[order]  # which members have each shingle
        names, out = y["node"].to_list(), []
        for node, data in zip(x["node"], x["shingles"]):
            own = np.frombuffer(data, "<u8")
            a, b = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            n = b - a
            met = at[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            common = np.bincount(met, minlength=len(parts))
            near = np.flatnonzero((common > 0) & (common >= SIMILAR * (len(own) + size - common)))
            out += [(min(node, names[k]), max(node, names[k])) for k in near if names[k] != node]
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.groupBy("first", "i", "j").applyInPandas(run, "a binary, b binary").distinct()


def _members(docs: DataFrame) -> DataFrame:
    """(node, doc_id, root): each distinct text, its smallest doc_id, and what names its class."""
    roots = components(links(docs))
    least = keyed(docs).groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    return materialise(least.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")), "members")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): documents that equal texts and links connect have the smallest doc_id among them.

    Null texts count as empty, empty texts as equal; repeated doc_ids keep their rows; a class with null doc_ids alone
    has a null class_id; of equal texts any stands for all; other columns are ignored; an empty table gives no rows.
    """
    member = _members(docs)
    of = member.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    names = materialise(member.select("node", "root").join(of, "root").select("node", "class_id"), "classes")
    return keyed(docs).select("doc_id", "node").join(names, "node").select("doc_id", "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """A row of ``docs`` for each class, with all its columns: the one with the smallest doc_id, nulls last.

    Of rows that are equal in text and doc_id any one stays; an empty table stays empty; columns may have any name.
    """
    chosen = _members(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first"))
    chosen = chosen.select(F.col("first.node").alias("__node"), F.col("first.doc_id").alias("__id"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed_rows = docs.select(
        F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("__node"), F.col("doc_id").cast("long").alias("__own"), row.alias("__row")
    )
    kept = keyed_rows.join(chosen, "__node").where(F.col("__own").eqNullSafe(F.col("__id")))
    return kept.groupBy("__node").agg(F.first("__row").alias("__row")).select("__row.*")
