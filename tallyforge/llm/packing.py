"""Packing into windows by Karmarkar-Karp multiway differencing.

Documents are cut into whole windows and a rest; the rest is cut into pieces of at most a quarter window. Pieces are
dealt over groups of bounded size. In a group, every piece begins as a partial partition over k windows; the two
partial partitions with the largest imbalance are merged, the fullest windows of one with the emptiest of the other,
until one is left. Where its fullest window exceeds the capacity, k rises and the group is partitioned again.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import in_slices, materialise
from tallyforge.llm.pieces import encoder

CAPACITY = 2048
#: Pieces in one group, on average: about 500 windows are balanced at a time.
GROUP_PIECES = 2500
#: Sequences that are one full window are numbered from here on; those of groups begin with the group's number.
ALONE = 1 << 62


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each size: multiway largest differencing. Ties go to the lower index."""
    n = len(sizes)
    sums: dict[int, np.ndarray] = {}
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-int(s), i))
        sums[i] = np.zeros(k, np.int64)
        sums[i][0] = s
    heapq.heapify(heap)
    merges = []
    node = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        sums[node] = both
        merges.append((node, a, b, order.astype(np.int32)))
        heapq.heappush(heap, (-int(both[0]), node))
        node += 1
    names = {heap[0][1]: np.arange(k, dtype=np.int32)} if n else {}
    for parent, a, b, order in reversed(merges):
        own = names.pop(parent)
        names[a] = np.empty(k, np.int32)
        names[a][order] = own
        names[b] = names[a][::-1]
    return np.array([names[i][0] for i in range(n)], np.int64)


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows for sizes of at most ``capacity``, none over it: as many as the total needs, and more while one is."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    if k > 64:  # a few ids of slack in each window, so that the first partition mostly fits
        k = -(-total // (capacity - max(1, capacity // 512)))
    while len(sizes):
        at = differencing(sizes, k)
        if np.bincount(at, sizes, k).max() <= capacity:
            return at
        k += 1
    return np.zeros(0, np.int64)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents' ids: whole windows, then parts of at most a quarter of one.

    A null text is empty and yields the end id alone; null and repeated doc_ids are kept as they are; other columns
    are ignored. ``ids``: the piece as little-endian unsigned 32-bit numbers, null unless ``with_ids``.
    """
    table = encoder(docs, tokenizer, True)
    part = max(1, capacity // 4)

    def run(batches):
        encode = table.open().encode
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in in_slices(texts):
                got, n = encode(texts[a:b])
                ids = np.insert(got, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                whole = n // capacity
                rest = n - whole * capacity
                parts = -(-rest // part)
                count = whole + parts
                doc = np.repeat(np.arange(b - a), count)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                in_rest = np.maximum(nth - whole[doc], 0)
                start = np.minimum(nth, whole[doc]) * capacity + in_rest * part
                length = np.where(nth < whole[doc], capacity, np.minimum(part, rest[doc] - in_rest * part))
                at = (np.cumsum(n) - n)[doc] + start
                data = [ids[i:j] for i, j in zip(at, at + length)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": doc_ids.slice(a, b - a).take(pa.array(doc)), "start": start, "length": length,
                    "ids_crc32": pa.array(map(zlib.crc32, data), pa.int64()), "doc_tokens": n[doc],
                    "ids": pa.array([x.tobytes() for x in data] if with_ids else [None] * len(data), pa.binary()),
                })

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``capacity`` ids.

    A full window is a sequence by itself and is not shuffled. The others are dealt over groups by a hash of the piece
    and of its number in the written table, so that no document makes one large, however long it is, and no row,
    however often it is repeated: a group has about GROUP_PIECES of them at any size of the table. Null and repeated
    doc_ids keep their pieces; an empty table gives none; columns beyond those of ``cut`` are kept.
    """
    pieces = materialise(pieces, "pieces")
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, round(rest.count() / GROUP_PIECES))
    keyed = rest.withColumn("batch", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    names = pieces.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        size = pdf["length"].to_numpy()
        at = windows(size, capacity)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(size[order])
        first = np.concatenate([[True], at[order][1:] != at[order][:-1]])
        before = np.maximum.accumulate(np.where(first, ends - size[order], 0))
        offset = np.empty(len(size), np.int64)
        offset[order] = ends - size[order] - before
        out = pdf[names].copy()
        out["sequence_id"] = (int(pdf["batch"].iloc[0]) << 32) + at
        out["offset"] = offset
        return out

    alone = pieces.where(F.col("length") == capacity).select("*", (F.monotonically_increasing_id() + ALONE).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(keyed.groupBy("batch").applyInPandas(run, schema))


def assemble(packed: DataFrame, pad_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids array<long>) of pieces cut ``with_ids``: each sequence's ids in order, padded to capacity.

    Pieces without ids are an error, as their sequence can't be put together; an empty table gives no sequences.
    """
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def run(frames):
        for pdf in frames:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4") for parts in pdf["parts"]]
            padded = [np.pad(x, (0, capacity - len(x)), constant_values=pad_id).astype(np.int64) for x in ids]
            yield pd.DataFrame({"sequence_id": pdf["sequence_id"], "ids": padded})

    return rows.mapInPandas(run, "sequence_id long, ids array<long>")
