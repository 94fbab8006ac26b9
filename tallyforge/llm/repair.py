"""Token-id output as Re-Pair grammars: frequent id pairs become nonterminals, per block, with random-access decoding.

A block holds the ids of whole documents in ascending id order. Its sequence is shortened in rounds: the most frequent
adjacent pairs each get a new symbol, and every occurrence, from left to right, becomes that symbol. Rules and the
lengths of their expansions are stored, so that a document, or a range of ids, is expanded without the rest.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import SHARD_BYTES, in_slices, materialise, stored_bytes
from tallyforge.llm.pieces import encoder

MAGIC = b"TFRP2\0\0\0"
#: Magic, number of plain ids, of documents, of rules, of symbols.
HEAD = "<8sIIIQ"
#: Ids of one block, at which it is closed; a longer document is a block of its own.
BLOCK_IDS = 1 << 20
#: Symbols, which ids and rules share, are stored in 16 bits, or in 32 where a block has more of them than 16 can hold.
SYMBOLS = 1 << 16


def compress(ids: np.ndarray, end_id: int, least: int = 8, share: float = 0.25):
    """(sequence, rules, lengths): ``rules[k]`` are the two symbols that symbol ``first + k`` stands for.

    ``first`` is one more than the largest id. No pair begins with ``end_id``, so no rule crosses documents. A round
    takes the pairs that occur at least ``share`` times as often as its most frequent pair; rounds go on until no pair
    occurs ``least`` times. Symbols are counted in 16 bits as long as they fit, and then in 32.
    """
    first = int(ids.max(initial=0)) + 1
    bits, pair = (32, np.uint64) if first >= SYMBOLS else (16, np.uint32)
    seq = ids.astype(pair)
    rules = np.empty(0, pair)
    while len(seq) > 1:
        pairs = seq[:-1] << pair(bits) | seq[1:]
        held = np.sort(pairs)
        a, b = np.searchsorted(held, np.array([end_id << bits, (end_id + 1) << bits], pair))
        if b > a:
            held = np.concatenate([held[:a], held[b:]])
        if not len(held):
            break
        at = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        counts = np.diff(np.append(at, len(held)))
        top = int(counts.max())
        if top < least:
            break
        often = np.flatnonzero(counts >= max(least, int(top * share)))
        if bits == 16 and first + len(rules) + len(often) > SYMBOLS:
            rules = (rules >> pair(16)).astype(np.uint64) << np.uint64(32) | (rules & pair(0xFFFF)).astype(np.uint64)
            bits, pair = 32, np.uint64
            seq = seq.astype(pair)
            continue
        chosen = held[at[often[np.argsort(-counts[often], kind="stable")]]]  # the most frequent first
        order = np.argsort(chosen)
        seq = _replace(seq, pairs, chosen[order], (first + len(rules) + order).astype(pair), end_id)
        rules = np.concatenate([rules, chosen])
    out = np.stack([rules >> pair(bits), rules & pair((1 << bits) - 1)], axis=1)
    symbol = np.uint16 if bits == 16 else np.uint32
    return seq.astype(symbol), out.astype(symbol), first, _lengths(out, first)


def _replace(seq, pairs, chosen, symbols, end_id):
    """Every occurrence of the chosen pairs becomes its symbol; of overlapping ones the leftmost goes first."""
    marked = np.zeros(1 << 18, bool)  # by a hash of the pair: most that aren't chosen drop out here
    marked[_slot(chosen)] = True
    maybe = np.flatnonzero(marked[_slot(pairs)] & (seq[:-1] != end_id))
    k = np.searchsorted(chosen, pairs[maybe]).clip(max=len(chosen) - 1)
    hit = chosen[k] == pairs[maybe]
    at, k = maybe[hit], k[hit]
    run = np.concatenate([[True], np.diff(at) != 1])  # begins a run of occurrences that overlap
    start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
    taken = (np.arange(len(at)) - start) % 2 == 0
    at, k = at[taken], k[taken]
    seq = seq.copy()
    seq[at] = symbols[k]
    keep = np.ones(len(seq), bool)
    keep[at + 1] = False
    return seq[keep]


def _slot(pairs: np.ndarray) -> np.ndarray:
    if pairs.dtype == np.uint64:
        return pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)
    return pairs * np.uint32(2654435761) >> np.uint32(14)


def _sizes(symbols: np.ndarray, first: int, spans: np.ndarray) -> np.ndarray:
    """How many ids each symbol stands for."""
    n = np.ones(len(symbols), np.int64)
    rule = symbols >= first
    n[rule] = spans[symbols[rule] - first]
    return n


def _lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule stands for."""
    out = np.zeros(len(rules), np.int64)
    while len(rules) and (out == 0).any():
        parts = [np.where(rules[:, i] < first, 1, out[np.maximum(rules[:, i].astype(np.int64) - first, 0)]) for i in (0, 1)]
        out = np.where((parts[0] > 0) & (parts[1] > 0), parts[0] + parts[1], 0)
    return out.astype(np.uint32)


def write_block(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, end_id: int) -> bytes:
    """A block's bytes: header, document ids, which of them are null, ids per document, symbols per document, rules,
    their lengths, symbols."""
    seq, rules, first, spans = compress(ids, end_id)
    each = _sizes(seq.astype(np.int64), first, spans)
    ends = np.searchsorted(np.cumsum(each), np.cumsum(lengths)) + 1
    parts = [
        np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), np.asarray(lengths, "<i8"), np.diff(ends, prepend=0).astype("<i8"),
        rules, spans.astype("<u4"), seq,
    ]
    head = struct.pack(HEAD, MAGIC, first, len(doc_ids), len(rules), len(seq))
    return head + b"".join(x.tobytes() for x in parts)


class Block:
    """A stored block; ``document(k)`` expands the k-th document alone, ``ids(a, b)`` any range of the block's ids."""

    def __init__(self, data: bytes):
        magic, self.first, docs, rules, symbols = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a grammar block")
        at, kind = struct.calcsize(HEAD), "<u4" if self.first >= SYMBOLS or self.first + rules > SYMBOLS else "<u2"

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.nulls, self.lengths, self._symbols = take("<i8", docs), take("u1", docs).astype(bool), take("<i8", docs), take("<i8", docs)
        self._rules = take(kind, 2 * rules).reshape(-1, 2)
        self._spans, self._seq = take("<u4", rules), take(kind, symbols)
        self._upto = np.concatenate([[0], np.cumsum(self._symbols)])
        self._flat = None

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """Symbol by symbol, down to ids; rules that these symbols don't need aren't read."""
        n = _sizes(symbols, self.first, self._spans)
        at, out = np.cumsum(n) - n, np.empty(int(n.sum()), np.uint32)
        while len(symbols):
            plain = symbols < self.first
            out[at[plain]] = symbols[plain]
            at, parts = at[~plain], self._rules[symbols[~plain] - self.first].astype(np.int64)
            at = np.concatenate([at, at + _sizes(parts[:, 0], self.first, self._spans)])
            symbols = np.concatenate([parts[:, 0], parts[:, 1]])
        return out

    def document(self, k: int) -> np.ndarray:
        return self._expand(self._seq[self._upto[k] : self._upto[k + 1]].astype(np.int64))

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids number ``a`` to ``b`` (exclusive) of the block, by the stored lengths."""
        ends = np.cumsum(_sizes(self._seq.astype(np.int64), self.first, self._spans))
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left") + 1
        before = ends[lo - 1] if lo else 0
        return self._expand(self._seq[lo:hi].astype(np.int64))[a - before : b - before]

    def all(self) -> np.ndarray:
        """Every id: here all rules are expanded first, from short ones to long ones, and then copied."""
        if self._flat is None:
            self._at = np.cumsum(self._spans, dtype=np.int64) - self._spans
            self._flat = np.zeros(int(self._spans.sum(dtype=np.int64)) + 1, np.uint32)
            for size in np.unique(self._spans):
                which = np.flatnonzero(self._spans == size)
                got = self._copied(self._rules[which].ravel().astype(np.int64)).reshape(len(which), size)
                self._flat[self._at[which][:, None] + np.arange(size)] = got
        return self._copied(self._seq.astype(np.int64))

    def _copied(self, symbols: np.ndarray) -> np.ndarray:
        n = _sizes(symbols, self.first, self._spans)
        ends = np.cumsum(n)
        plain = symbols < self.first
        at = np.zeros(len(symbols), np.int64)
        at[~plain] = self._at[symbols[~plain] - self.first]
        out = self._flat[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        out[ends[plain] - 1] = symbols[plain]
        return out


SHARD = "shard int, block int, start long, n_ids long, n_docs long, data binary"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Documents (doc_id, text) as grammar blocks, written in the shared folder; a row for each block.

    Documents are dealt by ranges of doc_id into ``shards`` (unless given, spark.sql.shuffle.partitions, or more for a
    larger table) and sorted there, so blocks in order of (shard, block) hold ascending ids. A null text is empty and
    yields the end id alone; a null doc_id stays null and comes first; equal doc_ids stay apart, ordered by a hash of the
    text, and ranges may part them, so that many rows of one id, or equal rows, don't meet in one task; other columns
    are ignored; an empty table yields no block. ``start`` counts the ids of the shard's earlier blocks.
    """
    spark = docs.sparkSession
    table = encoder(docs, tokenizer, False)
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored_bytes(docs) // SHARD_BYTES)

    def run(batches):
        encode = table.open().encode
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        ids, lens, held = [], [], 0
        names: list[int] = []

        def close():
            nonlocal block, start, held
            row = pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "start": [start],
                "n_ids": [held], "n_docs": [len(names)],
                "data": pa.array([write_block(names, np.concatenate(lens), np.concatenate(ids), end_id)], pa.binary()),
            })
            block, start, held = block + 1, start + held, 0
            ids.clear(), lens.clear(), names.clear()
            return row

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_slices(texts):
                got, n_got = encode(texts[a:b])
                ends = np.cumsum(n_got)
                with_end = np.insert(got, ends, end_id)
                n_got = n_got + 1
                ends = np.cumsum(n_got)
                first = 0
                while first < b - a:  # documents that still fit, one at least
                    upto = ends[first - 1] if first else 0
                    last = max(first + (not held), int(np.searchsorted(ends, upto + BLOCK_IDS - held, "right")))
                    if last > first:
                        ids.append(with_end[upto : ends[last - 1]])
                        lens.append(n_got[first:last])
                        names.extend(doc_ids[a + first : a + last])
                        held += int(ends[last - 1] - upto)
                    first = last
                    if first < b - a or held >= BLOCK_IDS:
                        yield close()
        if names:
            yield close()

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("nth"))
    order = ("doc_id", "hash", "nth")
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialise(dealt.mapInArrow(run, SHARD), "grammar")


READ = "shard int, start long, doc_id long, n_tokens long, ids_crc32 long, grammar_bytes long"


def read_shards(blocks: DataFrame) -> DataFrame:
    """Every document of the stored blocks, read back: its place among all ids, its number of ids and their crc32.

    Only one row for each shard, with its number of ids, is gathered to find where the shards begin.
    """

    def run(batches):
        for batch in batches:
            for shard, start, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "start", "data"))):
                block = Block(data)
                ids = block.all().astype("<u4")
                ends = np.cumsum(block.lengths)
                begins = ends - block.lengths
                n = len(ends)
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(np.full(n, shard, np.int32)), "start": pa.array(start + begins),
                    "doc_id": pa.array(block.doc_ids, mask=block.nulls), "n_tokens": pa.array(block.lengths),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)], pa.int64()),
                    "grammar_bytes": pa.array(block._seq.itemsize * block._symbols),
                })

    spark = blocks.sparkSession
    totals = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    begins, upto = [], 0
    for shard, n in totals:
        begins.append((shard, upto))
        upto += n
    offsets = spark.createDataFrame(begins, "shard int, offset long")  # as many rows as shards
    return (
        blocks.select("shard", "start", "data")
        .mapInArrow(run, READ)
        .join(F.broadcast(offsets), "shard")
        .select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "grammar_bytes")
    )
