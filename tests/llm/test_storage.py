"""Exact round trips of ids, chunks and windows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyforge.llm import chunking, packing, pieces, repair
from tests.llm.helpers import docs

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "the ", " ", "  ", "\n", "\xa0", "　", "\x1c", "\x85", "é", "don't", "I'LL", "12 345", "<|endoftext|>", "Ā", "́", "İ", "Σ", "\t", "\r\n", "😀", "x" * 50, ".", ",", "!", "é,", "—,", "x's", "'a'", "A!!", "中文", "​", "﻿"]


def texts(n=400):
    r = random.Random(1)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", "   ", "\xa0", "a" * 5000]


def plain(path, all_texts, end):
    return [e.ids + [end] for e in Tokenizer.from_file(path).encode_batch(all_texts, add_special_tokens=False)]


def test_pieces_give_the_ids_of_whole_texts(spark):
    t = texts()
    frame = docs(spark, list(enumerate(t)))
    for path, spaces in ((BYTE, True), (WORD, False)):
        ids, n = pieces.encoder(frame, path, spaces).open().encode(t)
        assert np.split(ids, np.cumsum(n)[:-1])[7].tolist() == plain(path, t, 0)[7][:-1]
        assert ids.tolist() == [i for x in plain(path, t, 0) for i in x[:-1]]


def test_grammar_blocks(spark):
    t = texts()
    got = repair.read_shards(repair.write_shards(docs(spark, list(enumerate(t))), WORD)).orderBy("doc_id").collect()
    at = 0
    for row, ids in zip(got, plain(WORD, t, 2), strict=True):
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_rules_and_random_access():
    r = np.random.default_rng(0)
    ids = r.integers(3, 40, 20_000).astype(np.uint32)
    ids[500:9000:50] = 2
    ids[3000:3100] = 7  # a run of one id
    ids[-1] = 2
    lens = np.diff(np.flatnonzero(ids == 2), prepend=-1)
    block = repair.Block(repair.write_block(list(range(len(lens))), lens, ids, 2))
    assert (block.all() == ids).all() and len(block._seq) < len(ids)
    ends = np.cumsum(lens)
    assert all((block.document(k) == ids[ends[k] - lens[k] : ends[k]]).all() for k in range(len(lens)))
    assert all((block.ids(a, a + 777) == ids[a : a + 777]).all() for a in range(0, 19_000, 997))


def test_chunks_round_trip(spark):
    r = random.Random(2)
    shared = "".join(r.choice("abcdefgh ") for _ in range(30_000))
    t = [*texts(60), shared, "x" + shared, shared[5000:], shared, "y" * 20_000, None]
    got = {x.doc_id: x for x in chunking.media(docs(spark, list(enumerate(t)))).collect()}
    for i, text in enumerate(t):
        raw = (text or "").encode()
        data = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        x = got[i]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
    assert got[len(t) - 6].media_sha256 == got[len(t) - 3].media_sha256
    store, lent = chunking.write_store(docs(spark, list(enumerate(t))))
    assert lent.count() > 5  # chunks after the altered beginning are cut alike


def test_windows_are_full_and_gapless(spark):
    t = [*texts(80), "many words " * 3000]
    want = plain(BYTE, t, 1)
    packed = packing.pack(packing.cut(docs(spark, list(enumerate(t))), BYTE, 1, 64, with_ids=True), 64)
    rows = packed.collect()
    by_doc, by_seq = {}, {}
    for x in rows:
        by_doc.setdefault(x.doc_id, []).append(x)
        by_seq.setdefault(x.sequence_id, []).append(x)
    for i, ids in enumerate(want):
        at = 0
        for x in sorted(by_doc[i], key=lambda x: x.start):
            assert x.start == at and x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(np.array(ids[at : at + x.length], "<u4").tobytes())
            at += x.length
        assert at == len(ids)
    for xs in by_seq.values():
        xs.sort(key=lambda x: x.offset)
        assert [x.offset for x in xs] == [sum(y.length for y in xs[:k]) for k in range(len(xs))] and sum(x.length for x in xs) <= 64
    assert sum(map(len, want)) / 64 / len(by_seq) > 0.9
    full = packing.assemble(packed, 0, 64).collect()
    assert all(len(x.ids) == 64 for x in full) and sum(map(len, want)) <= sum(len(x.ids) for x in full)


def test_differencing_is_balanced():
    sizes = np.random.default_rng(0).integers(1, 512, 400)
    at = packing.differencing(sizes, 50)
    sums = np.bincount(at, sizes, 50)
    assert sums.max() - sums.min() < 25 and len(at) == 400


def test_a_repeated_row_is_dealt_over_groups(spark):
    from collections import Counter

    from tallyforge.llm import packing

    n = 4 * packing.GROUP_PIECES
    pieces = spark.range(n).selectExpr("cast(null as long) as doc_id", "0L as start", "5L as length", "7L as ids_crc32", "5L as doc_tokens")
    got = packing.pack(pieces).select("sequence_id", "offset").collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == n
    assert max(Counter(r.sequence_id >> 32 for r in got).values()) < 2 * packing.GROUP_PIECES


def test_no_frequent_pair_is_left_when_16_bits_run_out():
    """More rules than 16 bits can number: symbols go on in 32 bits, until no pair occurs 8 times."""
    r = np.random.default_rng(1)
    first = 49_000
    halves = [r.permutation(np.arange(3, first)).astype(np.uint32)[:44_000].reshape(-1, 2) for _ in range(2)]
    pairs = np.concatenate(halves)  # 44,000 pairs, of 88,000 places
    ids = np.concatenate([pairs[r.permutation(len(pairs))].ravel() for _ in range(12)])
    ids[49_999::50_000] = 2
    ids[-1] = 2
    seq, rules, base, spans = repair.compress(ids, 2)
    assert base + len(rules) > repair.SYMBOLS and seq.dtype == np.uint32
    inner = seq[:-1] != 2
    left = np.unique(seq[:-1][inner].astype(np.uint64) << np.uint64(32) | seq[1:][inner], return_counts=True)[1]
    assert left.max() < 8
    lens = np.diff(np.flatnonzero(ids == 2), prepend=-1)
    block = repair.Block(repair.write_block(list(range(len(lens))), lens, ids, 2))
    assert (block.document(3) == ids[lens[:3].sum() : lens[:4].sum()]).all() and (block.all() == ids).all()


def test_rows_of_one_id_are_dealt_over_shards(spark):
    """Null ids, and equal rows, don't meet in one shard; places and ids stay right."""
    rows = [(None, "one and the same")] * 2000 + [(5, f"text {i}") for i in range(1000)] + [(9, "last")]
    blocks = repair.write_shards(docs(spark, rows).repartition(8), WORD, shards=8)
    assert blocks.groupBy("shard").agg({"n_docs": "sum"}).agg({"sum(n_docs)": "max"}).first()[0] < 2000
    got = sorted(repair.read_shards(blocks).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == [None] * 2000 + [5] * 1000 + [9]
    assert [x.start for x in got] == np.cumsum([0, *(x.n_tokens for x in got)])[:-1].tolist()
