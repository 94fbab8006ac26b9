"""Alignment against the libraries on whole texts and merges in plain Python."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tallyforge.llm import alignment
from tests.llm.helpers import docs

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "the cat sat on the mat, and the dog ran off.", "the cat sat on the mat, and the dog ran off.", None, "", " ", "  two  spaces \n\n lines\t tab ", "x" * 500, "naïve çà et là, 大神 😀😀 Ⅱ ﬁ é",
    "a▁b", "<s> <|endoftext|> <unk> <0x41>", "var x = f();\r\n\r\nint y;\r", "a　b\xa0c d", "==== ---- !!!!???... a.b,c;d", "\x00\x01\x7f", "don't we'll I'm", "1234567890 12,345.67", "wörter. Größe! é?", "😀" * 40,
    "word " * 3000, "A.B.C. e.g. i.e. http://x.example.com/a?b=c&d=e",
]


def plain(texts):
    """One row for each text, merged end by end."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_of, b_of = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a_of.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        a_bytes = {int(n): base64.b64decode(x) for x, n in map(bytes.split, f)}
    b_bytes = lambda n: bytes([int(b_of.id_to_piece(n)[1:-1], 16)]) if re.fullmatch("<0x..>", b_of.id_to_piece(n)) else b_of.id_to_piece(n).replace("▁", " ").encode()
    held, rows = defaultdict(set), []
    for k, text in enumerate(texts):
        a, b = (a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)) if text else ([], [])
        if not text or not (b"".join(map(a_bytes.get, a)) == (" " + text).encode() == b"".join(map(b_bytes, b))):
            rows.append(None)
            continue
        ends = lambda ids, of: np.cumsum([len(of(n)) for n in ids]).tolist()
        ea, eb = ends(a, a_bytes.get), ends(b, b_bytes)
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            x, y = ea.index(e, i) + 1, eb.index(e, j) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        for pair in links:
            held[pair].add(k)
        rows.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), ks in held.items():
        most[x] = max(most[x], len(ks))
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = r
        name = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        best = sum(n for p, n in links.items() if len(held[p]) == most[p[0]])
        out.append((n_a, n_b, len(groups), links.total(), best, sum(n * len(held[p]) for p, n in links.items()), hashlib.sha256(name.encode()).hexdigest()))
    return out


def test_against_plain(spark):
    frame = docs(spark, list(enumerate(TEXTS))).withColumns({n: F.lit("x") for n in ("keys", "times", "a_ids", "n_a", "shard")}).repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.alignment(frame, BYTE, PIECE).collect()}
    for k, want in enumerate(plain(TEXTS)):
        assert got[k] == want, TEXTS[k]


def test_given_documents(spark):
    """Whole documents of the smallest given table, with repeated and null ids beside them."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    rows += [(None, rows[0][1]), (rows[1][0], rows[1][1])]
    got = alignment.alignment(docs(spark, rows), BYTE, PIECE).collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, plain([t for _, t in rows]))), key=key)


def test_empty(spark):
    assert alignment.alignment(docs(spark, []), BYTE, PIECE).collect() == []
    assert [tuple(r)[1:] for r in alignment.alignment(docs(spark, [(1, None), (2, "")]), BYTE, PIECE).collect()] == [(0,) * 6 + ("",)] * 2


def test_division():
    """Random ends: the cuts are the common ends, whatever their number."""
    r = np.random.default_rng(3)
    for size, most in ((40, 30), (4000, 3), (4000, 2000), (20000, 60)):
        ea, eb, ua, ub, want = [], [], [], [], []
        for at in range(5):
            x, y = (np.unique(np.append(r.choice(np.arange(1, size), most, replace=most > size // 2), size)) for _ in range(2))
            ea.append(x + at * size), eb.append(y + at * size)
            ua.append(len(x)), ub.append(len(y))
            want += (np.intersect1d(x, y) + at * size).tolist()
        ea, eb = np.concatenate(ea), np.concatenate(eb)
        ca, cb = alignment.divided(ea, eb, np.cumsum(ua), np.cumsum(ub))
        assert ea[ca - 1].tolist() == eb[cb - 1].tolist() == want


def test_wide_groups():
    """A group of many links, counted by its distinct tokens, is as the links one by one."""
    r = np.random.default_rng(5)
    a, b = r.integers(0, 9, 300), r.integers(0, 7, 200)
    keys, times, bits = alignment._linked(a, b, np.array([100, 300]), np.array([90, 200]), np.array([0, 1]), 7)
    want = Counter((int(x) * 7 + int(y), 0) for x in a[:100] for y in b[:90]) + Counter((int(x) * 7 + int(y), 1) for x in a[100:] for y in b[90:])
    assert {(int(k) & ((1 << int(bits)) - 1), int(k) >> int(bits)): int(n) for k, n in zip(keys, times)} == dict(want)
