"""Tokens of two vocabularies aligned by divide and conquer at the ends that both share.

A text, with a space before it, is cut into tokens by a byte-level vocabulary (A) and by one of pieces (B). Over the
same bytes, an interval of tokens is divided at a common end near its middle, which is looked for outward from the
middle by bisection of B's ends, and both halves are divided in turn; an interval without a common end inside is a
group. All intervals of one depth are divided at once. Distinct pieces of the corpus are tokenized once (``pieces``).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import freed_shuffles, in_slices, materialise, new_folder
from tallyforge.llm.ngram import counted, summed
from tallyforge.llm.pieces import Encoder, encoder, ids_of, pieces
from tallyforge.llm.sharedfiles import map_array, map_counts, write_array, write_counts
from tallyforge.llm.textvec import mix, span_hashes

#: How vocabularies of pieces write a space.
_BLANK = chr(0x2581)
#: White space at which ``pieces`` cuts.
_GAPS = frozenset(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_MARKED = re.compile("[A-Za-z]([.,:;!?])")
#: Groups of more links than this are counted by their distinct tokens.
WIDE = 4096
#: Keys that a task gathers before it sums them, and parts of the table of pairs: bounded, as the pairs of two vocabularies are.
FLUSH, SHARDS = 2_000_000, 256


class Vocabularies:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, byte_level: str, of_pieces: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=of_pieces)
        # byte-level tokens write each byte as one character: printable ones as themselves, the rest from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in set(plain)]
        as_byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}
        own = self.a.get_vocab()
        self.a_bytes = [b""] * (max(own.values()) + 1)
        for token, n in own.items():
            self.a_bytes[n] = bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode()
        names = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(n) else p.replace(_BLANK, " ").encode() for n, p in enumerate(names)]
        self.a_lens, self.b_lens = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        spaced = [p.replace(_BLANK, " ") for n, p in enumerate(names) if not self.b.is_byte(n)]
        if any("\n" in p for p in spaced):
            raise ValueError("a vocabulary whose pieces hold line feeds has no safe place before a piece")
        #: Characters before which ``pieces`` would cut inside a token of B: texts with them are tokenized whole.
        across = {p[k] for p in spaced for k in range(1, len(p)) if p[k] in _GAPS and p[k - 1] not in _GAPS}
        across |= {m[1] for p in spaced for m in _MARKED.finditer(p)}
        self.across = re.compile("[" + re.escape("".join(sorted(across))) + "]") if across else None

    def _joined(self, a: list[int], b: list[int], text: str) -> bool:
        raw = text.encode("utf-8", "surrogatepass")
        return b"".join([self.a_bytes[n] for n in a]) == raw == b"".join([self.b_bytes[n] for n in b])

    def pair(self, texts: list[str]) -> list[list[int]]:
        """For each piece: how many tokens A has, those, and B's; a single 0 where the bytes of either differ from the piece's.

        B would put a space before a piece; behind a line feed, which joins with nothing, it doesn't.
        """
        lead = len(self.b.encode("\n"))
        found = self.b.encode(["\n" + t for t in texts], num_threads=1)
        return [[len(a), *a, *b[lead:]] if self._joined(a, b[lead:], t) else [0] for t, a, b in zip(texts, ids_of(self.a, texts, True), found)]

    def whole(self, text: str) -> tuple[list[int], list[int]]:
        """Tokens of a text, a space before it; none where the bytes differ."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        return (a, b) if self._joined(a, b, " " + text) else ([], [])


class Both(Encoder):
    """A table of pieces with the tokens of both vocabularies; ``tokenizer`` is their two files."""

    def library(self) -> Vocabularies:
        files = tuple(self.tokenizer)
        if files not in _loaded:
            _loaded.clear()
            _loaded[files] = Vocabularies(*files)
        return _loaded[files]

    def ids(self, library: Vocabularies, texts: list[str]) -> list[list[int]]:
        return library.pair(texts)

    def tokens(self, texts: list[str]):
        """(A's ids, each text's number, B's ids, each text's number) of texts, which are not empty, behind a space."""
        names = self.library()
        data, starts, ends, counts = pieces([" " + t for t in texts], True)
        keys, back = np.unique(span_hashes(data, starts, ends)[0], return_inverse=True)
        ids, lens, odd = self._lookup(keys)
        at = np.cumsum(lens) - lens
        n_a = np.where(lens > 0, ids[np.minimum(at, max(len(ids) - 1, 0))] if len(ids) else 0, 0).astype(np.int64)
        text = np.repeat(np.arange(len(texts)), counts)
        whole = np.zeros(len(texts), bool)
        whole[text[odd[back]]] = True
        if names.across:
            whole |= np.fromiter((bool(names.across.search(t)) for t in texts), bool, len(texts))
        none = whole.copy()
        none[text[(n_a == 0)[back]]] = True
        own = ~none[text]
        out = []
        for first, n in ((at + 1, n_a), (at + 1 + n_a, lens - 1 - n_a)):
            k = back[own]
            m = n[k]
            upto = np.cumsum(m)
            got = ids[np.repeat(first[k] - (upto - m), m) + np.arange(upto[-1] if len(upto) else 0)]
            out += [got, np.bincount(text[own], m, len(texts)).astype(np.int64)]
        if whole.any():
            parts = [np.split(out[k], np.cumsum(out[k + 1])[:-1]) for k in (0, 2)]
            for t in np.flatnonzero(whole):
                for p, got in zip(parts, names.whole(texts[t])):
                    p[t] = np.array(got, np.uint32)
            out = [x for p in parts for x in (np.concatenate(p), np.array([len(y) for y in p], np.int64))]
        return out


_loaded: dict[tuple, Vocabularies] = {}


def _near_middle(ends_a, ends_b, a0, a1):
    """(A's token, B's token) that end together inside each interval, nearest to the middle of A's; -1 where none do."""
    mid, last = a0 + (a1 - 2 - a0) // 2, a1 - 2
    at, bt = np.full(len(a0), -1), np.full(len(a0), -1)
    rest, reach, width = np.arange(len(a0)), 0, 1
    while len(rest):
        d = reach + np.arange(width)
        if reach:  # both sides, nearest first
            d = np.stack([-d, d], axis=1).ravel()
        tried = mid[rest, None] + d
        inside = (tried >= a0[rest, None]) & (tried <= last[rest, None])
        value = ends_a[np.where(inside, tried, mid[rest, None])]
        place = np.searchsorted(ends_b, value)
        hit = inside & (ends_b[place] == value)
        has = hit.any(axis=1)
        which = hit.argmax(axis=1)[has]
        at[rest[has]], bt[rest[has]] = tried[has, which], place[has, which]
        reach, width = reach + width, 2 * width if reach else 1
        rest = rest[~has]
        rest = rest[np.maximum(mid[rest] - a0[rest], last[rest] - mid[rest]) >= reach]
    return at, bt


def divided(ends_a: np.ndarray, ends_b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end, as numbers of tokens of A and of B before that place, in order.

    ``ends``: byte offsets where the tokens of all texts, one after the other, end; ``upto``: each text's last token, as
    a number of tokens. Every text has tokens of both, over the same bytes, so its end is an end of both.
    """
    a1, b1 = upto_a, upto_b
    a0, b0 = np.concatenate([[0], a1[:-1]]), np.concatenate([[0], b1[:-1]])
    cut_a, cut_b = [upto_a], [upto_b]
    while len(a0):
        wide = (a1 - a0 > 1) & (b1 - b0 > 1)
        a0, a1, b0, b1 = a0[wide], a1[wide], b0[wide], b1[wide]
        at, bt = _near_middle(ends_a, ends_b, a0, a1)
        has = at >= 0
        a0, a1, b0, b1, at, bt = a0[has], a1[has], b0[has], b1[has], at[has] + 1, bt[has] + 1
        cut_a.append(at)
        cut_b.append(bt)
        a0, a1, b0, b1 = np.concatenate([a0, at]), np.concatenate([at, a1]), np.concatenate([b0, bt]), np.concatenate([bt, b1])
    return np.sort(np.concatenate(cut_a)), np.sort(np.concatenate(cut_b))


def _halves(values: np.ndarray, upto: np.ndarray) -> list[bytes]:
    raw, at = np.ascontiguousarray(values, "<u4").tobytes(), np.concatenate([[0], upto]) * 4
    return [raw[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


def _table(docs: DataFrame, byte_level: str, of_pieces: str) -> tuple[DataFrame, Both]:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts, encoder(texts.select(F.concat(F.lit(" "), "text").alias("text")), (byte_level, of_pieces), True, Both)


GROUPS = "doc_id long, a_ids binary, b_ids binary, a_cuts binary, b_cuts binary"


def align(docs: DataFrame, byte_level: str, of_pieces: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_cuts, b_cuts) of every document: tokens of both vocabularies and where groups end.

    All four are 32-bit little-endian numbers in a binary column; a cut is a number of tokens from the text's start.
    Texts that are null or empty, or whose tokens' bytes of A or B differ from the text behind a space (one with U+2581,
    for one), have no tokens. Whole texts are read; null and repeated ids keep their rows; other columns, of any name,
    are left out; an empty table gives no rows.
    """
    texts, made = _table(docs, byte_level, of_pieces)
    return texts.mapInArrow(_aligner(made), GROUPS)


def _aligner(made: Both):
    def run(batches):
        table = made.open()
        names = table.library()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, last in in_slices(texts, 1 << 20):
                real = [k for k in range(first, last) if texts[k]]
                columns = [[b""] * (last - first) for _ in range(4)]
                if real:
                    a, n_a, b, n_b = table.tokens([texts[k] for k in real])
                    some = np.flatnonzero(n_a > 0)
                    if len(some):
                        upto_a, upto_b = np.cumsum(n_a[some]), np.cumsum(n_b[some])
                        cut_a, cut_b = divided(np.cumsum(names.a_lens[a]), np.cumsum(names.b_lens[b]), upto_a, upto_b)
                        groups = np.searchsorted(cut_a, upto_a) + 1
                        n = np.diff(groups, prepend=0)
                        out = (_halves(a, upto_a), _halves(b, upto_b), _halves(cut_a - np.repeat(upto_a - n_a[some], n), groups), _halves(cut_b - np.repeat(upto_b - n_b[some], n), groups))
                        for column, values in zip(columns, out):
                            for k, v in zip(some.tolist(), values):
                                column[real[k] - first] = v
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), *(pa.array(c, pa.binary()) for c in columns)], GROUPS.replace(",", "").split()[::2])

    return run


_ends: list[bytes] = []


def _printed(a, b, cut_a, cut_b, last: np.ndarray) -> list[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``; ``last``: whether a group is its text's last."""
    top = int(max(a.max(), b.max())) + 1
    while len(_ends) < 4 * top:  # every number with each of the marks that may follow it
        n = b"%d" % (len(_ends) // 4)
        _ends.extend((n + b",", n + b"|", n + b";", n))
    n_a, n_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    codes = np.empty(len(a) + len(b), np.int64)
    code_a, code_b = a.astype(np.int64) * 4, b.astype(np.int64) * 4
    code_a[cut_a - 1] += 1
    code_b[cut_b - 1] += np.where(last, 3, 2)
    codes[np.arange(len(a)) + np.repeat(cut_b - n_b, n_a)] = code_a
    codes[np.arange(len(b)) + np.repeat(cut_a, n_b)] = code_b
    at = np.concatenate([[0], (cut_a + cut_b)[last]]).tolist()
    take = _ends.__getitem__
    return [b"".join(map(take, codes[x:y].tolist())) for x, y in zip(at[:-1], at[1:])]


def _linked(a, b, cut_a, cut_b, text: np.ndarray, base: int):
    """(key with the text's number above it, times) of the distinct id pairs of each text's groups; ``text``: each group's."""
    n_a, n_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    bits = np.uint64((base * (int(a.max()) + 1)).bit_length())
    small = np.flatnonzero(n_a * n_b <= WIDE)
    links = (n_a * n_b)[small]
    upto = np.cumsum(links)
    group = np.repeat(small, links)
    nth = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - links, links)
    left, right = a[(cut_a - n_a)[group] + nth // n_b[group]], b[(cut_b - n_b)[group] + nth % n_b[group]]
    keys, times = counted((text[group].astype(np.uint64) << bits) | ((left * base + right).astype(np.uint64)))
    wide = np.flatnonzero(n_a * n_b > WIDE)
    if len(wide):
        more = [(keys, times)]
        for g in wide:
            x, m = counted(a[cut_a[g] - n_a[g] : cut_a[g]].astype(np.uint64))
            y, n = counted(b[cut_b[g] - n_b[g] : cut_b[g]].astype(np.uint64))
            more.append((((np.uint64(text[g]) << bits) | (x[:, None] * np.uint64(base) + y)).ravel(), (m[:, None] * n).ravel()))
        keys, times = summed(*(np.concatenate(c) for c in zip(*more)))
    return keys, times, bits


LINKS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"


def _linker(base: int):
    """From rows of ``align`` to LINKS: what each document says of its groups.

    keys: distinct pairs, A's id * base + B's, in order, as 64-bit numbers; times: how often each is linked.
    """

    def run(batches):
        for batch in batches:
            raw = [batch.column(c).to_pylist() for c in ("a_ids", "b_ids", "a_cuts", "b_cuts")]
            sizes = [len(x) + len(y) for x, y in zip(raw[0], raw[1])]
            for first, last in _runs(sizes, 1 << 21):
                a, b, cut_a, cut_b = (np.frombuffer(b"".join(c[first:last]), "<u4").astype(np.int64) for c in raw)
                n_a, n_b, n = (np.array([len(x) // 4 for x in c[first:last]], np.int64) for c in raw[:3])
                sums, digests, keys, times = np.zeros(len(n), np.int64), [""] * len(n), [b""] * len(n), [b""] * len(n)
                some = np.flatnonzero(n)
                if len(some):
                    text = np.repeat(np.arange(len(some)), n[some])
                    cut_a += (np.cumsum(n_a) - n_a)[some][text]
                    cut_b += (np.cumsum(n_b) - n_b)[some][text]
                    sums[some] = np.bincount(text, np.diff(cut_a, prepend=0) * np.diff(cut_b, prepend=0)).astype(np.int64)
                    ends = np.concatenate([text[1:] != text[:-1], [True]])
                    for k, x in zip(some.tolist(), _printed(a, b, cut_a, cut_b, ends)):
                        digests[k] = hashlib.sha256(x).hexdigest()
                    found, many, bits = _linked(a, b, cut_a, cut_b, text, base)
                    upto = np.searchsorted(found >> bits, np.arange(len(some)), "right")
                    found &= (np.uint64(1) << bits) - np.uint64(1)
                    for k, x, y in zip(some.tolist(), np.split(found, upto[:-1]), np.split(many, upto[:-1])):
                        keys[k], times[k] = x.astype("<u8").tobytes(), y.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(n_a), pa.array(n_b), pa.array(n), pa.array(sums), pa.array(digests, pa.string()), pa.array(keys, pa.binary()), pa.array(times, pa.binary())], LINKS.replace(",", "").split()[::2])

    return run


def _runs(sizes: list[int], most: int):
    """(first, last) of runs with about ``most`` bytes."""
    first = total = 0
    for k, size in enumerate(sizes):
        total += size
        if total >= most:
            yield first, k + 1
            first, total = k + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


class Counts:
    """How many documents hold each pair, and whether no pair of its A id is held by more; sorted arrays in the shared folder."""

    def __init__(self, folder: str, base: int):
        self.folder, self.base = folder, base

    def open(self) -> Counts:
        self._keys = [map_array(f"{self.folder}/pair-{s}", "<u8") for s in range(SHARDS)]
        self._n = [map_counts(f"{self.folder}/n-{s}", len(k)) for s, k in enumerate(self._keys)]
        self._best = [map_array(f"{self.folder}/best-{s}", "?") for s in range(SHARDS)]
        return self

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, whether best) of pairs that have been counted."""
        asked, back = np.unique(keys, return_inverse=True)
        shard = shards(asked, self.base)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(SHARDS + 1))
        n, best = np.empty(len(asked), np.int64), np.empty(len(asked), bool)
        for s in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[s] : bounds[s + 1]]
            at = np.searchsorted(self._keys[s], asked[own])
            n[own], best[own] = self._n[s][at], self._best[s][at]
        return n[back], best[back]


def shards(keys: np.ndarray, base: int) -> np.ndarray:
    """All pairs of an A id are in one part."""
    return (mix(keys // np.uint64(base)) % np.uint64(SHARDS)).astype(np.int64)


def count_pairs(links: DataFrame, base: int) -> Counts:
    """The number of documents for every pair of ids: sums of tasks meet by pair, then each A id's pairs in one part."""
    spark = links.sparkSession
    made = Counts(new_folder(spark, "links"), base)

    def gather(batches):
        held, total = [], 0

        def flush():
            keys, n = counted(np.concatenate(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(shards(keys, base), pa.int32()), pa.array(keys.astype(np.int64)), pa.array(n, pa.int64())], ["shard", "pair", "n"])

        for batch in batches:
            raw = batch.column("keys").to_pylist()
            for first, last in _runs([len(x) for x in raw], 8 * FLUSH):
                held.append(np.frombuffer(b"".join(raw[first:last]), "<u8"))
                total += len(held[-1])
                if total >= FLUSH:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    def write(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pairs, n = pdf["pair"].to_numpy().astype(np.uint64), pdf["n"].to_numpy()
        order = np.argsort(pairs)
        pairs, n = pairs[order], n[order]
        left = pairs // np.uint64(base)
        at = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
        top = np.repeat(np.maximum.reduceat(n, at), np.diff(np.append(at, len(n))))
        write_array(f"{made.folder}/pair-{key[0]}", pairs.astype("<u8"))
        write_counts(f"{made.folder}/n-{key[0]}", n)
        write_array(f"{made.folder}/best-{key[0]}", n == top)
        return pd.DataFrame({"shard": [key[0]]})

    sums = links.select("keys").mapInArrow(gather, "shard int, pair long, n long").groupBy("shard", "pair").agg(F.sum("n").alias("n"))
    with freed_shuffles(spark):
        found = {r.shard for r in sums.groupBy("shard").applyInPandas(write, "shard int").collect()}
    for s in set(range(SHARDS)) - found:
        for name, kind in (("pair", "<u8"), ("n", "<u4"), ("best", "?")):
            write_array(f"{made.folder}/{name}-{s}", np.empty(0, kind))
    return made


def alignment(docs: DataFrame, byte_level: str, of_pieces: str) -> DataFrame:
    """What ``align`` gives as counts for each document, with how widely the whole corpus holds its links.

    Documents without tokens have zeros and an empty digest; see ``align`` for other cases. Documents' distinct links are
    written once in the shared folder: they are counted from there, and looked up in the counts.
    """
    import sentencepiece

    base = sentencepiece.SentencePieceProcessor(model_file=of_pieces).get_piece_size()
    texts, made = _table(docs, byte_level, of_pieces)
    align_, link = _aligner(made), _linker(base)
    links = materialise(texts.mapInArrow(lambda batches: link(align_(batches)), LINKS), "links")
    made = count_pairs(links, base)
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def run(batches):
        table = made.open()
        for batch in batches:
            keys, times = batch.column("keys").to_pylist(), batch.column("times").to_pylist()
            best, sums = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for first, last in _runs([len(x) for x in keys], 1 << 23):
                k = np.frombuffer(b"".join(keys[first:last]), "<u8")
                if len(k):
                    n, top = table.find(k)
                    t = np.frombuffer(b"".join(times[first:last]), "<u4").astype(np.int64)
                    upto = np.concatenate([[0], np.cumsum([len(x) // 8 for x in keys[first:last]])])
                    for out, v in ((best, t * top), (sums, t * n)):
                        whole = np.concatenate([[0], np.cumsum(v)])
                        out[first:last] = whole[upto[1:]] - whole[upto[:-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(best), pa.array(sums), batch.column("groups_sha256")], kinds.replace(",", "").split()[::2])

    return links.mapInArrow(run, kinds)
