"""Whole texts as token ids, each distinct piece of the corpus encoded once by the ``tokenizers`` library.

A text is cut before every run of white space that follows other characters, and between an ASCII letter and a point,
comma, colon, semicolon, exclamation or question mark; the tokenizers used here always cut there themselves, so the
ids of the pieces, put together, are the ids of the text. A Spark job gathers the distinct pieces by
hash, encodes them, and writes sorted hash arrays with their ids; workers map those and look texts up in numpy.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import freed_shuffles, in_slices, new_folder, shard_bits
from tallyforge.llm.sharedfiles import map_array, write_array
from tallyforge.llm.textvec import span_hashes

#: Bytes of pieces and of their hashes that a task gathers before it drops repeated ones.
FLUSH = 32 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,:;!?"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _inside(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 are not white space, as Unicode has it."""
    inside = ~_SPACE[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(lead):
        after = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = data[lead], after[lead + 1], after[lead + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = (
            ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
            | ((a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
        )
        for at, n in ((lead[two], 2), (lead[three], 3)):
            for k in range(n):
                inside[at + k] = False
    return inside


def pieces(texts: list[str], spaces: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, counts): where pieces lie in the texts' bytes, and each text's number of pieces.

    With ``spaces`` the pieces cover the text, each with the white space before it, and white space at the end is one
    more; without, white space is left out, and A to Z are in lower case, as the vocabulary's are.
    """
    data = np.frombuffer("\n".join([*texts, ""]).encode("utf-8", "surrogatepass"), np.uint8)
    lens = np.fromiter((len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
    stops = np.cumsum(lens + 1) - 1  # of each text; a line feed follows
    inside = _inside(data)
    inside[stops] = False
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    marks = np.flatnonzero(_MARK[data])
    marks = marks[marks > 0]
    marks = marks[_LETTER[data[marks - 1]]]
    if len(marks):  # a piece ends before the mark, and the next begins with it
        starts, ends = np.sort(np.concatenate([starts, marks])), np.sort(np.concatenate([ends, marks]))
    counts = np.diff(np.searchsorted(starts, stops), prepend=0)
    if not spaces:  # such vocabularies are of lower case
        return _LOWER[data], starts, ends, counts
    begins = stops - lens
    upto = np.cumsum(counts)
    last = np.where(counts > 0, ends[np.maximum(upto - 1, 0)] if len(ends) else 0, begins)  # after each text's last word
    tail = last < stops
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.flatnonzero(counts > 0)
    if len(first):
        starts[upto[first] - counts[first]] = begins[first]
    where = upto[tail]
    return data, np.insert(starts, where, last[tail]), np.insert(ends, where, stops[tail]), counts + tail


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist())]


#: Pieces of ASCII letters, after one space at most: the pre-tokenizers leave these whole.
_PLAIN = re.compile("( ?)([A-Za-z]+)")
#: How byte-level vocabularies write a space.
_BLANK = "\u0120"


def ids_of(library, texts: list[str], spaces: bool) -> list[list[int]]:
    """The ids of each piece; plain ones go to the library's model at once, without its other steps."""
    tokenize, out, rest = library.model.tokenize, [None] * len(texts), []
    for k, text in enumerate(texts):
        plain = _PLAIN.fullmatch(text)
        if plain:
            word = _BLANK * len(plain[1]) + plain[2] if spaces else plain[2].lower()
            out[k] = [t.id for t in tokenize(word)]
        else:
            rest.append(k)
    for k, e in zip(rest, library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
        out[k] = e.ids
    return out


class Encoder:
    """Encodes texts by the written tables; opened by each worker once."""

    def __init__(self, folder: str, tokenizer: str, spaces: bool, shards: int):
        self.folder, self.tokenizer, self.spaces, self.shards = folder, tokenizer, spaces, shards

    def library(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.tokenizer)

    def ids(self, library, texts: list[str]) -> list[list[int]]:
        """What the table holds for each piece."""
        return ids_of(library, texts, self.spaces)

    def open(self) -> Encoder:
        """This encoder with its tables mapped; the same for every task of a worker."""
        if self.folder not in _open:
            _open.clear()
            _open[self.folder] = self
            self._own = None
            self._hash, self._end, self._ids = ([map_array(f"{self.folder}/{n}-{s}", k) for s in range(self.shards)] for n, k in (("hash", "<u8"), ("end", "<u4"), ("ids", "<u4")))
        return _open[self.folder]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and each text's number of ids."""
        data, starts, ends, counts = pieces(texts, self.spaces)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        names, back = np.unique(span_hashes(data, starts, ends)[0], return_inverse=True)
        ids, lens, odd = self._lookup(names)
        at = np.cumsum(lens) - lens
        lens = lens[back]
        upto = np.concatenate([[0], np.cumsum(lens)])
        out = ids[np.repeat(at[back] - upto[:-1], lens) + np.arange(upto[-1])]
        sizes = np.add.reduceat(np.append(lens, 0), np.minimum(np.cumsum(counts) - counts, len(lens))) * (counts > 0)
        if odd.any():
            return self._with_odd(data, starts, ends, counts, out, lens, odd[back])
        return out, sizes

    def _lookup(self, names: np.ndarray):
        """(ids, numbers of ids, which must be encoded where they occur) of distinct hashes in order."""
        bits = self.shards.bit_length() - 1
        cut = np.searchsorted(names >> np.uint64(64 - bits), np.arange(1, self.shards), "left") if bits else []
        cut = np.concatenate([[0], cut, [len(names)]]).astype(np.int64)
        lens, odd, ids = np.zeros(len(names), np.int64), np.ones(len(names), bool), []
        for s in range(self.shards):
            a, b = cut[s], cut[s + 1]
            held = self._hash[s]
            if a == b or not len(held):
                continue
            at = np.minimum(np.searchsorted(held, names[a:b]), len(held) - 1)
            end = self._end[s][at].astype(np.int64)
            begin = np.where(at > 0, self._end[s][at - 1], 0).astype(np.int64)
            shared = end == begin  # no piece is without ids but those that are left for later
            known = (held[at] == names[a:b]) & ~shared
            odd[a:b] = ~known
            n = np.where(known, end - begin, 0)
            lens[a:b] = n
            upto = np.cumsum(n)
            ids.append(self._ids[s][np.repeat(begin - (upto - n), n) + np.arange(upto[-1])])
        return np.concatenate(ids) if ids else np.empty(0, np.uint32), lens, odd

    def _with_odd(self, data, starts, ends, counts, ids, lens, odd):
        """Encodes the pieces that the tables leave open, and puts all in order."""
        self._own = self._own or self.library()
        which = np.flatnonzero(odd)
        got = [np.array(e.ids, np.uint32) for e in self._own.encode_batch_fast(_texts(data, starts[which], ends[which]), add_special_tokens=False)]
        parts = np.split(ids, np.cumsum(lens)[:-1])
        for k, g in zip(which, got):
            parts[k] = g
        lens = np.array([len(p) for p in parts])
        bounds = np.concatenate([[0], np.cumsum(lens)])
        last = np.cumsum(counts)
        return np.concatenate(parts), bounds[last] - bounds[last - counts]


_open: dict[str, Encoder] = {}


def encoder(docs: DataFrame, tokenizer: str, spaces: bool, kind: type[Encoder] = Encoder) -> Encoder:
    """Tables of every distinct piece of the texts of ``docs``, written in the shared folder.

    ``tokenizer``: a file of the ``tokenizers`` library. ``spaces``: whether white space yields ids (byte-level
    vocabularies) or is dropped. ``kind``: a class that holds something else for each piece. Hashes that two different pieces share are noticed when pieces meet; such pieces, and
    pieces without ids, are encoded where they occur.
    """
    spark = docs.sparkSession
    bits = shard_bits(docs)
    made = kind(new_folder(spark, "pieces"), tokenizer, spaces, 1 << bits)

    def gather(batches):
        held: list[tuple] = []
        total = 0

        def flush():
            h, check, size = (np.concatenate([x[k] for x in held]) for k in range(3))
            raw, place = b"".join(x[3] for x in held), np.cumsum(size) - size
            held.clear()
            order = np.lexsort((check, h))
            keep = order[np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(check[order]) != 0)])]
            h, size, place = h[keep], size[keep], place[keep]
            shard = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            cut = np.searchsorted(shard, np.arange((1 << bits) + 1))
            data = np.frombuffer(raw, np.uint8)
            rows = {"shard": [], "hashes": [], "sizes": [], "text": []}
            for s in np.flatnonzero(np.diff(cut)):
                a, b = cut[s], cut[s + 1]
                n = size[a:b]
                ends = np.cumsum(n)
                rows["shard"].append(s)
                rows["hashes"].append(h[a:b].tobytes())
                rows["sizes"].append(n.astype("<u4").tobytes())
                rows["text"].append(data[np.repeat(place[a:b] - (ends - n), n) + np.arange(ends[-1])].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int32()), *(pa.array(rows[k], pa.binary()) for k in ("hashes", "sizes", "text"))], list(rows))

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in in_slices(texts):
                data, starts, ends, _ = pieces(texts[a:b], spaces)
                if not len(starts):
                    continue
                h, check = span_hashes(data, starts, ends, 2)
                order = np.argsort(h)
                hs, cs = h[order], check[order]
                first = order[np.concatenate([[True], (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])])]
                n = ends[first] - starts[first]
                upto = np.cumsum(n)
                held.append((h[first], check[first], n, data[np.repeat(starts[first] - (upto - n), n) + np.arange(upto[-1])].tobytes()))
                total += 24 * len(first) + int(upto[-1])
                if total >= FLUSH:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    def learn(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, "<u8") for x in pdf["hashes"]])
        n = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["sizes"]]).astype(np.int64)
        data = np.frombuffer(b"".join(pdf["text"]), np.uint8)
        starts = np.cumsum(n) - n
        check = span_hashes(data, starts, starts + n, 2)[1] if len(n) else h
        order = np.lexsort((check, h))
        h, check, starts, n = h[order], check[order], starts[order], n[order]
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
        h, starts, n = h[keep], starts[keep], n[keep]
        one = np.concatenate([[True], h[1:] != h[:-1]])
        shared = np.add.reduceat(np.ones(len(h), np.int64), np.flatnonzero(one)) > 1
        h, starts, n = h[one], starts[one], n[one]
        library = made.library()
        lens, ids = np.zeros(len(h), np.int64), []
        for a in range(0, len(h), 50_000):
            own = slice(a, a + 50_000)
            got = made.ids(library, _texts(data, starts[own], starts[own] + n[own]))
            got = [[] if x else g for x, g in zip(shared[own], got)]
            lens[own] = [len(g) for g in got]
            ids.append(np.fromiter((i for g in got for i in g), np.uint32, int(lens[own].sum())))
        for name, values in (("hash", h.astype("<u8")), ("end", np.cumsum(lens).astype("<u4")), ("ids", np.concatenate(ids).astype("<u4"))):
            write_array(f"{made.folder}/{name}-{key[0]}", values)
        return pd.DataFrame({"shard": [key[0]], "n": [len(h)]})

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.mapInArrow(gather, "shard int, hashes binary, sizes binary, text binary")
    with freed_shuffles(spark):
        found = {r.shard for r in rows.groupBy("shard").applyInPandas(learn, "shard int, n long").collect()}
    for s in set(range(1 << bits)) - found:
        for name, kind in (("hash", "<u8"), ("end", "<u4"), ("ids", "<u4")):
            write_array(f"{made.folder}/{name}-{s}", np.empty(0, kind))
    return made
