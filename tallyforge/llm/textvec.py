"""Word hashes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space: space and the controls 9 to 13.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Everything but ASCII letters, digits and bytes of non-ASCII characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False

_Q = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes hashed at a time: what is held beside the bytes themselves does not grow with a text.
BLOCK = 1 << 18


def _powers(factor: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a factor and of its inverse modulo 2**64, BLOCK of each."""
    out = []
    for base in (factor, np.uint64(pow(int(factor), -1, 1 << 64))):
        steps = np.full(BLOCK, base)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return tuple(out)


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: int = 1) -> list[np.ndarray]:
    """One or two 64-bit hashes, of different factors, of each span of bytes; spans follow one another.

    Spans are hashed in runs of at most BLOCK bytes, and a longer span by itself, BLOCK after BLOCK.
    """
    while len(_tables) < hashes:
        _tables.append(_powers((_P, _Q)[len(_tables)]))
    out = [np.empty(len(starts), np.uint64) for _ in range(hashes)]
    first = 0
    while first < len(starts):
        begin = int(starts[first])
        last = int(np.searchsorted(ends, begin + BLOCK, "right"))
        if last <= first:  # longer than a block
            for k, (powers, _) in enumerate(_tables[:hashes]):
                out[k][first] = _long_span(data[begin : int(ends[first])], powers, (_P, _Q)[k])
            first += 1
            continue
        own = slice(first, last)
        plain = np.zeros(int(ends[last - 1]) - begin + 1, np.uint64)
        plain[:-1] = data[begin : begin + len(plain) - 1]
        plain[:-1] += np.uint64(1)
        at = starts[own] - begin
        edges = np.stack([at, ends[own] - begin], axis=1).ravel()
        for k, (powers, inverse) in enumerate(_tables[:hashes]):
            terms = plain.copy() if k + 1 < hashes else plain
            terms[:-1] *= powers[: len(plain) - 1]
            out[k][own] = mix(np.add.reduceat(terms, edges)[::2] * inverse[at])
        first = last
    return out


def _long_span(data: np.ndarray, powers: np.ndarray, factor: np.uint64) -> np.uint64:
    total = 0
    for a in range(0, len(data), BLOCK):
        part = data[a : a + BLOCK].astype(np.uint64) + np.uint64(1)
        total += int((part * powers[: len(part)]).sum()) * pow(int(factor), a, 1 << 64)
    return mix(np.array([total & ((1 << 64) - 1)], np.uint64))[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str], gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): a 64-bit hash of each word, text after text, and each text's number of words.

    Words are the longest runs of UTF-8 bytes outside ``gaps``, with A to Z in lower case. Whole texts are hashed.
    """
    data = np.frombuffer("\n".join([*texts, ""]).encode("utf-8", "surrogatepass"), np.uint8)
    lens = np.fromiter((len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
    ends = np.cumsum(lens + 1)
    inside = ~gaps[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, stops = edge[::2], edge[1::2]  # the data end in a gap, so edges come in pairs
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.searchsorted(starts, ends)
    return span_hashes(_LOWER[data], starts, stops)[0], np.diff(at, prepend=0)
