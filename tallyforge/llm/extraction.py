"""Main text of HTML pages by a recurrent block labeller: a bidirectional LSTM over a page's leaf blocks, in numpy.

A block is read as the sum of vectors of its path's names, the mean of vectors of its hashed words, and a few measures.
States of both directions, each of which has read the whole page on its side, give the probability that the block is
the article's. There are no labels: the network is fitted on texts of a bounded sample of the pages, set in made-up
layouts (``layouts``), and on those pages' own blocks where an article or main element tells what they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.blocks import Leaf, hashed, leaves, name_words
from tallyforge.llm.layouts import PARTS, layouts
from tallyforge.llm.textvec import NOT_ALNUM, word_hashes

#: Buckets of names and of words.
PATHS, WORDS = 2048, 4096
PATH_DIMS, WORD_DIMS, STATES = 24, 12, 24
_MEASURES = 7
_INPUT = PATH_DIMS + WORD_DIMS + _MEASURES
#: Pages that are learned from, at most about; of each, so many blocks, and so many characters of a block.
MOST_PAGES, MOST_BLOCKS, MOST_CHARS = 400, 40, 600
#: Made-up layouts, and passes over all pages.
LAYOUTS, EPOCHS = 1000, 8
_MARKS = re.compile("[.,:;!?]")
_DIGIT = re.compile("[0-9]")


class Pages:
    """Blocks of some pages as numbers: path buckets and words, each with the block they belong to, and measures."""

    def __init__(self, pages: list[list[Leaf]]):
        blocks = [leaf for page in pages for leaf in page]
        self.lens = np.array([len(p) for p in pages], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.path = np.fromiter((x for leaf in blocks for x in leaf.path), np.int64) % PATHS
        n = np.fromiter((len(leaf.path) for leaf in blocks), np.int64, len(blocks))
        self.path_of = np.repeat(np.arange(len(blocks)), n)
        hashes, words = word_hashes([leaf.text for leaf in blocks], NOT_ALNUM)
        self.word, self.word_of = (hashes % np.uint64(WORDS)).astype(np.int64), np.repeat(np.arange(len(blocks)), words)
        self.share = 1.0 / np.maximum(words, 1)
        chars = np.fromiter((len(leaf.text) for leaf in blocks), np.float64, len(blocks))
        count = lambda pattern: np.fromiter((len(pattern.findall(leaf.text)) for leaf in blocks), np.float64, len(blocks))
        linked = np.fromiter((leaf.linked for leaf in blocks), np.float64, len(blocks))
        last = np.fromiter((leaf.text[-1:] in ".!?" for leaf in blocks), np.float64, len(blocks))
        self.measures = np.stack([
            np.log1p(chars) / 8, np.log1p(words) / 6, linked / np.maximum(chars, 1), np.minimum(1, count(_MARKS) / np.maximum(words, 1)),
            np.minimum(1, count(_DIGIT) / np.maximum(chars, 1)), last, np.ones(len(blocks)),
        ], axis=1).astype(np.float32)

    def steps(self, back: bool) -> list[np.ndarray]:
        """The blocks that are read at each step, a row for each page that is as long, longest pages first."""
        order = np.argsort(-self.lens, kind="stable")
        starts, lens = self.starts[order], self.lens[order]
        upto = np.searchsorted(-lens, -np.arange(int(lens[0]) if len(lens) else 0), "left")
        return [starts[:n] + (lens[:n] - 1 - t if back else t) for t, n in enumerate(upto)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summed(rows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by the number in ``of``, which is in order."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(of):
        at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        out[of[at]] = np.add.reduceat(rows, at, axis=0)
    return out


class BlockLSTM:
    """Vectors of names and words, two LSTMs, and one output; ``p`` holds the parameters."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        wide = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {"path": r.normal(0, 0.1, (PATHS, PATH_DIMS)).astype(np.float32), "word": r.normal(0, 0.1, (WORDS, WORD_DIMS)).astype(np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": wide(_INPUT, 4 * STATES), f"h{d}": wide(STATES, 4 * STATES), f"c{d}": np.zeros(4 * STATES, np.float32)}
            self.p[f"c{d}"][STATES : 2 * STATES] = 1  # forget little at first
        self.p |= {"out": wide(2 * STATES + _INPUT, 1), "bias": np.zeros(1, np.float32)}

    def inputs(self, pages: Pages) -> np.ndarray:
        n = len(pages.measures)
        path = _summed(self.p["path"][pages.path], pages.path_of, n)
        word = _summed(self.p["word"][pages.word], pages.word_of, n) * pages.share[:, None].astype(np.float32)
        return np.concatenate([path, word, pages.measures], axis=1)

    def _scan(self, d: str, x: np.ndarray, steps: list[np.ndarray], kept: list | None) -> np.ndarray:
        """States of all blocks in one direction; ``kept`` takes what the slopes need."""
        wx, wh, c0, n = self.p[f"x{d}"], self.p[f"h{d}"], self.p[f"c{d}"], STATES
        out = np.zeros((len(x), n), x.dtype)
        h = c = np.zeros((len(steps[0]) if steps else 0, n), x.dtype)
        for rows in steps:
            h, c = h[: len(rows)], c[: len(rows)]
            z = x[rows] @ wx + h @ wh + c0
            gates, fresh = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            before, old = h, c
            c = f * old + i * fresh
            bent = np.tanh(c)
            h = o * bent
            out[rows] = h
            if kept is not None:
                kept.append((rows, before, old, i, f, o, fresh, bent))
        return out

    def probabilities(self, pages: Pages) -> np.ndarray:
        x = self.inputs(pages)
        states = [self._scan(d, x, pages.steps(d == "b"), None) for d in "fb"]
        return _sigmoid(np.concatenate([*states, x], axis=1) @ self.p["out"] + self.p["bias"])[:, 0]

    def slopes(self, pages: Pages, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean cross entropy of the blocks, and its slope for every parameter, back through all steps."""
        x = self.inputs(pages)
        kept = {d: [] for d in "fb"}
        full = np.concatenate([*(self._scan(d, x, pages.steps(d == "b"), kept[d]) for d in "fb"), x], axis=1)
        y = _sigmoid(full @ self.p["out"] + self.p["bias"])[:, 0]
        loss = -np.mean(np.where(labels > 0, np.log(y + 1e-7), np.log(1 - y + 1e-7)))
        top = ((y - labels) / len(y)).astype(x.dtype)[:, None]
        g = {"out": full.T @ top, "bias": top.sum(axis=0)}
        down = top @ self.p["out"].T
        dx = down[:, 2 * STATES :].copy()
        for k, d in enumerate("fb"):
            wx, wh, n = self.p[f"x{d}"], self.p[f"h{d}"], STATES
            gx, gh, gc = np.zeros_like(wx), np.zeros_like(wh), np.zeros_like(self.p[f"c{d}"])
            dh = dc = np.zeros((0, n), x.dtype)
            for rows, before, old, i, f, o, fresh, bent in reversed(kept[d]):
                more = np.zeros((len(rows) - len(dh), n), x.dtype)
                dh = np.concatenate([dh, more]) + down[rows, k * n : (k + 1) * n]
                dc = np.concatenate([dc, more]) + dh * o * (1 - bent**2)
                dz = np.concatenate([dc * fresh * i * (1 - i), dc * old * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - fresh**2)], axis=1)
                gx += x[rows].T @ dz
                gh += before.T @ dz
                gc += dz.sum(axis=0)
                dx[rows] += dz @ wx.T
                dh, dc = dz @ wh.T, dc * f
            g |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
        g["path"], g["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
        np.add.at(g["path"], pages.path, dx[pages.path_of, :PATH_DIMS])
        np.add.at(g["word"], pages.word, (dx[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] * pages.share[:, None].astype(x.dtype))[pages.word_of])
        return float(loss), g

    def fit(self, pages: list[tuple[list[Leaf], list[int]]], epochs: int = EPOCHS, batch: int = 24, rate: float = 4e-3, seed: int = 9) -> list[float]:
        """Adam; pages come in a new order in each pass, and each time a tenth of the names and all words of most
        blocks are hidden: texts that stand in an article here may stand in an advert there."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        losses, t = [], 0
        total = epochs * -(-len(pages) // batch)
        for _ in range(epochs):
            order, sums = r.permutation(len(pages)), []
            for at in range(0, len(order), batch):
                own = [pages[k] for k in order[at : at + batch]]
                held = Pages([p for p, _ in own])
                keep = r.random(len(held.path)) > 0.1
                held.path, held.path_of = held.path[keep], held.path_of[keep]
                keep = (r.random(len(held.measures)) > 0.6)[held.word_of]
                held.word, held.word_of = held.word[keep], held.word_of[keep]
                loss, g = self.slopes(held, np.array([x for _, labels in own for x in labels], np.float32))
                sums.append(loss)
                t += 1
                size = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
                step = rate * min(1.0, 1.3 * (1 - t / total) + 0.02)
                for k, x in g.items():
                    x = x * min(1.0, 2.0 / (size + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            losses.append(float(np.mean(sums)))
        return losses


def _held(names) -> frozenset[int]:
    return frozenset(hashed(n, k) for n in names for k in (True, False))


_INSIDE = _held(("<article>", "<main>"))
_NEVER = _held([*(f"<{t}>" for t in ("nav", "aside", "footer", "header", "form", "button", "select", "dialog"))])
_NAMES = _held({w for k in ("ad", "comments", "share", "notice", "side", "form") for x in PARTS[k] for w in name_words(x)})


def told(page: list[Leaf]) -> list[int] | None:
    """Labels that a page's own elements tell; None where it has no article or main element."""
    inside = [bool(_INSIDE.intersection(leaf.path)) for leaf in page]
    if not any(inside):
        return None
    return [int(x and not _NEVER.intersection(leaf.path) and not _NAMES.intersection(leaf.path)) for x, leaf in zip(inside, page)]


def _shown(html: str) -> list[Leaf]:
    return [Leaf(leaf.text[:MOST_CHARS], leaf.path, min(leaf.linked, MOST_CHARS)) for leaf in leaves(html)]


def train(pages: DataFrame) -> BlockLSTM:
    """A network fitted on layouts of texts from about MOST_PAGES different pages, drawn by a hash of url and html.

    Of a drawn page come MOST_BLOCKS blocks, spread evenly, cut at MOST_CHARS characters; these bounds are the fit's
    alone. Equal pages teach once. Without pages, or without any that tells what its article is, layouts hold invented
    words; so a network is fitted in any case.
    """
    rows = pages.where(F.col("html").isNotNull()).select("url", "html")
    total = rows.agg(F.approx_count_distinct(F.xxhash64("url", "html")).alias("n")).first().n
    share = min(1_000_000, int(1e6 * MOST_PAGES / max(total, 1)) + 1)

    def run(batches):
        for batch in batches:
            found = [p for p in map(_shown, batch.column("html").to_pylist()) if p]
            held = [[p[k] for k in np.unique(np.linspace(0, len(p) - 1, min(len(p), MOST_BLOCKS)).astype(int))] for p in found]
            columns = [[[leaf[k] for leaf in p] for p in held] for k in range(3)]
            kinds = (pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["text", "path", "linked"])

    drawn = rows.where(F.pmod(F.xxhash64("url", "html"), F.lit(1_000_000)) < share)
    got = sorted({(tuple(r.text), tuple(map(tuple, r.path)), tuple(r.linked)) for r in drawn.mapInArrow(run, "text array<string>, path array<array<long>>, linked array<int>").collect()})
    own = [([Leaf(*x) for x in zip(*page)], None) for page in got]
    own = [(page, labels) for page, _ in own if (labels := told(page))]
    texts = {y: sorted({leaf.text for page, labels in own for leaf, x in zip(page, labels) if x == y}) for y in (0, 1)}
    made = [([Leaf(leaf.text[:MOST_CHARS], leaf.path, leaf.linked) for leaf in leaves(html)], labels) for html, labels in layouts(LAYOUTS, texts[1], texts[0])]
    net = BlockLSTM()
    net.fit([*made, *own, *own])
    return net


def label(pages: DataFrame, net: BlockLSTM, blocks: str = "blocks") -> DataFrame:
    """``pages`` with a column ``blocks`` of (text, probability) structs, one for each leaf block in page order.

    A null or empty page, or one without text, has none. Null and repeated ids and extra columns stay. A page's blocks are
    read together, however many they are.
    """
    sent = pages.sparkSession.sparkContext.broadcast(net)
    schema = ", ".join(f"`{n}` {t}" for n, t in pages.dtypes) + f", `{blocks}` array<struct<text:string,probability:double>>"
    place = pages.columns.index("html")
    kind = pa.list_(pa.struct([("text", pa.string()), ("probability", pa.float64())]))

    def run(batches):
        net = sent.value
        for batch in batches:
            out: list[list] = []
            for a in range(0, batch.num_rows, 256):
                found = [leaves(h) for h in batch.column(place).slice(a, 256).to_pylist()]
                some = [p for p in found if p]
                sure = net.probabilities(Pages(some)).tolist() if some else []
                at = 0
                for p in found:
                    out.append([{"text": leaf.text, "probability": sure[at + k]} for k, leaf in enumerate(p)])
                    at += len(p)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, blocks])

    return pages.mapInArrow(run, schema)


def extract(pages: DataFrame, sure: float = 0.5) -> DataFrame:
    """(page_id, url, text, n_chars): the blocks of every page whose probability is ``sure`` or more, joined by line feeds.

    The text is empty where no block is; an empty table gives no rows. See ``label`` and ``train`` for other cases.
    """
    kept = F.filter("blocks", lambda b: b["probability"] >= sure)
    out = label(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), train(pages))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
