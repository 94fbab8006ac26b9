"""Language ID by a byte convolutional network: multi-width filters, max pooling and softmax, in numpy.

A text's bytes, with A to Z in lower case, are cut into consecutive windows of fixed length. Each window gives class
probabilities; a text's are the mean over all its windows, weighted by their bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import drawn, fold

WINDOW = 192
WIDTHS, FILTERS, EMBED = (2, 3, 4), 16, 8
#: Texts of each language that the network is fitted on, texts of all languages, and windows of each text, at most.
MOST_TEXTS, MOST_ALL, MOST_WINDOWS = 1200, 60_000, 4
UND = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all windows, text of each, bytes of text in each); the last window of a text is filled with zeros."""
    data = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    lens = np.array([len(d) for d in data], np.int64)
    n = np.maximum(1, -(-lens // WINDOW))
    out = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    for at, d in zip((np.cumsum(n) - n) * WINDOW, data):
        out[at : at + len(d)] = d
    row = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    return _LOWER[out].reshape(-1, WINDOW), row, np.minimum(WINDOW, lens[row] - nth * WINDOW).clip(min=1)


class ByteCNN:
    """One layer of filters over byte embeddings. Filters of all widths share a kernel of the largest, zero beyond."""

    def __init__(self, classes: int, seed: int = 7):
        r = np.random.default_rng(seed)
        widest, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.mask = np.zeros((widest, 1, n), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "kernel": (r.normal(0, 0.3, (widest, EMBED, n)) * self.mask).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": r.normal(0, 0.2, (n, classes)).astype(np.float32), "out_bias": np.zeros(classes, np.float32),
        }

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """Embeddings of every run of bytes as long as the widest filter, a row each."""
        e = self.p["embed"][x]
        n = x.shape[1] - len(self.mask) + 1
        return np.concatenate([e[:, j : j + n] for j in range(len(self.mask))], axis=2)

    def forward(self, x: np.ndarray):
        cols = self._columns(x)
        z = cols.reshape(-1, cols.shape[2]) @ self.p["kernel"].reshape(cols.shape[2], -1)
        z = z.reshape(len(x), cols.shape[1], -1)
        return cols, z, z.max(axis=1) + self.p["bias"]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(0, self.forward(x)[2]) @ self.p["out"] + self.p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 3e-3, seed: int = 11) -> None:
        """Adam on the cross entropy; the order of windows is drawn anew in each epoch."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                t += 1
                for k, g in self._slopes(x[rows], y[rows]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def _slopes(self, x, y):
        cols, z, top = self.forward(x)
        pooled = np.maximum(0, top)
        s = pooled @ self.p["out"] + self.p["out_bias"]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        s[np.arange(len(y)), y] -= 1
        s /= len(y)
        g = {"out": pooled.T @ s, "out_bias": s.sum(axis=0)}
        d = (s @ self.p["out"].T) * (top > 0)
        g["bias"] = d.sum(axis=0)
        best = z.argmax(axis=1)  # only the pooled place of each filter has a slope
        chosen = cols[np.arange(len(x))[:, None], best]  # window, filter, embeddings of the run
        widest, embed = self.mask.shape[0], EMBED
        g["kernel"] = np.einsum("nf,nfc->cf", d, chosen).reshape(widest, embed, -1) * self.mask
        back = np.einsum("nf,cf->nfc", d, self.p["kernel"].reshape(widest * embed, -1)).reshape(len(x), -1, widest, embed)
        g["embed"] = np.zeros_like(self.p["embed"])
        for j in range(widest):
            np.add.at(g["embed"], x[np.arange(len(x))[:, None], best + j], back[:, :, j])
        return g


def train(docs: DataFrame, allowed) -> tuple[list[str], ByteCNN | None]:
    """(languages, network) from rows that ``allowed`` admits, whose lang is not null and whose text has a letter.

    Up to about MOST_TEXTS texts of each language (fewer, where MOST_ALL is less than that), drawn by a hash of doc_id and
    text, and MOST_WINDOWS windows of each, spread evenly over the text. Windows are cut where the rows are; equal ones
    of one language teach once, so that repeated rows, with or without an id, don't swell what comes to the driver.
    Without such rows, and for an empty table, there is no network; with one language it is always that.
    """
    rows = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id"), "text", "lang")
    langs = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("n")).collect()}
    if not langs:
        return [], None
    total = F.element_at(F.create_map(*(F.lit(x) for item in sorted(langs.items()) for x in item)), F.col("lang"))

    def run(batches):
        for batch in batches:
            got = [(lang, t) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()) if has_letter(t)]
            if got:
                x, row, _ = windows([t for _, t in got])
                n = np.bincount(row)
                nth = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                keep = np.flatnonzero((nth * MOST_WINDOWS) // n[row] != ((nth - 1) * MOST_WINDOWS) // n[row])
                yield pa.RecordBatch.from_pydict({"lang": [got[k][0] for k in row[keep]], "window": pa.array([x[k].tobytes() for k in keep], pa.binary())})

    most = min(MOST_TEXTS, MOST_ALL // len(langs) + 1)
    got = sorted(tuple(r) for r in rows.where(drawn(total, most)).mapInArrow(run, "lang string, window binary").distinct().collect())
    names = sorted({lang for lang, _ in got})
    if not names:
        return [], None
    net = ByteCNN(len(names))
    net.fit(np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(-1, WINDOW), np.array([names.index(lang) for lang, _ in got]))
    return names, net


def predict(docs: DataFrame, names: list[str], net: ByteCNN | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with a column each for the language and its score; whole texts are read.

    ``und`` with score 0 for a text that is null or has no letter, and for all where nothing was learned. Null and
    repeated ids keep their rows.
    """
    if net is None:
        return docs.withColumns({lang: F.lit(UND), score: F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast(net)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{lang}` string, `{score}` double"
    place = docs.columns.index("text")

    def run(batches):
        net = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            found, sure = [UND] * len(texts), np.zeros(len(texts))
            real = [k for k, t in enumerate(texts) if has_letter(t)]
            for a in range(0, len(real), 256):
                ks = real[a : a + 256]
                x, row, size = windows([texts[k] for k in ks])
                p = np.concatenate([net.probabilities(x[i : i + 128]) for i in range(0, len(x), 128)])
                total = np.stack([np.bincount(row, p[:, c] * size, len(ks)) for c in range(p.shape[1])], axis=1)
                total /= total.sum(axis=1, keepdims=True)
                for k, c, s in zip(ks, total.argmax(axis=1), total.max(axis=1)):
                    found[k], sure[k] = names[c], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(sure)], [*batch.schema.names, lang, score])

    return docs.mapInArrow(run, schema)


def language(docs: DataFrame) -> DataFrame:
    """Predictions for all documents by a network of the rows whose crc32(doc_id) modulo 3 is not 1."""
    names, net = train(docs, fold("doc_id", 3) != 1)
    return predict(docs.select(F.col("doc_id").cast("long"), "text"), names, net).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score"
    )
