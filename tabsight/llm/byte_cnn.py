"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes run over the text at every second byte. Their outputs are
max-pooled over chunks of two blocks of ``BLOCK`` bytes, each chunk sharing a block with the next,
so that the chunks overlap and cover the whole document. A rectified linear layer gives each
chunk a logit; their mean over all chunks of the document becomes one probability. Filters, biases
and output weights are trained together by back-propagation (Adam) on a bounded, balanced sample
of labelled rows: at most ``per_class`` documents of each label, ``TRAIN_CHARS`` characters from
a place in each that its id decides. Scoring reads every byte of every text, in pieces of
``PIECE`` bytes, so memory does not grow with the text.

Defined results: a null or empty text is scored as one block of zero bytes. Without labelled
rows, or with one label only, every score is that label's share (0.5 without any). Rows that
repeat are scored alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabsight.llm.common import give_back, ship

WIDTH, FILTERS, BLOCK, PIECE = 8, 16, 128, 1 << 19
TRAIN_CHARS, PER_CLASS, EPOCHS, SEED = 2000, 1500, 14, 7
KEEP_FROM = 0.7


@dataclass
class ByteCNN:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # FILTERS
    shift: float
    constant: float | None = None
    _pairs: list[np.ndarray] = field(default_factory=list, repr=False)

    def pairs(self) -> list[np.ndarray]:
        """For each pair of places in a filter, its output by the two bytes there."""
        if not self._pairs:
            for j in range(0, WIDTH, 2):  # little-endian: the first byte is the low one
                both = self.filters[j + 1][:, None, :] + self.filters[j][None, :, :]
                self._pairs.append(np.ascontiguousarray(both.reshape(65536, -1), dtype=np.float32))
        return self._pairs

    def block_peaks(self, raw: bytes) -> np.ndarray:
        """The largest output of each filter in each block."""
        found = []
        for at in range(0, max(1, len(raw)), PIECE):
            piece = raw[at:at + PIECE + WIDTH - 2]
            own = min(len(raw) - at, PIECE) if raw else 0
            steps = max(1, -(-own // 2))
            codes = np.frombuffer(piece.ljust(2 * steps + WIDTH - 2, b"\0")[:2 * steps + WIDTH - 2], "<u2")
            total = self.pairs()[0][codes[:steps]]
            for j, table in enumerate(self.pairs()[1:], 1):
                total += table[codes[j:j + steps]]
            found.append(np.maximum.reduceat(total, np.arange(0, steps, BLOCK // 2), axis=0))
        return np.concatenate(found)

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        peaks = self.block_peaks((text or "").encode())
        if len(peaks) > 1:
            peaks = np.maximum(peaks[:-1], peaks[1:])
        logits = np.maximum(peaks + self.bias, 0) @ self.out + self.shift
        return float(1 / (1 + np.exp(-np.clip(logits.mean(), -60, 60))))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> ByteCNN:
    """Fit the network on texts (parts of documents) and labels 0 or 1."""
    rng = np.random.default_rng(seed)
    model = ByteCNN(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                    rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    half = BLOCK // 2
    documents = []  # per document: blocks x half x WIDTH bytes
    for text in texts:
        raw = text.encode()
        n = max(1, -(-len(raw) // BLOCK))
        padded = np.frombuffer(raw.ljust(n * BLOCK + WIDTH, b"\0"), np.uint8)
        windows = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[::2][:n * half]
        documents.append(windows.reshape(n, half, WIDTH))
    weights = [model.filters, model.bias, model.out, np.zeros(1, np.float32)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(y), 64):
            chosen = order[start:start + 64]
            blocks = np.concatenate([documents[i] for i in chosen])
            counts = np.array([len(documents[i]) for i in chosen])
            grads = _gradients(weights, blocks, counts, y[chosen])
            step += 1
            for k, (w, g) in enumerate(zip(weights, grads, strict=True)):
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    model.filters, model.bias, model.out, model.shift = *weights[:3], float(weights[3][0])
    return model


def _gradients(weights: list[np.ndarray], blocks: np.ndarray, counts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    filters, bias, out, shift = weights
    total = filters[0][blocks[:, :, 0]]
    for j in range(1, WIDTH):
        total += filters[j][blocks[:, :, j]]
    at = total.argmax(axis=1)  # blocks x filters
    peaks = np.take_along_axis(total, at[:, None, :], axis=1)[:, 0]
    # chunk i of a document: its blocks i and i + 1; a document of one block has one chunk
    firsts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    left = np.concatenate([f + np.arange(max(1, c - 1)) for f, c in zip(firsts, counts, strict=True)])
    right = np.concatenate([f + np.minimum(np.arange(max(1, c - 1)) + 1, c - 1) for f, c in zip(firsts, counts, strict=True)])
    owner = np.repeat(np.arange(len(counts)), np.maximum(1, counts - 1))
    taken = np.where(peaks[left] >= peaks[right], left[:, None], right[:, None])
    pooled = np.maximum(peaks[left], peaks[right]) + bias
    hidden = np.maximum(pooled, 0)
    sizes = np.bincount(owner)
    logits = np.bincount(owner, hidden @ out + shift[0]) / sizes
    slope = (1 / (1 + np.exp(-np.clip(logits, -60, 60))) - y) / len(y)
    per_chunk = (slope / sizes)[owner].astype(np.float32)
    g_out = per_chunk @ hidden
    g_hidden = per_chunk[:, None] * out[None, :] * (pooled > 0)
    where = at[taken, np.arange(FILTERS)[None, :]]
    g_filters = np.empty_like(filters)
    column = np.arange(FILTERS)[None, :]
    for j in range(WIDTH):
        codes = blocks[taken, where, j].astype(np.int64) * FILTERS + column
        g_filters[j] = np.bincount(codes.ravel(), g_hidden.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return [g_filters, g_hidden.sum(axis=0), g_out, np.array([per_chunk.sum()], np.float32)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> ByteCNN:
    """Train on at most ``per_class`` documents of each label. ``labels``: ``doc_id`` and ``label``;
    the rows to learn from, already chosen. The first by a hash of the id are taken."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("y")).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [known.where(F.col("y") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    picked = some[0].union(some[1])  # 2 * per_class rows
    length = F.char_length("text")
    start = F.when(length > TRAIN_CHARS, F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), length - TRAIN_CHARS)).otherwise(0) + 1
    rows = (docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
            .select("doc_id", "y", F.col("text").substr(start.cast("int"), F.lit(TRAIN_CHARS)).alias("part"))
            .dropDuplicates(["doc_id"]).orderBy("doc_id").collect())
    return train([r["part"] for r in rows], [r["y"] for r in rows])


_MODELS: dict[str, ByteCNN] = {}


def score_column(spark, model: ByteCNN, text: str | Column = "text") -> Column:
    """The probability of label 1 for a whole text, as a column."""
    ship(spark)
    shared = spark.sparkContext.broadcast((model.filters, model.bias, model.out, model.shift, model.constant))
    key = hashlib.sha256(model.filters.tobytes() + model.out.tobytes() + repr((model.shift, model.constant)).encode()).hexdigest()

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = ByteCNN(*shared.value)
        held = _MODELS[key]
        for texts in batches:
            yield pd.Series([held.score(t) for t in texts], dtype="float64")
        give_back()

    return score(text)
