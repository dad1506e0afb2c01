"""Benchmark decontamination by latent semantic retrieval.

1. *TF-IDF.* Words are hashed to ``FEATURES`` features; document frequencies over all documents
   give the weights.
2. *Randomised SVD.* The passages (``PASSAGE`` words) of all documents form a matrix A. Each task
   adds up its passages' part of A'AW for a random W, a table of fixed size that Spark sums; the left
   singular vectors of that sum span A's leading right singular space (range finder with one
   power step). No passage leaves its task.
3. *Candidates.* Overlapping windows of every document and of every benchmark item are projected,
   shorter ones for short items (``SCALES``); pairs with a cosine of at least ``MIN_COSINE`` are
   candidates if the window has ``COVER`` of the weight of as much of the item as it can hold. Any number of items is searched, ``ITEMS``
   at a time, each such part in a pass of its own over the documents.
4. *Every leak.* Step 3 can miss, so the leaks of step 5 are also looked up by a bound that loses
   none: a stretch with ``t`` words of an item holds at least ``t`` less the item's ``l`` lightest words of
   the others, wherever they stand. Stretches that do (and, below ``SURE``, have the answer near) are compared.
5. *Checks.* The words around a candidate window, narrowed to the stretch of 1.5 times the item's
   length that holds most of its words, are compared by longest common subsequence. A share of
   the item's words of ``SURE`` or more is a leak; from ``LIKELY`` on it is one if the item's answer (its last
   sentence) also stands there, at most an item's length away, word for word. In step 4 every stretch
   of that length is compared that could hold enough.

Words are runs of ``0-9 a-z`` and non-ASCII characters, ASCII lower case, compared by 64-bit hashes. Defined results:
a text that is null or has no words leaks nothing; items that are null or have no words match
nothing; items of fewer than ``SHORT_ITEM`` words must be met in full. Repeated rows are
judged alike; repeated items each count.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from tabsight.llm.common import give_back, ship, stored
from tabsight.llm.ngram_join import hashed_windows

FEATURE_BITS, RANK, EXTRA, SEED = 13, 56, 8, 11
FEATURES = 1 << FEATURE_BITS
PASSAGE = 32
BLOCK = 8
SCALES = ((24, 32, 16), (0, 16, 8))  # items of at least so many words: words of a window, words between windows
MIN_COSINE, COVER, SURE, LIKELY, SHORT_ITEM = 0.45, 0.4, 0.75, 0.5, 5
LIGHT = 0.4  # share of an item's words, the lightest, that the look-up does without
ITEMS = 5_000  # items in one search, about 10 KB each in a Python worker; more are searched in parts
HELD = 512  # items whose weights are laid out by feature at once, 32 KB each
_GROUP = 1 << 17  # words handled at once

_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32
                    for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def _groups(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and word counts of consecutive texts, some ``_GROUP`` words at a time."""
    held: list[bytes] = []
    counts: list[int] = []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        held += words
        if len(held) >= _GROUP:
            yield _hashes(held), np.array(counts)
            held, counts = [], []
    if counts:
        yield _hashes(held), np.array(counts)


def _hashes(words: list[bytes]) -> np.ndarray:
    """Word hashes, worked out in slices so that memory stays bounded on long texts."""
    return np.concatenate([hashed_windows(words[i:i + _GROUP], 1) for i in range(0, max(1, len(words)), _GROUP)])


def _features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _block_starts(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the blocks of ``size`` words of each text, and the number of blocks a text."""
    blocks = -(-counts // size)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return np.repeat(np.cumsum(counts) - counts, blocks) + size * nth, blocks


def _laid_out(features: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Blocks by place: the features of each block, filled up with FEATURES (which stands for none)."""
    places = starts[:, None] + np.arange(size)
    return np.where(places < ends[:, None], features[np.minimum(places, len(features) - 1)], FEATURES)


def _sum_rows(table: np.ndarray, laid_out: np.ndarray) -> np.ndarray:
    """Per block the sum of its features' rows of ``table`` (which has a zero row for none)."""
    total = table[laid_out[:, 0]].astype(np.float32)
    for j in range(1, laid_out.shape[1]):
        total += table[laid_out[:, j]]
    return total


def _add_by_feature(total: np.ndarray, features: np.ndarray, passage: np.ndarray, rows: np.ndarray, many: int = 48) -> None:
    """``total[f] += rows[p]`` for every word (f, p): features met often by a matrix of their counts, the
    others by their 1st, 2nd, ... occurrence, in each of which a feature stands once."""
    counts = np.bincount(features, minlength=FEATURES)
    often = np.flatnonzero(counts > many)
    place = np.full(FEATURES, -1)
    place[often] = np.arange(len(often))
    at = place[features]
    if len(often):
        matrix = np.bincount(at[at >= 0] * len(rows) + passage[at >= 0], minlength=len(often) * len(rows))
        total[often] += matrix.reshape(len(often), len(rows)).astype(np.float32) @ rows
    f, p = features[at < 0], passage[at < 0]
    order = np.argsort(f, kind="stable")
    f, p = f[order], p[order]
    firsts = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1]))[:len(f)])
    nth = np.arange(len(f)) - np.repeat(firsts, np.diff(np.append(firsts, len(f))))
    order = np.argsort(nth, kind="stable")
    f, p = f[order], p[order]
    upto = np.concatenate(([0], np.cumsum(np.bincount(nth)))) if len(f) else [0]
    for a, b in zip(upto[:-1], upto[1:], strict=True):
        total[f[a:b]] += rows[p[a:b]]


def learn_space(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(weights, space): log(N / df) of each feature over all documents, and the weights times the
    leading right singular vectors of all weighted passages, each over its singular value, as terms
    are folded into a latent space (FEATURES x RANK).

    One pass counts and sums: with T the passages' term counts, D the weights and A = TD, a random
    W = D^-1 R makes A'AW = D(T'TR), so T'TR can be summed before the weights are known. FEATURES + 1
    rows reach the driver, whatever the input."""
    ship(docs.sparkSession)
    width = RANK + EXTRA
    columns = [f"c{j}" for j in range(width)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (FEATURES + 1, width))
        signs[FEATURES] = 0
        df, total = np.zeros(FEATURES + 1, np.int64), np.zeros((FEATURES + 1, width))
        for batch in batches:
            df[FEATURES] += batch.num_rows
            for hashes, counts in _groups(batch.column(0).to_pylist()):
                features = _features(hashes)
                owner = np.repeat(np.arange(len(counts)), counts)
                df[:FEATURES] += np.bincount(np.unique(owner * FEATURES + features) % FEATURES, minlength=FEATURES)
                starts, _ = _block_starts(counts, PASSAGE)
                ends = np.append(starts[1:], len(features))
                for i in range(0, len(starts), 4096):  # texts of any length, 4096 passages at a time
                    s, e = starts[i:i + 4096], ends[i:i + 4096]
                    rows = _sum_rows(signs, _laid_out(features, s, e, PASSAGE))
                    _add_by_feature(total, features[s[0]:e[-1]], np.repeat(np.arange(len(s)), e - s), rows)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some]), *[pa.array(total[some, j]) for j in range(width)]],
                                         names=["feature", "n", *columns])
        give_back()

    found = (docs.select(text).mapInArrow(add, "feature long, n long, " + ", ".join(f"{c} double" for c in columns))
             .groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns]).toPandas())
    df, total = np.zeros(FEATURES + 1), np.zeros((FEATURES, width))
    df[found["feature"].to_numpy()] = found["n"].to_numpy()
    some = found[found["feature"] < FEATURES]
    total[some["feature"].to_numpy()] = some[columns].to_numpy()
    weights = np.log(max(df[FEATURES], 1) / np.maximum(df[:FEATURES], 1) + 1e-9).clip(0.01).astype(np.float32)
    left, values, _ = np.linalg.svd(weights[:, None] * total, full_matrices=False)
    values = np.sqrt(np.maximum(values[:RANK], 1e-9 * max(values[0], 1)))  # A's own, up to a factor
    return weights, np.ascontiguousarray(weights[:, None] * (left[:, :RANK] / values).astype(np.float32))


def _lcs(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel; ``masks``: word -> its places in the item."""
    full = (1 << size) - 1
    row = full
    for w in words:
        mask = masks.get(w)
        if mask is not None:
            shared = row & mask
            row = ((row + shared) | (row - shared)) & full
    return size - row.bit_count()


def _enough(size: int) -> tuple[int, int]:
    """Words that a sure leak of an item has at least, and a likely one (0: short items have none)."""
    return (size, 0) if size < SHORT_ITEM else (math.ceil(SURE * size), math.ceil(LIKELY * size))


def _stands(hashes: np.ndarray, words: list[int], starts: np.ndarray | None = None) -> np.ndarray:
    """Where the words stand one after the other. ``starts``: the places of the first, if they are known."""
    last = max(0, len(hashes) - len(words) + 1)
    at = np.flatnonzero(hashes[:last] == words[0]) if starts is None else starts[starts < last]
    for j in range(1, len(words)):
        at = at[hashes[at + j] == words[j]]
    return at


class Index:
    """The benchmark's windows in the latent space, and its items' words."""

    def __init__(self, weights: np.ndarray, space: np.ndarray, items: list[tuple[int, str]]) -> None:
        self.space = np.append(space, np.zeros((1, space.shape[1]), np.float32), axis=0)
        self.items = []
        vectors: list[list[np.ndarray]] = [[] for _ in SCALES]
        owner: list[list[int]] = [[] for _ in SCALES]
        for item_id, text in items:
            hashes = _hashes(words_of(text))
            if not len(hashes):
                continue
            sentences = [s for s in regex.split(r"[.!?]+", text or "") if words_of(s)]
            words = hashes.tolist()
            masks: dict[int, int] = {}
            for i, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << i
            self.items.append((item_id, words, masks, _hashes(words_of(sentences[-1])).tolist()))
            rows = space[_features(hashes)]
            scale, (_, span, step) = next((k, s) for k, s in enumerate(SCALES) if len(words) >= s[0])
            for s in range(0, max(1, len(words) - span + step), step):
                s = max(0, min(s, len(words) - span))
                vectors[scale].append(rows[s:s + span].sum(axis=0))
                owner[scale].append(len(self.items) - 1)
        self.vectors = [_unit(np.array(v, np.float32).reshape(-1, space.shape[1])) for v in vectors]
        self.owner = [np.array(o, np.int64) for o in owner]
        # an item's features and its weight on each; ``holds`` lays them out for some items
        self.features: list[np.ndarray] = []
        self.weights = weights
        self.holds = np.zeros((min(HELD, len(self.items)), FEATURES + 1), np.float32)
        self.held = (0, 0)
        self.needs = np.zeros(len(self.items), np.float32)
        for i, (_, words, _, _) in enumerate(self.items):
            features = np.unique(_features(np.array(words, np.uint64))).astype(np.int32)
            self.features.append(features)
            span = next(s[1] for s in SCALES if len(words) >= s[0])
            self.needs[i] = COVER * weights[features].sum() * min(1, span / len(words))
        self.chunks = [list(_chunks(o)) for o in self.owner]
        # the look-up: heavy word -> its items, and how many such words a leak has at least
        self.span = np.array([len(i[1]) + len(i[1]) // 2 for i in self.items], np.int64)
        self.least = np.zeros((2, len(self.items)), np.int64)  # for a sure leak, for a likely one (0: there is none)
        pairs: list[tuple[int, int]] = []
        for i, (_, words, masks, _) in enumerate(self.items):
            size = len(words)
            sure, likely = _enough(size)
            light, spare = 0, int(LIGHT * size) if likely else sure - 1
            heavy = dict.fromkeys(sorted(masks, key=lambda w: weights[w >> (64 - FEATURE_BITS)], reverse=True))
            for w in reversed(list(heavy)):
                light += masks[w].bit_count()
                if light > spare:
                    light -= masks[w].bit_count()
                    break
                del heavy[w]
            self.least[:, i] = sure - light, likely and likely - light
            pairs += [(w, i) for w in heavy]
        pairs.sort()
        words = np.array([w for w, _ in pairs], np.uint64)
        self.vocabulary, many = np.unique(words, return_counts=True)
        self.posting = np.array([i for _, i in pairs], np.int64)
        self.posted = np.concatenate(([0], np.cumsum(many)))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        # the first words of the answers, and which of them each item's answer has
        self.opening, self.opened = np.unique(np.array([i[3][0] for i in self.items], np.uint64), return_inverse=True)
        self.opens = np.zeros(1 << 20, bool)
        self.opens[(self.opening >> np.uint64(44)).astype(np.int64)] = True

    def _lay_out(self, first: int, last: int) -> None:
        """``holds``: the weights of the items from ``first`` to ``last``, and no others."""
        if self.held == (first, last):
            return
        for rows in range(*self.held):
            self.holds[rows - self.held[0], self.features[rows]] = 0
        for rows in range(first, last):
            self.holds[rows - first, self.features[rows]] = self.weights[self.features[rows]]
        self.held = (first, last)

    def _openings(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where answers may start: places in order of the first words, and the first place of each such word."""
        at = np.flatnonzero(self.opens[(hashes >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.opening, hashes[at]), len(self.opening) - 1)
        same = self.opening[place] == hashes[at]
        at, place = at[same], place[same]
        return at[np.argsort(place, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(self.opening)))))

    def search(self, texts: list[str | None]) -> list[list[tuple]]:
        """Per text its leaks: (item_id, cosine, lcs, item words, share, answer found)."""
        out: list[list[tuple]] = []
        for hashes, counts in _groups(texts):
            found: list[dict[int, tuple]] = [{} for _ in counts]
            if len(hashes) and len(self.items):
                self._look_up(hashes, counts, found)
                self._search(hashes, counts, found)
            out += [[f[k] for k in sorted(f)] for f in found]
        return out

    def _search(self, hashes: np.ndarray, counts: np.ndarray, found: list[dict[int, tuple]]) -> None:
        features = _features(hashes)
        starts, blocks = _block_starts(counts, BLOCK)
        upto = np.zeros((len(starts) + 1, self.space.shape[1]))  # sums of all blocks before each
        laid_out = _laid_out(features, starts, np.minimum(starts + BLOCK, np.repeat(np.cumsum(counts), blocks)), BLOCK)
        np.cumsum(_sum_rows(self.space, laid_out), axis=0, out=upto[1:])
        text_start, text_end = np.cumsum(counts) - counts, np.cumsum(counts)
        for scale, (_, span, step) in enumerate(SCALES):
            if not len(self.vectors[scale]):
                continue
            wide, apart = span // BLOCK, step // BLOCK
            last = np.maximum(blocks - wide, 0)  # the block where a text's last window starts
            windows = np.where(blocks > 0, -(-last // apart) + 1, 0)
            owner = np.repeat(np.arange(len(counts)), windows)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            before = (np.cumsum(blocks) - blocks)[owner]
            first = before + np.minimum(nth * apart, last[owner])
            vectors = _unit((upto[np.minimum(first + wide, before + blocks[owner])] - upto[first]).astype(np.float32))
            begins = starts[first]
            ends = np.minimum(begins + span, text_end[owner])
            for i in range(0, len(vectors), 2048):
                laid_out = _laid_out(features, begins[i:i + 2048], ends[i:i + 2048], span)
                for q, upto_q in self.chunks[scale]:
                    near = vectors[i:i + 2048] @ self.vectors[scale][q:upto_q].T
                    w, v = np.divmod(np.flatnonzero(near >= MIN_COSINE), near.shape[1])
                    if not len(w):
                        continue
                    items = self.owner[scale][v + q]
                    base = int(self.owner[scale][q])
                    self._lay_out(base, int(self.owner[scale][upto_q - 1]) + 1)
                    for s in range(0, len(w), 1 << 16):
                        at, of = w[s:s + (1 << 16)], items[s:s + (1 << 16)]
                        able = np.flatnonzero(self.holds[of[:, None] - base, laid_out[at]].sum(axis=1) >= self.needs[of])
                        words = np.sort(laid_out[at[able]], axis=1)  # now each feature once
                        words[:, 1:][words[:, 1:] == words[:, :-1]] = FEATURES
                        able = able[self.holds[of[able][:, None] - base, words].sum(axis=1) >= self.needs[of[able]]]
                        at += i
                        for k in able:
                            doc, item = int(owner[at[k]]), int(of[k])
                            if found[doc].get(item, (0,) * 5)[4] == 1:  # met in full already
                                continue
                            size = len(self.items[item][1])
                            low = max(int(text_start[doc]), int(begins[at[k]]) - size)
                            high = min(int(text_end[doc]), int(ends[at[k]]) + size)
                            leak = self._check(item, hashes[low:high], float(near[at[k] - i, v[s + k]]))
                            if leak and found[doc].get(item, (0,) * 5)[2] < leak[2]:
                                found[doc][item] = leak

    def _look_up(self, hashes: np.ndarray, counts: np.ndarray, found: list[dict[int, tuple]]) -> None:
        """The leaks, by the bound on heavy words."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[place] == hashes[at]
        at, place = at[same], place[same]
        many = self.posted[place + 1] - self.posted[place]
        item = self.posting[np.repeat(self.posted[place] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        key = np.sort(item << 40 | np.repeat(at, many))
        item, at = key >> 40, key & ((1 << 40) - 1)
        text_end = np.cumsum(counts)
        doc = np.repeat(np.arange(len(counts)), counts)[at]
        regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for likely in (0, 1):
            least = self.least[likely][item]
            i = np.flatnonzero(least > 0)
            j = i + least[i] - 1
            i, j = i[j < len(at)], j[j < len(at)]
            near = (item[i] == item[j]) & (doc[i] == doc[j]) & (at[j] - at[i] < self.span[item[i]])
            i, j = i[near], j[near]
            low, high, of = at[j] - self.span[item[j]] + 1, at[i] + self.span[item[i]], item[i]
            able = np.ones(len(i), bool)
            if likely:  # the answer must be near
                cuts = np.searchsorted(of, np.arange(len(self.items) + 1))
                starts, upto = self._openings(hashes)
                for k in np.unique(of):
                    answer, size = self.items[k][3], len(self.items[k][1])
                    some = slice(cuts[k], cuts[k + 1])
                    first = self.opened[k]
                    stands = _stands(hashes, answer, starts[upto[first]:upto[first + 1]])
                    able[some] = (np.searchsorted(stands, high[some] + size - len(answer), "right")
                                  > np.searchsorted(stands, low[some] - size))
            for k in np.flatnonzero(able):
                regions.setdefault((int(doc[i[k]]), int(of[k])), []).append((int(low[k]), int(high[k])))
        for (d, k), parts in regions.items():
            first, end = int(text_end[d] - counts[d]), int(text_end[d])
            low, high = None, None
            parts = sorted((max(a, first), min(b, end)) for a, b in parts)
            for a, b in [*parts, (end + 1, 0)]:  # overlapping ones in one piece
                if high is not None and a <= high:
                    high = max(high, b)
                    continue
                if high is not None:
                    leak = self._best(k, hashes, low, high, first, end)
                    if leak and found[d].get(k, (0,) * 5)[2] < leak[2]:
                        found[d][k] = leak
                low, high = a, b
                if found[d].get(k, (0,) * 5)[4] == 1:
                    break

    def _best(self, item: int, hashes: np.ndarray, low: int, high: int, first: int, end: int) -> tuple | None:
        """The leak with most words of the item among all stretches that start from ``low`` and end by ``high``."""
        item_id, words, masks, answer = self.items[item]
        size, span = len(words), int(self.span[item])
        sure, likely = _enough(size)
        near = hashes[low:high].tolist()
        begin = max(first, low - size)
        stands = _stands(hashes[begin:min(end, high + size)], answer) + begin - low
        least = likely if likely and len(stands) else sure
        if _lcs(masks, size, near) < least:  # no stretch holds more than all of them
            return None
        known = np.cumsum([0] + [w in masks for w in near])
        starts = np.flatnonzero(np.diff(known))
        starts = starts[known[np.minimum(starts + span, len(near))] - known[starts] >= least]
        best = None
        for a in starts.tolist():
            lcs = _lcs(masks, size, near[a:a + span])
            if lcs < least or best and lcs <= best[0]:
                continue
            answered = bool(np.any((stands >= a - size) & (stands + len(answer) <= a + span + size)))
            if lcs >= sure or answered:
                best = lcs, a, answered
                if lcs == size:
                    break
        if best is None:
            return None
        lcs, a, answered = best
        vector = self.space[_features(hashes[low + a:min(low + a + span, high)])].sum(axis=0)
        own = [v[o == item] for v, o in zip(self.vectors, self.owner, strict=True)]
        cosine = max(float((v @ (vector / max(np.linalg.norm(vector), 1e-12))).max()) for v in own if len(v))
        return item_id, cosine, lcs, size, lcs / size, answered

    def _check(self, item: int, region: np.ndarray, cosine: float) -> tuple | None:
        item_id, words, masks, answer = self.items[item]
        size = len(words)
        near = region.tolist()
        known = np.cumsum([0] + [w in masks for w in near])
        span = min(len(near), size + size // 2)
        best = int(np.argmax(known[span:] - known[:len(known) - span]))  # the stretch with most of the item's words
        lcs = _lcs(masks, size, near[best:best + span])
        share = lcs / size
        n = len(answer)
        answered = any(near[i:i + n] == answer for i in range(len(near) - n + 1) if near[i] == answer[0])
        sure = 1.0 if size < SHORT_ITEM else SURE
        if share >= sure or size >= SHORT_ITEM and share >= LIKELY and answered:
            return item_id, cosine, lcs, size, share, answered
        return None


def _chunks(owner: np.ndarray, vectors: int = 4096) -> Iterator[tuple[int, int]]:
    """Consecutive vectors, at most so many and of at most ``HELD`` items in a row."""
    first = 0
    while first < len(owner):
        last = min(first + vectors, int(np.searchsorted(owner, owner[first] + HELD)))
        yield first, last
        first = last


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


LEAKS = "array<struct<item_id: long, cosine: double, lcs: int, item_words: int, share: double, answered: boolean>>"
_INDEXES: dict[str, Index] = {}


def _parts(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items, about ``ITEMS`` at a time, and whether these are all; one part is on the driver at once."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    some = items.limit(ITEMS + 1).collect()
    alone = len(some) <= ITEMS
    count = 1 if alone else -(-items.count() // ITEMS)
    if not alone:
        items = stored(items.repartition(count).withColumn("part", F.spark_partition_id()), "benchmark-items")
    for part in range(count):
        rows = some if alone else items.where(F.col("part") == part).collect()
        yield sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])), alone


def _searched(docs: DataFrame, benchmark: DataFrame, text: str,
              keep: Callable[[Column], DataFrame]) -> tuple[list[DataFrame], bool]:
    """``keep`` of the leaks of a whole text (an array column), for each part of the items, and whether
    there is one part only; the space is learnt from all of ``docs``. Several parts are searched one
    after the other and what is kept of each is stored."""
    learnt = learn_space(docs, text)
    found = []
    for items, alone in _parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast((*learnt, items))
        frame = keep(_leaks_column(shared, learnt[1], items, text))
        if alone:
            return [frame], True
        found.append(stored(frame, "leaks"))
        shared.destroy()
    return found, False


def _leaks_column(shared: Broadcast, space: np.ndarray, items: list[tuple[int, str]], text: str) -> Column:
    key = hashlib.sha256(space.tobytes() + repr(items).encode()).hexdigest()

    @F.pandas_udf(LEAKS)
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[key] = Index(*shared.value)
        index = _INDEXES[key]
        names = ("item_id", "cosine", "lcs", "item_words", "share", "answered")
        for texts in batches:
            yield pd.Series([[dict(zip(names, leak, strict=True)) for leak in found] for found in index.search(list(texts))],
                            dtype=object)
        give_back()

    return leaks(text)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it."""
    found, _ = _searched(docs, benchmark, text, lambda leaks: docs.select(
        F.col(id_column).alias("doc_id"), F.explode(leaks).alias("leak")).select("doc_id", "leak.*"))
    return reduce(DataFrame.unionAll, found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, with their own columns. When the items
    are searched in parts, texts that leak are known by their md5."""
    columns: list[Column] = []

    def leaky(leaks: Column) -> DataFrame:
        columns.append(leaks)
        return docs.where(F.size(leaks) > 0).select(F.md5(text).alias("__leaky")).distinct()

    found, alone = _searched(docs, benchmark, text, leaky)
    if alone:
        return docs.where(F.size(columns[0]) == 0)
    return docs.join(reduce(DataFrame.unionAll, found), F.md5(docs[text]) == F.col("__leaky"), "left_anti")
