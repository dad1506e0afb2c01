"""Toxicity of disguised text: a noisy-channel decoder, then a score of the restored text.

A writer's letters reach us through a channel that swaps letters for look-alike signs (``1d10t``), puts
a sign between all letters (``i d i o t``, ``i-d-i-o-t``) and stretches letters (``idioooot``). Stretches of a
text that show such marks become a lattice: for every sign the letters it may stand for, itself included,
for a sign between letters a blank or nothing, for a letter held three times or more one or two of
it, each with a cost. Viterbi search over the last two letters finds the cheapest path by those costs and a character
trigram model, which is counted over the texts of all documents. Signs at a word's end that are punctuation, and runs of three or
more signs, stand for no letters.

The restored text is scored by word beginnings and whole words (``pieces``): those whose share of
documents is surely higher among toxic documents than among others, by counts over a bounded sample of labelled documents.
A logistic model, with the documents weighted to the labels' true shares, turns the numbers of the pieces
in the whole text into a probability.

Bounds, all parameters: at most ``per_class`` documents of each label are learnt from, the first by a hash of
the id; at most ``MOST_PIECES`` pieces. Texts are decoded and scored whole; a stretch of more than ``WINDOW``
signs is decoded window by window, each going on from the letters of the one before, so time stays linear and memory bounded.

Defined results: a null text is an empty text; an empty text is scored from the model's constant and its length of 0 words.
An id with both labels counts as toxic; of an id with several texts the one with the smallest hash is learnt from. Labels that are null
or other than 0 and 1 are left out. Without labelled documents every score is 0.5, with one label only it is that label. Without documents the
trigram model is even. Rows that repeat are scored alike. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabsight.llm.common import give_back, ship

PER_CLASS, MOST_PIECES, LEAST_DOCUMENTS, SURE, KEEP_FROM = 4_000, 768, 3, 2.0, 0.7
WINDOW, HELD, BUFFER = 256, 100_000, 1 << 20
BEGINNINGS = range(3, 8)

# The letters that a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou",
}
BETWEEN = " .-_/"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
# Costs (negative logarithms) of the channel.
AS_LETTER, AS_SIGN, NOTHING, BLANK, ONE, TWO = 1.0, 6.0, 0.5, 1.5, 0.5, 1.0

_L, _S = "a-zß-öø-ÿ", re.escape("".join(SIGNS))
_ENDS = "0-9@$"  # signs that may stand for a word's last letter; the others are punctuation there
_SPACED = rf"(?<![{_L}{_S}])[{_L}{_S}](?P<gap>[{re.escape(BETWEEN)}])(?:[{_L}{_S}](?P=gap)){{2,}}[{_L}{_S}](?![{_L}{_S}])"
_SWAPPED = rf"(?<![{_L}{_S}])(?=[{_L}]*[{_S}]{{1,2}}[{_L}]|[{_L}]+[{_ENDS}]{{1,2}}(?![{_L}{_S}]))[{_L}{_S}]+"
_HELD_LETTER = rf"[{_L}]*?(?P<held>[{_L}])(?P=held){{2}}[{_L}]*"
_MARKED = re.compile(f"{_SPACED}|{_SWAPPED}")
_STRETCHED = re.compile(rf"(?<![{_L}]){_HELD_LETTER}")
# Cheap searches for what every match of _MARKED holds: most texts have neither and are not searched further.
_SWAP = re.compile(rf"(?<![{_S}])[{_S}]{{1,2}}[{_L}]|(?<=[{_L}])[{_ENDS}]{{1,2}}(?![{_L}{_S}])")
_GAPS = re.compile(rf"[{re.escape(BETWEEN)}][{_L}{_S}][{re.escape(BETWEEN)}][{_L}{_S}][{re.escape(BETWEEN)}]")
_HAS_LETTER = re.compile(rf"[{_L}]")
_EDGE = re.compile(r"[!|+*]+$")
_OTHER = re.compile(r"[\W\d_]+")

SIZE = len(LETTERS) + 1  # letters, and 0 for all else
_CODES = np.zeros(256, np.int32)
_CODES[[ord(c) for c in LETTERS]] = np.arange(1, SIZE)
_CODE = {c: i for i, c in enumerate(LETTERS, 1)}


# ---------------------------------------------------------------- character model

def trigram_counts(texts: Iterator[str]) -> np.ndarray:
    """Counts of the trigrams of lower-cased texts that are not empty, each with two blanks before and behind."""
    counts, held, length = np.zeros(SIZE ** 3, np.int64), [], 0

    def add() -> None:
        points = np.frombuffer("  ".join(["", *held, ""]).encode("utf-32-le"), np.uint32)
        codes = _CODES[np.where(points < 256, points, 0)]
        cells = codes[:-2] * (SIZE * SIZE) + codes[1:-1] * SIZE + codes[2:]
        counts[:] += np.bincount(cells, minlength=SIZE ** 3)
        held.clear()

    for text in filter(None, texts):  # neighbours share their two blanks, which no trigram spans
        held.append(text.lower())
        length += len(text)
        if length > BUFFER:
            add()
            length = 0
    if held:
        add()
    return counts


def costs_of(counts: np.ndarray) -> np.ndarray:
    """Costs of a letter after two others, from trigram counts; rare contexts lean on shorter ones."""
    three = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
    return (-np.log(p3)).astype(np.float32)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = trigram_counts(t for batch in batches for t in batch.column("text").to_pylist())
    cells = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(cells.astype(np.int32)), pa.array(counts[cells])], ["cell", "n"])


def character_costs(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The trigram model of all texts; at most ``SIZE`` cubed counts reach the driver."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    found = rows.mapInArrow(_count_trigrams, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIZE ** 3, np.int64)
    counts[[r["cell"] for r in found]] = [r["n"] for r in found]
    return costs_of(counts)


# ---------------------------------------------------------------- channel

def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """For each place of a marked stretch the strings that may stand there, with their costs."""
    places: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(stretch):
        sign = stretch[at]
        run = at + 1
        while run < len(stretch) and stretch[run] == sign:
            run += 1
        if sign in _CODE and run - at >= 3:
            places.append([(sign, ONE), (sign * 2, TWO)])
            at = run
            continue
        if sign in _CODE:
            places.append([(sign, 0.0)])
        elif sign in SIGNS:
            places.append([(c, AS_LETTER) for c in SIGNS[sign]] + [(" ", AS_SIGN)])
        elif sign in BETWEEN:
            places.append([("", NOTHING), (" ", BLANK)])
        else:
            places.append([(" ", 0.0)])
        at += 1
    return places


def cheapest(places: list[list[tuple[str, float]]], costs: list, start: tuple[int, int] = (0, 0), last: bool = True) -> str:
    """The cheapest string through a lattice that follows the letters ``start``; with ``last``, a blank follows."""
    best = {start: (0.0, "")}
    for options in places:
        reached: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, text) in best.items():
            for add, price in options:
                x, y, total = a, b, cost + price
                for c in add:
                    z = _CODE.get(c, 0)
                    total += costs[x][y][z]
                    x, y = y, z
                old = reached.get((x, y))
                way = (total, text + add)
                if old is None or way < old:
                    reached[x, y] = way
        best = reached
    if last:
        return min((cost + costs[a][b][0], text) for (a, b), (cost, text) in best.items())[1]
    return min(best.values())[1]


class Restorer:
    """Restores texts by one character model; remembers stretches, as many as ``HELD`` and no more."""

    def __init__(self, costs: np.ndarray) -> None:
        self.costs = costs.tolist()
        self.known: dict[str, str] = {}

    def decode(self, stretch: str) -> str:
        found = self.known.get(stretch)
        if found is None:
            found = self._decode(stretch)
            if len(stretch) <= WINDOW:
                if len(self.known) >= HELD:
                    self.known.clear()
                self.known[stretch] = found
        return found

    def _decode(self, stretch: str) -> str:
        if not _HAS_LETTER.search(stretch):
            return stretch
        body = stretch[:-1] + " " if _EDGE.search(stretch[-1:]) else stretch
        places, out, before = lattice(body), [], (0, 0)
        for i in range(0, len(places), WINDOW):
            part = cheapest(places[i:i + WINDOW], self.costs, before, i + WINDOW >= len(places))
            out.append(part)
            tail = (out[-2][-2:] if len(out) > 1 else "") + part
            before = tuple(([0, 0] + [_CODE.get(c, 0) for c in tail])[-2:])
        return "".join(out)

    def restore(self, text: str) -> str:
        """The lower-cased text with every marked stretch decoded."""
        text = text.lower()
        if _SWAP.search(text) or _GAPS.search(text):
            text = _MARKED.sub(lambda m: self.decode(m.group()), text)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(points) > 2 and ((points[2:] == points[1:-1]) & (points[1:-1] == points[:-2]) & (points[2:] > 96)).any():
            text = _STRETCHED.sub(lambda m: self.decode(m.group()), text)
        return text

    def plain(self, text: str | None) -> str:
        """The restored text as words with a blank before and behind each."""
        return f" {_OTHER.sub(' ', self.restore(text or '')).strip()} "


# ---------------------------------------------------------------- score

@dataclass
class Scorer:
    costs: np.ndarray
    pieces: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # one a piece, then one for the length
    shift: float = 0.0
    constant: float | None = 0.5

    def prepare(self) -> None:
        self.restorer = Restorer(self.costs)
        self.finder = finder(self.pieces)

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        plain = self.restorer.plain(text)
        ids, n = counted(self.finder, plain)
        logit = self.shift + self.weights[-1] * np.log1p(plain.count(" ") - 1)
        if ids:
            logit += float(self.weights[ids] @ np.log2(np.add(n, 1)))
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def finder(pieces: list[str]) -> ahocorasick.Automaton | None:
    if not pieces:
        return None
    automaton = ahocorasick.Automaton()
    for i, piece in enumerate(pieces):
        automaton.add_word(piece, i)
    automaton.make_automaton()
    return automaton


def counted(automaton: ahocorasick.Automaton | None, plain: str) -> tuple[list[int], list[int]]:
    found = Counter(i for _, i in automaton.iter(plain)) if automaton is not None else Counter()
    ids = sorted(found)
    return ids, [found[i] for i in ids]


def pieces_of(plain: str) -> set[str]:
    """Beginnings of the words, and the words, of a restored text: a blank stands before, and behind a whole word."""
    words = set(plain.split())
    return {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n} | {f" {w} " for w in words if len(w) > 2}


def _count_pieces(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def out(found: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(found), pa.string()), pa.array([v[0] for v in found.values()], pa.int64()),
                                pa.array([v[1] for v in found.values()], pa.int64())], ["piece", "clean", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, found = Restorer(shared.value), {}
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                for piece in pieces_of(restorer.plain(text)):
                    found.setdefault(piece, [0, 0])[y] += 1
                if len(found) > HELD:
                    yield out(found)
                    found = {}
        yield out(found)
    return run


def _vectors(shared, pieces: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, automaton = Restorer(shared.value), finder(pieces)
        for batch in batches:
            plains = [restorer.plain(t) for t in batch.column("text").to_pylist()]
            counts = [counted(automaton, p) for p in plains]
            yield pa.record_batch([batch.column("id"), batch.column("y"), pa.array([p.count(" ") - 1 for p in plains], pa.int64()),
                                   pa.array([i for i, _ in counts], pa.list_(pa.int64())),
                                   pa.array([n for _, n in counts], pa.list_(pa.int64()))], ["id", "y", "words", "ids", "n"])
    return run


def logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, penalty: float = 0.05, steps: int = 1500) -> np.ndarray:
    """Weights (the last is the constant) of a weighted logistic model, by Nesterov's accelerated gradient."""
    n = share.sum()
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ahead, pull = w.copy(), np.r_[np.full(x.shape[1] - 1, penalty / n), 0.0]
    # the step from a bound of the curvature: the largest eigenvalue, by power iteration
    v = np.ones(x.shape[1])
    for _ in range(20):
        v = x.T @ (share * (x @ v))
        size = np.linalg.norm(v)
        v = v / size
    rate = 1 / (size / n / 4 * 1.05 + penalty / n)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -60, 60)))
        slope = x.T @ (share * (p - y)) / n + pull * ahead
        if np.abs(slope).max() < 1e-6:
            break
        new = ahead - rate * slope
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def fit(docs: DataFrame, labels: DataFrame, costs: np.ndarray, label: str = "toxic", id_column: str = "doc_id",
        text: str = "text", per_class: int = PER_CLASS, most_pieces: int = MOST_PIECES) -> Scorer:
    """Learn from at most ``per_class`` documents of each label. ``labels``: ids and labels, the rows to learn from."""
    spark = docs.sparkSession
    ship(spark)
    known = (labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull())
             .groupBy(F.col(id_column).alias("id")).agg(F.max(label).cast("int").alias("y")))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(totals) < 2:
        return Scorer(costs, constant=float(next(iter(totals), 0.5)))
    some = [known.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    picked = some[0].union(some[1])  # 2 * per_class ids
    rows = (docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
            .join(F.broadcast(picked), "id").groupBy("id", "y")
            .agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))).persist()
    try:
        held = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
        if len(held) < 2:
            return Scorer(costs, constant=totals[1] / (totals[0] + totals[1]))
        shared = spark.sparkContext.broadcast(costs)
        n0, n1 = held[0], held[1]
        counts = rows.mapInArrow(_count_pieces(shared), "piece string, clean long, toxic long").groupBy("piece").agg(
            F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= LEAST_DOCUMENTS)
        here, there = F.col("toxic") + 0.5, F.col("clean") + 0.5
        gain = F.log(here / (n1 + 1)) - F.log(there / (n0 + 1)) - SURE * F.sqrt(1 / here + 1 / there)
        # of pieces with equal counts, one within the other, the shorter says as much
        best = counts.select("piece", "clean", "toxic", gain.alias("gain")).where("gain > 0")
        best = best.groupBy(F.substring("piece", 1, min(BEGINNINGS) + 1), "clean", "toxic").agg(
            F.min(F.struct(F.length("piece").alias("size"), "piece")).alias("p"), F.first("gain").alias("gain"))
        pieces = [r["piece"] for r in best.select("p.piece", "gain").orderBy(F.desc("gain"), "piece").limit(most_pieces).collect()]
        id_type = rows.schema["id"].dataType.simpleString()
        vectors = rows.mapInArrow(_vectors(shared, pieces), f"id {id_type}, y int, words long, ids array<long>, n array<long>"
                                  ).orderBy("id").collect()  # 2 * per_class
    finally:
        rows.unpersist()
    x = np.zeros((len(vectors), len(pieces) + 1))
    for i, r in enumerate(vectors):
        x[i, r["ids"]] = np.log2(np.add(r["n"], 1))
        x[i, -1] = np.log1p(r["words"])
    y = np.array([r["y"] for r in vectors], float)
    share = np.where(y == 1, totals[1] / n1, totals[0] / n0)
    w = logistic(x, y, share / share.mean())
    return Scorer(costs, pieces, w[:-1], float(w[-1]), None)


_SCORERS: dict[str, Scorer] = {}


def score_column(spark, scorer: Scorer, text: str | Column = "text") -> Column:
    """The probability that a whole text is toxic, as a column."""
    ship(spark)
    facts = (scorer.costs, scorer.pieces, scorer.weights, scorer.shift, scorer.constant)
    shared = spark.sparkContext.broadcast(facts)
    key = hashlib.sha256(scorer.costs.tobytes() + scorer.weights.tobytes() + repr((facts[1], facts[3:])).encode()).hexdigest()

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(*shared.value)
            _SCORERS[key].prepare()
        held = _SCORERS[key]
        for texts in batches:
            yield pd.Series([held.score(t) for t in texts], dtype="float64")
        give_back()

    return score(text)
