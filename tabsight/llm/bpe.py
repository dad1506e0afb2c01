"""Byte-level BPE by a monoid tree reduction.

The encodings of byte strings form a monoid: ``encode(a + b)`` follows from ``encode(a)`` and
``encode(b)`` by re-encoding a window of tokens around the seam. A piece is split in halves down
to short leaves, which are merged directly by rank, and neighbours are joined on the way up. A
window's result is final once the tokens just outside it are *stable*: a token sequence is the
encoding of its bytes exactly if every two neighbouring tokens are the encoding of their own
joined bytes, so checking the two pairs at the window's edges proves the whole join; until both
hold, the window grows on the side that fails (doubling, so a join costs no more than the piece).
Decoding concatenates halves up the same tree.

A text is cut by the tokenizer's pattern and every match encoded by itself, no special tokens.
Vocabularies are files of ranks (one base64 token and its rank a line); the token table, a fixed
size, is broadcast. Work is per row: no shuffle, and a lost executor repeats only its own rows.

Defined results: a null text encodes as an empty one (no ids); null ids decode to null. Columns
of the input that are called like an output column are replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from tabsight.llm.common import give_back, ship

LEAF = 6  # bytes merged directly; such short strings recur, so their ids are remembered
_SCAN = 200  # bytes up to which a plain scan for the next merge beats a heap
_KEPT = 250_000  # pieces remembered by one worker process, and as many from before
_SEAMS = 100_000  # short strings and seams remembered
_OUT = 2_000_000  # ids in one output batch


def load_tokens(path: str) -> list[bytes]:
    """The tokens of a rank file, in rank order (a missing rank holds an empty token)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Codec:
    """Encoder and decoder over one token table."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.pattern = regex.compile(pattern)
        self.pieces = _Pieces(self)
        self.short: dict[bytes, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of ``piece`` by merging its bytes: lowest rank first, then leftmost."""
        if len(piece) > _SCAN:
            return self._merge_long(piece)
        ranks, never = self.ranks, len(self.tokens)
        parts = [piece[i:i + 1] for i in range(len(piece))]
        costs = [ranks.get(piece[i:i + 2], never) for i in range(len(piece) - 1)]
        while costs:
            low = min(costs)
            if low == never:
                break
            i = costs.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], never)
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], never)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0: merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            if not end[i] or (mid := end[i]) >= n or not end[mid] or end[mid] != to:
                continue
            end[mid], end[i] = 0, to
            if to < n:
                before[to] = i
                if (r := ranks.get(piece[i:end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (b := before[i]) >= 0 and (r := ranks.get(piece[b:to])) is not None:
                heapq.heappush(heap, (r, b, to))
        return [ranks[piece[i:end[i]]] for i in range(n) if end[i]]

    def merge_short(self, piece: bytes) -> list[int]:
        """:meth:`merge`, remembered for strings of a few bytes."""
        ids = self.short.get(piece)
        if ids is None:
            ids = self.merge(piece)
            if len(piece) <= 2 * LEAF:
                if len(self.short) >= _SEAMS:
                    self.short.clear()
                self.short[piece] = ids
        return ids

    def stable(self, a: int, b: int) -> bool:
        """True if the two tokens side by side are the encoding of their joined bytes."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= _SEAMS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):  # then every two neighbours are
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge_short(b"".join([self.tokens[t] for t in chain(left[-i:], right[:j])]))
            left_holds = i == len(left) or self.stable(left[-i - 1], window[0])
            right_holds = j == len(right) or self.stable(window[-1], right[j])
            if left_holds and right_holds:
                return left[:-i] + window + right[j:]
            i, j = i if left_holds else 2 * i, j if right_holds else 2 * j

    def tree(self, piece: bytes) -> list[int]:
        """The ids of one piece by halves (long pieces: cut at a power of two, so that repeats align)."""
        if len(piece) <= LEAF:
            return self.merge_short(piece)
        cut = len(piece) // 2 if len(piece) <= 64 else 1 << (len(piece) - 1).bit_length() - 1
        return self.join(self.tree(piece[:cut]), self.tree(piece[cut:]))

    def encode_packed(self, text: str) -> bytes:
        """The ids of a whole text as 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Pieces(dict):
    """Piece of text -> its ids, packed; once it holds ``_KEPT`` pieces they become the old ones, of
    which those met again are taken over and the others forgotten at the next turn."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            raw = piece.encode()
            whole = self.codec.ranks.get(raw)  # a piece that is itself a token is never split
            ids = array("i", [whole] if whole is not None else self.codec.tree(raw)).tobytes()
        if len(piece) <= 64:
            if len(self) >= _KEPT:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_CODECS: dict[str, Codec] = {}


def _codec(key: str, tokens, pattern: str) -> Codec:
    """One codec a worker process, kept for the tasks to come."""
    if key not in _CODECS:
        _CODECS[key] = Codec(tokens.value, pattern)
    return _CODECS[key]


def _shared(spark, tokens: list[bytes], pattern: str):
    key = hashlib.sha256(b"\0".join(tokens) + pattern.encode()).hexdigest()
    return key, spark.sparkContext.broadcast(tokens)


def _mapped(df: DataFrame, source: str, out: str, kind: T.DataType, work, keep: list[str] | None) -> DataFrame:
    """The columns ``keep`` of ``df`` (None: all) and ``out``; ``work`` maps a batch of values to batches of results."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c.lower() != out.lower() and (keep is None or c in keep)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, kind)])
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, start = batch.columns, 0
            for found in work(columns[at]):
                held = [c.slice(start, len(found)) for c in columns[:at]]
                yield pa.RecordBatch.from_arrays([*held, found], names=[*keep, out])
                start += len(found)
        give_back()

    values = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{source}`").alias("__in"))
    return values.mapInArrow(run, schema)


def _lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids",
           keep: list[str] | None = None) -> DataFrame:
    """``df`` with the token ids (``array<int>``) of its ``text`` column in ``out``; of its own columns
    those in ``keep``, or all."""
    key, tokens = _shared(df.sparkSession, load_tokens(path), pattern)

    def work(texts: pa.Array) -> Iterator[pa.Array]:
        codec, packed, size = _codec(key, tokens, pattern), [], 0
        for value in texts:
            packed.append(codec.encode_packed(value.as_py() or ""))
            size += len(packed[-1])
            if size >= 4 * _OUT:
                yield _lists(packed)
                packed, size = [], 0
        if packed:
            yield _lists(packed)

    return _mapped(df, text, out, T.ArrayType(T.IntegerType()), work, keep)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """``df`` with the bytes that its ``ids`` column stands for in ``out``."""
    key, tokens = _shared(df.sparkSession, load_tokens(path), pattern)

    def work(lists: pa.Array) -> Iterator[pa.Array]:
        codec, found, size = _codec(key, tokens, pattern), [], 0
        for value in lists:
            found.append(codec.decode(value.values.to_numpy().tolist()) if value.is_valid else None)
            size += len(found[-1] or b"")
            if size >= 4 * _OUT:
                yield pa.array(found, pa.binary())
                found, size = [], 0
        if found:
            yield pa.array(found, pa.binary())

    return _mapped(df, ids, out, T.BinaryType(), work, keep)
