"""Spelling variant grouping by dense prefix-suffix tiling.

Two words differ by exactly one inserted, deleted or replaced code point if the length of their common
prefix plus that of their common suffix reaches the longer one's length minus one. Words that may be near are brought
together without loss: a word of the longer length L is cut into ``SEGMENTS`` parts, one of which holds the only
difference, so that all before it is a common prefix and all behind it a common suffix. Those two, with L
and the part's number, are a block's key; every word goes, for each part, into the block of its own length
and into that of the next length. A block of more than a tile of words is cut into tiles by a hash, and each pair
of tiles is a row of its own, so no task holds more than two tiles of a block. Inside the tasks the words of many blocks
lie in padded code-point matrices, from the left and from the right, whose rows are compared at growing
offsets: pairs of rows of one block, each met once. A pair that several parts would find is given by the first of them.

A word's form is its near word of largest count (ties: smallest in code-point order) if that is at least
``TIMES`` its own; the root follows forms to the last, by doubling. Counts grow at least ``TIMES``-fold
along the way, so forms never form a ring and the rounds are few.

Defined results: null and empty texts have no words; a null id is written ``null`` in the hash that drops code points. Words
of any length are compared (tiles of long words hold fewer of them). Rows that repeat count as often as they stand there. Without
words the result is empty. Only the id and the text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabsight.llm.common import ship, stored

LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
SEGMENTS, TILE, TILE_CHARS = 3, 512, 1 << 18
HELD_WORDS, CELLS = 200_000, 1 << 21
# Runs of A-Z, a-z and U+00C0 to U+00FF; in Latin-1 each code point is a byte, and other characters become "?".
_RUN = rb"[a-z\xc0-\xff]{%d,}"


def changed(run: bytes, start: int, one_in: int) -> bytes:
    """The Latin-1 run without one code point if ``one_in`` divides the checksum that ``start`` begins."""
    check = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if check % one_in:
        return run
    at = check % len(run)
    return run[:at] + run[at + 1:]


def _count(least: int, one_in: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    runs = re.compile(_RUN % least)

    def out(found: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array([w.decode("latin-1") for w in found], pa.string()),
                                pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = Counter(runs.findall(text.encode("latin-1", "replace").lower()))
                if one_in is None:
                    found.update(words)
                    continue
                start = zlib.crc32(f"{name}:".encode())
                for word, n in words.items():
                    word = changed(word, start, one_in)
                    if len(word) >= least:
                        found[word] += n
                if len(found) > HELD_WORDS:
                    yield out(found)
                    found.clear()
        yield out(found)
    return run


def count_words(docs: DataFrame, id_column: str = "doc_id", text: str = "text", *, least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, one_in: int | None = None) -> DataFrame:
    """``word`` and ``n`` over all texts. With ``one_in``, a run whose crc32 of ``<id>:<run>`` it divides
    loses the code point at that checksum modulo the length."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("id"), F.col(text).alias("text"))
    return (rows.mapInArrow(_count(least_length, one_in), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


def blocks(words: DataFrame, segments: int = SEGMENTS, tile: int = TILE) -> DataFrame:
    """One row per pair of tiles of a block: ``longer`` (the block's length), ``part``, ``same`` (the
    pair is one tile), and the lists ``words``, ``counts`` and ``tiles``."""
    length = F.char_length("word")
    roles = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("longer"),
                         length.alias("length")).where(F.col("longer") > 1)
    parts = roles.select("*", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("part"))
    start, end = (F.expr(f"longer * (part + {i}) div {segments}").cast("int") for i in (0, 1))
    parts = parts.where(start < end)
    behind = F.col("longer") - end
    keyed = parts.select(
        "word", "n", "longer", "part", (F.col("length") == F.col("longer")).alias("full"),
        F.concat_ws(" ", F.substring("word", F.lit(1), start),
                    F.expr("word").substr(F.col("length") - behind + 1, behind)).alias("key"))
    key = ["longer", "part", "key"]
    size = F.greatest(F.lit(2), F.least(F.lit(tile), F.expr(f"{TILE_CHARS} div longer")))
    big = (keyed.groupBy(*key).agg(F.count("*").alias("m")).select(*key, F.ceil(F.col("m") / size).cast("int").alias("tiles"))
           .where(F.col("tiles") > 1))
    dealt = keyed.join(big, key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    pairs = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    return (pairs.groupBy(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
            .agg(F.collect_list(F.struct("word", "n", "own")).alias("rows"), F.max("full").alias("full"))
            .where((F.size("rows") > 1) & F.col("full"))
            .select("longer", "part", (F.col("i") == F.col("j")).alias("same"), F.col("rows.word").alias("words"),
                    F.col("rows.n").alias("counts"), F.col("rows.own").alias("tiles")))


def near_rows(words: list[str], owner: np.ndarray, tiles: np.ndarray, same: np.ndarray, part: np.ndarray, longer: int,
              segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that are near, among blocks of words of ``longer`` code points or one less.
    ``owner`` numbers each row's block (rows of a block stand together), of which ``same`` and ``part`` tell."""
    left = np.array(words, f"U{longer}").view(np.uint32).reshape(-1, longer)
    right = np.array([w[::-1] for w in words], f"U{longer}").view(np.uint32).reshape(-1, longer)
    full = left[:, -1] != 0
    ends = np.searchsorted(owner, owner, "right")
    rows = np.arange(len(words))
    step, found = 1, []
    cuts = np.array([longer * p // segments for p in range(segments + 1)])
    while True:
        rows = rows[rows + step < ends[rows]]
        if not len(rows):
            break
        for a in np.array_split(rows, max(1, len(rows) * longer // CELLS)):
            b = a + step
            fit = (full[a] | full[b]) & (same[owner[a]] | (tiles[a] != tiles[b]))
            a, b = a[fit], b[fit]
            head = _common(left[a], left[b])
            tail = _common(right[a], right[b])
            close = (head + tail >= longer - 1) & (head < longer)
            a, b, head, tail = a[close], b[close], head[close], tail[close]
            # parts that would find the pair: all before them in common, and all behind them
            seen = (head[:, None] >= cuts[None, :-1]) & (tail[:, None] >= longer - cuts[None, 1:]) & (cuts[1:] > cuts[:-1])
            first = seen.argmax(1) == part[owner[a]]
            found.append((a[first], b[first]))
        step += 1
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many columns agree before the first that does not; all rows differ or are equal throughout."""
    differ = a != b
    first = differ.argmax(1)
    return np.where(differ.any(1), first, a.shape[1])


def _compare(segments: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = whole.column("longer").to_numpy()
            for longer in np.unique(lengths):
                batch = whole.filter(pa.array(lengths == longer))
                lists = batch.column("words")
                sizes = np.diff(lists.offsets.to_numpy())
                words = lists.flatten().to_pylist()
                counts = batch.column("counts").flatten().to_numpy()
                a, b = near_rows(words, np.repeat(np.arange(len(sizes)), sizes), batch.column("tiles").flatten().to_numpy(),
                                 batch.column("same").to_numpy(zero_copy_only=False), batch.column("part").to_numpy(),
                                 int(longer), segments)
                if len(a):
                    here, there = np.concatenate([a, b]), np.concatenate([b, a])
                    held = pa.array(words, pa.string())
                    yield pa.record_batch([held.take(pa.array(here)), held.take(pa.array(there)), pa.array(counts[here]),
                                           pa.array(counts[there])], ["word", "other", "n", "other_n"])
    return run


def near_words(words: DataFrame, segments: int = SEGMENTS, tile: int = TILE) -> DataFrame:
    """``word``, ``other``, ``n``, ``other_n`` for all near words, in both directions."""
    ship(words.sparkSession)
    return blocks(words, segments, tile).mapInArrow(_compare(segments), "word string, other string, n long, other_n long")


def follow(links: DataFrame) -> DataFrame:
    """``word`` and ``root`` from ``word`` and ``form``: every round doubles the steps taken."""
    reached = stored(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stored(reached.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                F.col("further").isNotNull().alias("moved")), "forms")
        reached = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return reached


def group(words: DataFrame, times: int = TIMES, segments: int = SEGMENTS, tile: int = TILE) -> DataFrame:
    """Per word of ``words`` (``word``, ``n``): ``form``, ``root``, ``n``, ``n_near`` and ``form_n``."""
    words = stored(words, "words")
    per_word = near_words(words, segments, tile).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"),
        F.first("n").alias("n"))
    fits = -F.col("best.less") >= times * F.col("n")
    per_word = stored(per_word.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"),
                                      F.when(fits, -F.col("best.less")).alias("form_n")), "near")
    roots = follow(per_word.where("form IS NOT NULL"))
    return words.join(per_word, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        "form_n")


def oracle_sql(one_in: int, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> str:
    """DuckDB SQL of ``group`` over ``count_words``; the checksum is worked out byte by byte."""
    return f"""
WITH RECURSIVE steps(n, k, c) AS (
    SELECT i, 0, i FROM range(256) AS r(i)
    UNION ALL
    SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS crc FROM steps WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[a-zÀ-ÿ]+')) AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, 'null') || ':' || run)) AS h
        FROM runs WHERE length(run) >= {least_length} GROUP BY doc_id, run),
summed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2),
                lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
                lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM per, tab),
words AS MATERIALIZED (
    SELECT word, sum(n)::BIGINT AS n
    FROM (SELECT CASE WHEN h % {one_in} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                 ELSE run END AS word, n FROM summed)
    WHERE length(word) >= {least_length} GROUP BY word HAVING sum(n) >= {least_count}),
cut AS (SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail
        FROM (SELECT *, unnest(range(length(word)))::INT AS i FROM words)),
near AS (
    SELECT DISTINCT a.word, b.word AS other, b.n FROM cut a JOIN cut b USING (i, head, tail) WHERE a.word <> b.word
    UNION SELECT DISTINCT a.word, b.word, b.n FROM cut a JOIN words b ON a.head || a.tail = b.word
    UNION SELECT DISTINCT b.word, a.word, a.n FROM cut a JOIN words b ON a.head || a.tail = b.word),
best AS (SELECT word, count(*) AS n_near, min(row(-n, encode(other), other)) AS b FROM near GROUP BY word),
formed AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
                  CASE WHEN -b[1] >= {times} * words.n THEN b[3] END AS form,
                  CASE WHEN -b[1] >= {times} * words.n THEN -b[1] END AS form_n
           FROM words LEFT JOIN best USING (word)),
way(word, last) AS (
    SELECT word, word FROM words
    UNION ALL
    SELECT way.word, formed.form FROM way JOIN formed ON way.last = formed.word WHERE formed.form IS NOT NULL),
ends AS (SELECT way.word, last AS root FROM way JOIN formed ON last = formed.word WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
