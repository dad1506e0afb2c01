"""Spelling variants against edit distances by dynamic programming, and the counts against a plain loop."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from tabsight.llm import spelling

ODD = [(1, None, 3), (2, "", 3), (None, "Received received recieved " * 3, 3), (3, "éÉ×÷ÿÀbcdef " * 6, 3), (3, "éÉ×÷ÿÀbcdef", 3),
       (4, "x" * 70000 + " " + "x" * 69999, 3), (5, "日本語 receive😀received", 3)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_counts(rows, least=6, one_in=None):
    found = Counter()
    for name, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            check = zlib.crc32(f"{'null' if name is None else name}:{run}".encode())
            if one_in and check % one_in == 0:
                run = run[:check % len(run)] + run[check % len(run) + 1:]
            if len(run) >= least:
                found[run] += 1
    return found


def plain_group(counts, times=5):
    near = {w: [o for o in counts if abs(len(o) - len(w)) < 2 and distance(w, o) == 1] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-counts[o], o))
            if counts[best] >= times * counts[w]:
                form[w] = best
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None)
    return out


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("one_in", [None, 3])
def test_counts(spark, one_in):
    rows = ODD + [(n, "Accommodate accomodate ACCOMMODATION accommodate", 3) for n in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(5)
    found = {r["word"]: r["n"] for r in spelling.count_words(df, least_count=2, one_in=one_in).collect()}
    assert found == {w: n for w, n in plain_counts([r[:2] for r in rows], one_in=one_in).items() if n >= 2}


def test_no_words(spark):
    df = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    for rows in (df, df.limit(0)):
        assert spelling.group(spelling.count_words(rows, least_count=1)).collect() == []


@pytest.mark.parametrize("tile", [2, 5, 512])
def test_groups_equal_plain_version(spark, tile):
    rng = random.Random(11)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(260)}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababa", "ababababa", "x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499}
    counts = {w: rng.choice([5, 6, 24, 25, 30, 130, 700, 4000]) for w in sorted(words)}
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long").repartition(3)
    assert got(spelling.group(df, tile=tile)) == plain_group(counts)


def test_each_pair_once(spark):
    words = ["aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "abaaaa", "aaaaaaaa"]
    df = spark.createDataFrame([(w, 9) for w in words], "word string, n long")
    pairs = [(r["word"], r["other"]) for r in spelling.near_words(df).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if distance(a, b) == 1}


def test_ties_and_chains(spark):
    counts = {"grouping": 100, "groupinga": 20, "groupingab": 4, "groupingb": 20, "groupings": 100, "xgrouping": 100}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = got(spelling.group(df))
    assert found == plain_group(counts)
    assert found["groupingab"][:2] == ("groupinga", "grouping")


def test_hot_block_is_dealt_in_tiles(spark):
    words = [f"common{a}{b}{c}" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefgh"]
    df = spark.createDataFrame([(w, 7) for w in words], "word string, n long")
    sizes = [len(r["words"]) for r in spelling.blocks(df, tile=32).collect()]
    assert max(sizes) < 4 * 32
    found = spelling.near_words(df, tile=32).groupBy("word").count().collect()
    assert {r["count"] for r in found} == {9 + 9 + 7} and len(found) == 800


@given(st.lists(st.text("ab", min_size=5, max_size=7), min_size=2, max_size=14, unique=True), st.integers(1, 6))
@settings(max_examples=80, deadline=None)
def test_rows_by_hypothesis(words, segments):
    import numpy as np
    longest = max(map(len, words))
    words = [w for w in words if len(w) >= longest - 1]
    pairs = set()
    for part in range(segments):
        if longest * part // segments == longest * (part + 1) // segments:
            continue
        a, b = spelling.near_rows(words, np.zeros(len(words), int), np.zeros(len(words), int), np.ones(1, bool),
                                  np.array([part]), longest, segments)
        new = {frozenset((words[i], words[j])) for i, j in zip(a, b, strict=True)}
        assert not new & pairs
        pairs |= new
    assert pairs == {frozenset((v, w)) for v in words for w in words if longest in (len(v), len(w)) and distance(v, w) == 1}
