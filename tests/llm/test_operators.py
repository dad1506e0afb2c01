"""The operators against brute force on small tables, with nulls, repeats, long texts and clashing columns."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabsight.llm import bpe, byte_cnn, decontaminate, language_id, license_scan, ngram_join, quality_rules, queries, sharding, url_rules
from tabsight.llm.components import components
from tabsight.llm.common import train_split

from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm.brute import ascii_lower, jaccard_components, shingle_set, tiktoken_encoding
from tests.oracle_compare import duck, rows_of

ODD = [(1, None, 5), (2, "", 5), (3, "word", 5), (3, "word", 5), (None, "a b c d e f g", 5), (4, "long text of words. " * 20000, 5),
       (5, "\t\n \x0b\f\r", 5), (6, "é ñ 日本 😀 ß", 5)]
ODD_SCHEMA = "doc_id long, text string, n_words int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_matches_oracle(spark, key):
    df = queries.QUERIES[key](spark, SF_CHECK)
    res = duck(SF_CHECK).execute(queries.ORACLES[key])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, res.fetchall())


# ---------------------------------------------------------------- quality rules

def test_quality_rules_on_odd_rows(spark, odd):
    got = quality_rules.judge(odd).select("__row.doc_id", "__row.text", *[c for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]).collect()
    assert len(got) == len(ODD)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        counts = {g: grams.count(g) for g in set(grams)} if len(grams) < 1000 else {g: 2 for g in set(grams)}
        covered = {i + d for i, g in enumerate(grams) if counts[g] > 1 for d in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert quality_rules.keep_good(odd.limit(0)).columns == odd.columns


def test_quality_rules_run_no_python(spark):
    plan = quality_rules.judge(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---------------------------------------------------------------- sharding

def test_shards_on_odd_rows(odd):
    got = sharding.shard_by_bytes(odd, n_shards=3).collect()
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 8 for _, t, _ in ODD)
    assert sorted(r["text_crc32"] for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t, _ in ODD)
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["shard"] for r in ordered] == sorted(r["shard"] for r in got)
    assert sharding.shard_by_bytes(odd.limit(0)).count() == 0


def test_shards_are_near_equal_with_one_hot_id(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
                                    F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    sizes = {r["shard"]: r["s"] for r in sharding.shard_by_bytes(docs, 24).groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2 * 57


# ---------------------------------------------------------------- URL rules

URLS = [(1, "http://WWW.Example.com/en/x?q=1"), (2, "https://a.example.com/en/1"), (3, None), (4, "no scheme"), (5, "x://net"),
        (6, "http://m.b.net/fr/9#t"), (7, "http://b.net/es/"), (8, "http://com"), (9, "http://com/"), (10, "ftp://evilexample.com/en/"),
        (2, "https://a.example.com/en/1"), (11, "http://h.org?u=http://com/"), (12, "")]


def test_host_rules(spark):
    none = spark.createDataFrame([], "rule_id string, tokens array<string>, verdict string, confidence double, support double")
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    got = {r["page_id"]: r for r in url_rules.judge_urls(pages, none, queries.HOST_RULES).collect()}
    expected = {1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/1", "example.com/en/", "block"),
                3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("net", "", None, "allow"),
                6: ("m.b.net", "/fr/9", "net/fr/", "block"), 7: ("b.net", "/es/", "net/es/", "block"), 8: ("com", "", None, "allow"),
                9: ("com", "/", "com/", "allow"), 10: ("evilexample.com", "/en/", "com/", "allow"), 11: ("h.org", "", None, "allow"),
                12: ("", "", None, "allow")}
    assert {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()} == expected
    assert url_rules.judge_urls(pages, none).count() == len(URLS)


def test_mined_rules_against_counts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        host = rng.choice(["spam-farm.example", "news.example", "shop.example"])
        path = rng.choice(["buy", "read"])
        bad = host.startswith("spam") and path == "buy"
        rows.append((f"http://{host}/{path}/{i}", "block" if bad != (rng.random() < 0.05) else "allow"))
    labelled = spark.createDataFrame(rows + [(None, "block"), ("http://x.example/", None)], "url string, label string")
    rules = url_rules.mine_rules(labelled, min_support=0.02, min_confidence=0.7).collect()
    pages = spark.createDataFrame(list(enumerate(u for u, _ in rows)), "page_id long, url string")
    tokens = {r["page_id"]: set(r["t"]) for r in pages.select("page_id", url_rules.url_tokens("url").alias("t")).collect()}
    assert any(r["verdict"] == "block" for r in rules)
    for r in rules:  # support and confidence by counting
        holds = [i for i in tokens if set(r["tokens"]) <= tokens[i]]
        hits = [i for i in holds if rows[i][1] == r["verdict"]]
        assert len(hits) / len(holds) == pytest.approx(r["confidence"]) and r["confidence"] >= 0.7
        assert len(hits) / len(rows) == pytest.approx(r["support"]) and r["support"] >= 0.02
    got = {r["page_id"]: r for r in url_rules.judge_urls(pages, spark.createDataFrame(rules)).collect()}
    for i, t in tokens.items():  # the inverted index finds what a scan of all rules finds
        fit = [(r["confidence"], r["support"], len(r["tokens"]), r["rule_id"], r["verdict"]) for r in rules if set(r["tokens"]) <= t]
        best = max(fit, default=(0, 0, 0, None, "allow"))
        assert (got[i]["mined_rule"], got[i]["verdict"]) == best[3:]
    assert url_rules.mine_rules(labelled.limit(0)).count() == 0


def test_rules_of_a_frequent_label_and_of_many_tokens_are_kept(spark):
    rows = [(f"http://{'farm' if i % 20 else 'news'}.example/{i}", "block" if i % 20 else "allow") for i in range(400)]
    labelled = spark.createDataFrame(rows, "url string, label string")  # 95 % block: no lift reaches 1.1
    rules = url_rules.mine_rules(labelled)
    pages = spark.createDataFrame(list(enumerate(u for u, _ in rows)), "page_id long, url string")
    judged = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, rules).collect()}
    assert judged == {i: label for i, (_, label) in enumerate(rows)}
    for limit in (0, 100_000):  # joined by shuffle, and broadcast
        assert judged == {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, rules, broadcast_rules=limit).collect()}

    rows = []  # blocked when all of five keys are there: a rule of five tokens beats each of four
    for i in range(320):
        keys = [k for j, k in enumerate("abcde") if i % 2 or i >> (j + 1) & 1]
        rows.append((f"http://x.example/?{'&'.join(k + '=1' for k in keys)}", "block" if len(keys) == 5 else "allow"))
    rules = url_rules.mine_rules(spark.createDataFrame(rows, "url string, label string"))
    whole = {tuple(r["tokens"]): r["confidence"] for r in rules.where("verdict = 'block'").collect()}
    assert whole[tuple(f"key:{k}" for k in "abcde")] == 1
    pages = spark.createDataFrame([(1, "http://x.example/?e=2&d&c&b&a")], "page_id long, url string")
    assert url_rules.judge_urls(pages, rules).first()["mined_rule"] == "block key:a key:b key:c key:d key:e"


# ---------------------------------------------------------------- BPE

@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_tokens(queries.VOCABULARY), public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text(alphabet="ab", max_size=400), st.text(alphabet="the rnsé\n", max_size=400),
                 st.builds(lambda s, n: s * n, st.text(min_size=1, max_size=5), st.integers(1, 300))))
def test_tree_encoding_equals_tiktoken(text):
    held = test_tree_encoding_equals_tiktoken.__dict__.setdefault(
        "held", (bpe.Codec(bpe.load_tokens(queries.VOCABULARY), public_tokenizers.PATTERN), tiktoken_encoding()))
    ids = held[0].encode(text)
    assert ids == held[1].encode_ordinary(text)
    assert held[0].decode(ids) == text.encode()


def test_join_is_a_monoid(codec):
    rng = random.Random(5)
    for _ in range(300):
        raw = "".join(rng.choice("abcdenrsth é") for _ in range(rng.randint(0, 80))).encode()
        cuts = sorted(rng.randint(0, len(raw)) for _ in range(2))
        a, b, c = (codec.merge(p) for p in (raw[:cuts[0]], raw[cuts[0]:cuts[1]], raw[cuts[1]:]))
        assert codec.join(codec.join(a, b), c) == codec.join(a, codec.join(b, c)) == codec.merge(raw)


def test_bpe_query_and_odd_rows(spark, odd):
    encoding = tiktoken_encoding()
    coded = bpe.encode(odd.withColumn("ids", F.lit("clash")), queries.VOCABULARY, public_tokenizers.PATTERN)
    back = bpe.decode(coded, queries.VOCABULARY, public_tokenizers.PATTERN).collect()
    assert len(back) == len(ODD)
    for r in back:
        assert r["ids"] == encoding.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(odd.limit(0), queries.VOCABULARY, public_tokenizers.PATTERN).count() == 0
    unknown = spark.createDataFrame([(1, None)], "doc_id int, ids array<int>")
    assert bpe.decode(unknown, queries.VOCABULARY, public_tokenizers.PATTERN).first()["decoded"] is None


# ---------------------------------------------------------------- n-gram join

def near_copies(seed=1, n=60, words=80):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(n // 6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, words))]
        for c in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_jaccard_components_against_all_pairs(spark):
    rows = near_copies() + [(1000, None), (1001, ""), (1002, "x y"), (1003, "X  y\n"), (1004, "a " * 30000)]
    got = {r["doc_id"]: r for r in ngram_join.components_by_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = jaccard_components(dict(rows))
    assert {k: r["component_id"] for k, r in got.items()} == expected
    assert {k: r["n_shingles"] for k, r in got.items()} == {k: len(shingle_set(t)) for k, t in rows}


def test_jaccard_large_group_and_other_thresholds(spark):
    rng = random.Random(2)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(250):  # one large group of near copies
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(120)] = f"u{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 90):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.components_by_jaccard(docs, percent=percent).collect()}
        assert got == jaccard_components(dict(rows), percent)


def test_jaccard_order_counts_reach_the_driver_packed(spark, monkeypatch):
    texts = [" ".join(f"w{(i * 7 + j) % 997}x{j}" for j in range(40)) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen, kind = [], type(docs)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: seen.append(collect(self)) or seen[-1])
    monkeypatch.setattr(kind, "toPandas", lambda self: pytest.fail("a row a range would reach the driver"))
    found = ngram_join.bucket_counts(docs, "text", 5)
    want = np.zeros(1 << ngram_join.ORDER_BITS, np.int64)
    for text in texts:
        np.add.at(want, ngram_join._ranges(ngram_join.shingles(text), ngram_join.ORDER_BITS), 1)
    assert (found == want).all() and (want > 0).sum() > 5_000
    assert sum(len(rows) for rows in seen) <= 50


def test_jaccard_repeated_and_null_ids(spark):
    text = "one two three four five six seven eight"
    rows = [(5, text), (5, text), (5, "quite another text with many other words here"), (None, text), (None, None), (9, None), (3, text + " nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r)[:3] for r in ngram_join.components_by_jaccard(docs).collect()], key=str)
    assert got == sorted([(5, 4, 3), (5, 4, 3), (5, 4, 5), (None, 4, 3), (None, 0, None), (9, 0, 9), (3, 5, 3)], key=str)
    kept = ngram_join.keep_one(docs).collect()
    assert sorted([tuple(r) for r in kept], key=str) == sorted([rows[2], rows[4], rows[5], rows[6]], key=str)
    assert ngram_join.components_by_jaccard(docs.limit(0)).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for group in (range(301), range(1000, 1200), range(2000, 2009)):
        assert len({got[i] for i in group}) == 1
    assert len(set(got.values())) == 3


# ---------------------------------------------------------------- license scan

def test_license_base_against_regex(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()]
    docs += [(-i, t) for i, t in enumerate(["cc by cc by cc-by", "CC BY\n\nMIT License mit license", "accby cc byx", "GNU general\tpublic LICENSE", None, ""], 1)]
    got = {r["doc_id"]: r["s"] for r in spark.createDataFrame(docs, "doc_id long, text string")
           .select("doc_id", license_scan.scan_column(spark).alias("s")).collect()}
    for doc, text in docs:
        words = word.findall(ascii_lower(text or ""))
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            at = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
            places, labels = places + at, labels | ({label} if at else set())
        s = got[doc]
        assert (s["n_words"], s["n_base"], s["first_word"], s["last_word"]) == (
            len(words), len(places), min(places, default=None), max(places, default=None))
        assert s["base_labels"] == sorted(labels) and labels <= set(s["labels"]) and 0 <= s["score"] <= 1


def test_license_prefilter_loses_no_match_and_containment_holds():
    scanner = license_scan.Scanner(license_scan.build_rules())
    assert len(scanner.rules) >= 300
    texts = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
             "SPDX-License-Identifier: GPL-3.0-only", "see https://creativecommons.org/licenses/by-sa/4.0/", "Copyright (c) 2020 X. All rights reserved.",
             "This program is free software; you can redistribute it under the GNU GPL v2", "ofline mplx bsdy"]
    for text in texts:
        lower = text.lower()
        every = [(m.start(), m.end(), r) for r, p in scanner.rules for m in p.finditer(lower) if m.end() > m.start()]
        expected = license_scan._resolve(every)
        assert [(s, e, r.label) for s, e, r in scanner.detections(text)] == [(s, e, r.label) for s, e, r in expected]
        for s, e, r in expected:
            assert not any(o[0] <= s and e <= o[1] and o[2].priority > r.priority for o in every)
    labels = [scanner.scan(t)["labels"] for t in texts]
    assert "apache-2.0" in labels[0] and "mit" in labels[1] and "cc-by-nc-4.0" in labels[2] and labels[-1] == []


NOTICES = {
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee",
    "zlib": "This software is provided 'as-is', without any express or implied warranty.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License)", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl": "This program is free software; you can redistribute it", "copyright": "(c) 2020 X",
    "lgpl-2.1": "released under the terms of the GNU Lesser General Public License version 2.1",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."}


@pytest.mark.parametrize("gap", [" ", "\n", "\r\n  ", "\n * ", "\n *\n * ", "\n# ", "\n// ", "\n-- ", "\n\n"])
def test_wrapped_license_notices_are_found(gap):
    scanner = license_scan.Scanner(license_scan.build_rules())
    for label, notice in NOTICES.items():
        places = [i for i, c in enumerate(notice) if c == " "]
        texts = [notice[:i] + gap + notice[i + 1:] for i in places]  # broken at each place, and at all
        if len(gap) <= 2 or label != "bsd-3-clause":  # whose holder's name has 80 characters at most
            texts.append(notice.replace(" ", gap))
        for text in texts:
            lower = text.lower()
            every = [(m.start(), m.end(), r) for r, p in scanner.rules for m in p.finditer(lower) if m.end() > m.start()]
            assert scanner.detections(text) == license_scan._resolve(every)
            assert label in scanner.scan(text)["labels"], (label, text)
    assert scanner.scan("© 2019 Y")["labels"] == ["copyright"]


# ---------------------------------------------------------------- learned operators

def test_language_id_held_out(spark, odd):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    got = queries.QUERIES["op6_language_id"](spark, SF_CHECK).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.97
    dictionaries = language_id.learn(docs.where(train_split()))
    rows = odd.select("doc_id", "text", language_id.language_column(spark, dictionaries).alias("l")).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r["l"]["lang"] == "und") == (r["text"] is None or not any(c.isalpha() for c in r["text"]))
    nothing = language_id.learn(docs.limit(0))
    assert [r["l"]["lang"] for r in odd.select(language_id.language_column(spark, nothing).alias("l")).collect()] == ["und"] * len(ODD)


def test_quality_classifier_held_out(spark, odd):
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    got = queries.QUERIES["op9_quality_classifier"](spark, SF_CHECK).where("held_out").join(labels, "doc_id").collect()
    good, bad = [[r["score"] for r in got if r["quality"] == k] for k in (1, 0)]
    assert np.mean([g > b for g in good for b in bad]) >= 0.95
    assert np.mean([s >= 0.7 for s in good]) >= 0.97
    model = queries.quality_model(spark, SF_CHECK)
    rows = odd.select("text", byte_cnn.score_column(spark, model).alias("p")).collect()
    assert all(0 <= r["p"] <= 1 and r["p"] == pytest.approx(model.score(r["text"])) for r in rows) and len(rows) == len(ODD)
    empty = byte_cnn.fit(odd, labels.limit(0))
    assert empty.score("x") == 0.5


def test_cnn_covers_every_byte():
    model = byte_cnn.train(["good text here"] * 40 + ["bad #### text"] * 40, [1] * 40 + [0] * 40, epochs=3)
    text = "plain words " * 60000  # several pieces
    whole = model.block_peaks(text.encode())
    assert len(whole) == -(-len(text) // byte_cnn.BLOCK)
    changed = model.block_peaks((text[:-4] + "####").encode())
    assert not np.array_equal(whole[-1], changed[-1]) and np.array_equal(whole[:-2], changed[:-2])


def test_decontamination_finds_planted_items(spark, odd):
    items = [decontaminate.words_of(r["text"]) for r in spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect()]
    ids = [r["item_id"] for r in spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()
    expected = set()
    for r in docs:
        line = b" " + b" ".join(decontaminate.words_of(r["text"])) + b" "
        expected |= {(r["doc_id"], i) for i, w in zip(ids, items) if b" " + b" ".join(w) + b" " in line}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op8_decontamination"](spark, SF_CHECK).collect()}
    assert len(expected & got) >= 0.95 * len(expected) and not got - expected
    benchmark = spark.createDataFrame([(1, "long text of words"), (2, None), (3, "")], "item_id long, text string")
    found = decontaminate.find_leaks(odd, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(4, 1)}
    assert decontaminate.find_leaks(odd.limit(0), benchmark).count() == 0
    assert decontaminate.find_leaks(odd, benchmark.limit(0)).count() == 0


def test_items_beyond_one_search_are_searched_in_parts(spark, monkeypatch):
    benchmark = spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").select("item_id", "text")
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text")
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, benchmark).collect()))
    kept = sorted(map(tuple, decontaminate.drop_leaks(docs, benchmark).collect()))
    assert whole and len(kept) == docs.count() - len({r[0] for r in whole})
    monkeypatch.setattr(decontaminate, "ITEMS", 70)
    monkeypatch.setattr(decontaminate, "HELD", 16)
    assert sorted(map(tuple, decontaminate.find_leaks(docs, benchmark).collect())) == whole
    assert sorted(map(tuple, decontaminate.drop_leaks(docs, benchmark).collect())) == kept


def test_item_weights_are_held_in_bounded_memory():
    rng = np.random.default_rng(2)
    weights = np.ones(decontaminate.FEATURES, np.float32)
    space = rng.normal(size=(decontaminate.FEATURES, 4)).astype(np.float32)
    items = [(i, " ".join(f"w{j}" for j in rng.integers(0, 5000, 40))) for i in range(1500)]
    index = decontaminate.Index(weights, space, items)
    assert index.holds.nbytes <= 512 * 4 * (decontaminate.FEATURES + 1)
    found = index.search([f"before {items[i][1]} after" for i in (3, 700, 1499)])
    assert [{leak[0] for leak in f} for f in found] == [{3}, {700}, {1499}]


def planted_leaks(seed=4):
    """Items of 1 to 60 words, and texts that hold a share of 0.5 to 1 of one, spread over up to 1.5 times its length."""
    rng = random.Random(seed)
    items, texts = [], []
    for n in (1, 2, 3, 4, 5, 7, 12, 20, 23, 24, 32, 40, 60):
        for share in (0.5, 0.6, 0.75, 0.8, 1.0):
            words = [f"w{min(int(rng.expovariate(1 / 60)), 400)}" for _ in range(n)]
            answer = rng.randint(1, max(1, n // 4))
            items.append((len(items), " ".join(words[:n - answer]) + ". " * (answer < n) + " ".join(words[n - answer:])))
            keep = set(range(n - answer, n))  # the answer, and as many others as the share asks
            keep |= set(rng.sample(range(n - answer), max(0, min(n - answer, -int(-share * n // 1) - answer))))
            spare = n + n // 2 - len(keep)
            out = [words[i] for i in sorted(keep)]
            for _ in range(rng.randint(0, spare) if share < 1 else 0):  # the answer stays in one piece
                out.insert(rng.randint(0, max(0, len(out) - answer)), f"w{rng.randrange(400)}")
            around = [[f"w{min(int(rng.expovariate(1 / 60)), 400)}" for _ in range(rng.randint(0, 150))] for _ in range(2)]
            texts.append(" ".join(around[0] + out + around[1]))
    return items, texts


def leaks_by_scan(items, texts):
    """(text, item) by comparing every stretch of every text."""
    found = set()
    for d, text in enumerate(texts):
        there = decontaminate._hashes(decontaminate.words_of(text)).tolist()
        for i, item in items:
            words = decontaminate._hashes(decontaminate.words_of(item)).tolist()
            answer = decontaminate._hashes(decontaminate.words_of(item.split(".")[-1])).tolist()
            n, masks = len(words), {}
            for j, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << j
            for a in range(len(there)):
                lcs = decontaminate._lcs(masks, n, there[a:a + n + n // 2])
                near = there[max(0, a - n):a + n + n // 2 + n]
                if lcs >= (n if n < 5 else 0.75 * n) or n >= 5 and lcs >= 0.5 * n and any(
                        near[k:k + len(answer)] == answer for k in range(len(near))):
                    found.add((d, i))
                    break
    return found


def test_search_finds_every_leak_of_a_brute_force_scan():
    items, texts = planted_leaks()
    df = np.bincount([f for t in texts for f in set(decontaminate._features(decontaminate._hashes(decontaminate.words_of(t))).tolist())],
                     minlength=decontaminate.FEATURES)
    weights = np.log(len(texts) / np.maximum(df, 1) + 1e-9).clip(0.01).astype(np.float32)
    space = np.random.default_rng(1).normal(size=(decontaminate.FEATURES, 56)).astype(np.float32) * weights[:, None]
    index = decontaminate.Index(weights, space, items)
    expected = leaks_by_scan(items, texts)
    assert {(i, i) for i in range(len(items))} & expected and len(expected) > len(items) / 2
    got = {(d, leak[0]) for d, found in enumerate(index.search(texts)) for leak in found}
    assert not expected - got


def test_paraphrased_item_is_found(spark):
    rows = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text").collect()
    item = next(r for r in spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect() if len(r["text"].split()) >= 40)
    words = item["text"].split()
    words[::8] = ["changed"] * len(words[::8])
    planted = [(10 ** 6, rows[0]["text"] + " " + " ".join(words) + " " + rows[1]["text"])]
    docs = spark.createDataFrame([tuple(r) for r in rows] + planted, "doc_id long, text string")
    found = decontaminate.find_leaks(docs, spark.createDataFrame([tuple(item)], "item_id long, text string")).collect()
    assert any(r["doc_id"] == 10 ** 6 and r["share"] < 1 for r in found)


def test_lcs_against_dynamic_programming():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 30))] for _ in range(2))
        masks = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << i
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert decontaminate._lcs(masks, len(a), b) == row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


def test_randomised_space_matches_a_dense_one(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    weights, space = decontaminate.learn_space(docs)
    table = np.zeros((0, decontaminate.FEATURES), np.float32)
    df = np.zeros(decontaminate.FEATURES)
    for r in docs.collect():
        features = decontaminate._features(decontaminate._hashes(decontaminate.words_of(r["text"])))
        df[np.unique(features)] += 1
        rows = [np.bincount(features[i:i + decontaminate.PASSAGE], minlength=decontaminate.FEATURES)
                for i in range(0, len(features), decontaminate.PASSAGE)]
        table = np.vstack([table, *[np.array(rows, np.float32).reshape(-1, decontaminate.FEATURES)]])
    expected = np.log(docs.count() / np.maximum(df, 1) + 1e-9).clip(0.01)
    assert np.allclose(weights, expected, atol=1e-5)
    _, _, right = np.linalg.svd(table * weights, full_matrices=False)
    basis, _ = np.linalg.qr(space / weights[:, None])
    assert np.linalg.norm(basis.T @ right[0]) > 0.98  # the leading direction lies in the learned space


def test_jaccard_rows_under_few_ids(spark):
    """Many rows of one id do not multiply: 2 x 600 rows under an id each are linked as one pair."""
    words = [f"w{i}" for i in range(60)]
    other = words[:-1] + ["changed"]
    rows = [(i % 2, " ".join((words, other)[i % 2])) for i in range(1_200)] + [(7, "some words that stand here alone by themselves")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    docs = [r for r in ngram_join.components_by_jaccard(df).collect()]
    assert len(docs) == 1_201 and {(r["doc_id"], r["component_id"]) for r in docs} == {(0, 0), (1, 0), (7, 7)}
    shingled = ngram_join.prefixes(df, 80, "doc_id", "text", 5)
    classes = ngram_join.link_classes(df, shingled, 80, "doc_id", "text", 5)
    routes = classes.where("id = 0").select("cid", "id", "sig", "many", F.lit(1).cast("long").alias("key"))
    assert routes.first()["many"] and ngram_join._sets(df, routes, "doc_id", "text", 5).count() == 1


def test_jaccard_routes_of_many_keys_are_cut(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    sig = ngram_join._signature(ngram_join.shingles("a b c d e f g h"))
    routes = spark.range(3_000).select(F.col("id").alias("key"), F.lit(5).cast("long").alias("cid"), F.lit(1).cast("long").alias("id"),
                                       F.lit(bytearray(sig)).alias("sig"), F.lit(False).alias("many"))
    made = ngram_join._sets(df, routes, "doc_id", "text", 5)
    assert made.count() == 3_000 and made.select("key").distinct().count() == 3_000


def test_license_rules_on_long_white_space():
    """Long runs of blank lines take time in proportion, and what is found stands where it stood."""
    import time
    scanner = license_scan.Scanner(license_scan.build_rules())
    start = time.time()
    found = scanner.detections("gnu" + "\n " * 500_000 + "general public license" + "\n" * 500_000)
    assert time.time() - start < 5 and {r.label for _, _, r in found} == {"gpl"}
    for run in (" " * 40, "\n" * 40, " \n\t" * 20, "\r\n" * 30, "\n" + " " * 30):
        for text in (f"under the{run}mit license{run}x", f"{run}license: mit", f"word{run}license:{run}apache license", f"a{run}b"):
            every = [(m.start(), m.end(), r) for r, pattern in scanner.rules for m in pattern.finditer(text) if m.end() > m.start()]
            assert scanner.detections(text) == license_scan._resolve(every), repr(text)


def test_license_scan_on_odd_rows(spark, odd):
    rows = odd.select("doc_id", "n_words", license_scan.scan_column(spark).alias("s"))
    assert rows.count() == len(ODD) and rows.limit(0).count() == 0
    assert {r["s"]["n_words"] for r in rows.where("doc_id = 1 OR doc_id = 2").collect()} == {0}
    assert odd.limit(0).select(license_scan.scan_column(spark)).collect() == []


def test_language_learning_is_bounded_by_language(spark):
    rows = [(1, f"text number {i} " * 50, "en") for i in range(3_000)] + [(2, "ein text", "de"), (None, "x", "de"), (3, None, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = [language_id.learn(df.repartition(n)) for n in (1, 5)]
    assert learnt[0] == learnt[1] and list(learnt[0]) == ["en", "de"] and len(learnt[0]["en"]) <= language_id.DICTIONARY_BYTES
    assert language_id.learn(df.limit(0)) == {}


def test_language_sizes_are_those_of_plain_zstandard():
    import zstandard
    words = {"aa": b"the cat sat on the mat and the dog lay there " * 30, "bb": b"der hund lag auf der matte und die katze sass " * 30}
    model = language_id.Classifier(words)
    for text in ("the dog sat on the mat", "die katze lag auf der matte " * 40, "x"):
        raw = language_id.normal(text)
        level = language_id.SHORT_LEVEL if len(raw) <= language_id.SHORT else language_id.LEVEL
        sizes = {}
        for name, content in words.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[name] = sum(len(c.compress(language_id._FILLER + raw[i:i + language_id.CHUNK])) for i in range(0, len(raw), language_id.CHUNK))
        low, high = sorted(sizes.values())
        assert model.classify(text) == (min(sizes, key=sizes.get), (high - low) / high)


def test_answers_are_found_by_their_first_words():
    items = [(1, "aa bb. aa aa"), (2, "cc dd. bb"), (3, "dd ee. aa bb"), (4, "ff gg. hh")]
    index = decontaminate.Index(np.ones(decontaminate.FEATURES, np.float32), np.ones((decontaminate.FEATURES, 4), np.float32), items)
    rng = random.Random(4)
    for size in (1, 2, 500):
        hashes = decontaminate._hashes([rng.choice([b"aa", b"bb", b"cc", b"xx"]) for _ in range(size)])
        starts, upto = index._openings(hashes)
        for (_, _, _, answer), first in zip(index.items, index.opened, strict=True):
            found = decontaminate._stands(hashes, answer, starts[upto[first]:upto[first + 1]])
            assert found.tolist() == decontaminate._stands(hashes, answer).tolist()
