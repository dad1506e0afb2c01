"""The corpus pipeline's stages against brute force on their own inputs."""


import pytest

import corpus_pipeline
from tabsight.llm import byte_cnn, decontaminate, quality_rules
from tabsight.llm.common import read, train_split

from tests.conftest import SF_CHECK
from tests.llm.brute import jaccard_components, tiktoken_encoding
from tests.oracle_compare import duck


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs = read(spark, SF_CHECK, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], SF_CHECK)
        assert out.columns == docs.columns
        kept.append(spark.createDataFrame(out.collect(), docs.schema))
    return kept


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_quality_rules_stage(stages):
    rows = duck(SF_CHECK).execute(quality_rules.oracle_sql()).fetchall()
    assert ids(stages[1]) == sorted(r[0] for r in rows if r[-1])


def test_classifier_stage(spark, stages):
    model = byte_cnn.fit(read(spark, SF_CHECK, "documents"), read(spark, SF_CHECK, "labels").where(train_split()))
    expected = sorted(r["doc_id"] for r in stages[1].collect() if model.score(r["text"]) >= byte_cnn.KEEP_FROM)
    assert ids(stages[2]) == expected
    good = {r["doc_id"] for r in read(spark, SF_CHECK, "labels").where("quality = 1").collect()}
    assert len(good & set(expected)) >= 0.98 * len(good & set(ids(stages[1])))


def test_jaccard_stage(stages):
    rows = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    assert ids(stages[3]) == sorted(set(jaccard_components(rows).values()))


def test_decontamination_stage(spark, stages):
    items = [decontaminate.words_of(r["text"]) for r in read(spark, SF_CHECK, "benchmark").collect()]
    items = [b" " + b" ".join(w) + b" " for w in items]
    leaks = {r["doc_id"] for r in stages[3].collect()
             if any(i in b" " + b" ".join(decontaminate.words_of(r["text"])) + b" " for i in items)}
    assert leaks and set(ids(stages[3])) - set(ids(stages[4])) == leaks


def test_bpe_stage_and_run(spark, stages):
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF_CHECK).collect()}
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    encoding = tiktoken_encoding()
    assert set(rows) == set(texts)
    for doc, text in texts.items():
        assert rows[doc]["ids"] == encoding.encode_ordinary(text)
        assert rows[doc]["n_tokens"] == len(rows[doc]["ids"]) and rows[doc]["round_trip"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `Words` int, kept string, component int, at int"


def test_stages_take_nulls_repeats_and_clashing_columns(spark):
    text = "The old house of the family stood in a valley and it was the one that they had known for long. " * 4
    rows = [(1, text, None, None, None, 1, "x", 2, 3), (1, text, None, None, None, 1, "x", 2, 3), (None, text, "en", "s", 1, 1, "x", 2, 3),
            (None, None, None, None, None, None, None, None, None), (5, "", "en", "s", 0, 1, "x", 2, 3), (6, "one two", "en", "s", 0, 1, "x", 2, 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_CHECK)
        assert out.columns == docs.columns, name
        got = out.collect()
        if name == "ngram_jaccard":  # the row with the smallest id stays, and those without a partner
            assert sorted([r["doc_id"] for r in got], key=str) == [1, 5, 6, None]
        empty = stage(spark, docs.limit(0), SF_CHECK)
        assert empty.count() == 0 and empty.columns == docs.columns
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_CHECK).collect()
    assert len(last) == len(rows) and all(r["round_trip"] for r in last)
