"""Toxicity: Viterbi against all paths, the logistic model against its own optimum, held-out labels and planted disguises."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.llm import queries, toxicity

from tests.conftest import SF_CHECK

INSULTS = ["idiot", "moron", "stupid", "pathetic", "worthless"]
SCHEMA = "doc_id long, text string, score string, y int"


@pytest.fixture(scope="module")
def costs():
    rng = random.Random(1)
    words = INSULTS + "the of and to in that is was for with as on this are which from".split()
    return toxicity.costs_of(toxicity.trigram_counts(" ".join(rng.choices(words, k=300)) for _ in range(50)))


def path_cost(text, price, costs):
    a = b = 0
    for c in text + " ":
        z = toxicity._CODE.get(c, 0)
        price += float(costs[a, b, z])
        a, b = b, z
    return price


@pytest.mark.parametrize("stretch", ["1d1ot", "i d i o t", "p@th3t1c", "stuuupid", "m-0-r-o-n", "w0rthle$$", "a1b2", "éé1é", "|!|a", "aaa1bbb"])
def test_viterbi_equals_all_paths(costs, stretch):
    places = toxicity.lattice(stretch)
    every = {}
    for way in itertools.product(*places):
        text = "".join(t for t, _ in way)
        price = path_cost(text, sum(p for _, p in way), costs)
        every[text] = min(price, every.get(text, price))
    found = toxicity.cheapest(places, costs.tolist())
    assert every[found] == pytest.approx(min(every.values()), abs=1e-4)


@pytest.mark.parametrize("written, read", [
    ("1d10t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooooot", "idiot"), ("$tupid", "stupid"), ("m0r0n", "moron"),
    ("w0rthle$$", "worthless"), ("p@thet1c", "pathetic"), ("St*PiD!!", "stupid"), ("M-O-R-O-N", "moron"), ("m o r 0 n", "moron")])
def test_disguises_are_undone(costs, written, read):
    assert toxicity.Restorer(costs).plain(f"so, {written} that is.") == f" so {read} that is "


@pytest.mark.parametrize("text", ["the of and!", "on*** the&&& is###", "ou$$$ in%%%", "226.203.165.104", "", "   ", "of, and; to: in", "日本語 is"])
def test_unmarked_text_stays(costs, text):
    restorer = toxicity.Restorer(costs)
    assert restorer.restore(text) == text.lower() and not restorer.known


def test_long_stretches_in_windows(costs):
    restorer = toxicity.Restorer(costs)
    out = restorer.restore("a1" * 20_000 + "a " + "i d i o t " * 3_000 + "z" * 100_000)
    assert len(out) < 80_000 and out.endswith("z") and max(map(len, restorer.known), default=0) <= toxicity.WINDOW


def test_trigram_counts_over_partitions(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abÀé !1日😀\n", k=rng.randint(0, 30))) for _ in range(60)] + [None]
    want = toxicity.trigram_counts(t for t in texts if t is not None)
    plain = np.zeros_like(want)
    for t in texts:
        codes = [0, 0] + [toxicity._CODE.get(c, 0) for c in (t or "").lower()] + [0, 0]
        if t:
            for a, b, c in zip(codes, codes[1:], codes[2:]):
                plain[(a * toxicity.SIZE + b) * toxicity.SIZE + c] += 1
    apart = sum(toxicity.trigram_counts([t]) for t in texts if t is not None)
    assert (apart == plain).all() and (want == plain).all()
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    one = toxicity.character_costs(docs.coalesce(1))
    assert np.allclose(one, toxicity.costs_of(want)) and np.allclose(np.exp(-one).sum(2), 1, atol=1e-3)


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 5))
    y = (x @ [1, -2, 0, 0.5, 0] + rng.normal(0, 1, 300) > 0.5).astype(float)
    share = rng.uniform(0.5, 2, 300)
    w = toxicity.logistic(x, y, share, penalty=0.3)

    def loss(v):
        z = x @ v[:-1] + v[-1]
        return (share * (np.log1p(np.exp(z)) - y * z)).sum() + 0.15 * (v[:-1] ** 2).sum()

    for i in range(len(w)):
        for step in (-1e-2, 1e-2):
            assert loss(w) <= loss(w + step * np.eye(len(w))[i]) + 1e-9


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(8)
    plain = "the of and to in that is was for with as on this are which from".split()
    rows = []
    for i in range(400):
        words = rng.choices(plain, k=60)
        if i % 5 == 0:
            words[rng.randrange(60)] = rng.choice(INSULTS)
            words[rng.randrange(60)] = rng.choice(INSULTS)
        rows.append((i, " ".join(words), "x", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(400)], "doc_id long, toxic int, text int")
    return docs, labels


def scores(spark, scorer, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["s"] for r in df.select("i", toxicity.score_column(spark, scorer).alias("s")).orderBy("i").collect()]


def test_disguised_insults_are_scored(spark, small):
    docs, labels = small
    scorer = toxicity.fit(docs, labels, toxicity.character_costs(docs))
    clean = "that was for this which are on the of and to"
    long = (clean + " ") * 20_000
    bad = ["you idiot moron " + clean, "1d10t m0r0n " + clean, "i d i o t s t u p i d " + clean, "w0rthless st*pid " + clean]
    found = scores(spark, scorer, [clean, long, None, "", *bad, "idiot moron stupid " + long])
    assert max(found[:4]) < 0.5 and min(found[4:8]) > 0.7 and found[2] == found[3]
    assert found[8] > 10 * found[1]
    assert scores(spark, scorer, [bad[1]] * 3) == [found[5]] * 3


def test_model_does_not_depend_on_the_partitioning(spark, small):
    docs, labels = small
    both = docs.union(docs.limit(50)).union(spark.createDataFrame([(0, "another text of the id", "x", 0), (None, "idiot", "x", 0)], SCHEMA))
    labels = labels.union(spark.createDataFrame([(0, 0, 1), (5, None, 1), (7, 3, 1), (None, 1, 1)], labels.schema))
    made = [toxicity.fit(both.repartition(n), labels.repartition(n), toxicity.character_costs(docs)) for n in (1, 6)]
    assert made[0].pieces == made[1].pieces and np.allclose(made[0].weights, made[1].weights)


def test_without_labels_or_documents(spark, small):
    docs, labels = small
    costs = toxicity.character_costs(docs.limit(0))
    assert np.allclose(np.exp(-costs).sum(2), 1, atol=1e-3)
    assert toxicity.fit(docs, labels.limit(0), costs).constant == 0.5
    assert toxicity.fit(docs, labels.where("toxic = 1"), costs).constant == 1.0
    scorer = toxicity.fit(docs.limit(0), labels, costs)
    assert scorer.constant == pytest.approx(0.2) and scores(spark, scorer, [None, "x"]) == [scorer.constant] * 2
    assert docs.limit(0).select(toxicity.score_column(spark, scorer)).count() == 0


def test_held_out_documents(spark):
    rows = queries.op11_toxicity(spark, SF_CHECK)
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    assert rows.count() == docs.count()
    found = rows.join(spark.read.parquet(f"{SF_CHECK}/labels.parquet"), "doc_id").where("held_out")
    r = found.agg(F.avg(F.when(F.col("toxic") == 0, 1.0 - F.col("predicted"))).alias("clean"),
                  F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("caught")).first()
    assert r["clean"] >= 0.98 and r["caught"] >= 0.6
