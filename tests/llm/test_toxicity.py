from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pickwell.llm import toxicity
from tests.llm.made import words


def texts_with_pairs(n=600, seed=4):
    """Toxic only if an insult and a group come together; either alone is clean."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = words(rng, "en", rng.randint(5, 30)) + ["scum"] * insult + ["tribe"] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(insult and group)))
    return rows


def test_pairs_mean_what_neither_means_alone():
    rows = texts_with_pairs(1200)
    own, values = toxicity.terms(pa.array([t for _, t, _ in rows]))
    parts = [values[own == i] for i in range(len(rows))]
    labels = np.array([y for *_, y in rows], float)
    model = toxicity.fit(parts[:900], labels[:900], epochs=20)
    found = model.score(pa.array([t for _, t, _ in rows[900:]])) >= 0.5
    assert np.mean(found == labels[900:]) > 0.88


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(2)
    own, values = toxicity.terms(pa.array(["a b c", "b x", ""]))
    keys = np.unique(values)
    model = toxicity.FactorModel(-0.3, keys, rng.normal(0, 1, (len(keys), 4)).astype(np.float32))
    got = model.score(pa.array(["a b c", "b x", "", None, "unknown"]))
    for i in range(3):
        at = np.searchsorted(keys, values[own == i])
        w, v = model.weights[at, 0].astype(float), model.weights[at, 1:].astype(float)
        logit = -0.3 + w.sum() + sum(v[a] @ v[b] for a in range(len(at)) for b in range(a))
        assert np.isclose(got[i], 1 / (1 + np.exp(-logit)), atol=1e-6)
    assert np.allclose(got[2:], 1 / (1 + np.exp(0.3)))


def test_query(spark, docs, no_docs, doc_rows):
    toxic = texts_with_pairs(300)
    table = spark.createDataFrame([(i + 1000, t) for i, t, _ in toxic] + [(r[0], r[1]) for r in doc_rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i + 1000, y, "x") for i, _, y in toxic] + [(5, None, "x"), (6, 7, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity_query(table, labels).collect()
    assert len(got) == 300 + len(doc_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.score for r in toxicity.toxicity_query(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_query(no_docs, labels).count() == 0


def test_the_limit_of_the_sample_keeps_the_shares_of_the_classes(spark):
    """Words that say nothing of the class: the score is the share of toxic rows, cut (300 of 2,400 clean ones) or not."""
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, "en", 8)), int(i % 9 == 0)) for i in range(2700)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    plain = pa.array([None, "nothing known"])

    def logit(max_rows, table=table):
        score = toxicity.learn(table, table.select("doc_id", "toxic"), max_rows=max_rows).score(plain)
        return np.log(score / (1 - score))

    whole, cut = logit(3000), logit(300)
    assert np.all(np.abs(cut - whole) < 0.7)
    clean = table.filter("toxic = 0").withColumn("doc_id", F.col("doc_id") + 10_000)
    assert np.all(np.abs(logit(300, table.unionByName(clean)) - cut + np.log(2)) < 0.7)
    assert toxicity.rate_ratio({0: 800, 1: 100}, {0: 100, 1: 100}) == np.log(8)
    assert toxicity.rate_ratio({0: 800}, {0: 100, 1: 0}) == toxicity.rate_ratio({0: 5, 1: 2}, {0: 5, 1: 2}) == 0
