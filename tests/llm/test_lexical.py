"""Ranked lexical search against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pickwell.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "alpha Beta gamma delta eps zeta eta theta iota kappa Lambda mu nü xi pi rho sigma tau".split()


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    """Rows of all items; equal documents stay apart."""
    bags = [(i, Counter(split(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    big_n, big_l = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b, n in bags:
            m = 100 - 50 + 50 * n * big_n // big_l
            own = {t for t in split(text) if t in b}
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in own)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def made(n, seed):
    rng = random.Random(seed)
    weights = [1 / (j + 1) for j in range(len(WORDS))]
    return [" ".join(rng.choices(WORDS, weights, k=rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(i, t) for i, t in enumerate(made(900, 1))]
    docs += [(5, docs[5][1]), (None, docs[6][1]), (None, None), (2000, ""), (2001, "rare rare\tRARE-common"), (2002, "mu " * 5000 + "rare")]
    items = [(i, t) for i, t in enumerate(made(60, 2))] + [(100, None), (101, "!? --"), (102, "RARE rare"), (102, "absent"), (None, "rare mu")]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    return docs, items, *frames


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("k,block", [(50, {}), (3, {"most": 7}), (5, {"most_terms": 10})])
def test_equals_brute_force(tables, k, block):
    docs, items, d, i = tables
    assert rows(lexical.ranked(d, i, k, **block)) == sorted(brute(docs, items, k), key=str)


def test_made_documents(docs, doc_rows, spark, no_docs):
    items = [(i, r[1]) for i, r in enumerate(doc_rows[:20])]
    table = spark.createDataFrame(items, "item_id int, text string").withColumn("rank", F.lit("own"))
    got = lexical.lexical_query(docs, table)
    assert dict(got.dtypes) == {"item_id": "int", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert rows(got) == sorted(brute([(r[0], r[1]) for r in doc_rows], items), key=str)
    assert lexical.lexical_query(no_docs, table).count() == 0 and lexical.lexical_query(docs, table.limit(0)).count() == 0


def blocks(n, seed, per=40):
    """Documents on topics, each with terms of its own, as arrays."""
    rng = np.random.default_rng(seed)
    topics = rng.integers(0, 40, n)
    codes = [np.unique(t * 50 + rng.integers(0, 50, per)) for t in topics]
    ends = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
    return lexical.Docs(np.arange(n), np.zeros(n, bool), np.concatenate(codes), rng.integers(1, 10**6, ends[-1]).astype(float), ends)


def test_whole_batches_are_pruned_without_loss():
    docs, rng = blocks(4096, 0), np.random.default_rng(1)
    weight = rng.integers(1, 20_000, 2000)
    items = [np.unique(t * 50 + rng.integers(0, 50, 20)) for t in rng.integers(0, 40, 64)]
    search = lexical.Search(lexical.item_tree(items, weight), items, weight, np.zeros(64, np.int64), 10)
    search.add(docs)
    assert search.scored < 0.2 * 64 * 4096
    dense = np.zeros((4096, 2000))
    dense[np.repeat(np.arange(4096), np.diff(docs.ends)), docs.codes] = docs.impacts
    for i, own in enumerate(items):
        scores = dense[:, own] @ weight[own]
        want = np.lexsort((np.arange(4096), -scores))[:10]
        assert search.best[i][1].tolist() == want[scores[want] > 0].tolist()


def test_scores_beyond_double_precision():
    docs = lexical.Docs(np.arange(3), np.zeros(3, bool), np.array([0, 1, 0, 1, 0, 1]), np.array([999_999.0, 7, 999_999, 8, 999_999, 6]), np.array([0, 2, 4, 6]))
    weight = np.array([9 * 10**12, 1])
    search = lexical.Search(lexical.item_tree([np.array([0, 1])], weight), [np.array([0, 1])], weight, np.zeros(1, np.int64), 2)
    search.add(docs)
    assert search.best[0][1].tolist() == [1, 0] and search.best[0][0].tolist() == [999_999 * 9 * 10**12 + 8, 999_999 * 9 * 10**12 + 7]
