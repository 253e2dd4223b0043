"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pickwell.llm import periodic


def brute_runs(words, least=12):
    """All runs by trying every period and every stretch."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(least, 2 * p):
                best.setdefault((i, length), p)
            i = j
    return sorted((s, l, p) for (s, l), p in best.items())


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, l, p in runs for i in range(s + p, s + l)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2],
        sha("".join(f"{s},{l},{p}\n" for s, l, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def find(*texts):
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    codes = {}
    flat = np.array([codes.setdefault(w, len(codes)) for i in order for w in texts[i]], np.int64)
    got = periodic.find(flat, np.array([len(texts[i]) for i in order], np.int64))
    out = [[] for _ in texts]
    for t, s, l, p in zip(*(x.tolist() for x in got)):
        out[order[t]].append((s, l, p))
    return [sorted(x) for x in out]


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("letters,n", [(1, 60), (2, 40), (2, 200), (3, 120), (9, 300)])
def test_random_words(letters, n):
    rng = random.Random(letters * n)
    texts = [[rng.randrange(letters) for _ in range(rng.randrange(n))] for _ in range(60)]
    for t in texts[::2]:
        if len(t) > 8:
            a, p = rng.randrange(len(t) // 2), rng.randint(1, len(t) // 3)
            t[a:] = [t[a + i % p] for i in range(len(t) - a)]
    assert find(*texts) == [brute_runs(t) for t in texts]


def test_famous_words():
    texts = [thue_morse(300), fibonacci(400), [0] * 77, [], [5] * 11, [5] * 12, [1, 2, 3, 4, 5, 6] * 2, [1, 2, 3, 4, 5, 6] * 2 + [1], list(range(70)) * 2, list(range(70)) * 2 + [0, 1, 9]]
    assert find(*texts) == [brute_runs(t) for t in texts]


def test_time_of_long_texts_grows_in_proportion():
    took = []
    for n in (100_000, 400_000):
        words = np.r_[np.zeros(n // 2, np.int64), np.tile(np.arange(1, 1001), n // 2000)]
        began = time.process_time()
        got = [x.tolist() for x in periodic.find(words, np.array([len(words)]))]
        took.append(time.process_time() - began)
        assert list(zip(*got[1:])) == [(0, n // 2, 1), (n // 2, n // 2, 1000)]
    assert took[1] < 12 * took[0]


def test_query(docs, doc_rows, no_docs):
    got = periodic.periodic_query(docs.withColumn("start", F.lit("other")))
    want = [brute(r[0], r[1] if len(r[1] or "") < 20_000 else r[1]) for r in doc_rows if len(r[1] or "") < 100_000]
    rows = [tuple(r) for r in got.collect()]
    long = {r[0] for r in doc_rows if len(r[1] or "") >= 100_000}
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((r for r in rows if r[0] not in long), key=key) == sorted(want, key=key)
    assert len(rows) == len(doc_rows) and periodic.periodic_query(no_docs).count() == 0
    assert sum(r[1] > 0 for r in rows) >= 5


def test_operator_keeps_columns_and_rows(spark):
    docs = spark.createDataFrame([("a b " * 20 + "c", 1), (None, 2), (None, 2), ("", None)], "body string, n_words int")
    got = periodic.with_runs(docs, "body").collect()
    assert [r.n_words for r in got] == [1, 2, 2, None]
    assert [r.periodic.n_words for r in got] == [41, 0, 0, 0] and [r.periodic.collapsed for r in got] == ["a b c", "", "", ""]
    assert [tuple(x) for x in got[0].periodic.runs] == [(0, 40, 2)]
