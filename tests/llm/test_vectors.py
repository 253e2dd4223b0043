"""Exact top-k and embedding near-duplicates against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from pickwell.llm import topk, vecdup


def make_vectors(n=260, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(0, 1, dim)
        if i % 4 == 1 and rows:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(0, 0.12, dim)
        if i % 9 == 2:
            v = np.array(rows[0][1])
        rows.append((i * 5, v.astype(np.float32).tolist(), int(i % 3)))
    bad = [None, [None] + [0.1] * (dim - 1), [float("nan")] * dim, [float("inf")] * dim, [0.0] * dim, [], [1.0, 2.0], [1e-30] * dim]
    rows += [(5000 + 50 * i, v, 0) for i, v in enumerate(bad)]
    rows += [(6000, rows[0][1], None), (6050, rows[0][1], 0)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, score string"


@pytest.fixture(scope="module")
def rows():
    return make_vectors()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [topk.BLOCK_VALUES, 300])
def test_topk(table, rows, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_VALUES", block)
    w = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v, _ in rows if usable(v)}
    want = set()
    for q in (i for i in w if i % 50 == 0):
        score = {}
        for i, v in w.items():
            d = min(len(v), len(w[q]))
            score[i] = int(v[:d] @ w[q][:d])
        best = sorted((i for i in w if i != q), key=lambda i: (-score[i], i))[:5]
        want |= {(q, k + 1, i, score[i]) for k, i in enumerate(best)}
    assert {tuple(r) for r in topk.topk_query(table).collect()} == want


def test_topk_of_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0], 1, ""), (50, [1.0], 1, ""), (50, [1.0], 1, "")], SCHEMA)
    hits = [(0, 1, 50, 65536), (0, 2, 50, 65536)] + 2 * [(50, 1, 0, 65536)] + 2 * [(50, 2, 50, 65536)]
    assert sorted(map(tuple, topk.topk_query(few).collect())) == hits
    assert topk.topk_query(few.limit(0)).count() == 0


def brute(rows, threshold):
    links = {k: set() for k in range(len(rows))}
    for a, (_, x, la) in enumerate(rows):
        for b, (_, y, lb) in enumerate(rows[:a]):
            if la is None or la != lb or not usable(x) or not usable(y) or len(x) != len(y) or not any(x) or not any(y):
                continue
            x_, y_ = np.array(x, np.float64), np.array(y, np.float64)
            if x_ @ y_ / np.sqrt(x_ @ x_) / np.sqrt(y_ @ y_) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = set()
    for a in links:
        seen, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        root = min(rows[b][0] for b in seen)
        out.add((rows[a][0], len(links[a]), root, rows[a][0] == root))
    return out


@pytest.mark.parametrize("chunk,leaf", [(vecdup.CHUNK, vecdup.LEAF), (16, 4)])
def test_near_duplicates(table, rows, monkeypatch, chunk, leaf):
    monkeypatch.setattr(vecdup, "CHUNK", chunk)
    monkeypatch.setattr(vecdup, "LEAF", leaf)
    got = {tuple(r) for r in vecdup.vecdup_query(table).collect()}
    want = brute(rows, 0.93)
    assert got == want and sum(n for _, n, *_ in want) > 100


def test_ids_that_repeat_or_are_missing(spark):
    """Links follow the vectors; an id may stand on several of them or on none."""
    turn = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    rows = [(7, turn(0), 1), (7, turn(90), 1), (5, turn(15), 1), (None, turn(15), 1), (None, turn(80), 1), (None, turn(200), 1), (9, turn(90), 1), (None, None, 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = sorted(map(str, map(tuple, vecdup.vecdup_query(table).collect())))
    want = [(7, 2, 5, False), (7, 2, 7, True), (5, 2, 5, True), (None, 2, 5, False), (None, 2, 7, False), (None, 0, None, True), (9, 2, 7, False), (None, 0, None, True)]
    assert got == sorted(map(str, want))


def test_rows_sent_grow_in_proportion(spark, monkeypatch):
    """One label of groups of near copies: blocks that lie apart do not meet, so twice the rows send about twice."""
    monkeypatch.setattr(vecdup, "CHUNK", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (400, 4))
    found = []
    for n in (2000, 4000):
        x = centres[np.arange(n) % (n // 10)] + rng.normal(0, 0.02, (n, 4))
        rows = spark.createDataFrame([(1, (False, i, i), 1, v) for i, v in enumerate(x.tolist())], "group long, node struct<none boolean, id long, number long>, weight long, vector array<double>")
        eps = np.sqrt(2 - 2 * 0.999)
        placed = vecdup.sequence(rows, np.eye(4), 4, eps)
        goes = vecdup.run_pairs(placed, 4, eps)
        near = vecdup._between(["p0", "p1", "p2", "p3"], "low", "high") <= eps * eps
        found.append(placed.join(goes, "run").filter(near).count())
    assert found[1] < 2.6 * found[0]


def test_forest_joins_what_is_linked():
    rng = np.random.default_rng(5)
    forest, parts = vecdup.Forest(60), [{i} for i in range(60)]
    for _ in range(12):
        i, j = rng.integers(0, 60, 4), rng.integers(0, 60, 4)
        forest.add(i, j)
        for a, b in zip(i, j):
            joined = next(p for p in parts if a in p) | next(p for p in parts if b in p)
            parts = [p for p in parts if not p & joined] + [joined]
    assert len(forest.edges) == 60 - len(parts)
    assert all(len({forest.root[v] for v in p}) == 1 for p in parts) and len(set(forest.root)) == len(parts)


def test_no_vectors(table):
    assert vecdup.vecdup_query(table.limit(0)).count() == 0


def test_large_components_and_ties(spark):
    """Scores near 2**55, where a number for score and place together would not fit; ties of thousands."""
    rng = np.random.default_rng(7)
    x = rng.integers(-(2**27), 2**27, size=(3000, 3)).tolist() + [[5, 5, 5]] * 3000
    table = spark.createDataFrame(list(enumerate(x)), "id long, weights array<long>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(table.filter("id % 1500 = 0"), table, 5).collect())
    want = []
    for q in range(0, 6000, 1500):
        scores = [sum(a * b for a, b in zip(x[q], v)) for v in x]
        best = sorted((j for j in range(6000) if j != q), key=lambda j: (-scores[j], j))[:5]
        want += [(q, r, j, scores[j]) for r, j in enumerate(best, 1)]
    assert got == want


@pytest.mark.parametrize("block", [topk.BLOCK_VALUES, 40])
def test_topk_of_ids_that_repeat(spark, monkeypatch, block):
    """Every row but the query's own is a candidate, also those of its id; rows without id take no part."""
    monkeypatch.setattr(topk, "BLOCK_VALUES", block)
    rng = np.random.default_rng(11)
    rows = [(int(rng.integers(0, 8)) * 25, rng.integers(-3, 4, 4).astype(float).tolist(), 1, "") for _ in range(90)]
    got = topk.topk_query(spark.createDataFrame([*rows, (None, [9.0] * 4, 1, "")], SCHEMA).repartition(4)).collect()
    want = []
    for a, (q, x, *_) in enumerate(rows):
        if q % 50 == 0:
            scores = sorted((-int(256 * 256 * np.dot(x, y)), i) for b, (i, y, *_) in enumerate(rows) if b != a)
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_scores_beyond_64_bits_are_an_error_and_wrapping_sums_are_none(spark):
    big = 2**40
    fits = spark.createDataFrame([(0, [big, big, 1]), (1, [big, -big, 3])], "id long, weights array<long>")
    (row,) = topk.top_k(fits.filter("id = 0"), fits, 5).collect()
    assert (row.vec_id, row.score) == (1, 3)
    over = spark.createDataFrame([(0, [big]), (1, [big])], "id long, weights array<long>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(over, over, 5).collect()
