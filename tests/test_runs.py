"""Top-k over runs with bounds: the same hits as a plain scan, with most rows left unread."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from pickwell.operators import runs, topk
from pickwell.operators.runs import Bounds, read_runs, top_k_runs, write_runs
from pickwell.operators.topk import top_k
from tests.test_topk import brute, got, tables

WAYS = [{}, {"max_query_bytes": 0, "query_block_rows": 9}]


def clustered(rng, n, dim=12, centers=20, spread=0.03):
    c = rng.normal(size=(centers, dim))
    return c[rng.integers(0, centers, n)] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("k", [1, 10, 900])
def test_equals_brute_force(spark, tmp_path, way, k):
    rng = np.random.default_rng(11)
    x = clustered(rng, 800)
    x[100:400] = x[0]  # a third of all rows are copies
    q = np.vstack([x[[0, 5, 500]], rng.normal(size=(20, 12)), np.zeros((1, 12))])
    queries, items = tables(spark, q, x)
    write_runs(items, path := str(tmp_path / "runs"), run_rows=16, file_rows=200)
    assert got(top_k_runs(queries, path, k, **way)) == sorted(brute(q, x, list(range(800)), k))


def test_most_rows_are_skipped_where_vectors_lie_in_clusters(spark, tmp_path):
    rng = np.random.default_rng(12)
    x = clustered(rng, 4000)
    # three queries, twenty clusters
    queries, items = tables(spark, x[:3], x)
    write_runs(items, path := str(tmp_path / "runs"), run_rows=32, file_rows=1000)
    report = []
    assert got(top_k_runs(queries, path, 5, report=report)) == got(top_k(queries, items, 5))
    assert len(report) == 1 and report[0] >= 0.8
    stored = read_runs(spark, path)
    assert stored.count() == 4000 and stored.select("run").distinct().count() == stored.filter("centroid IS NOT NULL").count()
    sizes = [r.rows for r in stored.filter("rows IS NOT NULL").select("rows").collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 32


def test_bounds_hold(spark):
    rng = np.random.default_rng(13)
    x, q = rng.normal(size=(50, 7)) * 100, rng.normal(size=(30, 7))
    c = x.mean(0)
    reach = Bounds(q).of(c[None], np.array([np.linalg.norm(x - c, axis=1).max()]))[:, 0]
    assert (reach >= (q @ x.T).max(1)).all()


def test_text_ids_odd_vectors_and_empty_sides(spark, tmp_path):
    x = np.array([[1.0, 0], [1, 0], [0, 1], [np.nan, 1], [np.inf, 0]])
    queries, items = tables(spark, np.array([[1.0, 0], [np.nan, 0]]), x, ["b", "a", "é", "n", "i"], "string")
    write_runs(items, path := str(tmp_path / "runs"))
    assert got(top_k_runs(queries, path, 2)) == [(0, "a", 1, 1.0), (0, "b", 2, 1.0)]
    assert top_k_runs(queries.limit(0), path, 2).df.count() == 0
    write_runs(items.limit(0), path := str(tmp_path / "none"))
    assert top_k_runs(queries, path, 2).df.count() == 0


def test_many_queries_are_bounded_and_scored_in_turn(monkeypatch):
    """Neither bounds nor scores of all queries are held at once."""
    monkeypatch.setattr(runs, "_BOUND_CELLS", 40)
    monkeypatch.setattr(topk, "_QUERIES_AT_ONCE", 7)
    rng = np.random.default_rng(14)
    q, x, c = (rng.normal(size=(n, 5)) for n in (23, 60, 9))
    bounds = Bounds(q)
    parts = list(bounds.parts(9))
    sizes = [bounds.of(c, np.ones(9), p).shape for p in parts]
    assert max(a * b for a, b in sizes) <= 40
    assert np.allclose(np.vstack([bounds.of(c, np.ones(9), p) for p in parts]), bounds.of(c, np.ones(9)))
    seen, whole = [], topk._Best._add_block
    monkeypatch.setattr(topk._Best, "_add_block", lambda self, ids, mat, own: seen.append(len(self.q64[own])) or whole(self, ids, mat, own))
    best = topk._Best(pa.array(np.arange(23), pa.int32()), q.astype(np.float32), 4, np.full(23, -np.inf))
    vectors = pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))
    best.add(pa.array(np.arange(30)), vectors.slice(0, 30))
    best.add(pa.array(np.arange(30, 60)), vectors.slice(30), np.flatnonzero(np.arange(23) != 5))
    (batch,) = best.batches()
    hits = sorted(zip(*(batch.column(n).to_pylist() for n in ("qid", "item_id"))))
    want = sorted(h[:2] for h in brute(q, x, list(range(60)), 4))
    assert max(seen) <= 7 and [h for h in hits if h[0] != 5] == [h for h in want if h[0] != 5]
