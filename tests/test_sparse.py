"""Top-k of sparse vectors against brute force, and what MaxScore leaves out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pickwell.functions import vectors as V
from pickwell.operators.sparse import BestSparse, Postings, _parts, top_k_sparse
from pickwell.operators.topk import top_k
from registry.queries import QUERIES
from tests.test_topk import got

KIND = "array<struct<bucket:int,weight:float>>"
WAYS = [{}, {"seed_tasks": 2}, {"max_query_bytes": 0, "query_block_rows": 6}]


def random_vectors(rng, n, dim=1 << 18, hot=5, signed=False):
    """Lists in which some buckets are in nearly all of them."""
    out = []
    for _ in range(n):
        buckets = {int(b) for b in rng.integers(0, hot, rng.integers(0, 4))} | {int(b) * 1000 + 7 for b in rng.zipf(1.3, rng.integers(0, 12)) if b < 200}
        weights = rng.random(len(buckets)).astype(np.float32) - (0.4 if signed else 0)
        out.append(sorted(zip(buckets, weights.tolist())))
    return out


def dense(vectors):
    return [dict(v) for v in vectors]


def brute(q, x, ids, k):
    rows = []
    for i, own in enumerate(dense(q)):
        sims = [round(sum(np.float32(w) * float(np.float32(d[b])) for b, w in sorted(own.items()) if b in d), 9) + 0.0 for d in dense(x)]
        best = sorted(range(len(ids)), key=lambda j: (-sims[j], ids[j]))[:k]
        rows += [(i, ids[j], r + 1, sims[j]) for r, j in enumerate(best)]
    return rows


def same(a, b):
    assert [r[:3] for r in a] == [r[:3] for r in b]
    assert np.allclose([r[3] for r in a], [r[3] for r in b], atol=1.1e-9)


def tables(spark, q, x, ids=None, kind="bigint"):
    ids = ids or list(range(len(x)))
    queries = spark.createDataFrame(list(enumerate(q)), f"qid int, qvec {KIND}")
    return queries, spark.createDataFrame(list(zip(ids, x)), f"item_id {kind}, embedding {KIND}").repartition(4)


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("k,signed", [(1, False), (7, True), (7, False), (400, False)])
def test_equals_brute_force(spark, way, k, signed):
    rng = np.random.default_rng(k)
    x, q = random_vectors(rng, 300, signed=signed), random_vectors(rng, 14, signed=signed)
    x[50:150] = [x[3]] * 100
    queries, items = tables(spark, q, x)
    same(got(top_k_sparse(queries, items, k, **way)), sorted(brute(q, x, list(range(300)), k)))


def test_hot_buckets_are_probed_by_segments(spark):
    """Every item has the hot bucket; only few entries are looked at once the best are known."""
    rng = np.random.default_rng(2)
    n = 20_000
    x = [[(0, 0.1 + 0.01 * float(rng.random())), (int(rng.integers(1, 3000)), 1.0)] for _ in range(n)]
    for v in x:
        v.sort()
    ends = np.arange(0, 2 * n + 1, 2)
    buckets, weights = np.array([b for v in x for b, _ in v]), np.array([w for v in x for _, w in v])
    terms = np.array([0, 2]), np.array([0, 17]), np.array([0.3, 1.0])
    best = BestSparse(terms, np.array([1.0]), 3)
    import pyarrow as pa

    best.add(pa.array(np.arange(n)), ends, buckets, weights)
    assert best.added < 100 and best.probed < 100
    (batch,) = best.batches()
    scores = np.array([sum(w * {0: 0.3, 17: 1.0}.get(b, 0) for b, w in v) for v in x])
    assert batch.column("item_id").to_pylist() == np.argsort(-scores, kind="stable")[:3].tolist()
    postings = Postings(ends, buckets, weights)
    assert len(postings.segment) >= n // 128 and postings.most.max() == 1.0


@pytest.mark.parametrize("way", WAYS)
def test_missing_odd_and_empty_vectors(spark, way):
    nan = float("nan")
    x = [[(1, 1.0)], None, [(1, nan)], [], [(2, 1.0)], [(1, float("inf"))]]
    q = [[(1, 1.0)], None, [(1, nan)], []]
    queries, items = tables(spark, q, x, ["b", "n", "m", "c", "a", "i"], "string")
    assert got(top_k_sparse(queries, items, 9, **way)) == [
        (0, "a", 2, 0.0), (0, "b", 1, 1.0), (0, "c", 3, 0.0), (3, "a", 1, 0.0), (3, "b", 2, 0.0), (3, "c", 3, 0.0),
    ]
    assert top_k_sparse(queries.limit(0), items, 2, **way).df.count() == 0
    assert top_k_sparse(queries, items.limit(0), 2, **way).df.count() == 0


def test_agrees_with_dense_vectors(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(150)
    asked = texts.limit(20)
    both = []
    for encoder, search in ((V.HashEncoder(512), top_k), (V.SparseHashEncoder(512), top_k_sparse)):
        items = texts.select(F.col("doc_id").alias("item_id"), encoder(F.col("text")).alias("embedding"))
        queries = asked.select(F.col("doc_id").cast("int").alias("qid"), encoder(F.col("text")).alias("qvec"))
        both.append(got(search(queries, items, 5)))
    same(*both)


def test_texts_are_hashed_in_parts_of_bounded_size():
    texts = pa.array(["a b"] * 1500 + ["c" * 3_000_000, "d" * 3_000_000, "e" * 9_000_000, "", "f"])
    parts = list(V._text_parts(texts))
    assert [len(p) for p in parts] == [1024, 477, 1, 1, 2]
    assert pa.concat_arrays(parts).equals(texts)


def test_encoding_runs_once_a_text(spark, sf_dir):
    plan = QUERIES["sparse_encode"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_postings_are_made_of_bounded_numbers_of_entries():
    n = 1_500_000
    cells = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(n, dtype=np.int32), 2)), pa.array(np.ones(2 * n, np.float32))], ["bucket", "weight"])
    lists = pa.ListArray.from_arrays(pa.array([0, n, 2 * n], pa.int32()), cells)
    batch = pa.record_batch([pa.array([1, 2]), lists], ["item_id", "embedding"])
    assert [p.num_rows for p in _parts(batch)] == [1, 1]
