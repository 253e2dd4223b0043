from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pickwell.functions import vectors as V
from pickwell.operators import joins, topk
from pickwell.operators.joins import gather_items, restrict_to, salted_join
from pickwell.operators.topk import Hits, require_same_dims, top_k

VECTORS = "array<float>"


def tables(spark, q, x, ids=None, kind="bigint"):
    ids = ids if ids is not None else list(range(len(x)))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], f"qid int, qvec {VECTORS}")
    items = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], f"item_id {kind}, embedding {VECTORS}")
    return queries, items.repartition(5)


def brute(q, x, ids, k):
    sims = np.round(q.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float).T, 9) + 0.0
    out = []
    for i, row in enumerate(sims):
        best = sorted(range(len(ids)), key=lambda j: (-row[j], ids[j]))[:k]
        out += [(i, ids[j], r + 1, row[j]) for r, j in enumerate(best)]
    return out


def got(hits):
    return sorted((r.qid, r.item_id, r["rank"], r.similarity) for r in hits.df.collect())


WAYS = [{}, {"seed_tasks": 2}, {"max_query_bytes": 0, "query_block_rows": 7, "seed_tasks": 3}]


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("k", [1, 7, 500])
def test_equals_brute_force(spark, way, k):
    rng = np.random.default_rng(3)
    q, x = rng.normal(size=(23, 16)), rng.normal(size=(200, 16))
    queries, items = tables(spark, q, x)
    assert got(top_k(queries, items, k, **way)) == sorted(brute(q, x, list(range(200)), k))


def test_the_size_of_few_hits_is_known(spark):
    queries, items = tables(spark, np.ones((3, 2)), np.ones((9, 2)))
    assert top_k(queries, items, 5).max_bytes == 5 * (3 * 4 + 3 * 40)
    assert top_k(queries, items.withColumn("item_id", F.col("item_id").cast("string")), 5).max_bytes is None
    assert top_k(queries, items, 5, **WAYS[2]).max_bytes is None


@pytest.mark.parametrize("way", WAYS)
def test_copies_holding_a_third_of_all_rows_rank_by_id(spark, way):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    x[100:200] = x[0]
    q = np.vstack([x[0], -x[0], rng.normal(size=(3, 8))])
    queries, items = tables(spark, q, x)
    assert got(top_k(queries, items, 10, **way)) == sorted(brute(q, x, list(range(300)), 10))


@pytest.mark.parametrize("way", WAYS)
def test_text_ids_sort_like_sql_strings(spark, way):
    x = np.ones((6, 4))
    ids = ["b", "a", "é", "Z", "a/1", "z"]
    queries, items = tables(spark, x[:1], x, ids, "string")
    order = [r.item_id for r in sorted(top_k(queries, items, 6, **way).df.collect(), key=lambda r: r["rank"])]
    assert order == [r.item_id for r in items.orderBy("item_id").collect()]


def test_float32_prefilter_keeps_near_ties(spark):
    # differences far below single precision still decide
    base = np.random.default_rng(5).normal(size=64)
    x = np.tile(base, (50, 1))
    queries = spark.createDataFrame([(0, base.tolist())], "qid int, qvec array<double>")
    rows = []
    for i in range(50):
        v = base.copy()
        v[0] += i * 1e-7
        rows.append((i, v.tolist()))
        x[i] = v
    items = spark.createDataFrame(rows, "item_id int, embedding array<double>")
    want = np.argsort(-np.round(x @ base, 9), kind="stable")[:5].tolist()
    hits = top_k(queries, items, 5).df.orderBy("rank").collect()
    assert [r.item_id for r in hits] == want


def test_huge_values_fall_back_to_double(spark):
    q = spark.createDataFrame([(0, [1e30, 1.0])], "qid int, qvec array<double>")
    items = spark.createDataFrame([(0, [1e30, 0.0]), (1, [2e30, 0.0])], "item_id int, embedding array<double>")
    assert [r.item_id for r in top_k(q, items, 1).df.collect()] == [1]


@pytest.mark.parametrize("way", WAYS)
def test_vectors_that_are_no_numbers_are_no_hits(spark, way):
    rng = np.random.default_rng(6)
    q, x = rng.normal(size=(3, 4)), rng.normal(size=(40, 4))
    x[::3] = np.nan
    x[1] = np.inf
    q[1] = np.nan
    queries, items = tables(spark, q, x)
    ids = [i for i in range(40) if i % 3 and i != 1]
    want = [h for h in brute(q[[0, 2]], x[ids], ids, 30)]
    assert got(top_k(queries, items, 30, **way)) == sorted((0 if h[0] == 0 else 2, *h[1:]) for h in want)


@pytest.mark.parametrize("way", WAYS)
def test_no_items_and_no_queries(spark, way):
    queries, items = tables(spark, np.ones((2, 3)), np.ones((2, 3)))
    assert top_k(queries, items.limit(0), 3, **way).df.count() == 0
    assert top_k(queries.limit(0), items, 3, **way).df.count() == 0


def test_different_dimensions_are_refused(spark):
    queries, items = tables(spark, np.ones((1, 3)), np.ones((1, 4)))
    with pytest.raises(ValueError, match="different dimension"):
        require_same_dims(queries, items)
    with pytest.raises(ValueError, match="different dimension"):
        top_k(queries, items, 1)


def test_normalize_keeps_zero_and_gives_unit_length(spark, rows):
    out = rows([[3.0, 4.0], [0.0, 0.0]], V.normalize, "array<float>")
    assert out == [[0.6, 0.8], [0.0, 0.0]]


def test_hash_encoder_is_unit_length_and_blind_to_order(spark, rows):
    a, b, empty, null = rows(["Red bolt, red!", "red RED bolt", "", None], V.HashEncoder(32))
    assert a == b and abs(sum(v * v for v in a) - 1) < 1e-6 and len(a) == 32
    assert not any(empty) and not any(null)


def test_model_encoder_runs_a_users_model(spark, rows):
    def load():
        return lambda texts: np.array([[len(t), t.count("a"), 0.0] for t in texts])

    out = rows(["aaa", "b", None], V.ModelEncoder("lengths", 3, load))
    assert np.allclose(out, [[0.70710678, 0.70710678, 0], [1, 0, 0], [0, 0, 0]])


def test_salted_join_spreads_a_hot_key_and_loses_nothing(spark):
    many = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"))
    one = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    want = sorted(map(tuple, many.join(one, "key").collect()))
    assert sorted(map(tuple, salted_join(many, one, "key", "id", salts=5).collect())) == want


def test_gather_is_the_same_by_broadcast_and_by_shuffle(spark):
    hits = spark.range(400).select(
        F.col("id").alias("qid"), (F.col("id") % 5).alias("item_id"), F.lit(1).alias("rank"), F.lit(0.5).alias("similarity")
    )
    items = spark.range(9).select(F.col("id").alias("item_id"), F.concat(F.lit("t"), "id").alias("title"))
    ways = [
        gather_items(Hits(hits, 1, queries=400, query_bytes=3200, item_bytes=8), items),
        gather_items(Hits(hits, 1, queries=400, query_bytes=3200), items),
        gather_items(Hits(hits, 1), items, max_broadcast_bytes=0),
    ]
    first, *others = [sorted(map(tuple, w.select("qid", "item_id", "title").collect())) for w in ways]
    assert len(first) == 400 and all(o == first for o in others)
    assert "_salt" in ways[2]._jdf.queryExecution().toString()


def test_restrict_to_keeps_what_is_wanted_whatever_the_size(spark):
    wide = spark.createDataFrame([("a", 1), ("b", 2)], "url string, v int")
    wide = wide.unionByName(spark.createDataFrame([(None, 3)], "url string, v int"))
    wanted = spark.createDataFrame([("a",), (None,)], "url string")
    assert [r.v for r in restrict_to(wide, wanted, "url").collect()] == [1]
    many = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("url"))
    for bits in (64, 1 << 12, 1 << 20):
        kept = restrict_to(spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("url")), many, "url", bits)
        assert kept.join(many, "url").count() == 5000
    assert kept.count() < 5200 and restrict_to(wide, wanted.limit(0), "url").count() == 0
    assert joins.MAX_BROADCAST_BYTES <= 1 << 27


def test_shuffled_items_are_stored_before_blocks_of_queries_read_them(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    queries, items = tables(spark, rng.normal(size=(30, 6)), rng.normal(size=(90, 6)))
    items.write.parquet(path := str(tmp_path / "items"))
    dealt = spark.read.parquet(path).repartition(3)
    plans, whole = [], topk.block_hits
    monkeypatch.setattr(topk, "block_hits", lambda block, own, *rest: plans.append(own._jdf.queryExecution().executedPlan().toString()) or whole(block, own, *rest))
    want = got(top_k(queries, items, 4))
    plans.clear()
    assert got(top_k(queries, dealt, 4, max_query_bytes=0, query_block_rows=7)) == want
    assert len(plans) == 5 and not any("Exchange" in p for p in plans)
