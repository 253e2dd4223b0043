from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pickwell.functions.vectors import HashEncoder
from pickwell.operators import rerank as R
from pickwell.operators.dedup import conform
from pickwell.plans import evaluate as E
from pickwell.plans import results as O
from pickwell.plans.index import build_index
from pickwell.plans.search import recommend, search

ENC = HashEncoder(64)
# forces the block way of the search and the shuffled way of the gather
BLOCKS = {"max_query_bytes": 0, "query_block_rows": 2, "seed_tasks": 1}


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        (f"https://x.com/i/{i}", f"{kind} test {i % 4}", f"about {kind}", 10 * (i % 7) if i % 7 else None)
        for i, kind in enumerate(["java", "sales", "cooking", "gardening"] * 15)
    ]
    df = conform(spark.createDataFrame(rows, "url string, title string, description string, duration_min int"))
    return build_index(df, ENC).cache()


@pytest.fixture(scope="module")
def queries(spark):
    rows = [("java test 40 minutes", 5), ("  sales test 1-2 hours", 3), ("cooking", 0), ("knitting java developer", 50), ("sql", -1), (" ", 4), (None, 4)]
    return R.clean_queries(spark.createDataFrame(rows, "query string, topk int"), topk="topk").cache()


def test_clean_queries_clamp_count_and_reject(spark):
    raw = spark.createDataFrame([(" a ", 0), ("a", None), ("a", 10), ("a", 3), ("", 1), (None, 1), ("b", -5)], "query string, topk int")
    got = sorted((r.query, r.topk, r.copies) for r in R.clean_queries(raw, topk="topk").collect())
    assert got == [("a", 3, 1), ("a", 10, 3), ("b", 1, 1)]
    assert sorted(r.reason for r in R.query_rejects(raw).collect()) == ["empty query", "no query"]
    raw_texts = R.clean_queries(raw, trim=False).select("query").collect()
    assert sorted(r.query for r in raw_texts) == [" a ", "a", "b"]
    kept = R.clean_queries(raw.withColumn("id", F.monotonically_increasing_id()), topk="topk", qid="id")
    assert kept.count() == 5 and kept.select("qid").distinct().count() == 5


def test_clamp(rows):
    assert rows([0, None, -3, 1, 10, 11], R.clamp_topk, "int") == [10, 10, 1, 1, 10, 10]


def test_duration_score(spark):
    data = [(60, 45, 75, 1.0), (50, 45, 75, 1 / 3), (45, 45, 75, 0.0), (None, 45, 75, 0.0), (75, 60, 120, 0.5), (60, None, None, 0.0), (0, 0, 16, 1 - 8 / 15)]
    df = spark.createDataFrame(data, "d int, lo bigint, hi bigint, want double")
    for r in df.select("want", R.duration_score(F.col("d"), F.col("lo"), F.col("hi")).alias("s")).collect():
        assert abs(r.want - r.s) < 1e-12


def _key(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_recommend_follows_the_rules_step_by_step(index, queries):
    """Fetch 4k by similarity, gate, blend, cut: recomputed in Python from the plain search."""
    hits = recommend(queries, index, ENC)
    found = {}
    for r in search(queries, index, 40, ENC).collect():
        found.setdefault(r.qid, []).append(r)
    wanted = []
    for q in queries.select("*").collect():
        terms = [t for t in ("java", "sales", "developer", "sql") if t in q.query.split()]
        window = {"java test 40 minutes": (25, 55), "sales test 1-2 hours": (60, 120)}.get(q.query)
        scored = []
        for r in sorted(found[q.qid], key=lambda r: r["rank"])[: 4 * q.topk]:
            text = f"{r.title} {r.description}".lower()
            if terms and not any(t in text for t in terms):
                continue
            fit = 0.0
            if window and r.duration_min is not None:
                mid, tol = sum(window) / 2, max(15, (window[1] - window[0]) / 2)
                fit = max(0.0, 1 - abs(r.duration_min - mid) / tol)
            scored.append((-round(0.85 * r.similarity + 0.15 * fit, 9), -r.similarity, r.item_id))
        wanted += [(q.qid, n + 1, i) for n, (_, _, i) in enumerate(sorted(scored)[: q.topk])]
    assert _key(hits, "qid", "rank", "item_id") == sorted(wanted)


def test_gate_runs_after_the_cut(spark, index):
    # "r" passes every text with that letter, "sql" none: fewer than topk may remain, even none
    q = R.clean_queries(spark.createDataFrame([("cooking with sql",), ("cooking with r",)], "query string"))
    counts = {r.query: r["count"] for r in O.responses(q, recommend(q, index, ENC)).collect()}
    assert counts["cooking with sql"] == 0 and 0 < counts["cooking with r"] < 10
    words = {r.query: r["count"] for r in O.responses(q, recommend(q, index, ENC, whole_word=True)).collect()}
    assert words["cooking with r"] == 0


def test_blocks_give_the_same_recommendations(index, queries):
    a, b = recommend(queries, index, ENC), recommend(queries, index, ENC, **BLOCKS)
    assert _key(a, "qid", "rank", "item_id", "score") == _key(b, "qid", "rank", "item_id", "score")


def test_invariants(index, queries):
    hits = recommend(queries, index, ENC).join(queries.select("qid", "topk"), "qid").collect()
    ranks = {}
    for r in hits:
        assert -1 <= r.similarity <= 1 + 1e-6 and 0 <= r.duration_score <= 1 and r["rank"] <= r.topk
        ranks.setdefault(r.qid, []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())


def test_fewer_items_than_k_give_fewer_rows(index, queries):
    assert search(queries, index.limit(3), 10, ENC).groupBy("qid").count().filter("count <> 3").isEmpty()


def test_another_encoder_is_refused(index, queries):
    with pytest.raises(ValueError, match="encoder"):
        search(queries, index, 3, HashEncoder(32))


def test_responses_hold_eight_fields_in_rank_order(index, queries):
    hits = recommend(queries, index, ENC)
    answers = O.responses(queries, hits)
    assert answers.count() == queries.count()
    fields = answers.schema["recommendations"].dataType.elementType.fieldNames()
    assert fields == ["assessment_name", "assessment_url", "test_type", "level", "language", "duration_min", "similarity", "description"]
    order = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        order.setdefault(r.qid, []).append(r.url)
    for r in answers.select("qid", "count", F.to_json("recommendations").alias("j")).collect():
        urls = [h["assessment_url"] for h in json.loads(r.j)]
        assert urls == order.get(r.qid, []) and r["count"] == len(urls)


def test_result_view(index, queries):
    view = O.result_view(search(queries, index, 2, ENC).drop("level"))
    assert view.columns == ["qid", "rank", "Assessment", "URL", "Type", "Language", "Duration (min)", "Similarity", "Description"]
    assert view.first()["URL"].startswith("[link](https://")
    with pytest.raises(ValueError, match="among the hits' columns"):
        O.result_view(queries.select("qid"))


def test_batch_export_repeats_copies_whatever_their_number(spark, index, monkeypatch):
    monkeypatch.setattr(O, "COPIES_PER_TASK", 10)
    lines = spark.createDataFrame([("java",)] * 25 + [("sales",)] + [("cooking",)] * 10, "query string")
    q = R.clean_queries(lines)
    out = O.batch_export(q, search(q, index, 3, ENC))
    assert out.columns == ["Query", "Assessment_url"]
    assert {r.Query: r["count"] for r in out.groupBy("Query").count().collect()} == {"java": 75, "sales": 3, "cooking": 30}
    assert out.groupBy("Query", "Assessment_url").count().filter("Query = 'java' and count <> 25").isEmpty()


def test_recall(spark):
    pairs = spark.createDataFrame(
        [("q", "https://x.com/a"), ("q", "http://www.x.com/A/"), ("q", "https://x.com/b"), ("q", "https://"), ("p", "https://x.com/c"),
         (" q ", "https://x.com/a"), ("r", " "), (None, "https://x.com/d"), ("s", "https:///"), ("s", None)],
        "query string, relevant_url string",
    )
    truth = E.truth_pairs(pairs)
    ids = {r.query: r.qid for r in truth.select("query", "qid").distinct().collect()}
    predicted = spark.createDataFrame(
        [(ids["q"], 1, "x.com/a"), (ids["q"], 2, "https://x.com/a/"), (ids["q"], 3, "https://x.com/z"), (ids["q"], 4, "https://x.com/b")],
        "qid string, rank int, url string",
    )
    got = {r.query: (r.n_truth, r.recall) for r in E.recall_at_k(truth, predicted, 3).collect()}
    # two spellings of one URL are two hits; a truth without any usable URL divides by 1
    assert got == {"q": (5, 1.0), "p": (1, 0.0), "s": (1, 0.0)}
    mean = E.mean_recall(E.recall_at_k(truth, predicted, 3)).first()
    assert (mean.queries, round(mean.mean_recall, 9)) == (3, round(1 / 3, 9))
    report = E.report(E.recall_at_k(truth, predicted, 3)).collect()
    assert [r.query for r in report] == ["p", "s", "q"]


def test_evaluate_end_to_end(spark, index):
    pairs = spark.createDataFrame(
        [(f"{kind} test", f"https://x.com/i/{i}") for i, kind in enumerate(["java", "sales", "cooking", "gardening"] * 2)],
        "query string, relevant_url string",
    )
    out = E.evaluate(pairs, index, 10, ENC).collect()
    blocks = E.evaluate(pairs, index, 10, ENC, **BLOCKS).collect()
    assert len(out) == 4 and all(r.n_truth == 2 and 0 <= r.recall <= 1 for r in out)
    assert sorted(map(tuple, out)) == sorted(map(tuple, blocks))
