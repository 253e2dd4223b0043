"""One key, URL or query holding a third of all rows and more: whole and right results."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from pickwell.operators.dedup import conform
from pickwell.operators.pages import dedup_links
from pickwell.operators.rerank import clean_queries
from pickwell.plans import evaluate as E
from pickwell.plans.catalog import build_catalog, missing_urls

N = 6_000


def _hot(spark, hot, cold):
    """N rows, half of them ``hot``, the others ``cold`` followed by their number."""
    return spark.range(N).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, F.lit(hot)).otherwise(F.concat(F.lit(cold), "id")).alias("v")
    )


def test_links_of_a_hot_url(spark):
    links = _hot(spark, "hot", "u").select(F.col("id").alias("page_id"), F.lit(0).alias("pos"), F.lit("t").alias("title"), F.col("v").alias("url"))
    got = dedup_links(links.repartition(7))
    assert got.count() == N // 2 + 1 and got.filter("url = 'hot'").first().page_id == 0


def test_pages_of_a_hot_url(spark):
    pages = _hot(spark, "https://x.com/hot", "https://x.com/").select(
        F.col("id").alias("page_id"), F.col("v").alias("url"), F.concat(F.lit("<h1>n"), "id", F.lit("</h1>")).alias("html")
    )
    got = build_catalog(pages)
    assert got.count() == N // 2 + 1 and got.filter("assessment_id = 'hot'").first().title == "n0"


def test_missing_mentions_of_a_hot_url(spark):
    have = conform(spark.createDataFrame([("https://x.com/1",)], "url string"))
    pairs = _hot(spark, "http://x.com/hot", "https://x.com/").select(F.lit("q").alias("query"), F.col("v").alias("relevant_url"))
    got = Counter({r.url: r.mentions for r in missing_urls(have, pairs).collect()})
    assert sum(got.values()) == N - 1 and got["http://x.com/hot"] == N // 2 and "https://x.com/1" not in got


def test_truth_and_recall_of_a_hot_query(spark):
    pairs = _hot(spark, "hot", "q").select(F.col("v").alias("query"), F.concat(F.lit("https://x.com/"), F.col("id") % 1000).alias("relevant_url"))
    truth = E.truth_pairs(pairs)
    sizes = {r.query: (r.n_truth, r.n_distinct) for r in E.truth_sets(truth).collect()}
    assert sizes["hot"] == (N // 2, 500) and sizes["q1"] == (1, 1) and len(sizes) == N // 2 + 1
    predicted = truth.select("qid").distinct().select("qid", F.explode(F.array(F.lit(0), F.lit(1))).alias("u")).select(
        "qid", (F.col("u") + 1).alias("rank"), F.concat(F.lit("x.com/"), "u").alias("url")
    )
    got = {r.query: r.recall for r in E.recall_at_k(truth, predicted, 2).collect()}
    assert got["hot"] == 1 / 500 and got["q1"] == got["q1001"] == 1.0 and got["q3"] == 0.0


def test_a_hot_query_is_one_search(spark):
    got = clean_queries(_hot(spark, " hot ", "q"), text="v")
    assert got.count() == N // 2 + 1 and got.filter("query = 'hot'").first().copies == N // 2
