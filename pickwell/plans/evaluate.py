"""Recall of a search against labelled pairs.

The truth stays in long form, one row per (query, URL): no query's list of URLs
is ever gathered in one place, however many it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwell.functions.strings import strip
from pickwell.functions.urls import normalize_url
from pickwell.functions.vectors import HashEncoder
from pickwell.operators.rerank import MAX_TOPK
from pickwell.plans.search import search
from pickwell.session import materialise


def truth_pairs(pairs: DataFrame) -> DataFrame:
    """``qid, query, url, norm, mentions`` of the pairs with a query and a URL; the id is a hash of the query."""
    clean = pairs.select(strip(F.col("query")).alias("query"), strip(F.col("relevant_url")).alias("url")).filter(
        (F.col("query") != "") & (F.col("url") != "")
    )
    counted = clean.groupBy("query", "url").agg(F.count("*").alias("mentions"))
    return counted.select(
        F.sha2("query", 256).alias("qid"), "query", "url", normalize_url(F.col("url")).alias("norm"), "mentions"
    )


def truth_sets(truth: DataFrame) -> DataFrame:
    """``qid, query, n_truth, n_distinct``: labelled URLs of a query, with repeats and as a set."""
    # one row per normal form first: two plain counts instead of a distinct count
    per_url = truth.groupBy("qid", "query", "norm").agg(F.sum("mentions").alias("mentions"))
    return per_url.groupBy("qid", "query").agg(
        F.sum("mentions").alias("n_truth"),
        F.count(F.when(F.col("norm") != "", 1)).alias("n_distinct"),
    )


def recall_at_k(truth: DataFrame, predictions: DataFrame, k: int = MAX_TOPK) -> DataFrame:
    """``query, n_truth, recall`` of every labelled query.

    ``truth`` as made by ``truth_pairs``; ``predictions``: ``qid, rank, url``. A hit
    is a prediction whose normal form is in the query's truth; two spellings of
    one URL are two hits.
    """
    known = truth.filter(F.col("norm") != "").select("qid", "norm").distinct()
    predicted = predictions.filter(F.col("rank") <= k).select("qid", normalize_url(F.col("url")).alias("norm"))
    hits = predicted.join(known, ["qid", "norm"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    scored = truth_sets(truth).join(hits, "qid", "left")
    recall = F.coalesce("hits", F.lit(0)) / F.greatest(F.lit(1), F.col("n_distinct"))
    return scored.select("query", "n_truth", recall.alias("recall"))


def mean_recall(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("queries"), F.avg("recall").alias("mean_recall"))


def evaluate(pairs: DataFrame, index: DataFrame, k: int = MAX_TOPK, encoder=HashEncoder(), **options) -> DataFrame:
    """Search every labelled query and score it: ``query, n_truth, recall``."""
    truth = materialise(truth_pairs(pairs))
    queries = truth.select("qid", "query").distinct()
    return recall_at_k(truth, search(queries, index, k, encoder, **options), k)


def report(per_query: DataFrame) -> DataFrame:
    """Worst queries first."""
    return per_query.orderBy("recall", "query")
