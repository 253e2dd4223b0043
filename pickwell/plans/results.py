"""Shapes in which results leave the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwell.functions.urls import markdown_link
from pickwell.schemas import VIEW_COLUMNS

# Copies of one query row written by a single task.
COPIES_PER_TASK = 100_000


def result_view(hits: DataFrame, keep: tuple[str, ...] = ("qid", "rank")) -> DataFrame:
    """The display columns that exist, under their display names, the URL as a link."""
    shown = [c for c in VIEW_COLUMNS if c in hits.columns]
    if not shown:
        raise ValueError(f"none of {list(VIEW_COLUMNS)} among the hits' columns")
    columns = [markdown_link(F.col(c)) if c == "url" else F.col(c) for c in shown]
    return hits.select(*(k for k in keep if k in hits.columns), *(c.alias(VIEW_COLUMNS[n]) for n, c in zip(shown, columns)))


def responses(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``qid, query, count, recommendations``: one row per query, also for those without hits.

    The list of a query holds at most its ``topk`` hits.
    """
    hit = F.struct(
        "rank",
        F.struct(
            F.col("title").alias("assessment_name"),
            F.col("url").alias("assessment_url"),
            "test_type",
            "level",
            "language",
            "duration_min",
            "similarity",
            "description",
        ).alias("hit"),
    )
    lists = hits.groupBy("qid").agg(F.sort_array(F.collect_list(hit)).alias("_ranked"))
    joined = queries.select("qid", "query").join(lists, "qid", "left")
    recommendations = F.coalesce(F.transform("_ranked", lambda r: r["hit"]), F.array())
    return joined.select(
        "qid",
        "query",
        F.coalesce(F.size("_ranked"), F.lit(0)).alias("count"),
        recommendations.alias("recommendations"),
    )


def batch_export(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``Query, Assessment_url`` rows: the hits of each query, once per copy of the query.

    Copies are multiplied back in blocks, so one query repeated by a third of
    all rows is written by many tasks.
    """
    rows = hits.select("qid", "url").join(queries.select("qid", "query", "copies"), "qid")
    zero = F.lit(0).cast("bigint")
    last_block = F.expr(f"(copies - 1) div {COPIES_PER_TASK}")
    blocks = rows.withColumn("_block", F.explode(F.sequence(zero, last_block))).repartition("qid", "url", "_block")
    here = F.least(F.lit(COPIES_PER_TASK).cast("bigint"), F.col("copies") - F.col("_block") * COPIES_PER_TASK)
    return blocks.select(
        F.col("query").alias("Query"),
        F.col("url").alias("Assessment_url"),
        F.explode(F.sequence(zero + 1, here)).alias("_copy"),
    ).drop("_copy")
