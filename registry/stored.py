"""Readers and writers as queries: a table derived from the given ones is written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwell.operators.dedup import conform
from pickwell.plans import results as O
from pickwell.plans.index import build_index
from pickwell.session import scratch_path
from pickwell.sources import tables as S
from registry import inputs as I
from registry.inputs import derived, table


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(header="true", multiLine="true", quote='"', escape='"').csv(path)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog with quotes, line breaks and missing fields."""
    odd = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit('The "'), "title", F.lit('",\nnow; a\\b')))
    return derived(spark, sf_dir, I.CATALOG).withColumn("description", odd)


def stored_catalog(spark, sf_dir):
    S.write_catalog(_items(spark, sf_dir), path := scratch_path(spark))
    return S.read_catalog(spark, path)


def stored_metadata(spark, sf_dir):
    S.write_metadata(_items(spark, sf_dir), path := scratch_path(spark))
    return S.read_metadata(spark, path)


def stored_pairs(spark, sf_dir):
    S.write_csv(derived(spark, sf_dir, I.PAIRS), path := scratch_path(spark))
    return S.read_pairs(spark, path)


def stored_queries(spark, sf_dir):
    """Conversation turns as a query file with another column, under another name."""
    turns = table(spark, sf_dir, "conversations").select("turn", F.col("text").alias(" Job_Description"))
    S.write_csv(turns, path := scratch_path(spark))
    return S.read_queries(spark, path)


def stored_index(spark, sf_dir):
    from registry.queries import ENCODER, _cells

    S.write_index(build_index(derived(spark, sf_dir, I.CATALOG), ENCODER, "item_id"), path := scratch_path(spark))
    return _cells(S.read_index(spark, path), "item_id", "title")


def stored_export(spark, sf_dir):
    """Pages as pairs of title and URL."""
    pages = table(spark, sf_dir, "pages").select(F.substring("html", 1, 200).alias("Query"), F.col("url").alias("Assessment_url"), "page_id")
    S.write_batch_export(pages, path := scratch_path(spark))
    return _csv(spark, path)


def stored_view(spark, sf_dir):
    S.write_result_view(O.result_view(_items(spark, sf_dir), keep=()), path := scratch_path(spark))
    return _csv(spark, path)


def stored_merge(spark, sf_dir):
    """A merge that adds, and one that has nothing to add and so writes nothing."""
    items = conform(_items(spark, sf_dir))
    folder = scratch_path(spark)
    half = F.xxhash64("url") % 2 == 0
    wrote = S.write_merged_catalog(items.filter(half), items.filter(~half), f"{folder}/merged")
    again = S.write_merged_catalog(items, items.limit(0), f"{folder}/merged")
    merged = S.read_catalog(spark, f"{folder}/merged")
    return merged.select("*", F.lit(wrote).alias("wrote"), F.lit(again).alias("wrote_again"))


QUERIES = {f.__name__: f for f in (stored_catalog, stored_metadata, stored_pairs, stored_queries, stored_index, stored_export, stored_view, stored_merge)}
