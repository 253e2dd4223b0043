"""Jobs that build and extend the item catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pickwell.functions.strings import blank_to_null
from pickwell.functions.urls import normalize_url, slug, title_from_url
from pickwell.operators.dedup import conform, keep_first
from pickwell.operators.joins import restrict_to
from pickwell.operators.pages import PRODUCT_PATHS, dedup_links, extract_links, page_fields, page_reject_reason
from pickwell.session import materialise


def catalog_rows(pages: DataFrame) -> DataFrame:
    """Catalog rows of parsed pages: pages without URL, untitled ones and bundles go, ids come.

    The rule is that of ``page_rejects``.
    """
    kept = pages.filter(page_reject_reason(F.col("url"), F.lit(""), F.col("title")).isNull())
    return conform(kept.withColumn("assessment_id", slug(F.col("url"))))


def first_pages(pages: DataFrame, variant: str) -> DataFrame:
    """Parsed fields of the first page of every URL.

    The wide HTML column is consumed by a map-only step; only typed fields are
    shuffled. Rows are selected after this, as a page seen first counts even if
    it is dropped later; that also keeps filters from being pushed below the
    parser, where they would run it once more.
    """
    return keep_first(page_fields(pages, variant), ["url"], ["page_id"])


def build_catalog(pages: DataFrame) -> DataFrame:
    """Catalog of every page that has a title; one row per URL, the first page wins."""
    return catalog_rows(first_pages(pages, "crawl"))


def crawl_catalog(
    list_pages: DataFrame, pages: DataFrame, site: str, fragments: tuple[str, ...] = PRODUCT_PATHS
) -> DataFrame:
    """Catalog of the pages that the list pages link to; a page without title takes its anchor's text.

    Pages nobody links to are dropped before their markup is parsed.
    """
    found = dedup_links(extract_links(list_pages, site, fragments))
    links = materialise(found.select("url", F.col("title").alias("_anchor")))
    fields = first_pages(restrict_to(pages, links, "url"), "crawl")
    linked = fields.join(links, "url")
    titled = linked.withColumn("title", F.coalesce(blank_to_null(F.col("title")), "_anchor"))
    return catalog_rows(titled)


def missing_urls(catalog: DataFrame, pairs: DataFrame) -> DataFrame:
    """``url, mentions`` of the labelled URLs the catalog lacks, compared in normal form.

    Mentions are counted before the anti join, so a URL named a billion times
    joins as one row.
    """
    have = catalog.filter(F.col("url").isNotNull()).select(normalize_url(F.col("url")).alias("_norm")).distinct()
    wanted = pairs.filter(F.col("relevant_url").isNotNull()).groupBy(F.col("relevant_url").alias("url")).agg(
        F.count("*").alias("mentions")
    )
    return wanted.withColumn("_norm", normalize_url(F.col("url"))).join(have, "_norm", "left_anti").drop("_norm")


def augment_rows(
    urls: DataFrame, pages: DataFrame, default_title: str = "Untitled", default_id: str = "item"
) -> DataFrame:
    """Catalog rows for the given URLs out of their pages; sparse pages borrow from the URL."""
    wanted = materialise(urls.select("url").distinct())
    fields = first_pages(restrict_to(pages, wanted, "url"), "augment").drop("page_id")
    rows = fields.join(wanted, "url")
    rows = rows.withColumn("title", F.coalesce(blank_to_null(F.col("title")), title_from_url(F.col("url"), default_title)))
    rows = rows.withColumn("description", F.coalesce(blank_to_null(F.col("description")), "title"))
    return conform(rows.withColumn("assessment_id", slug(F.col("url"), default_id)))


def merge_catalogs(catalog: DataFrame, added: DataFrame) -> DataFrame:
    """Both tables by column name, one row per URL, rows of ``catalog`` first."""
    both = catalog.withColumn("_new", F.lit(0)).unionByName(added.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = ["_new", *(F.col(c).asc_nulls_last() for c in both.columns if c not in ("_new", "url"))]
    return keep_first(both, ["url"], order).drop("_new")


def augment_catalog(catalog: DataFrame, pairs: DataFrame, pages: DataFrame, **defaults: str) -> DataFrame:
    """The catalog plus a row for every labelled URL it lacked and a page is known for."""
    return merge_catalogs(catalog, augment_rows(missing_urls(catalog, pairs), pages, **defaults))


def write_counted(pages: DataFrame, path: str, variant: str = "crawl") -> dict[str, int]:
    """Write the catalog of ``pages`` as Parquet; gives the counts of ``catalog_counts``, taken along the way.

    Pages are counted where they are read and items where they are written, so no job runs but
    the write. A stage that Spark runs again for want of a lost executor's output counts its
    pages again: ``catalog_counts`` is exact in that case as well.
    """
    seen, kept = Observation(), Observation()
    fields = page_fields(pages.observe(seen, F.count("*").alias("pages")), variant)
    catalog = catalog_rows(keep_first(fields, ["url"], ["page_id"]))
    columns = {"items": F.lit(1), "with_description": F.col("description"), "with_type": F.col("test_type"), "with_duration": F.col("duration_min")}
    catalog.observe(kept, *(F.count(c).alias(n) for n, c in columns.items())).write.mode("overwrite").parquet(path)
    return seen.get | kept.get


def catalog_counts(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """``metric, n``: pages seen, catalog rows kept, and how many carry each optional field."""
    seen = pages.agg(F.count("*").alias("pages")).unpivot([], ["pages"], "metric", "n")
    filled = catalog.agg(
        F.count("*").alias("items"),
        F.count("description").alias("with_description"),
        F.count("test_type").alias("with_type"),
        F.count("duration_min").alias("with_duration"),
    ).unpivot([], ["items", "with_description", "with_type", "with_duration"], "metric", "n")
    return seen.unionByName(filled)
