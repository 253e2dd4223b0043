from __future__ import annotations

from pyspark.sql import functions as F

from pickwell.operators.dedup import conform, fill_missing, keep_first
from pickwell.plans import catalog as C
from pickwell.schemas import CATALOG_COLUMNS, CATALOG_SCHEMA

PAGES = "page_id int, url string, html string"


def catalog(spark, *rows):
    return conform(spark.createDataFrame([tuple(r) for r in rows], "assessment_id string, title string, url string"))


def test_conform_and_fill(spark):
    df = spark.createDataFrame([("t", "7", 1)], "title string, duration_min string, extra int")
    assert conform(df).schema == CATALOG_SCHEMA
    row = conform(df).first()
    assert (row.title, row.duration_min, row.url) == ("t", 7, None)
    filled = fill_missing(df)
    assert set(CATALOG_COLUMNS) <= set(filled.columns) and filled.first().url == ""


def test_keep_first_with_a_key_holding_most_rows(spark):
    df = spark.range(10_000).select(F.col("id"), F.when(F.col("id") < 9_000, 0).otherwise(F.col("id")).alias("k"))
    kept = keep_first(df, ["k"], [F.desc("id")])
    assert kept.count() == 1_001
    assert kept.filter("k = 0").first().id == 8_999
    assert keep_first(kept, ["k"], [F.desc("id")]).count() == 1_001


def test_build_catalog_keeps_the_first_page_of_a_url(spark):
    pages = spark.createDataFrame(
        [(3, "https://x.com/a", "<h1>late</h1>"), (1, "https://x.com/a", "<h1>first</h1>"), (2, "https://x.com/B_1/", "<h1>b</h1>"),
         (4, "https://x.com/c", "<h1>Pre-packaged</h1>"), (5, "https://x.com/d", "<p>no title</p>")],
        PAGES,
    )
    got = sorted((r.assessment_id, r.title) for r in C.build_catalog(pages).collect())
    assert got == [("a", "first"), ("b-1", "b")]
    assert C.build_catalog(pages).schema.fieldNames() == CATALOG_COLUMNS


def test_crawl_reads_linked_pages_only_and_borrows_anchor_titles(spark):
    lists = spark.createDataFrame(
        [(1, "", '<a href="/products/a">Link A</a><a href="/products/b">Link B</a><a href="/products/a">Again</a><a href="/products/s">A job solution</a>')],
        PAGES,
    )
    pages = spark.createDataFrame(
        [(1, "https://x.com/products/a", "<p>no heading"), (2, "https://x.com/products/b", "<h1>B</h1>"),
         (3, "https://x.com/products/z", "<h1>not linked</h1>"), (4, "https://x.com/products/s", "")],
        PAGES,
    )
    got = sorted((r.title, r.url) for r in C.crawl_catalog(lists, pages, "https://x.com").collect())
    assert got == [("B", "https://x.com/products/b"), ("Link A", "https://x.com/products/a")]


def test_missing_urls_compares_normal_forms_and_counts_mentions(spark):
    have = catalog(spark, ("a", "A", "https://www.x.com/a/"), ("n", "N", None))
    pairs = spark.createDataFrame(
        [("q", "http://X.com/A?ref"), ("q", "https://x.com/b"), ("r", "https://x.com/b"), ("r", "https://x.com/b/"), ("r", None)],
        "query string, relevant_url string",
    )
    got = {r.url: r.mentions for r in C.missing_urls(have, pairs).collect()}
    assert got == {"https://x.com/b": 2, "https://x.com/b/": 1}


def test_augment_adds_missing_pages_once_and_is_idempotent(spark):
    have = catalog(spark, ("a", "A", "https://x.com/a"))
    pairs = spark.createDataFrame(
        [("q", u) for u in ("https://x.com/a/", "https://x.com/sub/new-test/", "https://x.com/", "https://x.com/unknown", "https://x.com/sub/new-test/")],
        "query string, relevant_url string",
    )
    pages = spark.createDataFrame(
        [(1, "https://x.com/sub/new-test/", "<body>sparse, 90 minutes</body>"), (2, "https://x.com/", "<h1>Root</h1><p>text</p>"), (3, "https://x.com/a", "<h1>other</h1>")],
        PAGES,
    )
    once = C.augment_catalog(have, pairs, pages, default_id="none")
    got = {r.url: (r.assessment_id, r.title, r.description, r.duration_min, r.tags) for r in once.collect()}
    assert got == {
        "https://x.com/a": ("a", "A", None, None, None),
        "https://x.com/sub/new-test/": ("sub-new-test", "Sub/New Test", "Sub/New Test", 90, ""),
        "https://x.com/": ("none", "Root", "text", None, ""),
    }
    twice = C.augment_catalog(once, pairs, pages, default_id="none")
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_merge_prefers_catalog_rows_and_allows_other_columns(spark):
    old = spark.createDataFrame([("u", "old", 1), ("v", "v", 2)], "url string, title string, extra int")
    new = spark.createDataFrame([("u", "new", "x"), ("w", "w", "y")], "url string, title string, note string")
    got = {r.url: (r.title, r.extra, r.note) for r in C.merge_catalogs(old, new).collect()}
    assert got == {"u": ("old", 1, None), "v": ("v", 2, None), "w": ("w", None, "y")}


def test_counts(spark):
    pages = spark.createDataFrame([(1, "https://x.com/a", "<h1>t</h1> 5 min"), (2, "https://x.com/b", "")], PAGES)
    got = {r.metric: r.n for r in C.catalog_counts(pages, C.build_catalog(pages)).collect()}
    assert got == {"pages": 2, "items": 1, "with_description": 0, "with_type": 0, "with_duration": 1}
