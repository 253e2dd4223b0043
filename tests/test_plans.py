"""What the physical plans must and must not contain."""

from __future__ import annotations

from pyspark.sql import functions as F

from pickwell.operators.dedup import keep_first
from pickwell.operators.pages import extract_links, page_fields, page_rejects, page_titles
from pickwell.operators.topk import top_k
from pickwell.plans.index import build_index
from registry.inputs import CATALOG, PAGES, derived
from registry.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_first_cuts_before_the_shuffle(spark):
    text = plan(keep_first(spark.range(10).withColumn("k", F.col("id") % 3), ["k"], ["id"]))
    assert text.index("Final") < text.index("Exchange hashpartitioning(k") < text.index("Partial")


def test_top_k_reads_only_ids_and_vectors_and_cuts_before_the_shuffle(spark, sf_dir, tmp_path):
    path = str(tmp_path / "index")
    build_index(derived(spark, sf_dir, CATALOG), item_id="item_id").write.parquet(path)
    index = spark.read.parquet(path)
    queries = index.select(F.col("item_id").alias("qid"), F.col("embedding").alias("qvec"))
    text = plan(top_k(queries, index, 5).df)
    assert "ReadSchema: struct<item_id:bigint,embedding:array<float>>" in text
    assert text.count("Exchange hashpartitioning") == 1
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial") < text.index("MapInArrow")


def test_items_rest_whatever_the_number_of_queries(spark, tmp_path):
    """No exchange between the item scan and the cut, for one block of queries and for many; blocks are let go."""
    from pickwell.operators import topk

    path = str(tmp_path / "items")
    spark.range(4000).selectExpr("id AS item_id", "array(cast(sin(id) as float), cast(cos(id) as float)) AS embedding").repartition(6).write.parquet(path)
    items = spark.read.parquet(path)
    queries = items.selectExpr("item_id AS qid", "embedding AS qvec")
    lazy = top_k(queries.limit(50), items, 5).df
    block = queries.limit(50).toArrow()
    sent = []
    for df in (lazy, topk.block_hits(block, items, 5, sent=sent), topk.block_hits(block, items, 5, seed_tasks=2, sent=sent)):
        text = plan(df)
        assert "Exchange" not in text[text.index("MapInArrow") : text.index("FileScan")]
        assert text.count("Exchange hashpartitioning(qid") == 1
    assert len(sent) == 3
    seen = []
    whole = topk.send
    try:
        topk.send = lambda s, value, variables: seen.append((len(value[0]), [*variables])) or whole(s, value, variables)
        got = top_k(queries, items, 5, max_query_bytes=0, query_block_rows=1000)
    finally:
        topk.send = whole
    # a block has a variable or two of its own, hashed blocks are of about the same size
    assert sum(n for n, _ in seen) == 4000 and max(n for n, _ in seen) < 1200 and all(not held for _, held in seen)
    assert "FileScan" in plan(got.df) and "MapInArrow" not in plan(got.df) and got.df.count() == 20_000


def test_page_markup_is_never_shuffled(spark, sf_dir, tmp_path):
    path = str(tmp_path / "pages")
    spark.read.parquet(f"{sf_dir}/pages.parquet").write.parquet(path)
    from pickwell.plans.catalog import build_catalog

    text = plan(build_catalog(spark.read.parquet(path)))
    assert text.count("Exchange") == 1
    above_scan = text[: text.index("FileScan")]
    assert "html#" not in above_scan[: above_scan.index("Exchange")].split("Project")[-1]
    # the parser runs once: no filter was pushed below it
    assert above_scan.count("</script") == 1


def test_expensive_steps_run_once(spark, sf_dir):
    pages = derived(spark, sf_dir, PAGES)
    for df in (extract_links(pages, "https://x.com"), page_rejects(pages), page_titles(pages), page_fields(pages)):
        assert plan(df).count(r"</script\s") == 1
    assert plan(QUERIES["hash_encode"](spark, sf_dir)).count("ArrowEvalPython") == 1


def test_gate_works_on_unstored_cached_and_stored_indexes(tmp_path):
    """The gate names columns of both sides of a join; it must stay above it."""
    from pyspark.sql import SparkSession

    from pickwell.functions.vectors import HashEncoder
    from pickwell.operators.dedup import conform
    from pickwell.operators.rerank import clean_queries
    from pickwell.plans.index import build_index
    from pickwell.plans.search import recommend

    spark = SparkSession.active().newSession()
    items = spark.createDataFrame([(f"https://x.com/{i}", f"{w} test {i}") for i, w in enumerate(["java", "sales"] * 20)], "url string, title string")
    index = build_index(conform(items), HashEncoder(32))
    index.write.parquet(str(tmp_path / "index"))
    asked = spark.createDataFrame([("java", 20), ("sales", None), ("java sales", 0), ("tea", -3)], "query string, topk int")
    answers = []
    for made in (index, index.cache(), spark.read.parquet(str(tmp_path / "index"))):
        queries = clean_queries(asked, topk="topk", max_topk=20)
        hits = recommend(queries, made, HashEncoder(32), max_topk=20)
        assert "!Filter" not in hits._jdf.queryExecution().optimizedPlan().toString()
        answers.append(sorted(map(tuple, hits.collect())))
        n = {r.query: r.n for r in hits.join(queries, "qid").groupBy("query").agg({"*": "count"}).toDF("query", "n").collect()}
        assert n == {"java": 20, "sales": 10, "java sales": 10, "tea": 1}
    assert answers[0] == answers[1] == answers[2]


def test_index_ids_are_unique_and_there(spark):
    from pickwell.functions.vectors import HashEncoder
    from pickwell.operators.dedup import conform
    from pickwell.operators.rerank import clean_queries
    from pickwell.plans.index import build_index, index_rejects
    from pickwell.plans.search import search

    rows = [("u1", "b"), ("u1", "a"), ("u1", "a"), (None, "c"), (" ", "d"), *[(f"v{i}", "e") for i in range(6)]]
    items = conform(spark.createDataFrame(rows, "url string, title string"))
    index = build_index(items, HashEncoder(16))
    assert sorted((r.item_id, r.title) for r in index.collect()) == [("u1", "a"), *[(f"v{i}", "e") for i in range(6)]]
    assert sorted(r.reason for r in index_rejects(items).collect()) == ["empty id", "no id"]
    hits = search(clean_queries(spark.createDataFrame([("e",)], "query string")), index, 5, HashEncoder(16))
    assert sorted(r["rank"] for r in hits.collect()) == [1, 2, 3, 4, 5]
