"""Inputs the given tables lack, derived from them row by row.

Each derivation is a list of ``(column, expression)`` that both SQL dialects
read, so the Spark queries and their SQL twins start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME_PATH = "replace(p_name, ' ', '-')"
_KEY = "CAST(p_partkey AS STRING)"

# part -> catalog rows with numbers, tags and categories
CATALOG = [
    ("item_id", "p_partkey"),
    ("assessment_id", f"'part-' || {_KEY}"),
    ("title", "p_name"),
    ("url", f"'https://www.example.com/products/' || {_NAME_PATH} || '/' || {_KEY} || '/'"),
    ("description", "p_name || ' of ' || lower(p_type) || ' grade'"),
    ("category", "p_type"),
    ("test_type", "CASE WHEN p_size <= 10 THEN 'P' WHEN p_size <= 30 THEN 'K' END"),
    ("level", "CASE WHEN p_retailprice > 1000 THEN 'Senior' END"),
    ("duration_min", "CASE WHEN p_size <> 13 THEN p_size END"),
    ("language", "CAST(NULL AS STRING)"),
    ("tags", "replace(p_brand, '#', '-')"),
]

# part -> the same items under URLs that repeat, are empty or missing
LOOSE_URLS = [
    (name, "CASE WHEN p_size % 7 = 1 THEN NULL WHEN p_size % 7 = 2 THEN ' ' WHEN p_size % 7 < 5 THEN 'https://www.example.com/' || p_name ELSE p_brand END")
    if name == "url"
    else (name, made)
    for name, made in CATALOG
]

# part -> one wish per name and brand: text with a duration, and a number of results
_WISH = "CASE WHEN min(p_size) = max(p_size) THEN CAST(min(p_size) AS STRING) ELSE CAST(min(p_size) AS STRING) || '-' || CAST(max(p_size) AS STRING) END"
QUERIES = [
    ("query", f"' ' || p_name || ' ' || p_brand || ' about ' || {_WISH} || ' minutes '"),
    ("topk", "CAST(count(*) AS INT) - 1"),
]
QUERY_KEYS = ["p_name", "p_brand"]

# part -> lines of a query file: padded, blank, missing and repeated ones
LINES = [
    ("item_id", "p_partkey"),
    ("query", "CASE WHEN p_size <= 5 THEN repeat(' ', p_size) WHEN p_size > 6 THEN repeat(' ', p_size) || p_name || '  ' END"),
    ("topk", "p_size - 20"),
]

# part -> labelled pairs, the URL in another spelling than the catalog's
PAIRS = [
    ("query", "p_name || ' ' || p_brand"),
    ("relevant_url", f"'HTTP://example.com/Products/' || {_NAME_PATH} || '/' || {_KEY} || '?ref=label'"),
]

_ROLE = """CASE
  WHEN p_name LIKE 'red%' THEN 'senior Python developers'
  WHEN p_name LIKE 'blue%' THEN 'graduate sales managers with skill'
  WHEN p_name LIKE 'hot%' THEN 'entry communication staff'
  WHEN p_name LIKE 'cold%' THEN 'midnight shifts, personality'
  WHEN p_name LIKE 'new%' THEN 'English junior verbal staff'
  WHEN p_name LIKE 'old%' THEN 'lead behaviour, knowledge'
  WHEN p_name LIKE 'large%' THEN 'manager openness'
  ELSE 'anybody' END"""
_DURATION = """CASE p_type
  WHEN 'ECONOMY' THEN CAST(p_size AS STRING) || '-' || CAST(p_size + 11 AS STRING) || ' minutes'
  WHEN 'STANDARD' THEN '1 - 2 hours'
  WHEN 'MEDIUM' THEN CAST(p_size * 30 AS STRING) || ' min'
  WHEN 'PROMO' THEN CAST(p_size AS STRING) || ' hours'
  WHEN 'LARGE' THEN '1-' || CAST(p_size AS STRING) || ' hrs'
  ELSE CAST(p_size AS STRING) || ' mins, or 1 hr' END"""
_TEXT = f"p_name || ' takes ' || {_DURATION} || ' for ' || {_ROLE} || '.'"

# part -> short texts with the words the default vocabularies know
TEXTS = [("item_id", "p_partkey"), ("text", _TEXT)]

_HTML = f"""CASE WHEN p_size = 50 THEN NULL ELSE
  '<!DOCTYPE html><html><head><title>' || p_name || '</title>'
  || CASE WHEN p_size <= 20 THEN '<meta content="A &quot;' || p_name || '&quot; of ' || p_brand || ' &amp; co" name="description">'
          WHEN p_size <= 30 THEN '<META name=''description'' content="  "><meta property="og:description" content="Shared: ' || p_name || '">'
          ELSE '' END
  || CASE WHEN p_size > 40 AND p_size < 48 THEN '<meta property="og:title" content=" ' || p_type || ' ' || p_name || ' "/>' ELSE '' END
  || '<style>.tag {{color: red}}</style></head><body><nav class="top breadcrumb"><a href="/">Home</a> / <a href="/products/">' || p_type || '</a></nav>'
  || CASE WHEN p_size <= 25 THEN '<h1 class="x">' || p_name || ' <em> ' || p_brand || '</em></h1>'
          WHEN p_size <= 35 THEN '<h2>Job Solution: ' || p_name || '</h2>'
          WHEN p_size <= 40 THEN '<H1> </H1>' ELSE '' END
  || '<script>var s = "<p>python</p>";</script><!-- <h1>hidden</h1> --><div><p>The ' || {_TEXT} || '</p></div>'
  || '<span class="tag big">' || p_brand || '</span><i class=badge>' || p_type || ' &middot; &copy;</i><b class="tagline">no</b>'
  || '<footer><a href="/products/' || {_NAME_PATH} || '/' || {_KEY} || '/">See <b>' || p_name || '</b></a>'
  || '<a class="l" href=''//cdn.example.com/products/' || p_type || ';v=1''>Mirror</a>'
  || '<a href="a/./b/../products/' || {_KEY} || '?q=1#z">Relative</a><a href="/products/x">ab</a><a name="n">Products</a>'
  || '<a href="mailto:x@example.com">/products/ by mail</a></footer></body></html>' END"""

# part -> product pages with every kind of field, some of them absent or broken
PAGES = [
    ("page_id", "p_partkey"),
    ("url", f"'https://www.example.com/products/' || {_NAME_PATH} || '/' || {_KEY} || '/'"),
    ("html", _HTML),
]

# Tables whose rows are parsed, encoded or scored.
WIDE_WORK = ("documents", "embeddings", "pages", "part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one that is too small to occupy all cores is spread over them.

    A table of many splits is read as it lies, without a shuffle.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores and name in WIDE_WORK else df


def derived(spark: SparkSession, sf_dir: str, columns: list[tuple[str, str]], source: str = "part") -> DataFrame:
    return table(spark, sf_dir, source).selectExpr(*(f"{e} AS {n}" for n, e in columns))


def derived_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = [F.expr(e).alias(n) for n, e in QUERIES]
    return table(spark, sf_dir, "part").groupBy(*QUERY_KEYS).agg(*aggs).select("query", "topk")


def derived_sql(columns: list[tuple[str, str]], source: str = "part", group: list[str] | None = None) -> str:
    tail = f" GROUP BY {', '.join(group)}" if group else ""
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns)} FROM {source}{tail}"
