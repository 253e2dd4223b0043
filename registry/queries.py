"""Every operator as a query over whole tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwell.functions import html as H
from pickwell.functions import text as X
from pickwell.functions import urls as U
from pickwell.functions import vectors as V
from pickwell.functions.terms import Vocabulary
from pickwell.operators import pages as P
from pickwell.operators import rerank as R
from pickwell.operators.dedup import conform, keep_first
from pickwell.operators.joins import gather_items
from pickwell.operators.runs import top_k_runs, write_runs
from pickwell.operators.sparse import top_k_sparse
from pickwell.operators.topk import check_dims, top_k
from pickwell.plans import catalog as C
from pickwell.plans import evaluate as E
from pickwell.plans import results as O
from pickwell.plans import upsert as Up
from pickwell.plans.index import build_index
from pickwell.plans.search import recommend, search
from pickwell.session import materialise, scratch_path
from pickwell.streaming.answers import AnswerTable, answer_stream
from pickwell.streaming.recommend import recommend_stream
from registry import inputs as I
from registry.inputs import derived, derived_queries, table
from registry.stored import QUERIES as STORED

SITE = "https://www.example.com"
TOPK = 10
ENCODER = V.HashEncoder(384)
SPARSE = V.SparseHashEncoder(1 << 18)
# Words of the catalog's titles, as the vocabulary of strong terms.
TITLE_WORDS = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget", "hot")
# Vocabularies that occur in the prose of ``documents``.
PROSE_P, PROSE_K, PROSE_LEVELS = ("quell", "tionhand"), ("schkeit", "erenst"), ("que", "der", "the")
LINK_PATHS = ("/the", "/la", "/ei")


def _round(column: str, digits: int = 9):
    return F.round(column, digits).alias(column)


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, I.CATALOG)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_index(_catalog(spark, sf_dir), ENCODER, item_id="item_id")


def _wishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.clean_queries(derived_queries(spark, sf_dir), topk="topk")


# ------------------------------------------------------------ vectors


def vector_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    items = vectors.select(F.col("vec_id").alias("item_id"), "embedding")
    return top_k(queries, items, TOPK).df.select("qid", "item_id", "rank", "similarity")


def vector_topk_blocks(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    items = vectors.select(F.col("vec_id").alias("item_id"), "embedding")
    hits = top_k(queries, items, TOPK, max_query_bytes=0, query_block_rows=1024)
    return hits.df.select("qid", "item_id", "rank", "similarity")


def vector_topk_runs(spark, sf_dir):
    """The same through a stored index with bounds."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    write_runs(vectors.select(F.col("vec_id").alias("item_id"), "embedding"), path := scratch_path(spark))
    return top_k_runs(queries, path, TOPK).df.select("qid", "item_id", "rank", "similarity")


def catalog_topk_runs(spark, sf_dir):
    """Wishes against the catalog through a stored index with bounds."""
    queries = _wishes(spark, sf_dir).select("query").distinct()
    vectors = queries.select(F.col("query").alias("qid"), ENCODER(F.col("query")).alias("qvec"))
    write_runs(_index(spark, sf_dir), path := scratch_path(spark))
    return top_k_runs(vectors, path, TOPK).df.select(F.col("qid").alias("query"), "item_id", "rank", "similarity")


def vector_normalize(spark, sf_dir):
    # lengths differ after scaling by the label
    scaled = table(spark, sf_dir, "embeddings").withColumn(
        "v", F.transform("embedding", lambda x: x.cast("double") * F.col("label"))
    )
    unit = F.transform(V.normalize(F.col("v")), lambda x, i: F.struct(i.alias("pos"), x.alias("x")))
    return scaled.select("vec_id", F.round(V.norm(F.col("v")), 9).alias("norm"), F.inline(unit)).select(
        "vec_id", "norm", "pos", _round("x")
    )


def vector_dims(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return check_dims(v.select(F.col("embedding").alias("qvec")), v)


def vector_inner_product(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(V.dot(F.col("embedding"), F.reverse("embedding")), 9).alias("product"))


# ------------------------------------------------------------ URLs


def _spellings(spark, sf_dir):
    """Every page URL in five spellings."""
    url = F.col("url")
    forms = F.array(
        url,
        F.concat(F.lit(" \t"), F.upper(url), F.lit("\n")),
        F.concat(url, F.lit("/a-b/c_d;v=1?x=/y/#z")),
        F.regexp_replace(url, "^https?://", ""),
        F.concat(F.regexp_replace(url, "^https?://[^/]+", ""), F.lit("//")),
    )
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(forms).alias("form", "url"))


def url_normalize(spark, sf_dir):
    return _spellings(spark, sf_dir).select("page_id", "form", U.normalize_url(F.col("url")).alias("norm"))


def url_slug(spark, sf_dir):
    df = _spellings(spark, sf_dir)
    return df.select("page_id", "form", U.slug(F.col("url")).alias("slug"), U.slug(F.col("url"), "item").alias("slug_or_item"))


def url_title_fallback(spark, sf_dir):
    return _spellings(spark, sf_dir).select("page_id", "form", U.title_from_url(F.col("url"), "Untitled").alias("title"))


# ------------------------------------------------------------ pages


def link_extract(spark, sf_dir):
    raw = P.extract_links(table(spark, sf_dir, "pages"), SITE, LINK_PATHS)
    made = P.extract_links(derived(spark, sf_dir, I.PAGES), SITE)
    return raw.withColumn("source", F.lit("pages")).unionByName(made.withColumn("source", F.lit("part")))


def link_dedup(spark, sf_dir):
    return P.dedup_links(P.extract_links(table(spark, sf_dir, "pages"), SITE, LINK_PATHS))


def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.heading(H.visible(F.col("html"))).alias("title"))


def page_description(spark, sf_dir):
    marked = table(spark, sf_dir, "pages").select("page_id", H.visible(F.col("html")).alias("m"))
    meta = H.meta_content(H.meta_tags(F.col("m")), "name", "description")
    return marked.select("page_id", F.coalesce(meta, H.first_paragraph(F.col("m"))).alias("description"))


def page_body_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", F.lower(H.text_of(H.visible(F.col("html")), " ")).alias("body")
    )


def page_tags(spark, sf_dir):
    tags = H.class_texts(H.visible(F.col("html")), ["ad", "tag"])
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(F.array_join(tags, ";"), F.lit("")).alias("tags"))


def page_fields_crawl(spark, sf_dir):
    return P.page_fields(derived(spark, sf_dir, I.PAGES), "crawl")


def page_fields_augment(spark, sf_dir):
    return P.page_fields(derived(spark, sf_dir, I.PAGES), "augment")


def page_rejects(spark, sf_dir):
    return P.page_rejects(derived(spark, sf_dir, I.PAGES))


def pages_to_catalog(spark, sf_dir):
    return C.build_catalog(table(spark, sf_dir, "pages"))


def crawl_catalog(spark, sf_dir):
    # every product page lists its own link, the categories' and others
    pages = derived(spark, sf_dir, I.PAGES)
    return C.crawl_catalog(pages, pages, SITE)


# ------------------------------------------------------------ classifiers


def _texts(spark, sf_dir):
    return derived(spark, sf_dir, I.TEXTS).withColumn("low", F.lower("text"))


def classify_type_p_first(spark, sf_dir):
    return _texts(spark, sf_dir).select("item_id", X.test_type_personality_first(F.col("low")).alias("test_type"))


def classify_type_k_first(spark, sf_dir):
    return _texts(spark, sf_dir).select("item_id", X.test_type_knowledge_first(F.col("low")).alias("test_type"))


def classify_language(spark, sf_dir):
    return _texts(spark, sf_dir).select("item_id", X.language(F.col("low")).alias("language"))


def classify_level_substring(spark, sf_dir):
    return _texts(spark, sf_dir).select("item_id", X.level_substring(F.col("low")).alias("level"))


def classify_level_word(spark, sf_dir):
    return _texts(spark, sf_dir).select("item_id", X.level_word(F.col("low")).alias("level"))


def classify_documents(spark, sf_dir):
    low = F.col("low")
    return table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low")).select(
        "doc_id",
        X.test_type_personality_first(low, PROSE_P, PROSE_K).alias("p_first"),
        X.test_type_knowledge_first(low, PROSE_P, PROSE_K).alias("k_first"),
        X.level_substring(low, PROSE_LEVELS).alias("level_substring"),
        X.level_word(low, PROSE_LEVELS).alias("level_word"),
        X.language(low, "und", "German").alias("language"),
    )


def duration_simple(spark, sf_dir):
    return _texts(spark, sf_dir).select("item_id", X.duration_simple(F.col("low")).alias("minutes"))


def duration_full(spark, sf_dir):
    t = F.col("text")
    return _texts(spark, sf_dir).select(
        "item_id", X.duration_full(t).alias("minutes"), X.duration_full(t, short_hours=True).alias("minutes_with_hr")
    )


def duration_window(spark, sf_dir):
    w, s = X.duration_window(F.col("text")), X.duration_window(F.col("text"), short_hours=True)
    return _texts(spark, sf_dir).select(
        "item_id", w["lo"].alias("lo"), w["hi"].alias("hi"), s["lo"].alias("lo_with_hr"), s["hi"].alias("hi_with_hr")
    )


def exclude_bundles(spark, sf_dir):
    return P.page_titles(derived(spark, sf_dir, I.PAGES))


def strong_terms(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    return texts.select(
        "item_id",
        F.array_join(X.strong_terms(F.col("text")), " ").alias("terms"),
        F.array_join(X.strong_terms(F.col("text"), TITLE_WORDS), " ").alias("title_terms"),
    )


def _prose_words(spark, sf_dir) -> DataFrame:
    """Distinct words of four letters a-z or more in the documents."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.explode(words).alias("word")).distinct()


def vocabulary_found(spark, sf_dir):
    """Which of all words of the documents the benchmark texts hold, as substrings and as words."""
    words = Vocabulary.of(_prose_words(spark, sf_dir), "word")
    low = F.lower("text")
    found = table(spark, sf_dir, "benchmark").select("item_id", words.found_in(low).alias("inside"), words.found_in(low, True).alias("whole"))
    return found.select("item_id", F.array_join("inside", " ").alias("inside"), F.array_join("whole", " ").alias("whole"))


def vocabulary_terms(spark, sf_dir):
    """Words of the documents that some benchmark text has."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    known = Vocabulary.of(table(spark, sf_dir, "benchmark").select(F.explode(words).alias("word")), "word")
    terms = table(spark, sf_dir, "documents").select("doc_id", known.strong_terms(F.col("text")).alias("terms"))
    return terms.select("doc_id", F.size("terms").alias("n"), F.array_join("terms", " ").alias("terms"))


# ------------------------------------------------------------ catalog


def _labelled(spark, sf_dir):
    return derived(spark, sf_dir, I.PAIRS)


def _known(spark, sf_dir):
    """The catalog of product pages: those without heading and the bundles are missing."""
    return C.build_catalog(derived(spark, sf_dir, I.PAGES))


def _page_pairs(spark, sf_dir):
    """Labelled pairs whose URL is spelled as in the page table."""
    return derived(spark, sf_dir, I.PAGES).select(F.lit("any").alias("query"), F.col("url").alias("relevant_url"))


def missing_labelled_urls(spark, sf_dir):
    return C.missing_urls(_known(spark, sf_dir), _labelled(spark, sf_dir))


def augment_rows(spark, sf_dir):
    need = C.missing_urls(_known(spark, sf_dir), _page_pairs(spark, sf_dir))
    return C.augment_rows(need, derived(spark, sf_dir, I.PAGES))


def catalog_merge(spark, sf_dir):
    # read twice by the merge, as the stored catalog it stands for
    known = materialise(_known(spark, sf_dir))
    return C.augment_catalog(known, _page_pairs(spark, sf_dir), derived(spark, sf_dir, I.PAGES))


def catalog_dedup(spark, sf_dir):
    """Pages of one host and language count as one; the lowest id stays."""
    keyed = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[^?#]*/", 0).alias("url"))
    return keep_first(keyed, ["url"], ["page_id"])


def catalog_conform(spark, sf_dir):
    narrow = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_size").alias("duration_min"))
    return conform(narrow, keep=["p_partkey"])


def catalog_counts(spark, sf_dir):
    pages = derived(spark, sf_dir, I.PAGES)
    return C.catalog_counts(pages, C.build_catalog(pages))


def pages_split(spark, sf_dir):
    """Good pages and rejects, both from one parse."""
    parsed = materialise(Up.parse_pages(derived(spark, sf_dir, I.PAGES)))
    good = Up.catalog_of(parsed).select(F.lit("item").alias("side"), "url", F.col("title").alias("note"))
    return good.unionByName(Up.rejects_of(parsed).select(F.lit("reject").alias("side"), "url", F.col("reason").alias("note")))


def _earlier(df: DataFrame, key: str, column: str) -> DataFrame:
    """An earlier version of a table: some rows differ, some are missing, some are there that went since."""
    changed = F.when(F.col(key) % 10 == 3, F.concat(column, F.lit(" before"))).otherwise(F.col(column))
    went = df.filter(F.col(key) % 29 == 0).withColumn(key, -F.col(key) - 1)
    return df.filter(F.col(key) % 17 != 0).withColumn(column, changed).unionByName(went)


def pages_upsert(spark, sf_dir):
    """A catalog out of parsed pages of an earlier crawl and the pages that changed since."""
    pages = derived(spark, sf_dir, I.PAGES)
    before = materialise(Up.parse_pages(_earlier(pages, "page_id", "html")))
    return Up.catalog_of(Up.update_pages(before, pages))


def index_upsert(spark, sf_dir):
    """A stored index brought from one version of the catalog to the next."""
    items = _catalog(spark, sf_dir)
    Up.write_table(Up.index_rows(_earlier(items, "item_id", "title"), ENCODER, "item_id"), path := scratch_path(spark), folders=32)
    before = materialise(Up.read_table(spark, path).select("fingerprint"))
    Up.apply_changes(path, Up.index_changes(Up.read_table(spark, path), items, ENCODER, "item_id"))
    rows = Up.read_table(spark, path).join(before.withColumn("_had", F.lit(True)), "fingerprint", "left")
    return _cells(rows.withColumn("reused", F.col("_had").isNotNull()), "item_id", "title", "reused")


def catalog_write_counts(spark, sf_dir):
    """Counts that come with writing a catalog."""
    counts = C.write_counted(table(spark, sf_dir, "pages"), f"{scratch_path(spark)}/catalog")
    return spark.createDataFrame(list(counts.items()), "metric string, n long")


# ------------------------------------------------------------ documents and index


def build_doc(spark, sf_dir):
    return _catalog(spark, sf_dir).select("item_id", X.document().alias("doc"))


def _cells(df: DataFrame, *keys: str) -> DataFrame:
    """Non-zero cells of the vectors, to compare them.

    Exploding the bare column would make the optimizer test its size first, and
    for that run the encoder a second time below.
    """
    cells = F.transform("embedding", lambda w, i: F.struct(i.alias("bucket"), w.cast("double").alias("weight")))
    exploded = df.select(*keys, F.inline(F.filter(cells, lambda c: c["weight"] != 0)))
    return exploded.select(*keys, "bucket", _round("weight"))


def hash_encode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _cells(docs.select("doc_id", ENCODER(F.col("text")).alias("embedding")), "doc_id")


def build_index_query(spark, sf_dir):
    """From a catalog that lacks a column, which is filled."""
    index = build_index(_catalog(spark, sf_dir).drop("language"), ENCODER, item_id="item_id")
    return _cells(index, "item_id", "title", "url", "duration_min", "language")


def index_ids(spark, sf_dir):
    """Items under URLs that repeat or are missing."""
    index = build_index(derived(spark, sf_dir, I.LOOSE_URLS), ENCODER)
    return index.select("item_id", "title", "duration_min")


def text_topk(spark, sf_dir):
    texts = table(spark, sf_dir, "documents")
    docs = texts.select(F.col("doc_id").alias("item_id"), ENCODER(F.col("text")).alias("embedding"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), ENCODER(F.col("text")).alias("qvec"))
    return top_k(queries, docs, TOPK, dim=ENCODER.dim).df.select("qid", "item_id", "rank", "similarity")


def sparse_encode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", SPARSE(F.col("text")).alias("terms"))
    # as in _cells, the bare column would be encoded twice
    terms = F.transform("terms", lambda t: F.struct(t["bucket"].alias("bucket"), t["weight"].cast("double").alias("weight")))
    return docs.select("doc_id", F.inline(terms)).select("doc_id", "bucket", _round("weight"))


def sparse_topk(spark, sf_dir):
    """As ``text_topk``, with so many buckets that no dense vector would do."""
    texts = table(spark, sf_dir, "documents")
    docs = texts.select(F.col("doc_id").alias("item_id"), SPARSE(F.col("text")).alias("embedding"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), SPARSE(F.col("text")).alias("qvec"))
    return top_k_sparse(queries, docs, TOPK).df.select("qid", "item_id", "rank", "similarity")


# ------------------------------------------------------------ recommend


def clamp_topk(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    asked = F.nullif(F.col("p_size") - 20, F.lit(7))
    return part.select("p_partkey", R.clamp_topk(asked).alias("topk"))


def clean_queries(spark, sf_dir):
    return R.clean_queries(derived(spark, sf_dir, I.LINES), topk="topk")


def recommend_rejects(spark, sf_dir):
    return R.query_rejects(derived(spark, sf_dir, I.LINES)).select("item_id", "query", "reason")


def topk_with_meta(spark, sf_dir):
    queries = _wishes(spark, sf_dir)
    found = search(queries, _index(spark, sf_dir), 5, ENCODER)
    return found.join(queries.select("qid", "query"), "qid").select(
        "query", "rank", "similarity", "item_id", "title", "url", "category", "tags", "duration_min"
    )


def keyword_gate(spark, sf_dir):
    """The best ten by similarity, then only those on topic."""
    queries = _wishes(spark, sf_dir).withColumn("terms", X.strong_terms(F.col("query"), TITLE_WORDS))
    found = search(queries, _index(spark, sf_dir), TOPK, ENCODER)
    kept = R.keyword_gate(found.join(queries.select("qid", "query", "terms"), "qid"))
    return kept.select("query", "rank", "item_id", "title")


def duration_score(spark, sf_dir):
    w = X.duration_window(F.col("text"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_size")
    timed = _texts(spark, sf_dir).select("item_id", w.alias("w")).join(part, "item_id")
    score = R.duration_score(F.nullif(F.col("p_size"), F.lit(13)), F.col("w.lo"), F.col("w.hi"))
    return timed.select("item_id", F.round(score, 9).alias("duration_score"))


def _recommended(spark, sf_dir):
    queries = _wishes(spark, sf_dir)
    return queries, recommend(queries, _index(spark, sf_dir), ENCODER, TITLE_WORDS)


def recommend_query(spark, sf_dir):
    queries, hits = _recommended(spark, sf_dir)
    return hits.join(queries.select("qid", "query"), "qid").select(
        "query", "rank", "item_id", "title", "url", "test_type", "level", "language", "duration_min",
        "description", "similarity", _round("duration_score"), "score",
    )


def result_view(spark, sf_dir):
    _, hits = _recommended(spark, sf_dir)
    return O.result_view(hits, keep=("item_id", "rank"))


def response_nested(spark, sf_dir):
    queries, hits = _recommended(spark, sf_dir)
    answers = O.responses(queries, hits)
    billionths = lambda x: F.round(x * 1e9).cast("bigint")
    names = F.transform(
        "recommendations",
        lambda r: F.concat_ws(
            "|", r["assessment_name"], r["assessment_url"], r["test_type"], r["level"], r["language"],
            r["duration_min"], billionths(r["similarity"]), r["description"],
        ),
    )
    return answers.select("query", "count", F.array_join(names, ";").alias("recommendations"))


def batch_export(spark, sf_dir):
    """A query file with repeated lines: one query per part, equal ones searched once."""
    lines = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("query"))
    queries = R.clean_queries(lines, trim=False)
    return O.batch_export(queries, search(queries, _index(spark, sf_dir), TOPK, ENCODER))


def recommend_stream_query(spark, sf_dir):
    """Every part as an arriving query, answered by micro-batches into a table."""
    folder = scratch_path(spark)
    schema = table(spark, sf_dir, "part").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/part.parquet*").select(
        F.concat_ws(" ", "p_name", F.lower("p_type")).alias("query"), F.lit(3).alias("topk")
    )

    def write(answers, batch_id):
        answers.write.mode("overwrite").parquet(f"{folder}/answers/batch={batch_id}")

    stream = recommend_stream(arriving, materialise(_index(spark, sf_dir)), write, f"{folder}/state", encoder=ENCODER, vocabulary=TITLE_WORDS)
    stream.awaitTermination()
    answers = spark.read.parquet(f"{folder}/answers")
    return answers.select("query", F.posexplode("recommendations").alias("place", "hit")).select(
        "query", (F.col("place") + 1).alias("rank"), "hit.assessment_name", "hit.assessment_url", "hit.similarity"
    )


def answer_stream_query(spark, sf_dir):
    """Every part as an arriving query, in two rounds: the second repeats the first and finds its answers."""
    folder = scratch_path(spark)
    part = table(spark, sf_dir, "part")
    asked = part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("query"), F.lit(3).alias("topk"))
    index = materialise(_index(spark, sf_dir))
    for number in range(2):
        asked.write.parquet(f"{folder}/asked/{number}")
        arriving = spark.readStream.schema(asked.schema).parquet(f"{folder}/asked/*")
        options = {"encoder": ENCODER, "vocabulary": TITLE_WORDS}
        answer_stream(arriving, index, f"{folder}/answers", f"{folder}/state", clock=lambda: 1000.0 + number, **options).awaitTermination()
    answers = AnswerTable(spark, f"{folder}/answers").read()
    return answers.select("query", "batch", F.col("answered_at").cast("long").alias("answered_at"), F.posexplode("recommendations").alias("place", "hit")).select(
        "query", "batch", "answered_at", (F.col("place") + 1).alias("rank"), "hit.assessment_url", "hit.similarity"
    )


# ------------------------------------------------------------ evaluation


def truth_sets(spark, sf_dir):
    return E.truth_sets(E.truth_pairs(_labelled(spark, sf_dir))).drop("qid")


def recall_at_k(spark, sf_dir):
    per_query = E.evaluate(_labelled(spark, sf_dir), _index(spark, sf_dir), TOPK, ENCODER)
    return E.report(per_query.select("query", "n_truth", _round("recall")))


def mean_recall(spark, sf_dir):
    per_query = E.evaluate(_labelled(spark, sf_dir), _index(spark, sf_dir), TOPK, ENCODER)
    return E.mean_recall(per_query).select("queries", _round("mean_recall"))


QUERIES = {
    f.__name__.removesuffix("_query"): f
    for f in (
        vector_topk, vector_topk_blocks, vector_topk_runs, catalog_topk_runs, vector_normalize, vector_dims, vector_inner_product,
        url_normalize, url_slug, url_title_fallback,
        link_extract, link_dedup, page_title, page_description, page_body_text, page_tags,
        page_fields_crawl, page_fields_augment, page_rejects, pages_to_catalog, crawl_catalog,
        classify_type_p_first, classify_type_k_first, classify_language, classify_level_substring,
        classify_level_word, classify_documents, duration_simple, duration_full, duration_window,
        exclude_bundles, strong_terms, vocabulary_found, vocabulary_terms,
        missing_labelled_urls, augment_rows, catalog_merge, catalog_dedup, catalog_conform, catalog_counts,
        build_doc, hash_encode, build_index_query, index_ids, text_topk, sparse_encode, sparse_topk,
        catalog_write_counts, pages_split, pages_upsert, index_upsert,
        clamp_topk, clean_queries, recommend_rejects, topk_with_meta, keyword_gate, duration_score,
        recommend_query, result_view, response_nested, batch_export, recommend_stream_query, answer_stream_query,
        truth_sets, recall_at_k, mean_recall,
    )
} | STORED
