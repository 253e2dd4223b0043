"""Search and recommendation for a table of queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwell.functions import text as X
from pickwell.functions.terms import Vocabulary
from pickwell.functions.vectors import HashEncoder
from pickwell.operators.joins import MAX_BROADCAST_BYTES, gather_items
from pickwell.operators.rerank import MAX_TOPK, OVERFETCH, clamp_topk, duration_score, final_rank, keyword_gate
from pickwell.operators.topk import Hits, top_k
from pickwell.plans.index import require_encoder
from pickwell.schemas import CATALOG_COLUMNS
from pickwell.session import materialise


def find(queries: DataFrame, index: DataFrame, k: int, encoder=HashEncoder(), **options) -> Hits:
    """Ids and similarities of the k best items of each query (``qid, query``)."""
    require_encoder(index, encoder)
    vectors = queries.select("qid", encoder(F.col("query")).alias("qvec"))
    return top_k(vectors, index, k, dim=encoder.dim, **options)


def search(queries: DataFrame, index: DataFrame, k: int = MAX_TOPK, encoder=HashEncoder(), **options) -> DataFrame:
    """Plain top-k with the items' catalog columns: ``qid, rank, similarity, item_id, …``."""
    hits = find(queries, index, k, encoder, **options)
    items = index.select("item_id", *CATALOG_COLUMNS)
    return gather_items(hits, items).select("qid", "rank", "similarity", "item_id", *CATALOG_COLUMNS)


def recommend(
    queries: DataFrame,
    index: DataFrame,
    encoder=HashEncoder(),
    vocabulary: Sequence[str] | Vocabulary = X.STRONG_TERMS,
    whole_word: bool = False,
    short_hours: bool = False,
    overfetch: int = OVERFETCH,
    max_topk: int = MAX_TOPK,
    **options,
) -> DataFrame:
    """Up to ``topk`` items per query (``qid, query, topk``), best first.

    ``topk`` is clamped to 1 .. ``max_topk``; NULL and 0 mean the default of ten.

    Fetches ``overfetch * topk`` by similarity, drops off-topic hits, blends
    similarity with the fit to the wished duration, and ranks again.
    ``whole_word`` keeps a term such as "r" from matching inside other words,
    ``short_hours`` reads "hr" and "hrs" as hours. A ``Vocabulary`` may hold any number
    of terms; a sequence of them becomes part of the plan.
    """
    large = vocabulary if isinstance(vocabulary, Vocabulary) else None
    # stored, as it is counted, encoded and joined
    queries = materialise(queries.select("qid", "query", clamp_topk(F.col("topk"), most=max_topk).alias("topk")))
    hits = find(queries, index, overfetch * max_topk, encoder, **options)
    window = X.duration_window(F.col("query"), short_hours=short_hours)
    # what the rules need of a query; distinct terms, so its size is bounded by the vocabulary
    wishes = queries.select(
        "qid",
        "topk",
        F.array_distinct(large.strong_terms(F.col("query")) if large else X.strong_terms(F.col("query"), vocabulary)).alias("terms"),
        window["lo"].alias("lo"),
        window["hi"].alias("hi"),
    )
    if hits.queries is not None and not large:
        per_query = sum(len(word.encode()) + 16 for word in vocabulary) + 64
        if hits.query_bytes + hits.queries * per_query <= MAX_BROADCAST_BYTES:
            wishes = F.broadcast(wishes)
    found = gather_items(hits, index.select("item_id", *CATALOG_COLUMNS)).join(wishes, "qid")
    full = keyword_gate(found.filter(F.col("rank") <= F.col("topk") * overfetch), "terms", whole_word, large)
    scored = full.withColumn("duration_score", duration_score(F.col("duration_min"), F.col("lo"), F.col("hi")))
    return final_rank(scored, max_topk=max_topk).select(
        "qid", "rank", "item_id", *CATALOG_COLUMNS, "similarity", "duration_score", "score"
    )
