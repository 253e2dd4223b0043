"""Query preparation, keyword gate, duration score and the final order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickwell.functions import text as X
from pickwell.functions.terms import Vocabulary
from pickwell.functions.strings import null_to_blank, strip

MAX_TOPK = 10
OVERFETCH = 4
# Share of similarity and of duration fit in the final score.
SIMILARITY_WEIGHT = 0.85
DURATION_WEIGHT = 0.15
MIN_TOLERANCE = 15.0

# The columns a hit's text is made of, in this order.
GATE_COLUMNS = ("title", "description", "tags", "category")


def clamp_topk(topk: Column, default: int = MAX_TOPK, most: int = MAX_TOPK) -> Column:
    """Results wanted: 1 to ``most``; 0 and NULL mean the default (at most ``most``), negatives 1."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(F.nullif(topk, F.lit(0)), F.lit(min(default, most))))).cast("int")


def clean_queries(
    queries: DataFrame,
    text: str = "query",
    topk: str | None = None,
    qid: str | None = None,
    trim: bool = True,
    max_topk: int = MAX_TOPK,
) -> DataFrame:
    """``qid, query, topk, copies`` of the usable queries.

    Without an id column, equal queries become one row with the number of their
    copies, and the id is a hash of the text; so a query repeated many times is
    searched once. ``trim=False`` keeps the text as it is, as a batch export
    repeats it. ``max_topk`` is the most results a query can ask for; give
    ``recommend`` the same.
    """
    wanted = clamp_topk(F.col(topk) if topk else F.lit(None).cast("int"), most=max_topk)
    query = strip(F.col(text)) if trim else F.col(text)
    df = queries.select(
        *([F.col(qid).alias("qid")] if qid else []), query.alias("query"), wanted.alias("topk")
    ).filter(strip(F.col("query")) != "")
    if qid:
        return df.withColumn("copies", F.lit(1).cast("bigint"))
    counted = df.groupBy("query", "topk").agg(F.count("*").alias("copies"))
    key = F.concat_ws("\u0001", F.col("topk").cast("string"), F.col("query"))
    return counted.select(F.sha2(key, 256).alias("qid"), "query", "topk", "copies")


def query_rejects(queries: DataFrame, text: str = "query") -> DataFrame:
    """The rows without a usable query, with the reason."""
    reason = F.when(F.col(text).isNull(), "no query").when(strip(F.col(text)) == "", "empty query")
    return queries.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def gate_text(columns: Sequence[str] = GATE_COLUMNS) -> Column:
    return F.lower(F.concat_ws(" ", *(null_to_blank(F.col(c)) for c in columns)))


def keyword_gate(hits: DataFrame, terms: str = "terms", whole_word: bool = False, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Hits whose text holds any strong term of their query; no terms keep all.

    With a ``vocabulary`` that has all terms of all queries, a text is searched once for
    all of them, not once for each term of its query.

    It runs after the top-k cut, as moving it before would bring other items in.
    Evaluated inside an array, it is no join condition and cannot be moved to
    one side of the join that brings hits and queries together.
    """
    if vocabulary is not None:
        found = hits.withColumn("_found", vocabulary.found_in(gate_text(), whole_word))
        holds = (F.size(terms) == 0) | F.arrays_overlap(F.col("_found"), F.col(terms))
        return found.filter(holds).drop("_found")
    text = F.array(F.struct(gate_text().alias("_gate")))
    on_topic = F.filter(text, lambda t: X.on_topic(t["_gate"], F.col(terms), whole_word))
    return hits.select("*", F.inline(on_topic)).drop("_gate")


def duration_score(duration: Column, lo: Column, hi: Column) -> Column:
    """1 at the middle of the wished window, falling to 0 at its tolerance; 0 if either is unknown."""
    center = (lo + hi) / F.lit(2.0)
    tolerance = F.greatest(F.lit(MIN_TOLERANCE), (hi - lo) / F.lit(2.0))
    d = duration.try_cast("double")
    fit = F.lit(1.0) - F.abs(F.when(~F.isnan(d), d) - center) / tolerance
    # greatest() skips NULL, so an unknown duration or window gives 0
    return F.greatest(F.lit(0.0), fit)


def final_rank(
    hits: DataFrame,
    similarity_weight: float = SIMILARITY_WEIGHT,
    duration_weight: float = DURATION_WEIGHT,
    max_topk: int = MAX_TOPK,
) -> DataFrame:
    """Blend both scores and keep each query's ``topk`` best; no ``topk`` is above ``max_topk``."""
    score = F.round(
        F.lit(similarity_weight) * F.col("similarity") + F.lit(duration_weight) * F.col("duration_score"), 9
    )
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("similarity"), "item_id")
    ranked = hits.withColumn("score", score).withColumn("rank", F.row_number().over(w))
    # the constant bound lets the plan cut rows before the shuffle
    return ranked.filter((F.col("rank") <= max_topk) & (F.col("rank") <= F.col("topk")))
