"""Exact top-k by integer inner product, term at a time.

Queries and rows are cut into hashed blocks; a task holds one block of each.
There the rows become postings (for each component, the rows that have it and
their weights), and each query, a sparse row of weights, adds its weighted
postings into a dense array of scores. A partition selection keeps the k best of
the block; the bests of all blocks are merged by rank. A postings list that
holds more than half of the block's rows is kept as a dense array.

Defined cases: vectors that are NULL or hold NULL, NaN or infinite components
take no part, nor rows without id; rows with the same id are rows of their own, as
queries and as hits, told apart by ``row``; a component that only one side has adds
nothing; ties go to the smaller id; fewer than k other rows give fewer results;
empty tables give none; a score beyond 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickwell.llm import common as C
from pickwell.session import materialise

BLOCK_VALUES = 1 << 18  # components of one side in a task
SCORES = 1 << 20  # dense scores held at once


def finite(vector: Column) -> Column:
    """True if the vector is there and all its components are finite numbers."""
    inf = float("inf")
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf))
    return vector.isNotNull() & F.coalesce(ok, F.lit(False))


def quantised(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``id, row, weights``: every component as ``floor(scale * x)``, x taken as double; stored, so that a row keeps its number."""
    rows = vectors.filter(F.col(key).isNotNull() & finite(F.col(vector))).select(
        F.col(key).cast("long").alias("id"),
        F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("weights"),
    )
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()))


def _sparse(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, their row numbers, and the (place, component, weight) of all components, by component."""
    rows = rows.sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()
    ids = rows.column("id").to_numpy()
    lists = rows.column("weights").combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    weights = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    terms = C.ranges(np.zeros(len(lengths), np.int64), lengths)
    order = np.argsort(terms, kind="stable")
    return ids, rows.column("row").to_numpy(), np.repeat(np.arange(len(ids)), lengths)[order], terms[order], weights[order]


def search_block(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of this block for each query of this block."""
    ids, numbers, owner, terms, weights = _sparse(rows)
    query_ids, q_numbers, q_owner, q_terms, q_weights = _sparse(queries)
    n = len(ids)
    by_number = np.argsort(numbers)
    selves = np.searchsorted(numbers, q_numbers, sorter=by_number)
    known = selves < n
    selves = by_number[np.minimum(selves, n - 1)] if n else selves
    known[known] = numbers[selves[known]] == q_numbers[known]
    out: list[tuple[np.ndarray, ...]] = []
    sum_bound = float(np.abs(weights).max(initial=1)) * float(np.abs(q_weights).max(initial=1)) * (terms.max(initial=0) + 1.0)
    kind = np.int32 if sum_bound < 2**31 else np.int64
    starts = np.append(C.run_starts(terms), len(terms))
    postings = {}
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        real = weights[a:b] != 0
        at, w = owner[a:b][real], weights[a:b][real].astype(kind)
        if 2 * len(at) > n:
            full = np.zeros(n, kind)
            full[at] = w
            at, w = None, full
        postings[int(terms[a])] = at, w
    step = max(1, SCORES // max(n, 1))
    for first in range(0, len(query_ids), step):
        size = min(step, len(query_ids) - first)
        scores = np.zeros((size, n), kind)
        mine = (q_owner >= first) & (q_owner < first + size) & (q_weights != 0)
        own, term, weight = q_owner[mine] - first, q_terms[mine], q_weights[mine].astype(kind)
        cuts = np.append(C.run_starts(term), len(term))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if int(term[a]) not in postings:
                continue
            at, w = postings[int(term[a])]
            added = np.multiply.outer(weight[a:b], w)
            if at is not None:
                scores[np.ix_(own[a:b], at)] += added
            elif b - a == size:
                scores += added
            else:
                scores[own[a:b]] += added
        scores = scores.astype(np.int64)
        this, there = selves[first : first + size], known[first : first + size]
        if sum_bound >= 2.0**63:
            _require_fit(own, term, weight, postings, size, n, np.flatnonzero(there), this[there])
        keep = min(k + 1, n)  # one more, as the query's own row may be among them
        best = _best(scores, keep)
        row = np.repeat(np.arange(size), best.shape[1])
        col = best.ravel()
        other = ~(there[row] & (col == this[row]))
        row, col = row[other], col[other]
        out.append((q_numbers[first + row], query_ids[first + row], ids[col], scores[row, col]))
    parts = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), (), ()))]
    return pa.table([pa.array(p, pa.int64()) for p in parts], names=["query", "query_id", "vec_id", "score"])


def _best(scores: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the highest scores of each row; of equal ones the first, as rows are in id order."""
    size, n = scores.shape
    if not n or keep == n:
        return np.tile(np.arange(n), (size, 1))
    border = np.partition(scores, n - keep, axis=1)[:, n - keep, None]
    above = scores > border
    # places left for scores at the border, the first ones get them
    at_border = scores == border
    room = keep - above.sum(1, keepdims=True)
    chosen = above | at_border & (np.cumsum(at_border, axis=1, dtype=np.int32) <= room)
    return np.nonzero(chosen)[1].reshape(size, keep)


def _require_fit(own: np.ndarray, term: np.ndarray, weight: np.ndarray, postings: dict, size: int, n: int, queries: np.ndarray, selves: np.ndarray) -> None:
    """Sums in 64 bits wrap without harm if their result fits; one that does not is an error."""
    total = np.zeros((size, n))
    for q, t, w in zip(own.tolist(), term.tolist(), weight.tolist()):
        if t in postings:
            at, values = postings[t]
            total[q, slice(None) if at is None else at] += float(w) * values.astype(np.float64)
    # a query's product with itself is no score
    total[queries, selves] = 0
    if np.abs(total).max(initial=0) >= 2.0**63 * (1 - 1e-9):
        raise OverflowError("an inner product does not fit 64 bits: scale the vectors down")


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query (``id, weights``) among the other rows.

    ``row`` tells which row is the query's own; without that column the id does, and has to be unique.
    """
    queries, rows = [df if "row" in df.columns else df.withColumn("row", F.col("id")) for df in (queries, rows)]
    size = lambda df: df.agg(F.count("*"), F.max(F.size("weights"))).first()
    (n, width), (m, q_width) = size(rows), size(queries)
    per_task = max(16, BLOCK_VALUES // max(width or 1, q_width or 1, 1))
    row_blocks, query_blocks = -(-max(n, 1) // per_task), -(-max(m, 1) // per_task)

    def block(count: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = queries.select("id", "row", "weights", F.lit(True).alias("is_query"), block(query_blocks).alias("q"), every(row_blocks).alias("r"))
    right = rows.select("id", "row", "weights", F.lit(False).alias("is_query"), block(row_blocks).alias("r"), every(query_blocks).alias("q"))

    def run(cell: pa.Table) -> pa.Table:
        is_query = cell.column("is_query")
        return search_block(cell.filter(is_query), cell.filter(pc.invert(is_query)), k)

    found = left.unionByName(right).groupBy("q", "r").applyInArrow(run, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def topk_query(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k best other rows of each row whose id is divisible by ``every``."""
    rows = quantised(vectors.select("vec_id", "embedding"), "vec_id", "embedding", 256.0)
    return top_k(rows.filter(F.col("id") % every == 0), rows, k)
