"""Exact top-k by inner product, for many queries at once.

Every (query, item) score is looked at, none is stored: a task multiplies a
block of queries with a block of items and keeps k candidates per query. Only
those leave the task, and one window per query picks the final k.

Queries come in blocks that fit every task (``max_query_bytes``, and k of each query
``MAX_KEPT``). Items never move: a block's matrix goes to the tasks, items are scanned
where they lie, and nothing but candidates is shuffled, under the number of their
query; ids come back after the last cut. One block is a lazy plan. More than one
are stored and searched one after the other: the driver holds one of them, which is
sent, used and destroyed before the next, and its hits are added to a table in the
shared folder. Each block reads the items again, which is little beside the
products of its tens of thousands of queries with every item.

If items lie in many tasks, a share of them is searched first. Its kth best is a
floor that the search of all of them starts with, so a task no longer sends k
candidates a query but those that may still be among the k best.

Similarity is summed in double precision and rounded to ``DIGITS``; equal values
are ordered by item id, so exact copies of an item rank in a fixed order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pickwell.session import materialise, scratch_path

DIGITS = 9
MAX_QUERY_BYTES = 32 * 1024 * 1024
QUERY_BLOCK_BYTES = 64 * 1024 * 1024
SCAN_TASKS = 20_000
# with more tasks than this, one item in as many is searched first
SEED_TASKS = 64
# candidates one task keeps
MAX_KEPT = 4_000_000
_SCORE_CELLS = 4_000_000
# queries whose scores are taken at once; more are taken in turn
_QUERIES_AT_ONCE = 1 << 16


@dataclass
class Hits:
    """Top-k rows ``qid, item_id, rank, similarity`` and what is known of their size.

    ``queries`` and ``query_bytes`` (of their ids) are set if the queries were few
    enough to be counted out, ``item_bytes`` if item ids have a fixed width, ``stored``
    if the rows are a table and no plan.
    """

    df: DataFrame
    k: int
    queries: int | None = None
    query_bytes: int | None = None
    item_bytes: int | None = None
    stored: bool = False

    @property
    def max_bytes(self) -> int | None:
        """A proven bound of the size of all rows, or None."""
        if self.queries is None or self.item_bytes is None:
            return None
        return self.k * (self.query_bytes + self.queries * (self.item_bytes + 32))


def check_dims(queries: DataFrame, items: DataFrame, qvec: str = "qvec", ivec: str = "embedding") -> DataFrame:
    """``side, min_dim, max_dim, rows`` of both vector columns."""

    def sizes(df: DataFrame, column: str, side: str) -> DataFrame:
        n = F.size(column)
        return df.agg(
            F.lit(side).alias("side"), F.min(n).alias("min_dim"), F.max(n).alias("max_dim"), F.count(n).alias("rows")
        )

    return sizes(queries, qvec, "queries").unionByName(sizes(items, ivec, "items"))


def require_same_dims(queries: DataFrame, items: DataFrame, qvec: str = "qvec", ivec: str = "embedding") -> int:
    """The common dimension; raises a clear error if the vectors disagree."""
    seen = {d for r in check_dims(queries, items, qvec, ivec).collect() for d in (r.min_dim, r.max_dim) if d is not None}
    if len(seen) > 1:
        raise ValueError(f"vectors of different dimension: {sorted(seen)}; were they made by the same encoder?")
    return seen.pop() if seen else 0


def top_k(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    max_query_bytes: int = MAX_QUERY_BYTES,
    query_block_rows: int | None = None,
    scan_tasks: int = SCAN_TASKS,
    seed_tasks: int = SEED_TASKS,
    dim: int | None = None,
) -> Hits:
    """The k best items of each query.

    ``queries``: ``qid, qvec``; ``items``: ``item_id, embedding``. Ids are unique
    on each side. Fewer items than k give fewer rows. The width of the vectors is
    that of the first one unless ``dim`` tells it; a task that meets another width
    fails with a message. ``scan_tasks`` bounds the tasks of a scan, and with them the
    candidates shuffled. Items of a plan that encodes or shuffles them are stored before
    they are read more than once.
    """
    queries, items = queries.select("qid", "qvec"), items.select("item_id", "embedding")
    dim = dim or _first_dim(queries, items)
    rested: list[DataFrame] = []

    def search(block: pa.Table, sent: list[Broadcast] | None) -> DataFrame:
        if sent is not None and not rested:
            rested.append(resting(items))
        return block_hits(block, rested[0] if rested else items, k, scan_tasks, seed_tasks, queries.schema["qid"].dataType, sent)

    return search_in_blocks(queries, items.schema["item_id"].dataType, k, search, F.lit(8 * dim), max_query_bytes, query_block_rows)


def search_in_blocks(
    queries: DataFrame,
    itype: T.DataType,
    k: int,
    search: Callable[[pa.Table, list[Broadcast] | None], DataFrame],
    size: Column,
    max_query_bytes: int = MAX_QUERY_BYTES,
    query_block_rows: int | None = None,
) -> Hits:
    """Hits of ``queries`` (``qid`` and what a query is), by one search or by a search a block.

    ``search`` answers a block; its list, if there is one, takes the variables it sends. ``size``
    is what a query takes in a task, in bytes.
    """
    item_bytes = 8 if isinstance(itype, T.IntegralType) else None
    # Measuring reads little more than ids; queries are fetched once they are known to fit.
    id_bytes = F.octet_length(F.col("qid").cast("string"))
    n, ids, most = queries.agg(F.count("*"), F.coalesce(F.sum(id_bytes), F.lit(0)), F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()
    if most + ids <= max_query_bytes and n * k <= MAX_KEPT:
        block = queries.toArrow()
        return Hits(search(block, None), k, block.num_rows, block["qid"].nbytes, item_bytes)
    blocks = -(-n // query_block_rows) if query_block_rows else max(-(-most // (2 * QUERY_BLOCK_BYTES)), -(-n * k // MAX_KEPT))
    return Hits(_block_by_block(queries, itype, int(blocks), search), k, item_bytes=item_bytes, stored=True)


def resting(items: DataFrame) -> DataFrame:
    """The items as they are if they are read from files, else stored.

    A plan that encodes items or deals them out anew would do so for every block.
    """
    plans = items._jdf.queryExecution()
    made = "UDF" in plans.optimizedPlan().toString() or "Exchange" in plans.executedPlan().toString()
    return materialise(items) if made or not items.inputFiles() else items


def _block_by_block(queries: DataFrame, itype: T.DataType, blocks: int, search: Callable) -> DataFrame:
    """Hits of all queries, a hashed block of them at a time."""
    spark, qtype = queries.sparkSession, queries.schema["qid"].dataType
    path = scratch_path(spark)
    of_block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")
    # one task writes a block, which is as large as what one task is sent
    queries.withColumn("_block", of_block).repartition(blocks, "_block").write.partitionBy("_block").parquet(f"{path}/queries")
    stored = spark.read.schema(T.StructType([*queries.schema, T.StructField("_block", T.IntegerType())])).parquet(f"{path}/queries")
    schema = hit_schema(qtype, itype)
    spark.createDataFrame([], schema).write.parquet(f"{path}/hits")
    for number in range(blocks):
        block = stored.filter(F.col("_block") == number).drop("_block").toArrow()
        sent: list[Broadcast] = []
        search(block, sent).write.mode("append").parquet(f"{path}/hits")
        for variable in sent:
            variable.destroy()
    return spark.read.schema(schema).parquet(f"{path}/hits")


def hit_schema(qtype: T.DataType, itype: T.DataType) -> T.StructType:
    kinds = {"qid": qtype, "item_id": itype, "rank": T.IntegerType(), "similarity": T.DoubleType()}
    return T.StructType([T.StructField(n, kind) for n, kind in kinds.items()])


def block_hits(
    block: pa.Table,
    items: DataFrame,
    k: int,
    scan_tasks: int = SCAN_TASKS,
    seed_tasks: int = SEED_TASKS,
    qtype: T.DataType | None = None,
    sent: list[Broadcast] | None = None,
) -> DataFrame:
    """``qid, item_id, rank, similarity`` of one block of queries (``qid, qvec``), items scanned where they lie.

    With ``sent``, what goes to the tasks is a broadcast variable, added to that list.
    """
    spark = items.sparkSession
    qtype = qtype or T.LongType()
    if not block.num_rows:
        return spark.createDataFrame([], hit_schema(qtype, items.schema["item_id"].dataType))
    items = items.coalesce(scan_tasks)
    matrix = _matrix(block["qvec"])
    floors = np.full(block.num_rows, -np.inf)
    if items.rdd.getNumPartitions() > seed_tasks:
        some = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(seed_tasks)) == 0)
        for r in ranked_hits(_scan_items(send(spark, (matrix, floors), sent), some, k), k).filter(F.col("rank") == k).toLocalIterator():
            floors[r.qid] = r.similarity
    return named(ranked_hits(_scan_items(send(spark, (matrix, floors), sent), items, k), k), block, qtype)


def named(ranked: DataFrame, block: pa.Table, qtype: T.DataType) -> DataFrame:
    """Hits with the ids of their queries in place of numbers; as many names are sent as the block has queries."""
    names = ranked.sparkSession.createDataFrame(
        pa.table({"_number": pa.array(np.arange(block.num_rows), pa.int32()), "_name": block["qid"]}),
        T.StructType([T.StructField("_number", T.IntegerType()), T.StructField("_name", qtype)]),
    )
    joined = ranked.withColumnRenamed("qid", "_number").join(F.broadcast(names), "_number").withColumnRenamed("_name", "qid")
    return joined.select("qid", "item_id", "rank", "similarity")


def send(spark: SparkSession, value: tuple, sent: list[Broadcast] | None) -> Callable[[], tuple]:
    """A way for tasks to get the value: part of their function, or a broadcast variable the caller destroys."""
    if sent is None:
        return lambda: value
    variable = spark.sparkContext.broadcast(value)
    sent.append(variable)
    return lambda: variable.value


def ranked_hits(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), "item_id")
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _first_dim(queries: DataFrame, items: DataFrame) -> int:
    firsts = [df.select(F.size(c)).first() for df, c in ((queries, "qvec"), (items, "embedding"))]
    widths = sorted({r[0] for r in firsts if r and r[0]})
    if len(widths) > 1:
        raise ValueError(f"vectors of different dimension: {widths}; were they made by the same encoder?")
    return max(widths, default=1)


def _scan_items(get: Callable[[], tuple], items: DataFrame, k: int) -> DataFrame:
    """Candidates whose ``qid`` is the number of the query in the block."""
    out = T.StructType(
        [T.StructField("qid", T.IntegerType()), items.schema["item_id"], T.StructField("similarity", T.DoubleType())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, floors = get()
        best = _Best(pa.array(np.arange(len(matrix)), pa.int32()), matrix, k, floors)
        for batch in batches:
            best.add(batch.column("item_id"), batch.column("embedding"))
        yield from best.batches()

    return items.mapInArrow(scan, out)


# ---------------------------------------------------------------- inside a task


def _ids(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = _ids(column)
    n = len(lists)
    if n == 0:
        return np.zeros((0, 0))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if lists.null_count or len(flat) % n or np.any(np.diff(lists.offsets.to_numpy()) != len(flat) // n):
        raise ValueError("vectors of different dimension or missing vectors")
    return flat.reshape(n, -1)


def _arrow_schema(qid: pa.DataType, item: pa.DataType) -> pa.Schema:
    return pa.schema([("qid", qid), ("item_id", item), ("similarity", pa.float64())])


class _Best:
    """The k best items so far of each query of a block."""

    def __init__(self, qids: pa.Array, qmat: np.ndarray, k: int, floors: np.ndarray):
        self.qids, self.k = qids, k
        self.q64 = qmat.astype(np.float64, copy=False)
        self.q32 = qmat.astype(np.float32, copy=False)
        self.qnorm = np.linalg.norm(self.q64, axis=1)
        self.qmax = self.qnorm[np.isfinite(self.qnorm)].max(initial=0.0)
        self.floor = floors.copy()
        self.q = np.zeros(0, np.int64)
        self.sim = np.zeros(0)
        self.ids: pa.Array | None = None
        self.pending: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.pending_rows = 0

    def add(self, ids: pa.Array | pa.ChunkedArray, vectors: pa.Array | pa.ChunkedArray, only: np.ndarray | None = None) -> None:
        """Looks at more items; with ``only``, for the queries of these numbers."""
        ids, mat = _ids(ids), _matrix(vectors)
        if not len(mat):
            return
        if mat.shape[1] != self.q64.shape[1]:
            raise ValueError(
                f"queries have {self.q64.shape[1]} dimensions, items {mat.shape[1]}; were they made by the same encoder?"
            )
        asked = len(self.q64) if only is None else len(only)
        step = max(1, min(len(mat), _SCORE_CELLS // max(1, min(asked, _QUERIES_AT_ONCE))))
        for first in range(0, asked, _QUERIES_AT_ONCE):
            part = slice(first, min(asked, first + _QUERIES_AT_ONCE))
            for start in range(0, len(mat), step):
                self._add_block(ids.slice(start, step), mat[start : start + step], part if only is None else only[part])

    def _add_block(self, ids: pa.Array, mat: np.ndarray, own: slice | np.ndarray) -> None:
        """Score in single precision, keep what may still matter, rescore that in double.

        A float32 product of d terms is off by at most about d * 2^-24 * |q| * |x|.
        Whatever lies within that distance of the k-th best survives, so the
        result is that of double precision throughout.
        """
        x64 = mat.astype(np.float64)
        usable = np.isfinite(x64).all(axis=1)
        if not usable.all():
            # a vector with NaN or infinity is similar to nothing
            mat, x64, ids = mat[usable], x64[usable], ids.filter(pa.array(usable))
            if not len(mat):
                return
        xnorm = np.linalg.norm(x64, axis=1).max()
        slack = (mat.shape[1] + 8) * 2.0**-23 * self.qnorm[own] * xnorm + 10.0**-DIGITS
        # beyond this a single-precision sum might overflow
        if self.qmax * xnorm < 1e30:
            scores = self.q32[own] @ mat.astype(np.float32).T
        else:
            scores = self.q64[own] @ x64.T
        alive = scores >= (self.floor[own] - slack)[:, None]
        if np.count_nonzero(alive) > 2 * self.k * len(scores):
            # k items of this very block lie above its own k-th best
            cut = scores.shape[1] - self.k
            if cut > 0:
                kth = np.partition(scores, cut, axis=1)[:, cut]
                self.floor[own] = np.maximum(self.floor[own], kth - slack)
                alive = scores >= (self.floor[own] - slack)[:, None]
        q, i = np.nonzero(alive)
        q = q + own.start if isinstance(own, slice) else own[q]
        if not len(q):
            return
        exact = np.empty(len(q))
        step = max(1, _SCORE_CELLS // mat.shape[1])
        for s in range(0, len(q), step):
            part = slice(s, s + step)
            exact[part] = np.einsum("ij,ij->i", self.q64[q[part]], x64[i[part]])
        # adding 0.0 turns -0.0 into 0.0
        self.pending.append((q, np.round(exact, DIGITS) + 0.0, ids.take(pa.array(i))))
        self.pending_rows += len(q)
        # sorting the survivors costs as much as all kept rows, so they pile up first
        if self.pending_rows >= max(len(self.q) // 2, 10_000):
            self._merge()

    def _merge(self) -> None:
        """Cut the kept and the pending rows down to k per query and raise the floors."""
        if not self.pending:
            return
        kept = [] if self.ids is None else [(self.q, self.sim, self.ids)]
        qs, sims, ids = zip(*kept, *self.pending)
        self.pending, self.pending_rows = [], 0
        q, sim, ids = np.concatenate(qs), np.concatenate(sims), pa.concat_arrays(ids)
        order = np.lexsort((_sort_codes(ids), -sim, q))
        q, sim = q[order], sim[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        kept = place < self.k
        self.q, self.sim, self.ids = q[kept], sim[kept], ids.take(pa.array(order[kept]))
        full = place == self.k - 1
        self.floor[q[full]] = np.maximum(self.floor[q[full]], sim[full])

    def batches(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        if self.ids is None:
            return
        columns = [self.qids.take(pa.array(self.q)), self.ids, pa.array(self.sim)]
        yield from pa.Table.from_arrays(columns, schema=_arrow_schema(self.qids.type, self.ids.type)).to_batches(max_chunksize=65_536)


def _sort_codes(ids: pa.Array) -> np.ndarray:
    """Numbers that sort like the ids."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False)
    # bytes of UTF-8 sort like Spark's strings
    values = ids.cast(pa.binary()) if pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type) else ids
    encoded = values.dictionary_encode()
    rank = np.argsort(np.array(encoded.dictionary.to_pylist(), dtype=object), kind="stable")
    code = np.empty(len(rank), np.int64)
    code[rank] = np.arange(len(rank))
    return code[encoded.indices.to_numpy(zero_copy_only=False)]
