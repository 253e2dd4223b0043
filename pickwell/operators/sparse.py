"""Exact top-k by inner product of sparse vectors, given as ``(bucket, weight)`` lists.

As for dense vectors, a block of queries goes to every task and items are scanned
where they lie: no join on buckets, so a bucket that most items have costs what its
entries cost and meets no other task's. Inside a task, some thousand items at a time
become postings by bucket, cut into segments of ``SEGMENT`` entries with their largest
weight. A query takes its buckets in the order of what they can add at most
(MaxScore). As long as the rest may lift an item that has nothing yet to the query's
kth best, whole postings are added up. Beyond that point only items already met can
get there: the rest of the postings is probed for them, and a segment whose largest
weight cannot lift an item is not looked into. What survives is added up again in the
order of buckets, so equal items have equal similarities in every task.

Items that share no bucket with a query have similarity 0 and fill up its k rows, by id.
Similarities are rounded to ``DIGITS`` as in ``topk``; negative weights are allowed.
Buckets of a list are distinct and ascending, as encoders give them. A NULL list is
similar to nothing; nor is one with a weight that is not a number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pickwell.operators.topk import (
    DIGITS,
    MAX_QUERY_BYTES,
    SCAN_TASKS,
    SEED_TASKS,
    Hits,
    _arrow_schema,
    _ids,
    _sort_codes,
    hit_schema,
    named,
    ranked_hits,
    resting,
    search_in_blocks,
    send,
)

SEGMENT = 128
ITEMS_AT_ONCE = 16_384
ENTRIES_AT_ONCE = 2_000_000


def top_k_sparse(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    max_query_bytes: int = MAX_QUERY_BYTES,
    query_block_rows: int | None = None,
    scan_tasks: int = SCAN_TASKS,
    seed_tasks: int = SEED_TASKS,
) -> Hits:
    """The k best items of each query: ``queries`` are ``qid, qvec``, ``items`` are ``item_id, embedding``, both vectors lists of terms."""
    queries, items = queries.select("qid", "qvec"), items.select("item_id", "embedding")
    qtype, itype = queries.schema["qid"].dataType, items.schema["item_id"].dataType
    rested: list[DataFrame] = []

    def search(block: pa.Table, sent: list[Broadcast] | None) -> DataFrame:
        spark = items.sparkSession
        block = block.filter(_usable(block["qvec"]))
        if not block.num_rows:
            return spark.createDataFrame([], hit_schema(qtype, itype))
        if sent is not None and not rested:
            rested.append(resting(items))
        own = (rested[0] if rested else items).coalesce(scan_tasks)
        terms, floors = _terms(block["qvec"]), np.full(block.num_rows, -np.inf)
        if own.rdd.getNumPartitions() > seed_tasks:
            some = own.filter(F.pmod(F.xxhash64("item_id"), F.lit(seed_tasks)) == 0)
            for r in ranked_hits(_scan(some, send(spark, (terms, floors), sent), k), k).filter(F.col("rank") == k).toLocalIterator():
                floors[r.qid] = r.similarity
        return named(ranked_hits(_scan(own, send(spark, (terms, floors), sent), k), k), block, qtype)

    return search_in_blocks(queries, itype, k, search, F.size("qvec") * 16 + 64, max_query_bytes, query_block_rows)


def _terms(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the lists from 0, their buckets and weights."""
    lists = _ids(column)
    ends = lists.offsets.to_numpy().astype(np.int64)
    cells = lists.flatten()
    return ends - ends[0], cells.field("bucket").to_numpy(zero_copy_only=False).astype(np.int64), cells.field("weight").to_numpy(zero_copy_only=False).astype(np.float64)


def _usable(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """Whether a list is there and all its weights are numbers."""
    lists = _ids(column)
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    odd = ~np.isfinite(lists.flatten().field("weight").to_numpy(zero_copy_only=False).astype(np.float64))
    bad = np.bincount(np.repeat(np.arange(len(n)), n), odd, minlength=len(n)) > 0
    return pc.and_(lists.is_valid(), pa.array(~bad))


def _scan(items: DataFrame, get: Callable[[], tuple], k: int) -> DataFrame:
    out = T.StructType([T.StructField("qid", T.IntegerType()), items.schema["item_id"], T.StructField("similarity", T.DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, floors = get()
        best = BestSparse(terms, floors, k)
        for batch in batches:
            for part in _parts(batch):
                part = part.filter(_usable(part.column("embedding")))
                best.add(part.column("item_id"), *_terms(part.column("embedding")))
        yield from best.batches()

    return items.mapInArrow(scan, out)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of bounded numbers of items and entries; a longer item is a slice of its own."""
    sizes = batch.column("embedding").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    group = np.maximum(np.cumsum(sizes) // ENTRIES_AT_ONCE, np.arange(len(sizes)) // ITEMS_AT_ONCE) if len(sizes) else sizes
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


class Postings:
    """Entries of some items by bucket, in segments with their largest and smallest weight."""

    def __init__(self, ends: np.ndarray, buckets: np.ndarray, weights: np.ndarray):
        n = np.diff(ends)
        row = np.repeat(np.arange(len(n)), n)
        order = np.argsort(buckets, kind="stable")
        self.row, self.weight = row[order], weights[order]
        ordered = buckets[order]
        first = np.flatnonzero(np.diff(ordered, prepend=-1)) if len(ordered) else np.zeros(0, np.int64)
        self.bucket = ordered[first]
        self.ends = np.append(first, len(ordered))
        # where segments begin: at each bucket and after every SEGMENT entries of it
        sizes = np.diff(self.ends)
        pieces = -(-sizes // SEGMENT)
        self.segment_ends = np.concatenate([[0], np.cumsum(pieces)])
        within = np.arange(int(pieces.sum())) - np.repeat(self.segment_ends[:-1], pieces)
        self.segment = np.repeat(first, pieces) + within * SEGMENT
        self.most = np.maximum.reduceat(self.weight, self.segment) if len(self.segment) else np.zeros(0)
        self.least = np.minimum.reduceat(self.weight, self.segment) if len(self.segment) else np.zeros(0)
        self.bucket_most = np.maximum.reduceat(self.most, self.segment_ends[:-1]) if len(first) else np.zeros(0)
        self.bucket_least = np.minimum.reduceat(self.least, self.segment_ends[:-1]) if len(first) else np.zeros(0)

    def find(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those of the buckets that occur, and which they are."""
        if not len(self.bucket):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        at = np.searchsorted(self.bucket, buckets)
        there = self.bucket[np.minimum(at, len(self.bucket) - 1)] == buckets
        return at[there], there

    def probe(self, place: int, rows: np.ndarray) -> np.ndarray:
        """Weights that the rows (ascending) have in a bucket."""
        a, b = self.ends[place], self.ends[place + 1]
        at = a + np.searchsorted(self.row[a:b], rows)
        inside = np.minimum(at, b - 1)
        return np.where((at < b) & (self.row[inside] == rows), self.weight[inside], 0.0)

    def reach(self, place: int, rows: np.ndarray, weight: float) -> np.ndarray:
        """What the bucket adds to each row at most, by the segment that would hold it."""
        a, b = self.segment_ends[place], self.segment_ends[place + 1]
        at = a + np.maximum(np.searchsorted(self.row[self.segment[a:b]], rows, "right") - 1, 0)
        return np.maximum(0.0, weight * (self.most[at] if weight > 0 else self.least[at]))


class BestSparse:
    """The k best items so far of each query of a block."""

    def __init__(self, terms: tuple[np.ndarray, np.ndarray, np.ndarray], floors: np.ndarray, k: int):
        self.ends, self.buckets, self.weights = terms
        self.floor, self.k = floors.copy(), k
        self.kept: list[list[tuple[np.ndarray, pa.Array]]] = [[] for _ in floors]
        self.rows = np.zeros(len(floors), np.int64)
        self.probed = self.added = 0

    def add(self, ids: pa.Array, ends: np.ndarray, buckets: np.ndarray, weights: np.ndarray) -> None:
        if not len(ids):
            return
        postings, n = Postings(ends, buckets, weights), len(ids)
        by_id = np.argsort(_sort_codes(ids), kind="stable")
        for q in range(len(self.floor)):
            own = slice(self.ends[q], self.ends[q + 1])
            rows = self._candidates(postings, self.buckets[own], self.weights[own], self.floor[q], n)
            if self.floor[q] <= 0:
                # what shares no bucket counts with similarity 0: k more rows, if there are
                rows = np.union1d(rows, by_id[: self.k + len(rows)])
            similarity = self._exact(postings, self.buckets[own], self.weights[own], rows)
            good = similarity >= self.floor[q]
            if good.any():
                self._keep(q, similarity[good], ids.take(pa.array(rows[good])))

    def _candidates(self, postings: Postings, buckets: np.ndarray, weights: np.ndarray, floor: float, n: int) -> np.ndarray:
        """Rows, ascending, that may have a similarity of ``floor`` or more and share a bucket with the query."""
        place, there = postings.find(buckets)
        weight = weights[there]
        most = np.maximum(0.0, np.where(weight > 0, weight * postings.bucket_most[place], weight * postings.bucket_least[place]))
        order = np.argsort(-most, kind="stable")
        place, weight, most = place[order], weight[order], most[order]
        rest = np.append(np.cumsum(most[::-1])[::-1], 0.0)
        limit = floor - 10.0**-DIGITS - 1e-12 * rest[0]
        total, met = np.zeros(n), np.zeros(n, bool)
        i = 0
        while i < len(place) and rest[i] >= limit:
            entries = slice(postings.ends[place[i]], postings.ends[place[i] + 1])
            total[postings.row[entries]] += weight[i] * postings.weight[entries]
            met[postings.row[entries]] = True
            self.added += entries.stop - entries.start
            i += 1
        rows = np.flatnonzero(met & (total + rest[i] >= limit))
        total = total[rows]
        for j in range(i, len(place)):
            able = total + postings.reach(place[j], rows, weight[j]) + rest[j + 1] >= limit
            rows, total = rows[able], total[able]
            total += weight[j] * postings.probe(place[j], rows)
            self.probed += len(rows)
            able = total + rest[j + 1] >= limit
            rows, total = rows[able], total[able]
        return rows

    @staticmethod
    def _exact(postings: Postings, buckets: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        place, there = postings.find(buckets)
        total = np.zeros(len(rows))
        for p, w in zip(place, weights[there]):
            total += w * postings.probe(p, rows)
        return np.round(total, DIGITS) + 0.0

    def _keep(self, q: int, similarity: np.ndarray, ids: pa.Array) -> None:
        held = self.kept[q]
        held.append((similarity, ids))
        self.rows[q] += len(ids)
        if self.rows[q] >= 2 * self.k or self.rows[q] >= self.k and self.floor[q] == -np.inf:
            self._cut(q)

    def _cut(self, q: int) -> None:
        similarity, ids = np.concatenate([s for s, _ in self.kept[q]]), pa.concat_arrays([i for _, i in self.kept[q]])
        order = np.lexsort((_sort_codes(ids), -similarity))[: self.k]
        self.kept[q] = [(similarity[order], ids.take(pa.array(order)))]
        self.rows[q] = len(order)
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], similarity[order[-1]])

    def batches(self) -> Iterator[pa.RecordBatch]:
        for q in range(len(self.floor)):
            if self.kept[q]:
                self._cut(q)
                similarity, ids = self.kept[q][0]
                columns = [pa.array(np.full(len(ids), q, np.int32)), ids, pa.array(similarity)]
                yield pa.Table.from_arrays(columns, schema=_arrow_schema(pa.int32(), ids.type)).to_batches()[0]
