"""A stored index of vectors with bounds, and exact top-k that skips most of it.

``write_runs`` sorts vectors by the nearest two of a few hundred centers, learned
from a sample, and cuts the order into runs of some hundred rows. A run carries
its centroid c and radius r, so for a query q no inner product in it is above
``q.c + |q| r``. ``top_k_runs`` reads these bounds alone first, searches the runs with
the best bounds, and takes the kth best found there as a floor: then only runs with
a bound at or above some query's floor are read, and in them only those queries are
scored. The result is that of ``top_k``, ties included; how much is skipped depends
on how far the vectors lie in clusters, nothing else does.

Rows are dealt to files by ranges of (centers, distance, id), so a center that a third
of all rows are next to, or a vector that a third of them repeat, is spread over as many
tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pickwell.operators.joins import restrict_to
from pickwell.operators.topk import (
    DIGITS,
    MAX_QUERY_BYTES,
    Hits,
    _Best,
    _matrix,
    hit_schema,
    named,
    ranked_hits,
    search_in_blocks,
    send,
)
from pickwell.session import materialise

RUN_ROWS = 512
FILE_ROWS = 1 << 16
CENTERS = 256
SAMPLE_ROWS = 16_384
# runs of the best bounds that are searched for a first floor
FIRST_RUNS = 4
MERGED_ROWS = 4096
# bounds of queries and runs that are taken at once
_BOUND_CELLS = 1_000_000


# ---------------------------------------------------------------- writing


def learn_centers(items: DataFrame, centers: int = CENTERS, sample: int = SAMPLE_ROWS, rounds: int = 6) -> np.ndarray:
    """Centers of a sample of bounded size; they affect speed, not results."""
    usable = items.filter(_finite("embedding")).select("embedding").orderBy(F.xxhash64("embedding")).limit(sample)
    x = _matrix(usable.toArrow()["embedding"]).astype(np.float64)
    if not len(x):
        return np.zeros((1, 1))
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), min(len(x), centers, max(1, len(x) // 16)), replace=False)]
    for _ in range(rounds):
        nearest = _distances(x, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        count = np.bincount(nearest, minlength=len(c))
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return c


def _finite(column: str):
    ok = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & ok


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, up to rounding."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def write_runs(items: DataFrame, path: str, run_rows: int = RUN_ROWS, file_rows: int = FILE_ROWS, centers: int = CENTERS) -> None:
    """Store ``item_id, embedding`` as runs with bounds. Vectors that are not all numbers are similar to nothing and left out."""
    items = items.select("item_id", "embedding")
    usable = items.filter(_finite("embedding"))
    known = learn_centers(items, centers)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding")).astype(np.float64)
            if not len(x):
                continue
            d = _distances(x, known)
            first = d.argmin(1)
            near = np.sqrt(np.maximum(d[np.arange(len(x)), first], 0))
            d[np.arange(len(x)), first] = np.inf
            second = d.argmin(1) if d.shape[1] > 1 else first
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(np.round(near, 6))],
                [*batch.schema.names, "cluster", "second", "distance"],
            )

    placed_schema = T.StructType([*items.schema, *(T.StructField(n, T.IntegerType()) for n in ("cluster", "second")), T.StructField("distance", T.DoubleType())])
    order = ["cluster", "second", "distance", "item_id"]
    # stored, as sorting by ranges reads it twice
    placed = materialise(usable.mapInArrow(place, placed_schema))
    files = max(1, -(-placed.count() // file_rows))
    spread = placed.repartitionByRange(files, *order).sortWithinPartitions(*order).select("item_id", "embedding", "cluster")
    schema = _run_schema(items)
    spread.mapInArrow(_cutter(run_rows), schema).write.mode("overwrite").partitionBy("cluster").parquet(path)
    # an index without rows has no file that tells its columns
    items.sparkSession.createDataFrame([], schema).write.parquet(f"{path}/_columns")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/_columns").schema).parquet(path)


def _run_schema(items: DataFrame) -> T.StructType:
    """A row for each vector; the first of a run has what is known of all of them."""
    bounds = [("run", T.LongType()), ("rows", T.IntegerType()), ("centroid", T.ArrayType(T.DoubleType())), ("radius", T.DoubleType())]
    return T.StructType([*items.schema, T.StructField("cluster", T.IntegerType()), *(T.StructField(n, k) for n, k in bounds)])


def _cutter(run_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        for batch in batches:
            codes = batch.column("cluster").to_numpy()
            edges = np.flatnonzero(np.diff(codes)) + 1
            for a, b in zip([0, *edges], [*edges, len(codes)]):
                if held and held[0].column("cluster")[0].as_py() != codes[a]:
                    yield _run(held, number)
                    held, number = [], number + 1
                while a < b:
                    room = run_rows - sum(h.num_rows for h in held)
                    held.append(batch.slice(a, min(room, b - a)))
                    a += held[-1].num_rows
                    if held[-1].num_rows == room:
                        yield _run(held, number)
                        held, number = [], number + 1
        if held:
            yield _run(held, number)

    return cut


def _run(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts)
    x = _matrix(table["embedding"]).astype(np.float64)
    centroid = x.mean(0)
    # above the largest distance whatever rounding does
    radius = np.sqrt(((x - centroid) ** 2).sum(1)).max() * (1 + 1e-9) + 1e-12
    n = len(x)
    rest = [None] * (n - 1)
    bounds = [
        pa.array(np.full(n, number)), pa.array([n, *rest], pa.int32()), pa.array([centroid.tolist(), *rest], pa.list_(pa.float64())), pa.array([radius, *rest], pa.float64()),
    ]
    merged = table.combine_chunks().to_batches()[0]
    return pa.RecordBatch.from_arrays([*merged.columns, *bounds], [*merged.schema.names, "run", "rows", "centroid", "radius"])


# ---------------------------------------------------------------- searching


class Bounds:
    """Upper bounds of the inner products of queries with what lies in a run."""

    def __init__(self, matrix: np.ndarray):
        self.q = matrix.astype(np.float64, copy=False)
        self.length = np.linalg.norm(self.q, axis=1)

    def of(self, centroids: np.ndarray, radii: np.ndarray, part: slice = slice(None)) -> np.ndarray:
        """One row a query; the margin covers rounding, here and of similarities."""
        reach = self.length[part, None] * (radii + 1e-12 * np.linalg.norm(centroids, axis=1))
        return self.q[part] @ centroids.T + reach + 10.0**-DIGITS

    def parts(self, runs: int) -> Iterator[slice]:
        """Queries in turn, so few that their bounds of so many runs take little room."""
        step = max(1, _BOUND_CELLS // max(1, runs))
        return (slice(a, min(len(self.q), a + step)) for a in range(0, len(self.q), step))


def _heads(runs: DataFrame) -> DataFrame:
    """A row for each run, without its vectors."""
    return runs.filter("centroid IS NOT NULL").select("run", "cluster", "rows", "centroid", "radius")


def _best_runs(heads: DataFrame, get: Callable[[], tuple], most: int) -> DataFrame:
    """``run`` of the best bounds of each query, at most ``most`` of one."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(get()[0])
        for batch in batches:
            if not batch.num_rows:
                continue
            centroids, radii = _matrix(batch.column("centroid")), batch.column("radius").to_numpy()
            for part in bounds.parts(len(radii)):
                b = bounds.of(centroids, radii, part)
                top = np.argsort(-b, axis=1, kind="stable")[:, :most]
                q = np.repeat(np.arange(len(b)), top.shape[1])
                values = b[q, top.ravel()]
                usable = ~np.isnan(values)
                yield pa.record_batch(
                    [pa.array(q[usable] + part.start, pa.int32()), batch.column("run").take(pa.array(top.ravel()[usable])), pa.array(values[usable])],
                    ["qid", "item_id", "similarity"],
                )

    found = heads.select("run", "centroid", "radius").mapInArrow(look, "qid int, item_id long, similarity double")
    return ranked_hits(found, most).select(F.col("item_id").alias("run")).distinct()


def _alive(heads: DataFrame, get: Callable[[], tuple]) -> DataFrame:
    """``run, cluster, rows, alive``: whether some query may have a hit in the run."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, floors = get()
        bounds = Bounds(matrix)
        for batch in batches:
            if batch.num_rows:
                centroids, radii = _matrix(batch.column("centroid")), batch.column("radius").to_numpy()
                alive = np.zeros(len(radii), bool)
                for part in bounds.parts(len(radii)):
                    alive |= (bounds.of(centroids, radii, part) >= floors[part, None]).any(0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(alive)], ["run", "cluster", "rows", "alive"])

    return heads.select("run", "cluster", "rows", "centroid", "radius").mapInArrow(look, "run long, cluster int, rows int, alive boolean")


def _scan_runs(rows: DataFrame, get: Callable[[], tuple], k: int) -> DataFrame:
    """Candidates as of a plain scan; of each run only the queries its bound leaves are scored."""
    out = T.StructType([T.StructField("qid", T.IntegerType()), rows.schema["item_id"], T.StructField("similarity", T.DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, floors = get()
        best = _Best(pa.array(np.arange(len(matrix)), pa.int32()), matrix, k, floors)
        bounds = Bounds(best.q64)
        run, only = -1, None
        for batch in batches:
            numbers = batch.column("run").to_numpy()
            edges = np.flatnonzero(np.diff(numbers, prepend=-2))
            ids, vectors = batch.column("item_id"), batch.column("embedding")
            # runs in a row that all queries need are scored at once
            first = last = 0
            for a, b in zip(edges, [*edges[1:], len(numbers)]):
                if numbers[a] != run:
                    run, only = numbers[a], None
                head = batch.column("centroid").slice(a, 1)
                # a split of a file may begin inside a run: its rows count for all queries
                if head.is_valid()[0].as_py():
                    reach = bounds.of(_matrix(head), batch.column("radius").slice(a, 1).to_numpy())[:, 0]
                    only = np.flatnonzero(reach >= best.floor)
                if only is None or len(only) == len(matrix):
                    first, last = (first if last == a else a), b
                    if last - first < MERGED_ROWS:
                        continue
                elif len(only):
                    best.add(ids.slice(a, b - a), vectors.slice(a, b - a), only)
                best.add(ids.slice(first, last - first), vectors.slice(first, last - first))
                first = last = 0
            best.add(ids.slice(first, last - first), vectors.slice(first, last - first))
        yield from best.batches()

    return rows.select("item_id", "embedding", "run", "centroid", "radius").mapInArrow(scan, out)


def top_k_runs(
    queries: DataFrame,
    path: str,
    k: int,
    max_query_bytes: int = MAX_QUERY_BYTES,
    query_block_rows: int | None = None,
    first_runs: int = FIRST_RUNS,
    report: list[float] | None = None,
) -> Hits:
    """The k best items of each query (``qid, qvec``) in the runs stored at ``path``; the rows of ``top_k``.

    ``report`` gets, for each block of queries, the share of rows that were not read.
    """
    spark: SparkSession = queries.sparkSession
    runs = read_runs(spark, path)
    qtype, itype = queries.schema["qid"].dataType, runs.schema["item_id"].dataType

    def search(block: pa.Table, sent: list[Broadcast] | None) -> DataFrame:
        if not block.num_rows or runs.isEmpty():
            return spark.createDataFrame([], hit_schema(qtype, itype))
        matrix, floors = _matrix(block["qvec"]), np.full(block.num_rows, -np.inf)
        heads = _heads(runs)
        plain = send(spark, (matrix, floors), sent)
        # at most first_runs numbers a query of the block
        first = F.broadcast(_best_runs(heads, plain, first_runs))
        best = ranked_hits(_scan_runs(runs.join(first, "run", "left_semi"), plain, k), k)
        for r in best.filter(F.col("rank") == k).toLocalIterator():
            floors[r.qid] = r.similarity
        get = send(spark, (matrix, floors), sent)
        alive = materialise(_alive(heads, get))
        clusters = alive.groupBy("cluster").agg(F.sum("rows").alias("rows"), F.sum(F.when(F.col("alive"), F.col("rows")).otherwise(0)).alias("alive")).collect()
        if report is not None:
            report.append(1 - sum(r.alive for r in clusters) / sum(r.rows for r in clusters))
        # whole clusters go by their folders, other runs by a filter of fixed size
        read = runs.filter(F.col("cluster").isin([r.cluster for r in clusters if r.alive]))
        read = restrict_to(read, alive.filter("alive"), "run")
        return named(ranked_hits(_scan_runs(read, get, k), k), block, qtype)

    size = F.size("qvec") * 8
    return search_in_blocks(queries.select("qid", "qvec"), itype, k, search, size, max_query_bytes, query_block_rows)
