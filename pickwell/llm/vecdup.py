"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length one, so a cosine of ``t`` is a distance of
``eps = sqrt(2 - 2t)``, and projected on leading principal directions (fitted on a
bounded sample; any directions give the same result, good ones prune more). A
grid of width eps over them gives each vector a cell, and vectors are sorted by
cells over the whole table. The sequence is cut into blocks of bounded size, each
with the box of its projections. Only blocks of neighbouring cells whose boxes lie
within eps meet, and of their vectors only those within eps of the other box are
sent. In a task, intervals of the sequence are split recursively and pairs of
intervals whose boxes lie further apart than eps skipped. What is left is compared
in double precision.

Equal vectors are folded into one class with a weight first. A task returns a
number of links per class and a spanning forest, never pairs.

Defined cases: a vector that is NULL, empty, zero, has a NULL or non-finite
component, or a NULL label links with nothing; vectors of different length do
not link; rows of equal id, or of none, are rows of their own, linked and counted
by their vectors; a component's id is the smallest that is not NULL, NULL if it has
none; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pickwell.llm import common as C
from pickwell.llm.graph import components
from pickwell.llm.topk import finite
from pickwell.session import materialise

CELL = ["group", "dim", "c0", "c1"]
ORDER_DIMENSIONS = 8
CHUNK = 1024
LEAF = 64
SAMPLE = 2048
SLACK = 1e-6


def principal(classes: DataFrame, dim: int, most: int = SAMPLE) -> np.ndarray:
    """Leading directions (dim x up to 8) of at most ``most`` vectors, those with the smallest hash."""
    picked = classes.filter(F.size("vector") == dim).orderBy("h1", "h2").limit(most).select("vector").toArrow()
    x = np.asarray(picked.column("vector").combine_chunks().flatten()).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True).reshape(dim, dim))
    return vectors[:, np.argsort(-values)[:ORDER_DIMENSIONS]]


def unit_rows(lists: pa.Array, dim: int) -> np.ndarray:
    x = pc.list_flatten(lists).to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of very large or small values are lost
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grid_join(x: np.ndarray, y: np.ndarray | None, directions: np.ndarray, threshold: float):
    """Index pairs of rows of ``x`` and ``y`` (of ``x`` alone if None, first below second) with cosine of at least ``threshold``."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK

    def ordered(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = v @ directions
        order = np.lexsort(np.floor(p / max(eps, 1e-3)).T[::-1])
        return order, v[order], p[order]

    first = ordered(x)
    second = first if y is None else ordered(y)

    def boxes(p: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        found, open_ = {}, [(0, len(p))]
        while open_:
            a, b = open_.pop()
            found[a, b] = p[a:b].min(0), p[a:b].max(0)
            if b - a > LEAF:
                m = (a + b) // 2
                open_ += [(a, m), (m, b)]
        return found

    box1 = boxes(first[2]) if len(x) else {}
    box2 = box1 if y is None else (boxes(second[2]) if len(y) else {})
    if not box1 or not box2:
        return
    todo = [(0, len(first[1]), 0, len(second[1]))]
    while todo:
        a, b, c, d = todo.pop()
        if y is None and d <= a:
            continue  # the mirror image is looked at
        low, high = box1[a, b], box2[c, d]
        gap = np.maximum(0, np.maximum(low[0] - high[1], high[0] - low[1]))
        if (gap @ gap) > eps * eps:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(first[1][a:b] @ second[1][c:d].T >= threshold)
            i, j = i + a, j + c
            if y is None:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield first[0][i], second[0][j]
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]


class Forest:
    """Spanning forest of pairs that arrive in blocks."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Only pairs of trees that are still apart are looked at one by one, each pair of trees once."""
        a, b = np.minimum(self.root[i], self.root[j]), np.maximum(self.root[i], self.root[j])
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return
        _, first = np.unique(a[apart] * len(self.root) + b[apart], return_index=True)
        parent: dict[int, int] = {}

        def top(v: int) -> int:
            while parent.get(v, v) != v:
                parent[v] = parent.get(parent[v], parent[v])
                v = parent[v]
            return v

        for at in apart[first].tolist():
            x, y = top(int(a[at])), top(int(b[at]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.edges.append((int(i[at]), int(j[at])))
        moved = np.arange(len(self.root))
        for v in parent:
            moved[v] = top(v)
        self.root = moved[self.root]


def _between(names: Sequence[str], low: str, high: str) -> Column:
    """Squared distance of a point's coordinates ``names`` from the box ``low{i}, high{i}``."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"{low}{i}") - F.col(c), F.col(c) - F.col(f"{high}{i}")) for i, c in enumerate(names)]
    return sum((g * g for g in gaps), F.lit(0.0))


def _apart(dimensions: int) -> Column:
    """Squared distance of the boxes ``low{i}, high{i}`` and ``n_low{i}, n_high{i}``."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"low{i}") - F.col(f"n_high{i}"), F.col(f"n_low{i}") - F.col(f"high{i}")) for i in range(dimensions)]
    return sum((g * g for g in gaps), F.lit(0.0))


def sequence(classes: DataFrame, directions: np.ndarray, dim: int, eps: float) -> DataFrame:
    """The classes in grid order, cut into runs: with ``dim, c0, c1, p0..`` (place) and ``run``, stored.

    A run lies in one task's part of the sequence and in one cell of the first two directions.
    """
    width, dimensions = max(eps, 1e-3), directions.shape[1]
    places = [f"p{i}" for i in range(dimensions)]
    kept = classes.select("group", "node", "weight", "vector")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    extra = "dim int, grid array<long>, c0 long, c1 long, " + ", ".join(f"{p} double" for p in places)

    def place(batches):
        for batch in batches:
            vectors = C.column(batch, "vector")
            sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            p = np.zeros((batch.num_rows, dimensions))
            for size in np.unique(sizes).tolist():
                base = directions if size == dim else np.eye(size)[:, :dimensions]
                p[sizes == size, : base.shape[1]] = unit_rows(vectors.filter(pa.array(sizes == size)), size) @ base
            grid = np.floor(p / width).astype(np.int64)
            grids = pa.FixedSizeListArray.from_arrays(pa.array(grid.ravel()), dimensions).cast(pa.list_(pa.int64()))
            second = grid[:, min(1, dimensions - 1)]
            arrays = [*batch.columns, pa.array(sizes, pa.int32()), grids, pa.array(grid[:, 0]), pa.array(second), *map(pa.array, np.ascontiguousarray(p.T))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "dim", "grid", "c0", "c1", *places])

    order = ["group", "dim", "c0", "c1", "grid", *places, "node"]
    placed = kept.mapInArrow(place, f"{shape}, {extra}").repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches):
        run, rows, last = TaskContext.get().partitionId() << 40, 0, None
        for batch in batches:
            runs = []
            for cell in zip(*[C.column(batch, c).to_pylist() for c in CELL]):
                if cell != last or rows == CHUNK:
                    run, rows, last = run + 1, 0, cell
                rows += 1
                runs.append(run)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.int64())], [*batch.schema.names, "run"])

    return materialise(placed.mapInArrow(cut, f"{shape}, {extra}, run long").drop("grid"))


def run_pairs(placed: DataFrame, dimensions: int, eps: float) -> DataFrame:
    """``run, a, b, side, low0.., high0..``: where the rows of a run go, and the box that a row has to be near.

    Runs of a cell that tasks cut short are joined to blocks of ``CHUNK`` to ``2 * CHUNK`` rows, each
    with its box. Blocks of the same or of neighbouring cells meet if their boxes are within ``eps``.
    """
    span = range(dimensions)
    lows, highs = [f"low{i}" for i in span], [f"high{i}" for i in span]
    boxes = [F.min(f"p{i}").alias(lows[i]) for i in span] + [F.max(f"p{i}").alias(highs[i]) for i in span]
    runs = placed.groupBy(*CELL, "run").agg(F.count("*").alias("rows"), *boxes)
    before = Window.partitionBy(*CELL).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialise(runs.withColumn("part", F.floor(F.coalesce(F.sum("rows").over(before), F.lit(0)) / CHUNK)))
    wide = [F.min(c).alias(c) for c in lows] + [F.max(c).alias(c) for c in highs]
    blocks = materialise(runs.groupBy(*CELL, "part").agg(F.min("run").alias("block"), *wide))
    # a cell with each neighbour that is not before it
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    here = blocks.withColumn("to", F.explode(near)).withColumns({"n0": F.col("c0") + F.col("to.i"), "n1": F.col("c1") + F.col("to.j")})
    there = blocks.select("group", "dim", F.col("c0").alias("n0"), F.col("c1").alias("n1"), F.col("block").alias("n_block"), *[F.col(c).alias(f"n_{c}") for c in lows + highs])
    same = (F.col("c0") == F.col("n0")) & (F.col("c1") == F.col("n1"))
    met = here.join(there, ["group", "dim", "n0", "n1"]).filter((~same | (F.col("block") <= F.col("n_block"))) & (_apart(dimensions) <= eps * eps))
    met = materialise(met.select(F.col("block").alias("a"), F.col("n_block").alias("b"), *lows, *highs, *[f"n_{c}" for c in lows + highs]))
    left = met.select("a", "b", F.col("a").alias("block"), F.lit(0).alias("side"), *[F.col(f"n_{c}").alias(c) for c in lows + highs])
    right = met.filter("a <> b").select("a", "b", F.col("b").alias("block"), F.lit(1).alias("side"), *lows, *highs)
    members = runs.select("run", *CELL, "part").join(blocks.select(*CELL, "part", "block"), [*CELL, "part"]).select("run", "block")
    return members.join(left.unionByName(right), "block").drop("block")


def links(classes: DataFrame, threshold: float) -> DataFrame:
    """From ``group, node, weight, vector`` (with hashes ``h1, h2``): rows ``node, n`` (links found) and ``node, other`` (forest)."""
    dims = classes.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = dims[0]["dim"] if dims else 1
    directions = principal(classes, dim) if dims else np.eye(1)
    dimensions = directions.shape[1]
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    placed = sequence(classes, directions, dim, eps)
    goes = run_pairs(placed, dimensions, eps)
    places = [f"p{i}" for i in range(dimensions)]
    sent = placed.join(goes, "run").filter(_between(places, "low", "high") <= eps * eps).select("a", "b", "side", "node", "weight", "vector")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        nodes = rows.column("node").combine_chunks()
        vectors = rows.column("vector").combine_chunks()
        side = rows.column("side").to_numpy()
        weight = rows.column("weight").to_numpy()
        same = key[0] == key[1]
        a = np.flatnonzero(side == 0)
        b = a if same else np.flatnonzero(side == 1)
        n = np.zeros(len(nodes), np.int64)
        forest = Forest(len(nodes))
        if len(a) and len(b):
            size = len(vectors[0])
            x = unit_rows(vectors, size)
            base = directions if size == dim else np.eye(size)[:, :ORDER_DIMENSIONS]
            for i, j in grid_join(x[a], None if same else x[b], base, threshold):
                i, j = a[i], b[j]
                np.add.at(n, i, weight[j])
                np.add.at(n, j, weight[i])
                forest.add(i, j)
        some = np.flatnonzero(n)
        ends = np.array(forest.edges, np.int64).reshape(-1, 2)
        return pa.table(
            {
                "node": nodes.take(pa.array(np.concatenate([some, ends[:, 0]]))),
                "other": nodes.take(pa.array(np.concatenate([np.zeros(len(some), np.int64), ends[:, 1]]), mask=np.arange(len(some) + len(ends)) < len(some))),
                "n": pa.array(np.concatenate([n[some], np.zeros(len(ends), np.int64)]), pa.int64()),
            }
        )

    kind = classes.schema["node"].dataType.simpleString()
    return materialise(sent.groupBy("a", "b").applyInArrow(run, f"node {kind}, other {kind}, n long"))


def near_duplicates(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", group: Column | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row; ``group`` limits links to equal values of it (NULL: to none)."""
    group = F.lit(0) if group is None else group
    element = vectors.select(vector).schema[0].dataType.elementType
    kind = "float" if isinstance(element, T.FloatType) else "double"
    # -0.0 and 0.0 are one number
    number = F.transform(vector, lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    usable = finite(F.col(vector)) & F.exists(vector, lambda x: x != 0) & group.isNotNull()
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), number).alias("vector"), group.cast("long").alias("group"))
    rows = rows.withColumns({"h1": F.xxhash64("group", "vector"), "h2": F.xxhash64(F.lit(7), "vector", "group")})
    linked = rows.filter(F.col("vector").isNotNull())
    classes = linked.groupBy("h1", "h2").agg(F.first("group").alias("group"), F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    # nodes order by smallest id, those without any last; the number tells classes apart that share an id
    node = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), F.monotonically_increasing_id().alias("number"))
    classes = materialise(classes.withColumn("node", node).drop("id"))
    found = links(classes, threshold)
    counts = found.filter("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    root = F.coalesce("component", "node")
    facts = (
        classes.select("h1", "h2", "node", "weight")
        .join(counts, "node", "left")
        .join(roots, "node", "left")
        .select("h1", "h2", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.when(~root["none"], root["id"]).alias("root"))
    )
    return _with_facts(rows, materialise(facts))


def _with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Each row with the facts of its class.

    Classes that hold over a thousandth of the rows are fewer than a thousand, so they are broadcast;
    their rows and those without a usable vector then carry keys of their own through the shuffle.
    """
    total = facts.agg(F.sum("weight")).first()[0] or 0
    frequent = F.col("weight") * 1000 > total
    hot = facts.filter(frequent).select("h1", "h2", F.col("links").alias("hot_links"), F.col("root").alias("hot_root"))
    usable = F.col("vector").isNotNull()
    out = rows.select("vec_id", "h1", F.when(usable, F.col("h2")).alias("h2")).join(F.broadcast(hot), ["h1", "h2"], "left")
    asks = F.col("h2").isNotNull() & F.col("hot_links").isNull()
    out = out.withColumns({"asks": asks, "h1": F.when(asks, F.col("h1")).otherwise(F.monotonically_increasing_id())})
    rest = facts.filter(~frequent).select("h1", "h2", F.lit(True).alias("asks"), "links", "root")
    out = out.join(rest, ["h1", "h2", "asks"], "left")
    root = F.coalesce("hot_root", "root", "vec_id")
    count = F.coalesce("hot_links", "links", F.lit(0)).cast("long")
    return out.select("vec_id", count.alias("n_links"), root.alias("component_id"), F.col("vec_id").eqNullSafe(root).alias("kept"))


def vecdup_query(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Near-duplicates among vectors of equal label."""
    return near_duplicates(vectors.select("vec_id", "embedding", "label"), threshold, group=F.col("label"))
