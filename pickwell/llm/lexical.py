"""Ranked lexical search of many items in all documents by dual-tree traversal.

An item is a vector of term weights, a document a vector of term impacts, and the
score is their inner product. Both sides are put into hierarchies whose nodes
hold, for each term, the largest coordinate of what lies below them, so the inner
product of two nodes' maxima bounds the score of every item and document below.
A pair of nodes whose bound is under the weakest kth score of the node's items is
pruned with all that lies below it; a pair with an equal bound stays, as equal
scores rank by id. Pairs that reach the leaves are scored exactly.

How it runs:

* items come in blocks of bounded size, one after the other; a block's terms are the
  vocabulary of its passes, so what is sent to tasks never grows with the table;
* one pass over the texts leaves a row of term numbers and counts for each
  document, stored in the shared folder; counts of documents and terms come from it;
* a pass over a bounded number of those rows gives each item a first kth score to prune
  with (a lower bound of the final one, so it only affects speed);
* the search itself is map-only: each task keeps k rows an item, and a window picks
  the final k.

Inner products are sums of whole numbers in double precision, exact below 2**53; where
an item's score might pass that, leaves are scored in 64-bit integers instead.

Defined cases: texts without terms and NULL texts match nothing and do not count; items
without terms get no rows; every row of either table counts on its own, so repeated
rows of documents take places of their own, and repeated items are ranked each for
itself; documents with NULL id rank after others of equal score; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pickwell.llm import common as C
from pickwell.session import materialise

TOP = 50
LENGTH_SHARE = 50  # how much of a document's length counts, in hundredths
ITEM_BLOCK, TERM_BLOCK = 2048, 1 << 15
ITEM_LEAF, DOC_LEAF, FAN = 8, 32, 8
DOCS_AT_ONCE = 2048
SEED_DOCS = 100_000
_EXACT = 2.0**53
_LAST = np.iinfo(np.int64).max

# Bytes that end a term become blanks, A-Z become a-z.
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[:0x30] = _TABLE[0x3A:0x41] = _TABLE[0x5B:0x61] = _TABLE[0x7B:0x80] = 0x20
_TABLE[0x41:0x5B] += 0x20


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row number and text of every term ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z in lower case."""
    ends, raw = C.buffers(texts)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(_TABLE[raw]))
    return C.split_words(plain, lower=False)


# ---------------------------------------------------------------- items


@dataclass
class Items:
    """A block of items: ids, distinct terms, and of each item the numbers of its terms."""

    ids: list
    vocabulary: pa.Array
    codes: list[np.ndarray]


def item_blocks(items: DataFrame, item_id: str, text: str, most: int = ITEM_BLOCK, most_terms: int = TERM_BLOCK) -> Iterator[Items]:
    """The items in blocks; the driver holds one of them."""
    known: dict[str, int] = {}
    ids, codes = [], []
    for row in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = pc.unique(terms(pa.array([row.t], pa.string()))[1]).to_pylist()
        if not words:
            continue
        if ids and (len(ids) == most or len(known) + len(words) > most_terms):
            yield Items(ids, pa.array(known, pa.large_string()), codes)
            known, ids, codes = {}, [], []
        ids.append(row.i)
        codes.append(np.array(sorted(known.setdefault(w, len(known)) for w in words), np.int32))
    if ids:
        yield Items(ids, pa.array(known, pa.large_string()), codes)


@dataclass
class Node:
    """Items of the tree below this node, the largest weight of each of their terms, children."""

    items: np.ndarray
    codes: np.ndarray
    weights: np.ndarray
    below: list[Node] = field(default_factory=list)


def item_tree(codes: list[np.ndarray], weight: np.ndarray) -> Node:
    """Items with the same weighty terms lie side by side; leaves hold ``ITEM_LEAF``, other nodes ``FAN`` nodes."""
    # a term says more about neighbours the more items share it and the more it weighs
    shared = np.bincount(np.concatenate(codes), minlength=len(weight))
    value = weight * np.where(shared > 1, 1.0, 0.25)
    keys = [tuple(c[np.argsort(-value[c], kind="stable")][:3].tolist()) for c in codes]
    order = sorted(range(len(codes)), key=lambda i: keys[i])
    level = []
    for i in range(0, len(order), ITEM_LEAF):
        own = np.array(order[i : i + ITEM_LEAF])
        every = np.unique(np.concatenate([codes[j] for j in own]))
        level.append(Node(own, every, weight[every].astype(np.float64)))
    while len(level) > 1:
        level = [_over(level[i : i + FAN]) for i in range(0, len(level), FAN)]
    return level[0]


def _over(nodes: list[Node]) -> Node:
    codes = np.concatenate([n.codes for n in nodes])
    weights = np.concatenate([n.weights for n in nodes])
    order = np.lexsort((-weights, codes))
    codes, weights = codes[order], weights[order]
    first = C.run_starts(codes)
    return Node(np.concatenate([n.items for n in nodes]), codes[first], weights[first], nodes)


# ---------------------------------------------------------------- documents


@dataclass
class Docs:
    """Some documents: ids, and term numbers with impacts, by document; ``ends`` delimit them."""

    ids: np.ndarray
    missing: np.ndarray
    codes: np.ndarray
    impacts: np.ndarray
    ends: np.ndarray

    def ordered(self, weight: np.ndarray) -> Docs:
        """Documents with the same strongest term side by side."""
        n = np.diff(self.ends)
        row = np.repeat(np.arange(len(n)), n)
        strongest = np.lexsort((-(self.impacts * weight[self.codes]), row))[self.ends[:-1]]
        order = np.argsort(self.codes[strongest], kind="stable")
        at = C.ranges(self.ends[:-1][order], n[order])
        return Docs(self.ids[order], self.missing[order], self.codes[at], self.impacts[at], np.concatenate([[0], np.cumsum(n[order])]))

    def maxima(self, terms: int) -> list[np.ndarray]:
        """Of each level of the hierarchy, leaves first: a row of maxima for each node."""
        n = np.diff(self.ends)
        leaf = np.repeat(np.arange(len(n)) // DOC_LEAF, n)
        key = leaf * terms + self.codes
        order = np.argsort(key, kind="stable")
        first = C.run_starts(key[order])
        low = np.zeros((-(-len(n) // DOC_LEAF), terms))
        if len(first):
            low.ravel()[key[order][first]] = np.maximum.reduceat(self.impacts[order], first)
        levels = [low]
        while len(levels[-1]) > 1:
            under = levels[-1]
            levels.append(np.stack([under[i : i + FAN].max(0) for i in range(0, len(under), FAN)]))
        return levels


class Search:
    """Traversal of both trees for the documents of one task, with the k best of each item so far."""

    def __init__(self, root: Node, codes: list[np.ndarray], weight: np.ndarray, floors: np.ndarray, k: int):
        # impacts are below a million
        self.kind = np.float64 if max(weight[c].sum() for c in codes) * 1e6 < _EXACT else np.int64
        self.root, self.codes, self.weight, self.k = root, codes, weight.astype(self.kind), k
        self.floors = floors.astype(self.kind)
        self.best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.scored = 0

    def add(self, docs: Docs) -> None:
        docs = docs.ordered(self.weight)
        levels = docs.maxima(len(self.weight))
        self._visit(self.root, len(levels) - 1, np.arange(len(levels[-1])), docs, levels)

    def _visit(self, node: Node, level: int, alive: np.ndarray, docs: Docs, levels: list[np.ndarray]) -> None:
        """``alive``: nodes of that level of the documents' tree that may still matter to the node's items."""
        bounds = levels[level][np.ix_(alive, node.codes)] @ node.weights
        # the margin covers what rounding may take off a bound beyond 2**53
        alive = alive[(bounds > 0) & (bounds * (1 + 1e-9) >= self.floors[node.items].min())]
        if not len(alive):
            return
        if level:
            below = (alive[:, None] * FAN + np.arange(FAN)).ravel()
            alive, level = below[below < len(levels[level - 1])], level - 1
            # both sides go down together while they can
            for child in node.below or [node]:
                self._visit(child, level, alive, docs, levels)
        elif node.below:
            for child in node.below:
                self._visit(child, 0, alive, docs, levels)
        else:
            self._score(node, alive, docs)

    def _score(self, node: Node, leaves: np.ndarray, docs: Docs) -> None:
        rows = (leaves[:, None] * DOC_LEAF + np.arange(DOC_LEAF)).ravel()
        rows = rows[rows < len(docs.ids)]
        n = docs.ends[rows + 1] - docs.ends[rows]
        at = C.ranges(docs.ends[rows], n)
        place = np.full(len(self.weight), -1)
        place[node.codes] = np.arange(len(node.codes))
        column = place[docs.codes[at]]
        used = column >= 0
        impacts = np.zeros((len(rows), len(node.codes)), self.kind)
        impacts[np.repeat(np.arange(len(rows)), n)[used], column[used]] = docs.impacts[at][used]
        weights = np.zeros((len(node.codes), len(node.items)), self.kind)
        for j, i in enumerate(node.items):
            weights[place[self.codes[i]], j] = self.weight[self.codes[i]]
        scores = impacts @ weights
        self.scored += scores.size
        for j, i in enumerate(node.items.tolist()):
            own = scores[:, j]
            good = np.flatnonzero((own > 0) & (own >= self.floors[i]))
            if len(good):
                self._keep(i, own[good], docs.ids[rows[good]], docs.missing[rows[good]])

    def _keep(self, i: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        if i in self.best:
            scores, ids, missing = (np.concatenate(x) for x in zip(self.best[i], (scores, ids, missing)))
        order = np.lexsort((ids, missing, -scores))[: self.k]
        self.best[i] = scores[order], ids[order], missing[order]
        if len(order) == self.k:
            self.floors[i] = max(self.floors[i], scores[order[-1]])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for i, (scores, ids, missing) in sorted(self.best.items()):
            yield pa.record_batch(
                [pa.array(np.full(len(ids), i, np.int32)), pa.array(ids, mask=missing), pa.array(scores.astype(np.int64))],
                ["item", "doc_id", "score"],
            )


# ---------------------------------------------------------------- passes


def _counted(docs: DataFrame, vocabulary: pa.Array, doc_id: str, text: str) -> DataFrame:
    """``id, docs, n, codes, tfs``: a row for each document with a term of the vocabulary.

    ``n`` counts all terms of the document. What the other documents of a block
    have in sum is a row without ``codes``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.blocks(batches, "t"):
            rows, words = terms(C.column(batch, "t"))
            code, distinct = C.distinct(words) if len(words) else (np.zeros(0, np.int64), pa.array([], pa.large_string()))
            known = pc.fill_null(pc.index_in(distinct.cast(pa.large_string()), vocabulary), -1).to_numpy(zero_copy_only=False)[code]
            n = np.bincount(rows, minlength=batch.num_rows)
            rows, known = rows[known >= 0], known[known >= 0]
            key, tf = np.unique(rows * len(vocabulary) + known, return_counts=True)
            row, lengths = np.unique(key // len(vocabulary), return_counts=True)
            rest = np.delete(n, row)
            ids = pa.concat_arrays([C.column(batch, "id").take(pa.array(row)), pa.nulls(1, pa.int64())])
            masked = np.arange(len(row) + 1) == len(row)
            lengths = np.append(lengths, 0)
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.append(masked, False))
            yield pa.record_batch(
                [
                    ids,
                    pa.array(np.append(np.ones(len(row), np.int64), np.count_nonzero(rest))),
                    pa.array(np.append(n[row], rest.sum())),
                    pa.ListArray.from_arrays(ends, pa.array(key % len(vocabulary), pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())),
                ],
                ["id", "docs", "n", "codes", "tfs"],
            )

    wanted = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    return wanted.mapInArrow(count, "id long, docs long, n long, codes array<int>, tfs array<int>")


def _frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found, pa.int32()), pa.array(total[found])], ["code", "df"])

    out = np.zeros(size, np.int64)
    sums = counted.filter("codes IS NOT NULL").select("codes").mapInArrow(add, "code int, df long").groupBy("code").agg(F.sum("df").alias("df"))
    for r in sums.toLocalIterator():
        out[r.code] = r.df
    return out


def _found(counted: DataFrame, items: Items, weight: np.ndarray, floors: np.ndarray, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """``item, doc_id, score``: the k best documents of each item and task, or more than all that matter."""
    root, codes = item_tree(items.codes, weight), items.codes

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Search(root, codes, weight, floors, k)
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(start, DOCS_AT_ONCE)
                ids, n, lists, tfs = (part.column(i) for i in range(4))
                ends = lists.offsets.to_numpy().astype(np.int64)
                tf = tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                length = 100 - LENGTH_SHARE + LENGTH_SHARE * n.to_numpy(zero_copy_only=False) * n_docs // n_terms
                impact = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(length, np.diff(ends)))
                missing = ids.is_null().to_numpy(zero_copy_only=False)
                state.add(
                    Docs(pc.fill_null(ids, _LAST).to_numpy(zero_copy_only=False), missing, lists.flatten().to_numpy(zero_copy_only=False), impact.astype(np.float64), ends - ends[0])
                )
        yield from state.rows()

    return counted.filter("codes IS NOT NULL").select("id", "n", "codes", "tfs").mapInArrow(search, "item int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", **block: int) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k highest-scoring documents of each item with a score above 0.

    ``doc_id`` is a whole number. Several blocks of items give a union of as many results;
    their texts are read once a block. ``block``: ``most`` items and ``most_terms`` of one.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType
    parts = []
    for own in item_blocks(items, item_id, text, **block):
        counted = materialise(_counted(docs, own.vocabulary, doc_id, text))
        n_docs, n_terms = counted.agg(F.sum("docs"), F.sum("n")).first()
        if not n_terms:
            continue
        df = _frequencies(counted, len(own.vocabulary))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)
        floors = np.zeros(len(own.ids), np.int64)
        share = max(16, -(-n_docs // SEED_DOCS))
        some = counted.filter(F.pmod(F.xxhash64("id", "n", "codes"), F.lit(share)) == 0)
        for r in _ranked(_found(some, own, weight, floors, k, n_docs, n_terms), k).filter(F.col("rank") == k).toLocalIterator():
            floors[r.item] = r.score
        best = _ranked(_found(counted, own, weight, floors, k, n_docs, n_terms), k)
        names = spark.createDataFrame(list(enumerate(own.ids)), f"item int, item_id {kind.simpleString()}")
        # as many names as a block has items
        parts.append(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def lexical_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return ranked(docs, items)
