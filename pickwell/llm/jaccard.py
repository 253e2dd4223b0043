"""Documents linked by the Jaccard similarity of their word shingles.

1. A text becomes the set of its 5-word shingles, each a 64-bit hash. Documents
   with the same set are one class, named by a hash of the set; all further work
   is on classes.
2. Two sets this similar share a shingle among the first ``n - ceil(0.75 n) + 1``
   of each in any fixed order. The order puts shingles seen often last. Postings
   of these prefixes are grouped by shingle; each list is reduced to a star, its
   smallest class with every other, so a list of any length stays linear.
3. Pairs of a star are looked up by T-occurrence search: in a task the sets of
   the members are inverted lists; a query merges its short lists by counting,
   probes the longest lists by binary search for what is left (DivideSkip), and keeps
   members that reach the overlap ``ceil(75 (a + b) / 175)``.
4. Members of a star that are not in its component are compared with the other
   members too, components apart, inside cells of bounded size: first by a bound from
   bit sketches, then by the same search over the sets of those with a partner left.
   A cell gives a forest of links, so what leaves it grows with its members and not with
   their pairs. With that every pair that shares a prefix shingle is decided or inside
   one component.

The hints on frequent shingles and the filters only save work; no link is lost.

Defined cases: NULL and blank texts have an empty set and stay alone; fewer than
five words are one shingle; equal rows and equal texts form one component; a NULL
id never names a component unless all of it are NULL; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickwell.llm import common as C
from pickwell.llm.counts import most_frequent
from pickwell.llm.graph import components
from pickwell.operators.joins import salted_join
from pickwell.session import batch_rows, materialise

WORDS = 5
PERCENT = 75
FREQUENT = 1 << 20  # shingles that may be named frequent: a hint of bounded size
SKETCH = 16  # 64-bit words of a sketch, at least
TASK_SHINGLES = 1 << 18
BLOCK_MEMBERS, BLOCK_SHINGLES = 2048, 1 << 20
MU = 0.0085  # weight of a probe against a merge step, as published with DivideSkip
LONG = 2048  # a shorter list is counted in less time than probed
SMALL_BLOCK, CHUNK = 32, 1 << 20
BATCH_ROWS = 2000  # of a batch on its way to Python: whole texts, twice in memory there and on the way

_U = np.uint64


class Sets:
    """Shingle sets of a block: ``n`` per row, ``values`` sorted within each row, ``starts``, and the class of each row."""

    def __init__(self, texts: pa.Array):
        rows_n = len(texts)
        rows, h = C.hashed_words(pc.fill_null(texts, ""))
        counts = np.bincount(rows, minlength=rows_n)
        begins = np.cumsum(counts) - counts
        m = max(0, len(h) - WORDS + 1)
        rolled = h[:m].copy()
        for k in range(1, WORDS):
            rolled = (rolled ^ (rolled >> _U(29))) * _U(0x9E3779B97F4A7C15) + h[k : k + m]
        full = rows[:m] == rows[WORDS - 1 :] if m else np.zeros(0, bool)
        owner, values = rows[:m][full], C.mix(rolled[full])
        short = np.flatnonzero((counts > 0) & (counts < WORDS))
        if len(short):
            whole = []
            for r in short.tolist():
                seed = np.array([counts[r]], np.uint64)
                for x in h[begins[r] : begins[r] + counts[r]]:
                    seed = C.mix(seed * _U(0xD1342543DE82EF95) + x)
                whole.append(seed[0])
            owner = np.concatenate([owner, short])
            values = np.concatenate([values, np.array(whole, np.uint64)])
            order = np.argsort(owner, kind="stable")
            owner, values = owner[order], values[order]
        cuts = np.searchsorted(owner, np.arange(rows_n + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                values[a:b].sort()
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        owner, self.values = owner[new], values[new]
        self.n = np.bincount(owner, minlength=rows_n)
        self.starts = np.cumsum(self.n) - self.n
        self.cls = np.zeros(rows_n, np.uint64)
        some = self.n > 0
        if some.any():
            self.cls[some] = C.mix(np.add.reduceat(C.mix(self.values + _U(1)), self.starts[some]) ^ self.n[some].astype(np.uint64))

    def of(self, row: int) -> np.ndarray:
        return self.values[self.starts[row] : self.starts[row] + self.n[row]]

    def first_of_class(self, seen: set[int]) -> list[int]:
        """Rows whose class was not seen before; remembers them."""
        out = []
        for row, c in enumerate(self.cls.tolist()):
            if self.n[row] and c not in seen:
                seen.add(c)
                out.append(row)
        return out


def _batch(names: str, *arrays) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays(
        [a if isinstance(a, pa.Array) else pa.array(a.view(np.int64) if a.dtype == np.uint64 else a, kinds[k]) for a, (_, k) in zip(arrays, fields, strict=True)],
        [f[0] for f in fields],
    )


_MEMBERS = "kind int, doc_id long, cls long, n long, text_hash long, bits array<long>"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: each row with class and set size, and the sketch with the first row of a class in a task.

    Kind 1: shingles that several classes of a block hold, with their number.
    """
    sketched: set[int] = set()
    for block in C.blocks(batches):
        sets = Sets(C.column(block, "text"))
        new = sets.first_of_class(sketched)
        drawn, length = sketches(sets.values[C.ranges(sets.starts[new], sets.n[new])], sets.n[new]) if new else (np.zeros(0, np.int64), 0)
        lengths = np.zeros(block.num_rows, np.int64)
        lengths[new] = length
        bits = C.lists(drawn, lengths, pa.int64())
        yield _batch(_MEMBERS, np.zeros(block.num_rows, np.int32), C.column(block, "doc_id"), sets.cls, sets.n, C.column(block, "text_hash"), bits)
        rows = sets.first_of_class(set())
        held = sets.values[C.ranges(sets.starts[rows], sets.n[rows])] if rows else sets.values[:0]
        value, times = np.unique(held, return_counts=True)
        value, times = value[times > 1], times[times > 1]
        none = pa.nulls(len(value), pa.int64())
        yield _batch(_MEMBERS, np.ones(len(value), np.int32), none, value, times, none, pa.nulls(len(value), pa.list_(pa.int64())))


def prefix_length(n: int) -> int:
    return n + (-PERCENT * n) // 100 + 1


def needed(a: int, b: int) -> int:
    """Smallest overlap with which sets of these sizes are similar."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


_POSTING = "token long, cls long, n long"


def _postings(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, level = frequent.value
        seen: set[int] = set()
        for block in C.blocks(batches):
            sets = Sets(C.column(block, "text"))
            values = sets.values
            at = np.searchsorted(keys, values)
            hit = at < len(keys)
            hit[hit] = keys[at[hit]] == values[hit]
            grade = np.zeros(len(values), np.uint64)
            grade[hit] = level[at[hit]]
            order_key = (grade << _U(58)) | (values >> _U(6))
            chosen, owner = [], []
            for row in sets.first_of_class(seen):
                a, n = int(sets.starts[row]), int(sets.n[row])
                chosen.append(a + np.argsort(order_key[a : a + n], kind="stable")[: prefix_length(n)])
                owner.append(row)
            if chosen:
                where = np.repeat(owner, [len(c) for c in chosen])
                yield _batch(_POSTING, values[np.concatenate(chosen)], sets.cls[where], sets.n[where])

    return run


_STAR = "a long, n_a long, b long, n_b long"


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by token and class: the first class of each list with every other."""
    token = hub = hub_n = None
    for batch in batches:
        tokens, cls, n = (batch.column(i).to_numpy() for i in range(3))
        if not len(tokens):
            continue
        starts = C.run_starts(tokens)
        run = np.searchsorted(starts, np.arange(len(tokens)), "right") - 1
        a, n_a = cls[starts], n[starts]
        if token is not None and tokens[0] == token:
            a[0], n_a[0] = hub, hub_n
        token, hub, hub_n = tokens[-1], a[-1], n_a[-1]
        other = a[run] != cls
        if other.any():
            pairs = np.unique(np.stack([a[run][other], n_a[run][other], cls[other], n[other]], 1), axis=0)
            yield _batch(_STAR, *[np.ascontiguousarray(pairs[:, i]) for i in range(4)])


def sketches(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of sets that lie one after the other, with their lengths: parity of the shingles at each bit, with a bit per shingle or more (a power of two).

    Differing bits never outnumber differing shingles. Xor of its halves is the
    sketch of half the size.
    """
    bits = np.array([max(64 * SKETCH, 1 << (x - 1).bit_length()) for x in n.tolist()], np.int64)
    ends = np.cumsum(bits)
    place = np.repeat(ends - bits, n) + (values & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    parity = np.bincount(place, minlength=int(ends[-1])) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64), bits >> 6


def sketch(values: np.ndarray) -> np.ndarray:
    return sketches(values, np.array([len(values)]))[0]


def halved(bits: np.ndarray) -> np.ndarray:
    middle = bits.shape[-1] // 2
    return bits[..., :middle] ^ bits[..., middle:]


_SET = "cls long, shingles array<long>"
MARKS = 3  # bits that a wanted row sets


def _marks(doc_id: pa.Array, text_hash: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """Places of a row, named by its id and the hash of its text, in a bit array; a NULL id counts as the largest."""
    ids, texts = (pc.fill_null(c.cast(pa.int64()), 2**63 - 1).to_numpy(zero_copy_only=False).view(np.uint64) for c in (doc_id, text_hash))
    h = C.mix(texts ^ C.mix(ids))
    for _ in range(MARKS):
        yield (h & _U(bits - 1)).astype(np.int64)
        h = C.mix(h + _U(1))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sets of the wanted classes, each from the document that stands for it (``cls, doc_id, text_hash``).

    The wanted rows are named by a bit array of bounded size that is asked before a text is
    split; the few rows it lets through besides do no harm. Sets are long, so they are made again
    from the texts where they are needed rather than stored for every candidate.
    """
    spark = docs.sparkSession
    bits = 1 << min(28, max(16, (16 * wanted.count()).bit_length()))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _marks(C.column(batch, "doc_id"), C.column(batch, "text_hash"), bits):
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6, pa.int64()), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64), pa.int64())], ["word", "mask"])

    words = wanted.mapInArrow(marks, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    array = np.zeros(bits >> 6, np.int64)
    array[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    held = spark.sparkContext.broadcast(array)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.ones(batch.num_rows, bool)
            for at in _marks(C.column(batch, "doc_id"), C.column(batch, "text_hash"), bits):
                found &= (held.value[at >> 6] >> (at & 63)) & 1 == 1
            if found.any():
                yield batch.filter(pa.array(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for block in C.blocks(marked(batches)):
            sets = Sets(C.column(block, "text"))
            rows = np.array(sets.first_of_class(seen), np.int64)
            yield _batch(_SET.replace("array<long>", "long"), sets.cls[rows], C.lists(sets.values[C.ranges(sets.starts[rows], sets.n[rows])].view(np.int64), sets.n[rows], pa.int64()))

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, _SET)


def divide_skip(lists: list, least: int) -> dict[int, int]:
    """How often each number occurs in the sorted lists of small numbers, of those that occur at least ``least`` times."""
    if len(lists) < least:
        return {}
    lists = sorted(lists, key=len)
    longest = len(lists[-1])
    n_long = min(len(lists) - 1, least - 1, int(least / (MU * np.log2(longest + 1) + 1)))
    n_long = min(n_long, sum(len(x) > LONG for x in lists)) if longest > LONG else 0
    # a number that occurs often enough is in (least - n_long) short lists
    times = np.bincount(np.concatenate(lists[: len(lists) - n_long], dtype=np.int64, casting="unsafe"))
    found = np.flatnonzero(times >= least - n_long)
    times = times[found]
    for left, values in zip(range(n_long - 1, -1, -1), lists[len(lists) - n_long :], strict=True):
        if not len(found):
            break
        at = np.searchsorted(values, found)
        at[at == len(values)] = 0
        times = times + (values[at] == found)
        likely = times + left >= least
        found, times = found[likely], times[likely]
    return dict(zip(found.tolist(), times.tolist(), strict=True))


def search_cell(queries: list[tuple[int, np.ndarray]], members: list[tuple[int, np.ndarray]], by_place: bool = False) -> list[tuple[int, int]]:
    """Links between queries and members (class, sorted set), by T-occurrence search over the members' inverted lists.

    ``by_place`` names members by their place in the list.
    """
    if not members or not queries:
        return []
    sizes = [len(v) for _, v in members]
    smallest = min(sizes)
    flat = np.concatenate([v for _, v in members])
    owner = np.repeat(np.arange(len(members)), sizes)
    if len(queries) == 1 and len(members) > 1:
        # for one query only its own shingles need an inverted list
        at = np.searchsorted(queries[0][1], flat)
        at[at == len(queries[0][1])] = 0
        held = queries[0][1][at] == flat
        flat, owner = flat[held], owner[held]
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    links = []
    for cls, values in queries:
        a, b = np.searchsorted(flat, values), np.searchsorted(flat, values, "right")
        some = b > a
        lists = [owner[i:j] for i, j in zip(a[some].tolist(), b[some].tolist(), strict=True)]
        least = max(needed(len(values), smallest), -(-PERCENT * len(values) // 100))
        for i, times in divide_skip(lists, least).items():
            if times >= needed(len(values), sizes[i]) and (by_place or members[i][0] != cls):
                links.append((cls, i if by_place else members[i][0]))
    return links


def search(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links ``a, b`` among candidate pairs (``a, n_a, b, n_b``); other true links may come along.

    Only classes left after the tests of size and sketch get their sets. Pairs are put in cells of bounded numbers of shingles; a query with more members than that is in several.
    """
    # sizes that may be similar are a factor of two apart at most, and so are their sketches
    words = F.least(F.size("bits_a"), F.size("bits_b"))

    def common(name: str) -> Column:
        halves = F.zip_with(F.slice(name, 1, words), F.slice(name, words + 1, words), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(name) > words, halves).otherwise(F.col(name))

    xor = F.aggregate(F.zip_with(common("bits_a"), common("bits_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    both = F.col("n_a") + F.col("n_b")
    least = F.expr(f"({PERCENT} * (n_a + n_b) + {99 + PERCENT}) div {100 + PERCENT}")
    sized = pairs.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT)
    bits = sketches.select("cls", "bits")
    close = (
        sized.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b").filter(xor <= both - 2 * least)
        .select("a", "n_a", "b", "n_b").distinct()
    )
    close = materialise(close)
    total = close.agg(F.sum(F.col("n_a") + F.col("n_b"))).first()[0] or 0
    cells = max(1, -(-total // TASK_SHINGLES))
    load = close.groupBy("a").agg(F.ceil(F.sum("n_b") / TASK_SHINGLES).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts"))
    placed = close.join(load, "a").select("a", "b", F.pmod(F.xxhash64("a", part), F.lit(cells)).alias("cell"))
    member = placed.select("cell", F.col("b").alias("cls"), F.lit(False).alias("is_query")).distinct()
    query = placed.select("cell", F.col("a").alias("cls"), F.lit(True).alias("is_query")).distinct()
    left = close.select(F.col("a").alias("cls")).union(close.select("b")).distinct().join(wanted, "cls")
    rows = member.unionByName(query).join(sets_of(docs, materialise(left)), "cls")

    def run(cell: pa.Table) -> pa.Table:
        cls, is_query = cell.column("cls").to_numpy(), cell.column("is_query").to_numpy()
        lists = cell.column("shingles").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        chosen: tuple[dict[int, np.ndarray], dict[int, np.ndarray]] = ({}, {})
        for i, c in enumerate(cls.tolist()):
            chosen[int(is_query[i])][c] = flat[ends[i] : ends[i + 1]]
        links = search_cell(sorted(chosen[1].items()), sorted(chosen[0].items()))
        return pa.table({k: pa.array([x[j] for x in links], pa.int64()) for j, k in enumerate("ab")})

    return materialise(rows.groupBy("cell").applyInArrow(run, "a long, b long"))


def open_members(stars: DataFrame, roots: DataFrame, across: bool) -> tuple[DataFrame, int]:
    """Members of stars with a member outside their component, dealt to blocks, and the number of cells these fill.

    A row is ``a, i, j`` (the star and its block), ``cell``, ``b, n, root``, and whether the member is to be compared
    with the others of the block (``is_query``) or is one of those. ``across``: members outside
    the star's component meet all others, in blocks of both. Else a star is cut into blocks once, so
    each member is in one of them.
    """
    root = roots.select(F.col("node"), "component")
    known = (
        stars.join(root.toDF("a", "root_a"), "a", "left").join(root.toDF("b", "root_b"), "b", "left")
        .select("a", "b", F.col("n_b").alias("n"), F.coalesce("root_b", "b").alias("root"), (F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).alias("outside"))
    )
    known = materialise(known)
    parts = lambda rows, shingles: F.greatest(F.ceil(rows / BLOCK_MEMBERS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    sizes = known.groupBy("a").agg(
        F.count("*").alias("m"), F.sum("n").alias("n_m"), F.count_if("outside").alias("o"), F.sum(F.when(F.col("outside"), F.col("n")).otherwise(0)).alias("n_o")
    )
    open_ = sizes.filter("m > 1 and o > 0").select("a", parts(F.col("m"), F.col("n_m")).alias("m_parts"), parts(F.col("o"), F.col("n_o")).alias("o_parts"), "n_m", "n_o")
    open_ = materialise(open_)
    load = F.col("n_m") * F.col("o_parts") + F.col("n_o") * F.col("m_parts") if across else F.col("n_m")
    cells = max(1, -(-(open_.agg(F.sum(load)).first()[0] or 0) // BLOCK_SHINGLES))
    rows = known.join(open_.drop("n_m", "n_o"), "a")
    h = F.xxhash64("b")
    own = lambda part: F.pmod(h, F.col(part)).cast("int")
    columns = ["a", "b", "n", "root"]
    if across:
        every = lambda part: F.explode(F.sequence(F.lit(0), F.col(part) - 1))
        index = rows.select(*columns, F.lit(False).alias("is_query"), own("m_parts").alias("i"), every("o_parts").alias("j"))
        query = rows.filter("outside").select(*columns, F.lit(True).alias("is_query"), every("m_parts").alias("i"), own("o_parts").alias("j"))
        placed = index.unionByName(query)
    else:
        placed = rows.select(*columns, F.lit(True).alias("is_query"), own("m_parts").alias("i"), F.lit(0).alias("j"))
    return placed.withColumn("cell", F.pmod(F.xxhash64("a", "i", "j"), F.lit(cells))), cells


class Sketches:
    """Sketches of some sets, compared without regard to their lengths."""

    def __init__(self, bits: list[np.ndarray]):
        self.length = np.array([len(x) for x in bits], np.int64)
        # sketches by their length; a row's place among those of its length
        self.at, self.by_length = np.zeros(len(bits), np.int64), {}
        for size in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == size)
            self.at[own] = np.arange(len(own))
            self.by_length[size] = np.stack([bits[i] for i in own]).view(np.uint64)

    def differing(self, rows: np.ndarray, q: int) -> np.ndarray:
        """A lower bound of the shingles in which the sets of these rows differ from that of q."""
        out = np.zeros(len(rows), np.int64)
        mine = self.by_length[self.length[q]][self.at[q]]
        for size in np.unique(self.length[rows]).tolist():
            some = self.length[rows] == size
            theirs, own = self.by_length[size][self.at[rows[some]]], mine
            if size > len(own):
                theirs = halved(theirs)
            elif size < len(own):
                own = halved(own)
            out[some] = np.bitwise_count(theirs ^ own).sum(1, dtype=np.int64)
        return out

    def near(self, index: np.ndarray, n: np.ndarray, root: np.ndarray, q: int) -> np.ndarray:
        """Rows of ``index`` (by size) in other components than q that size and sketch leave."""
        low = np.searchsorted(n[index], -(-PERCENT * n[q] // 100))
        high = np.searchsorted(n[index], 100 * n[q] // PERCENT, "right")
        rows = index[low:high]
        rows = rows[root[rows] != root[q]]
        both = n[rows] + n[q]
        return rows[self.differing(rows, q) <= both - 2 * (-(-PERCENT * both // (100 + PERCENT)))]


def _blocks_of_cell(cell: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows of a cell by block and size, and where the blocks begin, with the end of the last."""
    cell = cell.sort_by([(c, "ascending") for c in ("a", "i", "j", "n", "b")]).combine_chunks()
    block = np.stack([cell.column(c).to_numpy().astype(np.int64) for c in "aij"], 1)
    return cell, np.append(np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]).any(1)])), len(block))


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    flat = column.combine_chunks()
    ends, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_PLACED = "a long, i int, j int, cell long, b long, n long, root long, is_query boolean"


def _near_in_small(cuts: np.ndarray, n: np.ndarray, root: np.ndarray, is_query: np.ndarray, column: pa.ChunkedArray) -> np.ndarray:
    """Which rows of these small blocks have a partner by size and sketch: all pairs of many blocks at once."""
    found = np.zeros(len(n), bool)
    size = np.diff(cuts)
    queries = np.add.reduceat(is_query, cuts[:-1], dtype=np.int64)
    start, size, mixed = (np.repeat(x, size) for x in (cuts[:-1], size, queries < size))
    flat = column.combine_chunks()
    ends, words = flat.offsets.to_numpy(), flat.values.to_numpy().view(np.uint64)
    length = np.diff(ends)
    asked = np.flatnonzero(is_query & (size > 1) & (size <= SMALL_BLOCK))
    for part in np.split(asked, np.flatnonzero(np.diff(np.cumsum(size[asked]) // CHUNK)) + 1):
        q, r = np.repeat(part, size[part]), C.ranges(start[part], size[part])
        some = (root[q] != root[r]) & ~(is_query[r] & mixed[r]) & (100 * n[r] >= PERCENT * n[q]) & (PERCENT * n[r] <= 100 * n[q])
        q, r = q[some], r[some]
        # the sizes are similar, so a sketch is as long as the other, or twice
        q, r = np.where(length[q] <= length[r], q, r), np.where(length[q] <= length[r], r, q)
        both = n[q] + n[r]
        most = both - 2 * (-(-PERCENT * both // (100 + PERCENT)))
        for short, long in set(zip(length[q].tolist(), length[r].tolist(), strict=True)):
            pairs = np.flatnonzero((length[q] == short) & (length[r] == long))
            for at in np.split(pairs, np.arange(CHUNK // long + 1, len(pairs), CHUNK // long + 1)):
                theirs = words[ends[r[at]][:, None] + np.arange(long)]
                while theirs.shape[1] > short:
                    theirs = halved(theirs)
                own = words[ends[q[at]][:, None] + np.arange(short)]
                near = at[np.bitwise_count(theirs ^ own).sum(1, dtype=np.int64) <= most[at]]
                found[q[near]] = found[r[near]] = True
    return found


def _with_partner(cell: pa.Table) -> pa.Table:
    """The rows of a cell that size and sketch leave a partner in their block, without their sketches."""
    names = [f.split()[0] for f in _PLACED.split(", ")]
    cell, cuts = _blocks_of_cell(cell)
    n, root, is_query = (cell.column(c).to_numpy() for c in ("n", "root", "is_query"))
    found = _near_in_small(cuts, n, root, is_query, cell.column("bits"))
    for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if stop - start <= SMALL_BLOCK:
            continue
        some = slice(start, stop)
        sketches = Sketches(_lists(cell.column("bits").slice(start, stop - start)))
        own = np.flatnonzero(~is_query[some])
        own = own if len(own) else np.arange(stop - start)
        for q in np.flatnonzero(is_query[some]):
            near = sketches.near(own, n[some], root[some], q)
            if len(near):
                found[start + near] = found[start + q] = True
    return cell.select(names).filter(pa.array(found))


def _forest(cell: pa.Table) -> pa.Table:
    """Links of a cell that join components, at most one fewer than it has rows.

    Members are compared in turn, by T-occurrence search over the inverted lists of those that are in
    other components by then and that size and sketch leave.
    """
    links: list[tuple[int, int]] = []
    cell, cuts = _blocks_of_cell(cell)
    for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = cell.slice(start, stop - start)
        b, n, root, is_query = (part.column(c).to_numpy() for c in ("b", "n", "root", "is_query"))
        root = root.copy()
        sets = [x.view(np.uint64) for x in _lists(part.column("shingles"))]
        sketches = Sketches([sketch(x) for x in sets])
        own = np.flatnonzero(~is_query)
        own = own if len(own) else np.arange(len(n))
        for q in np.flatnonzero(is_query):
            near = sketches.near(own, n, root, q)
            if not len(near):
                continue
            for _, found in search_cell([(int(b[q]), sets[q])], [(int(m), sets[m]) for m in near], by_place=True):
                if root[near[found]] != root[q]:
                    links.append((int(b[q]), int(b[near[found]])))
                    root[root == root[near[found]]] = root[q]
    return pa.table({k: pa.array([x[j] for x in links], pa.int64()) for j, k in enumerate("ab")})


def joined(docs: DataFrame, stars: DataFrame, roots: DataFrame, sketches: DataFrame, wanted: DataFrame, across: bool) -> DataFrame:
    """Links ``a, b`` between members of a star that are in different components, enough of them to join what they link.

    All comparing is done inside cells of bounded size, first by sketch, then by set for the members that have a
    partner left. Pairs never leave a cell, only members and a forest of links do.
    """
    placed, _ = open_members(stars, roots, across)
    bits = sketches.select(F.col("cls").alias("b"), "bits")
    left = placed.join(bits, "b").groupBy("cell").applyInArrow(_with_partner, _PLACED)
    left = materialise(left)
    own = left.select(F.col("b").alias("cls")).distinct().join(wanted, "cls")
    sets = sets_of(docs, materialise(own)).withColumnRenamed("cls", "b")
    return materialise(left.join(sets, "b").groupBy("cell").applyInArrow(_forest, "a long, b long"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``).

    Besides, ``text_hash`` tells rows of one id apart and ``root`` names the component's class (0: empty set).
    """
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        return _similar_documents(docs)


def _similar_documents(docs: DataFrame) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    found = materialise(docs.mapInArrow(_members, _MEMBERS))
    members = found.filter("kind = 0").select("doc_id", "cls", "n", "text_hash")
    often = materialise(found.filter("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")))
    often = most_frequent(often, FREQUENT).toArrow()
    keys = often.column("cls").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    level = np.minimum(np.log2(np.maximum(often.column("n").to_numpy(), 1)) + 1, 31).astype(np.uint64)
    frequent = sc.broadcast((keys[order], level[order]))
    postings = docs.select("text").mapInArrow(_postings(frequent), _POSTING)
    stars = postings.repartition("token").sortWithinPartitions("token", "cls").mapInArrow(_stars, _STAR)
    stars = materialise(stars.distinct())
    # the row that stands for a class: of its smallest id, the smallest text hash
    stands = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    first = materialise(members.filter("n > 0").groupBy("cls").agg(stands.alias("row")).select("cls", "row.doc_id", "row.text_hash"))
    nodes = materialise(stars.select(F.col("a").alias("cls")).union(stars.select("b")).distinct())
    wanted = materialise(nodes.join(first, "cls"))
    drawn = found.filter("kind = 0 and size(bits) > 0").select("cls", "bits")
    sketches = materialise(drawn.join(nodes, "cls", "left_semi").groupBy("cls").agg(F.first("bits").alias("bits")))
    links = search(docs, stars, sketches, wanted)
    # first inside blocks of a star, which joins most of a group of any size; few members are left to meet all blocks
    for across in (False, True):
        roots = components(links)
        links = links.unionByName(joined(docs, stars, roots, sketches, wanted, across))
    # every class in a component of several, with the smallest document of that component
    roots = components(links)
    named = materialise(first.drop("text_hash").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("component", "cls")))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = salted_join(named, smallest, "root", spread_by="cls").select("cls", "component_id", "root")
    return (
        members.join(classes, "cls", "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            "text_hash", F.coalesce("root", F.lit(0)).alias("root"),
        )
    )


def jaccard_query(docs: DataFrame) -> DataFrame:
    """Components of similar documents over the whole table."""
    return similar_documents(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of similar documents, with all its columns: one with the smallest id."""
    found = similar_documents(docs.select("doc_id", "text"))
    named = found.filter((F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = named.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*", F.lit(True).alias("has_words"))
    empty = found.filter("n_shingles = 0").select("doc_id", "text_hash", F.lit(False).alias("has_words")).distinct()
    keep = one.unionByName(empty).toDF("_keep_id", "_keep_hash", "_has_words")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_keep_id")) & (F.xxhash64("text") == F.col("_keep_hash"))
    # equal rows of one id: the first; texts without words are in no group
    copy = F.row_number().over(Window.partitionBy("_keep_id", "_keep_hash").orderBy(F.lit(0)))
    kept = docs.join(keep, same).withColumn("_copy", copy).filter((F.col("_copy") == 1) | ~F.col("_has_words"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
