"""Mixing sources to target weights.

Every source gets a target of words: its share by weight of all words, at most
``MAX_REPEATS`` times its own size, the excess shared again among the others. Its
documents, permuted by a hash and cut into blocks, are drawn whole passes first
and then a run of permuted blocks. A splitting tree deals the exact number of
blocks of each source to the output shards: at every node the blocks are divided
between the two halves by a multivariate hypergeometric draw, so a shard is a
random mix and no block is dealt twice. Rows are shuffled inside their shard by
a hash. All row work is DataFrame functions; the driver sees one row per source.

Defined cases: NULL texts have size 0 and are taken with their block; sources
without words have target 0 and take nothing; NULL source is a source of its own,
last in order; rows of equal id and text are numbered and drawn one by one; an empty table gives no rows; other
columns pass, old columns named as the new ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickwell.session import materialise

MAX_REPEATS = 3
DOCS_PER_BLOCK = 64
MAX_BLOCKS = 1 << 16  # of a source; beyond, its blocks grow
MAX_SOURCES = 100_000
SALTED = 1024  # most repeated rows that are numbered in SALTS parts
SALTS = 64
SEED = 20240229
ADDED = ("size", "source_size", "target", "draws", "taken")


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``: starts of words, counted without building them."""
    blank = "\t\n\x0b\x0c\r"
    spaced = F.translate(F.coalesce(text, F.lit("")), blank, " " * len(blank))
    return F.coalesce(F.regexp_count(spaced, F.lit("[^ ]+")), F.lit(0)).cast("long")


def cyclic_weight(position: int) -> float:
    """Weights 1, 2, 3, 1, 2, 3, ... by position of the source."""
    return position % 3 + 1


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MAX_REPEATS) -> list[float]:
    """Words wanted of each source: all words shared by weight, none above ``most`` times its
    size; what is cut off goes to the others by weight until nothing is above."""
    total = float(sum(sizes))
    wanted = [0.0] * len(sizes)
    open_ = [i for i, size in enumerate(sizes) if size > 0]
    while open_:
        by = sum(weights[i] for i in open_)
        above = [i for i in open_ if total * weights[i] / by > most * sizes[i]]
        for i in above or open_:
            wanted[i] = float(most * sizes[i]) if above else total * weights[i] / by
        if not above:
            break
        total -= sum(wanted[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return wanted


@dataclass
class SourcePlan:
    source: str | None
    size: int
    target: float
    blocks: int
    passes: int
    part_blocks: int  # whole blocks of the last, partial pass
    rest: int  # words wanted of that pass


def split_tree(counts: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source for each shard (sources x shards).

    A node's blocks are halved in number (to one block), the left part's share of each source drawn
    without replacement; leaves are shards. Row and column sums are exact.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), np.int64)

    def deal(have: np.ndarray, a: int, b: int) -> None:
        if b - a == 1:
            out[:, a] = have
            return
        middle = (a + b) // 2
        wanted = int(have.sum()) * (middle - a) // (b - a)
        left = rng.multivariate_hypergeometric(have, wanted, method="marginals")
        deal(left, a, middle)
        deal(have - left, middle, b)

    if len(counts):
        deal(np.asarray(counts, np.int64), 0, shards)
    return out


def _hash(*cols: Column | str) -> Column:
    return F.xxhash64(F.lit(SEED), *cols)


def _numbered(rows: DataFrame) -> DataFrame:
    """``_h`` in place of ``_u``: a hash of ``_u`` and the row's number among the rows of that ``_u``, from 0 up.

    The ``SALTED`` most repeated values are numbered in random parts; any other has less than one in
    ``SALTED`` of the rows. The rows are stored, so that every reader sees the same numbers.
    """
    often = rows.groupBy("_u").count().filter(F.col("count") > SALTS).orderBy(F.desc("count"), "_u").limit(SALTED).select("_u", F.lit(True).alias("_often"))
    salt = F.when(F.col("_often"), F.floor(F.rand(SEED) * SALTS).cast("int")).otherwise(0)
    dealt = rows.join(F.broadcast(often), "_u", "left").withColumn("_salt", salt)
    number = F.row_number().over(Window.partitionBy("_u", "_salt").orderBy(F.lit(0))) - 1
    stored = materialise(dealt.withColumn("_number", number.cast("long")))
    parts = stored.filter("_often").groupBy("_u", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_u").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_u", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # SALTED * SALTS rows at most
    found = stored.join(F.broadcast(offsets), ["_u", "_salt"], "left")
    kept = [F.col(f"`{c}`") for c in rows.columns if c != "_u"]
    return found.select(*kept, _hash("_u", F.col("_number") + F.coalesce("_offset", F.lit(0))).alias("_h"))


def plan(docs: DataFrame, key: str, text: str, source: str, shards: int, weight: Callable[[int], float], most: float, narrow: bool = False) -> tuple[DataFrame, list[SourcePlan]]:
    """Documents with size and hash, and each source's plan."""
    old = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in old],
        word_count(F.col(text)).alias("size"),
        _hash(F.col(key).cast("string"), F.lit(0), F.col(text), F.lit(0), F.col(source)).alias("_u"),
        F.col(source).alias("_source"),
    )
    rows = _numbered(rows.drop(text) if narrow else rows)
    found = rows.groupBy("_source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    wanted = targets([r["size"] for r in found], [weight(i) for i in range(len(found))], most)
    plans = []
    for r, target in zip(found, wanted, strict=True):
        blocks = max(1, -(-r["n"] // DOCS_PER_BLOCK))
        passes = min(int(most), math.floor(target / r["size"] + 1e-12)) if r["size"] else 0
        rest = max(0, round(target - passes * r["size"])) if passes < most else 0
        plans.append(SourcePlan(r["_source"], r["size"], target, min(blocks, MAX_BLOCKS), passes, 0, rest))
    return rows, plans


def mix_plan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    shards: int = 8,
    weight: Callable[[int], float] = cyclic_weight,
    most: int = MAX_REPEATS,
    narrow: bool = False,
) -> DataFrame:
    """Every document with ``size, source_size, target, draws, taken``; ``narrow`` leaves its text out.

    ``draws`` lists the output shard of each time the document is taken.
    """
    return _mix_plan(docs, key, text, source, shards, weight, most, narrow).drop("_h")


def _mix_plan(docs: DataFrame, key: str, text: str, source: str, shards: int, weight: Callable[[int], float], most: int, narrow: bool = False) -> DataFrame:
    """``mix_plan`` with the hash of each row in ``_h``."""
    spark = docs.sparkSession
    rows, plans = plan(docs, key, text, source, shards, weight, most, narrow)
    kept = [c for c in rows.columns if c not in ("_h", "_source")]
    same = F.col("_source").eqNullSafe(F.col("p_source"))

    def table(values: list[tuple], schema: str) -> DataFrame:
        made = spark.createDataFrame(values, schema)
        return F.broadcast(made) if len(values) <= 10_000 else made

    block = F.pmod(F.col("_h"), F.col("p_blocks"))
    sizes = table([(p.source, p.blocks, p.rest) for p in plans], "p_source string, p_blocks long, p_rest long")
    joined = rows.select("_source", "_h", "size").join(sizes, same).filter(F.col("p_rest") > 0)
    # the partial pass: whole blocks while they fit, then a part of the next one
    by_block = joined.groupBy("p_source", "p_rest", block.alias("_block")).agg(F.sum("size").alias("_words"))
    along = Window.partitionBy("p_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    fits = by_block.withColumn("_sum", F.sum("_words").over(along)).filter(F.col("_sum") <= F.col("p_rest"))
    # blocks stand in order 0, 1, ...; one without rows has no words
    whole = {r["p_source"]: (r["b"] + 1, r["w"]) for r in fits.groupBy("p_source").agg(F.max("_block").alias("b"), F.max("_sum").alias("w")).collect()}
    for p in plans:
        p.part_blocks, words = whole.get(p.source, (0, 0))
        p.rest -= words
    rests = table([(p.source, p.part_blocks, p.rest) for p in plans if p.rest > 0], "r_source string, r_part long, r_rest long")
    last = joined.join(rests, F.col("p_source").eqNullSafe(F.col("r_source"))).filter(block == F.col("r_part"))
    order = Window.partitionBy("p_source").orderBy("_h").rangeBetween(Window.unboundedPreceding, 0)
    upto = last.withColumn("_sum", F.sum("size").over(order))
    # take documents while the sum stays nearer to what is wanted than without them
    border = upto.filter(F.col("_sum") - F.col("size") / 2 <= F.col("r_rest"))
    until = {r["p_source"]: r["h"] for r in border.groupBy("p_source").agg(F.max("_h").alias("h")).collect()}
    draws = [p.passes * p.blocks + p.part_blocks + (p.source in until) for p in plans]
    dealt = np.cumsum(split_tree(draws, shards), axis=1)
    full = table(
        [(p.source, p.size, p.target, p.blocks, p.passes, p.part_blocks, until.get(p.source), dealt[i].tolist()) for i, p in enumerate(plans)],
        "p_source string, source_size long, target double, p_blocks long, p_passes int, p_part long, p_until long, p_cuts array<long>",
    )
    partial = (block < F.col("p_part")) | ((block == F.col("p_part")) & (F.col("_h") <= F.col("p_until")))
    # draw number p of a block stands at p * blocks + block in its source's sequence
    numbers = F.filter(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: F.when(p < F.col("p_passes"), p * F.col("p_blocks") + block)),
            F.array(F.when(F.coalesce(partial, F.lit(False)), F.col("p_passes") * F.col("p_blocks") + block)),
        ),
        lambda x: x.isNotNull(),
    )
    shard = F.transform(numbers, lambda x: F.size(F.filter(F.col("p_cuts"), lambda c: c <= x)))
    out = rows.join(full, same).select(*[F.col(f"`{c}`") for c in kept], "source_size", "target", "_h", shard.alias("draws"))
    return out.withColumn("taken", F.col("size") * F.size("draws"))


def mix(
    docs: DataFrame,
    shards: int = 8,
    key: str = "doc_id",
    slices: int = 64,
    text: str = "text",
    source: str = "source",
    weight: Callable[[int], float] = cyclic_weight,
    most: int = MAX_REPEATS,
) -> DataFrame:
    """The mixed rows: each document as often as it is drawn, with all columns of ``docs``.

    ``mix_shard`` is the output shard; inside it rows lie in the random order of
    ``mix_order``, in ``slices`` consecutive partitions so that no task holds a whole shard.
    """
    old = [c for c in docs.columns if c not in (*ADDED, "mix_shard", "mix_order")]
    planned = _mix_plan(docs.select(*[F.col(f"`{c}`") for c in old]), key, text, source, shards, weight, most)
    taken = planned.select(*[F.col(f"`{c}`") for c in old], "_h", F.posexplode("draws").alias("_time", "mix_shard"))
    placed = taken.withColumn("mix_order", _hash(F.col("mix_shard"), F.col("_time"), F.col("_h"))).drop("_time", "_h")
    piece = F.floor(F.col("mix_order") / F.lit(2.0**64 / slices))
    return placed.repartition("mix_shard", piece).sortWithinPartitions("mix_shard", "mix_order")


def mixing_query(docs: DataFrame) -> DataFrame:
    """Words taken of every document."""
    planned = mix_plan(docs.select("doc_id", "text", "source"), narrow=True)
    return planned.select("doc_id", "size", "source_size", "target", "taken", "draws")
