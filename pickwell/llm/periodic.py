"""Runs of periodically repeating words, found by catchers over completed dyadic blocks.

Words of a text are appended one after the other. Whenever ``B = 2**k`` of them
complete a block that starts at a multiple of ``B``, a catcher is set up for it,
of every size ``B``. It waits for its block to come back at a distance between
``2B - 1`` and ``4B - 2``: each appended word completes a suffix of ``B`` words, which is
compared with the blocks of the two catchers of that size in reach. A stretch
that keeps period ``p`` over ``p`` words or more holds a complete block of the size
whose reach has ``p`` in it, so no square is missed. Catchers of neighbouring blocks that
report the same distance are merged, their stretch is stretched on both sides by
halving steps, and what is found with several periods counts with the smallest.

The comparisons of one word do not depend on those of another, so all words of a
block of texts are appended together: for each size, the suffix hashes of all of
them are compared with their two catchers in two array operations. Two suffixes
of ``2B`` words are equal if their halves are, so their hash is made of two hashes
of ``B`` words. Work is ``O(n log n)`` for a text of n words, whatever repeats in it,
and memory about ``8 log2 n`` bytes a word of the texts held at once (2 MB, or one
longer text).

Defined cases: NULL, empty and blank texts have no words, no runs and an empty
``collapsed``; rows are independent of each other, so repeated rows, ids that
repeat or are NULL, and other columns make no difference; an input column named
as the result is replaced. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pickwell.functions.strings import let
from pickwell.llm import common as C

LEAST = 12
_KIND = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_ARROW = pa.struct(
    [("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), ("collapsed", pa.string())]
)

_U = np.uint64


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of two pieces after one another."""
    x = first * _U(0x9E3779B97F4A7C15) + second
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def find(codes: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """``text, start, length, period`` of all runs, by text and start.

    ``codes`` are the words of all texts, ``lengths`` their numbers, longest first: the
    texts long enough for a size of catcher are then the first ones.
    """
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    place = np.arange(len(codes)) - np.repeat(starts[:-1], lengths)
    left = np.repeat(lengths, lengths) - place
    suffix = [C.mix(codes.astype(np.uint64) + _U(1))]
    found = []
    size = 1
    while True:
        reach = int(starts[np.searchsorted(-lengths, -max(least, 2 * (2 * size - 1)), "right")])
        if not reach:
            break
        if size > 1:
            half, shorter = size // 2, suffix[-1][:reach]
            longer = shorter.copy()
            longer[:-half] = _joined(shorter[:-half], shorter[half:])
            suffix.append(longer)
        caught, distance = _caught(suffix[-1], place[:reach], left[:reach], size)
        found.append(_stretched(caught, distance, suffix, place, left, size, least))
        size *= 2
    lo, length, period = map(np.concatenate, zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    text = np.searchsorted(starts, lo, "right") - 1
    order = np.lexsort((period, length, lo))
    lo, length, period, text = lo[order], length[order], period[order], text[order]
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (length[1:] != length[:-1])
    lo, length, period, text = lo[new], length[new], period[new], text[new]
    order = np.lexsort((period, lo))
    return text[order], (lo - starts[text])[order], length[order], period[order]


def _caught(suffix: np.ndarray, place: np.ndarray, left: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Catchers (by the place of their block) whose block came back, and at what distance."""
    shift = size.bit_length() - 1
    back = np.flatnonzero((place >= 2 * size - 1) & (left >= size))
    inside = place[back]
    newest = (inside - (2 * size - 1)) >> shift
    base = back - inside
    hits = []
    for catcher in (newest, newest - 1):
        block = base + (catcher << shift)
        equal = (suffix[np.maximum(block, 0)] == suffix[back]) & (catcher >= 0)
        hits.append((block[equal], back[equal] - block[equal]))
    return tuple(np.concatenate(x) for x in zip(*hits))


def _stretched(
    block: np.ndarray, distance: np.ndarray, suffix: list[np.ndarray], place: np.ndarray, left: np.ndarray, size: int, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of the stretches that the catches of one size belong to."""
    order = np.lexsort((block, distance))
    block, distance = block[order], distance[order]
    new = np.ones(len(block), bool)
    new[1:] = (distance[1:] != distance[:-1]) | (block[1:] - block[:-1] != size) | (place[block[1:]] == 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(block))[: len(first)] - 1
    lo, hi, period = block[first], block[last] + size, distance[first]
    wide = hi - lo + 2 * (size - 1) >= np.maximum(least - period, period)
    lo, hi, period = lo[wide], hi[wide], period[wide]
    end = lo + left[lo]
    step = size // 2
    while step:
        hashes = suffix[step.bit_length() - 1]
        can = place[lo] >= step
        at = np.where(can, lo - step, lo)
        lo = np.where(can & (hashes[at] == hashes[at + period]), at, lo)
        can = hi + period + step <= end
        at = np.where(can, hi, 0)
        hi = np.where(can & (hashes[at] == hashes[np.where(can, at + period, 0)]), hi + step, hi)
        step //= 2
    length = hi - lo + period
    long = length >= np.maximum(least, 2 * period)
    return lo[long], length[long], period[long]


def _block(texts: pa.Array, least: int) -> pa.StructArray:
    rows, words = C.split_words(texts, lower=False)
    n = np.bincount(rows, minlength=len(texts)).astype(np.int64)
    order = np.argsort(-n, kind="stable")
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    old = C.ranges(first[order], n[order])
    codes = C.distinct(words)[0] if len(words) else np.zeros(0, np.int64)
    text, start, length, period = find(codes[old], n[order], least)
    row = order[text]
    begin = first[row] + start
    change = np.bincount(begin + period, minlength=len(codes) + 1) - np.bincount(begin + length, minlength=len(codes) + 1)
    kept = np.cumsum(change)[: len(codes)] == 0
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows[kept], minlength=len(texts)))])
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), words.filter(pa.array(kept))), " ").cast(pa.string())
    order = np.lexsort((period, start, row))
    cells = pa.StructArray.from_arrays([pa.array(x[order]) for x in (start, length, period)], fields=list(_ARROW.field("runs").type.value_type))
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(ends), cells, type=_ARROW.field("runs").type)
    return pa.StructArray.from_arrays([pa.array(n), runs, collapsed], fields=list(_ARROW))


def with_runs(docs: DataFrame, text: str = "text", name: str = "periodic", least: int = LEAST, keep_text: bool = True) -> DataFrame:
    """``docs`` and, as a struct, ``n_words``, ``runs`` (by start, then period) and ``collapsed``: the text without what runs repeat.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch with smallest
    period q that no neighbouring word continues, of ``max(least, 2q)`` words or more. ``collapsed``
    drops the words that a run holds after its first q, and joins the rest by blanks.
    """
    other = [c for c in docs.columns if c != name and (keep_text or c != text)]

    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.blocks(batches, text):
            yield pa.RecordBatch.from_arrays([*(C.column(batch, c) for c in other), _block(C.column(batch, text), least)], [*other, name])

    schema = T.StructType([*(docs.schema[c] for c in other), T.StructField(name, T.StructType.fromDDL(_KIND))])
    return docs.select(*dict.fromkeys([f"`{c}`" for c in [*other, text]])).mapInArrow(analyse, schema)


def made_periodic(key: Column, text: Column) -> Column:
    """The text; of one key in ten, made to repeat from some word on.

    With ``h = crc32(key)`` and ``g = h div 10``, the words i from ``a = g % n`` on of
    keys with ``h % 10 = 0`` become the words ``a + (i - a) % p``, ``p = 1 + (n - a) div (3 + g % 8)``.
    """
    h = F.crc32(key.cast("string"))

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        g = F.floor(h / 10)
        cut = F.struct(F.pmod(g, n).alias("a"), (g % 8 + 3).alias("parts"))

        def at(c: Column) -> Column:
            shape = F.struct(c["a"].alias("a"), (F.floor((n - c["a"]) / c["parts"]) + 1).alias("p"))
            return let(shape, lambda s: F.transform(words, lambda w, i: F.when(i < s["a"], w).otherwise(F.get(words, (s["a"] + (i - s["a"]) % s["p"]).cast("int")))))

        return F.when(n > 0, F.array_join(let(cut, at), " ")).otherwise("")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when((h % 10 == 0) & text.isNotNull(), let(words, repeat)).otherwise(text)


def periodic_query(docs: DataFrame) -> DataFrame:
    """Of each document, with one in ten made periodic: the number of runs, the longest, and digests."""
    found = docs.select("doc_id", made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    runs = F.col("periodic.runs")
    longest = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = with_runs(found, keep_text=False).select("doc_id", F.size(runs).cast("bigint").alias("n_runs"), longest.alias("l"), lines.alias("lines"), F.col("periodic.collapsed").alias("collapsed"))
    length, period = -F.col("l.less"), F.col("l.period")
    return found.select(
        "doc_id",
        "n_runs",
        F.col("l.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
