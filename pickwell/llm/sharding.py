"""Shards cut along a Hilbert curve over several metadata dimensions.

Each dimension, number or whole string, is quantised by quantiles of its rows; the cells' places on the curve order
the rows; the order is cut into runs of equal row counts. A run covers a compact
part of all dimensions at once, so each shard's minima and maxima prune reads by
any of them. Everything is DataFrame functions.

Law ``rows``: shard sizes differ by one row at most. Rows of one cell are ordered
by a hash, in buckets small enough for one task even if a cell holds most rows.

Defined cases: NULL in a dimension comes first; a NULL text has size 1 (no bytes,
plus one) and checksum 0; equal rows are kept, each with a slot of its own; with
fewer rows than shards the first shards get one row each; an empty table gives no
rows; other columns pass through ``hilbert_shards``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pickwell.session import materialise

BITS = 4
ROWS_PER_BUCKET = 2000
MAX_BUCKETS = 65536
SALTS = 64


def quantise(docs: DataFrame, dimensions: Sequence[Column], bits: int = BITS) -> list[Column]:
    """Cell number 0 .. 2^bits - 1 of each numeric dimension, by approximate quantiles.

    The boundaries, ``2^bits - 1`` numbers per dimension, are all that reaches the driver.
    """
    cells = 1 << bits
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    names = [F.percentile_approx(d, shares, 1000).alias(f"d{i}") for i, d in enumerate(dimensions)]
    found = docs.agg(*names).first()
    codes = []
    for d, cuts in zip(dimensions, found, strict=True):
        above = [F.when(d > F.lit(c), 1).otherwise(0) for c in sorted(set(cuts or ()))]
        codes.append(sum(above, F.lit(0)).cast("int"))
    return codes


def hilbert_index(codes: Sequence[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of the cell with these coordinates.

    Level by level from the highest bit: the coordinates' bits name a corner of
    the current cube, which is turned into the cube's own frame (entry corner
    ``e``, direction ``d``); its place along the Gray code is the next digit.
    """
    n = len(codes)
    corners = 1 << n
    gray = [i ^ (i >> 1) for i in range(corners)]
    place = [gray.index(i) for i in range(corners)]
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(corners)]

    def ones(w: int) -> int:
        return (~w & (w + 1)).bit_length() - 1

    turn = [0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % n for w in range(corners)]

    def rol(x: int, k: int) -> int:
        k %= n
        return ((x << k) | (x >> (n - k))) & (corners - 1)

    # one row per state (e, d) and corner: digit and next state, all in one small array
    states = corners * n
    digits, following = [0] * (states * corners), [0] * (states * corners)
    for e in range(corners):
        for d in range(n):
            for corner in range(corners):
                w = place[rol(corner ^ e, n - (d + 1))]
                at = (e * n + d) * corners + corner
                digits[at] = w
                following[at] = (e ^ rol(entry[w], d + 1)) * n + (d + turn[w] + 1) % n
    digit, follow = F.array(*map(F.lit, digits)), F.array(*map(F.lit, following))

    def step(state: Column, level: Column) -> Column:
        corner = sum((F.call_function("shiftright", c, level).bitwiseAND(1) * (1 << i) for i, c in enumerate(codes)), F.lit(0))
        at = (state["s"] * corners + corner + 1).cast("int")
        return F.struct(F.element_at(follow, at).alias("s"), (state["h"] * corners + F.element_at(digit, at)).cast("long").alias("h"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda state: state["h"])


def text_cuts(docs: DataFrame, value: Column, bits: int = BITS) -> list[str]:
    """At most ``2^bits - 1`` values that cut the rows, in the order of whole strings, into cells of near equal counts.

    Rows are counted for each distinct value and the values sorted over all tasks; a value's rank
    is the number of rows before it. Only the cuts reach the driver.
    """
    counts = docs.select(value.alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    ranked = materialise(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    parts = ranked.groupBy("part").agg(F.sum("n").alias("rows"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("rows").over(whole), F.lit(0)).alias("before"))
    total = ranked.agg(F.sum("n")).first()[0]
    if not total:
        return []
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("rank", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part")
    cell = F.floor((F.col("before") + F.col("rank")) * (1 << bits) / total).alias("cell")
    found = ranked.groupBy(cell).agg(F.min("value").alias("cut")).filter("cell > 0").collect()
    return sorted((r.cut for r in found), key=lambda cut: cut.encode())


def cells(docs: DataFrame, dimensions: Sequence[Column], bits: int = BITS) -> list[Column]:
    """Cell numbers of numeric and string dimensions; NULL is in the first cell."""
    texts = [isinstance(docs.select(d).schema[0].dataType, T.StringType) for d in dimensions]
    numbers = [F.coalesce(d.cast("double"), F.lit(float("-inf"))) for d, text in zip(dimensions, texts) if not text]
    numeric = iter(quantise(docs, numbers, bits) if numbers else [])
    codes = []
    for d, text in zip(dimensions, texts):
        above = [F.when(d >= F.lit(c), 1).otherwise(0) for c in text_cuts(docs, d, bits)] if text else []
        codes.append(sum(above, F.lit(0)).cast("int") if text else next(numeric))
    return codes


def hilbert_shards(docs: DataFrame, dimensions: Sequence[Column], tie: Sequence[Column], shards: int, bits: int = BITS) -> DataFrame:
    """All columns of ``docs`` with ``hilbert, shard, slot``; old columns of these names are replaced.

    ``dimensions`` are numeric or string columns; ``tie`` orders rows of the same cell. The rows are
    stored once, with their places, as they are counted before they are numbered.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("hilbert", "shard", "slot")])
    kept = docs.columns
    placed = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.struct(*[t.alias(f"t{i}") for i, t in enumerate(tie)]).alias("_tie"),
        F.array(*cells(docs, dimensions, bits)).alias("_codes"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("_at"),
    )
    placed = placed.withColumn("hilbert", hilbert_index([F.col("_codes")[i] for i in range(len(dimensions))], bits))
    placed = materialise(placed.drop("_codes"))
    total = placed.count()
    buckets = min(max(1, -(-total // ROWS_PER_BUCKET)), MAX_BUCKETS)
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("_tie"), F.lit(buckets)))
    # a bucket over a thousandth of all rows and well over its share (fewer than a thousand) holds many equal rows,
    # which are numbered in salted parts; equal rows are alike, so the result does not depend on the salt
    most = max(total // 1000, 8 * ROWS_PER_BUCKET)
    hot = placed.groupBy("hilbert", "_bucket").count().filter(F.col("count") > most).select("hilbert", "_bucket", F.lit(True).alias("_hot"))
    placed = placed.join(F.broadcast(hot), ["hilbert", "_bucket"], "left")
    part = {"_equal": F.xxhash64(F.lit(42), "_tie"), "_salt": F.col("_at")}
    placed = placed.withColumns({c: F.when(F.col("_hot"), v).otherwise(F.lit(0)) for c, v in part.items()})
    unit = ["hilbert", "_bucket", "_equal", "_salt"]
    # first row number of each unit: cells (a fixed number) in one window, units within their cell
    sizes = placed.groupBy(*unit).agg(F.count("*").alias("_n"))
    by_cell = sizes.groupBy("hilbert").agg(F.sum("_n").alias("_n"))
    before = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    by_cell = by_cell.select("hilbert", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_cell"))
    inside = Window.partitionBy("hilbert").orderBy(*unit[1:]).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(by_cell, "hilbert")
    starts = starts.select(*unit, (F.col("_cell") + F.col("_inside")).alias("_start"))
    ranked = placed.withColumn("_row", F.row_number().over(Window.partitionBy(*unit).orderBy("_tie")))
    rank = (F.col("_start") + F.col("_row") - 1).alias("_rank")
    ranked = ranked.join(starts, unit).select(*[F.col(f"`{c}`") for c in kept], "hilbert", rank)
    small, more = total // shards, total % shards
    border = more * (small + 1)  # the first `more` shards have one row more
    r = F.col("_rank")
    in_large = r < border
    shard = F.when(in_large, F.expr(f"_rank div {small + 1}")).otherwise(F.expr(f"{more} + (_rank - {border}) div {max(small, 1)}"))
    slot = F.when(in_large, r % (small + 1)).otherwise((r - border) % max(small, 1))
    return ranked.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")}).drop("_rank")


def sharding_query(docs: DataFrame, shards: int = 8) -> DataFrame:
    """All documents in shards by source, language and size."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.coalesce(F.crc32(F.encode("text", "utf-8")), F.lit(0).cast("long"))
    rows = materialise(docs.select("doc_id", "source", "lang", size.alias("size"), crc.alias("text_crc32")))
    placed = hilbert_shards(
        rows,
        [F.col("source"), F.col("lang"), F.col("size")],
        [F.col("doc_id"), F.col("text_crc32"), F.col("size")],
        shards,
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )
