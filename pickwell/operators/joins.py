"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwell.operators.topk import Hits
from pickwell.session import materialise

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
FILTER_BITS = 1 << 24  # 262,144 rows of 16 bytes at most


def _bytes(df: DataFrame, *columns: str) -> int:
    """Measured size of the columns, with an allowance for each row."""
    lengths = [F.octet_length(F.col(c).cast("string")) for c in columns]
    return df.agg(F.sum(sum(lengths, F.lit(32)))).first()[0] or 0


def restrict_to(wide: DataFrame, wanted: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``wide`` whose key may be wanted: all that are, and few others, without shuffling ``wide``.

    The wanted keys are marked in an array of ``bits`` bits, kept as at most
    ``bits / 64`` rows and broadcast; its size does not depend on the number of
    keys, so the plan is always the same. The more keys there are, the more other
    rows pass, and the caller's own join drops them. NULL keys are not wanted.
    """
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(63).cast("int")
    mark = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    marks = wanted.filter(F.col(key).isNotNull()).select(word.alias("_word"), mark.alias("_mark"))
    marks = marks.groupBy("_word").agg(F.bit_or("_mark").alias("_marks"))
    held = F.call_function("shiftright", F.col("_marks"), bit).bitwiseAND(1) == 1
    return wide.filter(F.col(key).isNotNull()).join(F.broadcast(marks), (word == F.col("_word")) & held, "left_semi")


def salted_join(many: DataFrame, one: DataFrame, key: str, spread_by: str, salts: int = 200) -> DataFrame:
    """Inner join of ``many`` with ``one`` (unique on ``key``), frequent keys salted.

    A key is frequent if it holds over a thousandth of ``many``; there are fewer
    than a thousand such keys whatever the data, so their list is broadcast.
    Frequent rows of ``one`` are copied ``salts`` times, all others stay single.
    ``many`` is read twice: pass a materialised table.
    """
    counts = many.groupBy(key).count()
    total = many.count()
    hot = counts.filter(F.col("count") * 1000 > total).select(key, F.lit(True).alias("_hot"))
    salted = many.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts))).otherwise(F.lit(0).cast("bigint"))
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).otherwise(
        F.array(F.lit(0).cast("bigint"))
    )
    spread = one.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(copies))
    return salted.drop("_hot").join(spread.drop("_hot"), [key, "_salt"]).drop("_salt")


def gather_items(hits: Hits, items: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hits with the columns of their items, joined only after the top-k cut.

    Hits small enough travel to the item table, which is then read once without
    a shuffle: at once if a bound of their size is known, else after they were
    stored and measured. Above the limit both sides are shuffled, frequent items salted.
    """
    if hits.max_bytes is not None and hits.max_bytes <= max_broadcast_bytes:
        return items.join(F.broadcast(hits.df), "item_id")
    rows = hits.df if hits.stored else materialise(hits.df)
    if _bytes(rows, "qid", "item_id") <= max_broadcast_bytes:
        return items.join(F.broadcast(rows), "item_id")
    return salted_join(rows, items, "item_id", spread_by="qid")
