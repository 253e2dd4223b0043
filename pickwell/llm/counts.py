"""The most frequent keys of a table of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT = 4096


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """Rows with the highest counts, all of a count or none, at most ``most`` of them.

    The border is read off a histogram of a few thousand levels, so no task sorts or
    reads all rows. Counts above ``EXACT`` share levels by their size in bits.
    """
    level = F.when(F.col(n) <= EXACT, F.col(n)).otherwise(EXACT + F.length(F.bin(n))).cast("long")
    found = sorted(((r["level"], r["rows"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    border, total = None, 0
    for value, rows in found:
        total += rows
        if total > most:
            break
        border = value
    return counts.limit(0) if border is None else counts.filter(level >= border)
