"""Keep-first de-duplication and column conformance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pickwell.schemas import CATALOG_SCHEMA


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first in ``order``, which must break all ties.

    ``row_number = 1`` plans as a group limit before the exchange, so a key held
    by a third of all rows sends one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def conform(df: DataFrame, schema: T.StructType = CATALOG_SCHEMA, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the columns of ``schema`` in its order; missing ones become NULL."""
    present = set(df.columns)
    columns = [
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ]
    return df.select(*keep, *columns)


def fill_missing(df: DataFrame, columns: Sequence[str] = CATALOG_SCHEMA.fieldNames()) -> DataFrame:
    """Add each expected column the table lacks, filled with ``''``."""
    return df.withColumns({c: F.lit("") for c in columns if c not in df.columns})
