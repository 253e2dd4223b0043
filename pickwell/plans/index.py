"""The index: catalog rows, their documents' vectors, and the encoder's name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pickwell.functions.text import document
from pickwell.functions.vectors import HashEncoder
from pickwell.functions.strings import strip
from pickwell.operators.dedup import fill_missing, keep_first
from pickwell.schemas import CATALOG_COLUMNS


def _id_reason(column: str, kind: T.DataType):
    missing = F.when(F.col(column).isNull(), "no id")
    return missing.when(strip(F.col(column)) == "", "empty id") if isinstance(kind, T.StringType) else missing


def index_rejects(catalog: DataFrame, item_id: str = "url") -> DataFrame:
    """The catalog rows that cannot be indexed for want of an id, with the reason."""
    reason = _id_reason(item_id, catalog.schema[item_id].dataType)
    return catalog.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def index_documents(catalog: DataFrame, item_id: str = "url") -> DataFrame:
    """``item_id``, the catalog columns and ``doc``, the text an item is found by.

    Ids are unique and there: rows without one are left out (``index_rejects`` lists
    them), and of rows with the same id the first in the order of their columns
    stays, so a hit joins with one row.
    """
    usable = catalog.filter(_id_reason(item_id, catalog.schema[item_id].dataType).isNull())
    order = [F.col(f"`{c}`").asc_nulls_last() for c, kind in usable.dtypes if c != item_id and not kind.startswith(("map", "variant"))]
    df = fill_missing(keep_first(usable, [item_id], order or [item_id])).withColumn("doc", document())
    return df.select(F.col(item_id).alias("item_id"), *CATALOG_COLUMNS, "doc")


def encoded(documents: DataFrame, encoder) -> DataFrame:
    """``embedding`` in place of ``doc``.

    The encoder's name and width ride along as column metadata, which Parquet
    keeps, so a search with another encoder is refused instead of answered wrongly.
    """
    other = [c for c in documents.columns if c != "doc"]
    vector = encoder(F.col("doc")).alias("embedding", metadata={"encoder": encoder.name, "dim": encoder.dim})
    return documents.select(*other, vector)


def build_index(catalog: DataFrame, encoder=HashEncoder(), item_id: str = "url") -> DataFrame:
    """``item_id``, the catalog columns and ``embedding`` of every item that ``index_documents`` gives."""
    return encoded(index_documents(catalog, item_id), encoder)


def require_encoder(index: DataFrame, encoder) -> None:
    made_by = index.schema["embedding"].metadata
    if made_by and made_by.get("encoder") not in (None, encoder.name):
        raise ValueError(f"index was built by encoder {made_by['encoder']!r}, queries use {encoder.name!r}")
