"""Readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwell.operators.dedup import conform
from pickwell.schemas import CATALOG_COLUMNS, CATALOG_SCHEMA, QUERY_COLUMN_NAMES

_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by name; fields may hold quotes and line breaks."""
    return spark.read.options(**_CSV).csv(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog CSV, columns matched by name; an empty one is an error."""
    raw = _read_csv(spark, path)
    if "duration_min" in raw.columns:
        # other tools write whole numbers with gaps as 30.0
        raw = raw.withColumn("duration_min", F.col("duration_min").try_cast("double").cast("int"))
    df = conform(raw.select(*(c for c in CATALOG_COLUMNS if c in raw.columns)), CATALOG_SCHEMA)
    if df.isEmpty():
        raise ValueError(f"catalog is empty: {path}")
    return df


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs CSV with the columns ``query`` and ``relevant_url``."""
    df = _read_csv(spark, path)
    lacking = {"query", "relevant_url"} - set(df.columns)
    if lacking:
        raise ValueError(f"labelled pairs lack the columns {sorted(lacking)}: {path}")
    return df


def query_column(df: DataFrame) -> str:
    """First column that may hold query text, by its trimmed lower-case name."""
    for name in df.columns:
        if name.strip().lower() in QUERY_COLUMN_NAMES:
            return name
    raise ValueError(f"the text must be in a column named {' or '.join(QUERY_COLUMN_NAMES)}, but the file has {df.columns}")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query CSV as one column ``query``, whatever the file calls it."""
    df = _read_csv(spark, path)
    return df.select(F.col(f"`{query_column(df)}`").alias("query"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Items, catalog columns and vectors as written by ``write_index``."""
    return spark.read.parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    """Catalog columns and vectors in one table: a reader of either prunes the other."""
    index.write.mode("overwrite").parquet(path)


def write_metadata(catalog: DataFrame, path: str) -> None:
    """Only the catalog columns, as Parquet."""
    conform(catalog).write.mode("overwrite").parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Catalog columns written by ``write_metadata``."""
    return conform(spark.read.parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    """Texts keep the blanks at their ends, which the writer drops unless told."""
    blanks = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.mode("overwrite").options(header="true", quote='"', escape='"', encoding="UTF-8", **blanks).csv(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    write_csv(conform(catalog), path)


def write_merged_catalog(catalog: DataFrame, added: DataFrame, path: str) -> bool:
    """Write the merge unless there is nothing to add; tells whether it wrote."""
    from pickwell.plans.catalog import merge_catalogs

    if added.isEmpty():
        return False
    write_catalog(merge_catalogs(catalog, added), path)
    return True


def write_result_view(view: DataFrame, path: str) -> None:
    """The rows people see, under their display names."""
    write_csv(view, path)


def write_batch_export(rows: DataFrame, path: str) -> None:
    """Result pairs of a query file; the header is written even without rows."""
    write_csv(rows.select("Query", "Assessment_url"), path)
