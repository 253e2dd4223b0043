"""Table layouts the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# The catalog's columns in their order.
CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("assessment_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("test_type", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("duration_min", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("tags", T.StringType()),
    ]
)
CATALOG_COLUMNS = CATALOG_SCHEMA.fieldNames()

PAIRS_SCHEMA = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("relevant_url", T.StringType()),
    ]
)

# Names under which a query file may keep its text.
QUERY_COLUMN_NAMES = ("query", "queries", "jd", "job_description", "text")

# Columns of the result view, in order, with the names shown to people.
VIEW_COLUMNS = {
    "title": "Assessment",
    "url": "URL",
    "test_type": "Type",
    "level": "Level",
    "language": "Language",
    "duration_min": "Duration (min)",
    "similarity": "Similarity",
    "description": "Description",
}
